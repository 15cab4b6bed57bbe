"""Sparse contact matrices as tables of cells: resolution, chrom1, bin1, chrom2, bin2, cnt.

A missing cell counts 0. Only one of the two mirror cells is stored: (chrom1, bin1) <= (chrom2, bin2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.session import cut

CELL = ["resolution", "chrom1", "bin1", "chrom2", "bin2"]


def upper(pixels: DataFrame) -> DataFrame:
    """Each cell once, in the upper triangle.

    Repeated rows count once; different rows of one cell, mirrored ones included, add up. Rows with a
    null coordinate or count are left out.
    """
    swap = (F.col("chrom1") > F.col("chrom2")) | ((F.col("chrom1") == F.col("chrom2")) & (F.col("bin1") > F.col("bin2")))
    turned = [
        "resolution",
        *(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("chrom1", "chrom2"), ("bin1", "bin2"))),
        *(F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("chrom1", "chrom2"), ("bin1", "bin2"))),
        "cnt",
        swap.alias("_swap"),
    ]
    # one shuffle by cell serves both the distinct rows and the sums
    rows = pixels.dropna(subset=[*CELL, "cnt"]).select(*turned).repartition(*CELL).distinct()
    return rows.groupBy(*CELL).agg(F.sum("cnt").alias("cnt"))


def sizes(chrom_sizes: DataFrame) -> DataFrame:
    """(chrom, length): each contig once, with its greatest length; rows with a null are left out."""
    return chrom_sizes.dropna(subset=["chrom", "length"]).groupBy("chrom").agg(F.max("length").alias("length"))


def symmetrised(pixels: DataFrame) -> DataFrame:
    """Both mirror cells of every cell; those on the diagonal once."""
    off = (F.col("chrom1") != F.col("chrom2")) | (F.col("bin1") != F.col("bin2"))
    mirror = pixels.where(off).select(
        "resolution", F.col("chrom2").alias("chrom1"), F.col("bin2").alias("bin1"),
        F.col("chrom1").alias("chrom2"), F.col("bin1").alias("bin2"), "cnt",
    )
    return pixels.select(*CELL, "cnt").union(mirror)


def coarsened(pixels: DataFrame, factor: int) -> DataFrame:
    """The matrix with bins `factor` times as long; the sum of all counts stays the same."""
    return (
        pixels.select(
            (F.col("resolution") * factor).alias("resolution"), "chrom1", F.expr(f"bin1 div {factor}").cast("int").alias("bin1"),
            "chrom2", F.expr(f"bin2 div {factor}").cast("int").alias("bin2"), "cnt",
        )
        .groupBy(*CELL).agg(F.sum("cnt").alias("cnt"))
    )


def binned(pairs: DataFrame, resolutions: list[int]) -> DataFrame:
    """Contact counts of read pairs (chrom1, pos1, chrom2, pos2) at several resolutions, as upper cells.

    With a column `flag`, pairs marked as duplicates (1024) are left out. The finest counts are made
    once; a coarser resolution that is a multiple of the finest is summed from them.
    """
    if "flag" in pairs.columns:
        pairs = pairs.where(F.coalesce("flag", F.lit(0)).bitwiseAND(F.lit(1024)) == 0)
    fine = min(resolutions)
    base = upper(
        pairs.dropna(subset=["chrom1", "pos1", "chrom2", "pos2"])
        .select(
            F.lit(fine).alias("resolution"), "chrom1", F.expr(f"pos1 div {fine}").cast("int").alias("bin1"),
            "chrom2", F.expr(f"pos2 div {fine}").cast("int").alias("bin2"),
        )
        .groupBy(*CELL).agg(F.count(F.lit(1)).alias("cnt"))
    )
    made = [base]
    for resolution in sorted(set(resolutions) - {fine}):
        if resolution % fine:
            raise ValueError(f"{resolution} is no multiple of {fine}")
        made.append(coarsened(base, resolution // fine))
    out = made[0]
    for part in made[1:]:
        out = out.union(part)
    return out


def mates(reads: DataFrame, flag: str = "flag") -> DataFrame:
    """Adds mate, 1 or 2, by the bits 64 and 128 of the alignment flag; reads with neither are left out."""
    first, second = (F.col(flag).bitwiseAND(F.lit(bit)) != 0 for bit in (64, 128))
    return reads.withColumn("mate", F.when(first, 1).when(second, 2)).where(F.col("mate").isNotNull())


def region(pixels: DataFrame, resolution: int, chrom: str, start: int, end: int) -> DataFrame:
    """The cells of one contig with both bins in [start, end)."""
    inside = [(F.col(b) >= start) & (F.col(b) < end) for b in ("bin1", "bin2")]
    return pixels.where((F.col("resolution") == resolution) & (F.col("chrom1") == chrom) & (F.col("chrom2") == chrom) & inside[0] & inside[1])


def band(pixels: DataFrame, half: int) -> DataFrame:
    """Cells of one contig at most `half` off the diagonal."""
    return pixels.where((F.col("chrom1") == F.col("chrom2")) & (F.abs(F.col("bin1") - F.col("bin2")) <= half))


def diagonal_quantile(cells: DataFrame, chrom_sizes: DataFrame, half: int = 10, q: float = 0.95) -> DataFrame:
    """(resolution, quantile): the q-quantile of all entries at most `half` off the diagonals of all contigs.

    Zeros count, and off-diagonal entries count on both sides. With n bins (rounded up) a contig has
    n + 2 * sum of max(n - k, 0) for k = 1..half such entries; what has no cell is 0. Resolutions
    without any cell near a diagonal are missing.
    """
    # one row per resolution and count; read three times below
    counted = cut(
        band(cells, half)
        .groupBy("resolution", F.col("cnt").cast("double").alias("v"))
        .agg(F.sum(F.when(F.col("bin1") == F.col("bin2"), 1).otherwise(2)).alias("n"))
    )
    n = F.expr("cast((length + resolution - 1) div resolution as bigint)")
    entries = F.col("n") + 2 * (F.least(F.col("n") - 1, F.lit(half)) * F.col("n") - F.expr(f"least(n - 1, {half}) * (least(n - 1, {half}) + 1) div 2"))
    # a matrix has a handful of resolutions, so those that have cells near the diagonal come as one row
    listed = counted.agg(F.collect_set("resolution").alias("_r"))
    every = sizes(chrom_sizes).select("length").crossJoin(F.broadcast(listed)).select("length", F.explode("_r").alias("resolution"))
    total = every.withColumn("n", n).where("n > 0").groupBy("resolution").agg(F.sum(entries).alias("all"))
    seen = counted.groupBy("resolution").agg(F.sum("n").alias("seen"))
    zeros = total.join(seen, "resolution", "left").select(
        "resolution", F.lit(0.0).alias("v"), F.greatest(F.col("all") - F.coalesce("seen", F.lit(0)), F.lit(0)).alias("n")
    )
    return counted.union(zeros.where("n > 0")).groupBy("resolution").agg(F.percentile("v", q, F.col("n")).alias("quantile"))


def nonzero_quantile(cells: DataFrame, q: float = 0.999) -> DataFrame:
    """(resolution, quantile): the q-quantile of the positive entries within contigs; mirrored ones count twice."""
    return (
        cells.where((F.col("chrom1") == F.col("chrom2")) & (F.col("cnt") > 0))
        .groupBy("resolution", F.col("cnt").cast("double").alias("v"))
        .agg(F.sum(F.when(F.col("bin1") == F.col("bin2"), 1).otherwise(2)).alias("n"))
        .groupBy("resolution").agg(F.percentile("v", q, F.col("n")).alias("quantile"))
    )


def whole_stats(cells: DataFrame, log: bool = True) -> DataFrame:
    """(resolution, mean, std, least, greatest): of the positive entries within contigs, and of their z-scores."""
    v = F.log1p(F.col("cnt").cast("double")) if log else F.col("cnt").cast("double")
    within = cells.where((F.col("chrom1") == F.col("chrom2")) & (F.col("cnt") > 0)).select("resolution", v.alias("v"))
    found = within.groupBy("resolution").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("_l"), F.max("v").alias("_g")
    )
    return found.select(
        "resolution", "mean", "std",
        F.try_divide(F.col("_l") - F.col("mean"), F.col("std")).alias("least"),
        F.try_divide(F.col("_g") - F.col("mean"), F.col("std")).alias("greatest"),
    )


def block_sums(cells: DataFrame, block: int) -> DataFrame:
    """(resolution, chrom1, chrom2, block1, block2, total): sums over blocks of block x block bins."""
    return cells.groupBy(
        "resolution", "chrom1", "chrom2", F.expr(f"bin1 div {block}").alias("block1"), F.expr(f"bin2 div {block}").alias("block2")
    ).agg(F.sum("cnt").alias("total"))


def hotspots(cells: DataFrame, block: int = 1000, size: int = 100, stride: int = 125) -> DataFrame:
    """(resolution, chrom1, chrom2, block1, block2, sub1, sub2, total): where two contigs touch most.

    Of all blocks of a pair those with at least half the sum of the strongest are kept; in each of them
    the size x size window at multiples of stride with the largest sum, the first in row order if equal.
    """
    pair = ["resolution", "chrom1", "chrom2"]
    between = cells.where(F.col("chrom1") != F.col("chrom2"))
    totals = block_sums(between, block)
    strongest = totals.groupBy(*pair).agg(F.max("total").alias("most"))
    kept = totals.join(strongest, pair).where(F.col("total") * 2 >= F.col("most")).select(*pair, "block1", "block2")
    inside = between.select(
        *pair, F.expr(f"bin1 div {block}").alias("block1"), F.expr(f"bin2 div {block}").alias("block2"),
        F.expr(f"bin1 % {block}").alias("i"), F.expr(f"bin2 % {block}").alias("j"), "cnt",
    )
    windows = (
        inside.where((F.col("i") % stride < size) & (F.col("j") % stride < size))
        .join(kept, [*pair, "block1", "block2"])
        .groupBy(*pair, "block1", "block2", F.expr(f"i div {stride}").alias("sub1"), F.expr(f"j div {stride}").alias("sub2"))
        .agg(F.sum("cnt").alias("total"))
    )
    first = Window.partitionBy(*pair, "block1", "block2").orderBy(F.desc("total"), "sub1", "sub2")
    return windows.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


def rescaled(bins: Column, from_resolution: Column | int, to_resolution: int) -> Column:
    """A bin of one resolution as the bin of another that holds its start."""
    start = bins.cast("long") * (F.lit(from_resolution) if isinstance(from_resolution, int) else from_resolution)
    return F.floor(start / F.lit(to_resolution)).cast("long")


def contigs(cells: DataFrame) -> DataFrame:
    """(chrom): all contigs with a contact."""
    return cells.select(F.col("chrom1").alias("chrom")).union(cells.select("chrom2")).distinct()
