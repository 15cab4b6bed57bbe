"""Images along the diagonal: every window of 2S x 2S bins around a position of a contig."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions.images import both_mirrors, dense, sorted_cells
from contactloom.operators import contacts
from contactloom.operators.ranking import spread, with_running

WINDOW = ["resolution", "chrom", "pos"]


def positions(cells: DataFrame, chrom_sizes: DataFrame, half: int = 10) -> DataFrame:
    """Each cell near the diagonal with every window position it belongs to.

    A cell belongs to pos if both bins are in [pos - S, pos + S - 1], and pos runs from S to n - S with
    n whole bins. The positions of a cell follow from its bins, so nothing is joined but the length.
    """
    near = contacts.band(cells, 2 * half - 1).select(
        "resolution", F.col("chrom1").alias("chrom"), F.col("bin1").alias("lo"), F.col("bin2").alias("hi"), "cnt"
    )
    ranged = near.join(contacts.sizes(chrom_sizes), "chrom").withColumns({
        "_from": F.greatest(F.col("hi") - (half - 1), F.lit(half)).cast("long"),
        "_to": F.least(F.col("lo") + half, F.expr(f"length div resolution - {half}")).cast("long"),
    }).where("_from <= _to")
    return ranged.select("resolution", "chrom", F.explode(F.sequence("_from", "_to")).alias("pos"), "lo", "hi", "cnt")


def spans(chrom_sizes: DataFrame, resolutions: DataFrame, half: int = 10) -> DataFrame:
    """(resolution, chrom, first, last): the positions S to n - S of each contig that has any, with contacts or without."""
    ranged = contacts.sizes(chrom_sizes).crossJoin(F.broadcast(resolutions.select("resolution").distinct()))
    last = F.expr(f"length div resolution - {half}")
    return ranged.select("resolution", "chrom", F.lit(half).cast("long").alias("first"), last.alias("last")).where("first <= last")


def every_position(chrom_sizes: DataFrame, resolutions: DataFrame, half: int = 10) -> DataFrame:
    """(resolution, chrom, pos): all positions of spans; their number follows the lengths, not the contacts."""
    return spread(spans(chrom_sizes, resolutions, half), F.col("first"), F.col("last"), 1, "pos").select(*WINDOW)


def window_sum_runs(cells: DataFrame, chrom_sizes: DataFrame, half: int = 10, width: int = 100_000) -> DataFrame:
    """(resolution, chrom, first, last, total): the sum of every window, as runs of positions with equal sums; mirrored cells count twice.

    All positions S to n - S are covered, with contacts or without. A cell adds to the sums from one
    position on and takes its count away after another, so it makes two rows, and the sums are running
    totals of these. They run in buckets of `width` positions, so no contig comes together in one task.
    """
    near = contacts.band(cells, 2 * half - 1).join(contacts.sizes(chrom_sizes), F.col("chrom1") == F.col("chrom"))
    ranged = near.select(
        "resolution", "chrom", F.greatest(F.col("bin2") - (half - 1), F.lit(half)).cast("long").alias("_from"),
        F.least(F.col("bin1") + half, F.expr(f"length div resolution - {half}")).cast("long").alias("_to"),
        F.when(F.col("bin1") == F.col("bin2"), F.col("cnt")).otherwise(2 * F.col("cnt")).alias("_v"),
    ).where("_from <= _to")
    change = lambda at, v: F.struct(at.alias("first"), v.alias("_v"))
    steps = ranged.select("resolution", "chrom", F.explode(F.array(change(F.col("_from"), F.col("_v")), change(F.col("_to") + 1, -F.col("_v")))).alias("_c")).select("resolution", "chrom", "_c.*")
    # the ends of a contig change nothing, but a run begins and ends there
    limits = spans(chrom_sizes, cells, half)
    bounds = limits.select("resolution", "chrom", F.explode(F.array("first", F.col("last") + 1)).alias("first"), F.lit(0).cast("long").alias("_v"))
    every = steps.withColumn("_end", F.lit(False)).union(bounds.withColumn("_end", F.lit(True)))
    changes = every.groupBy("resolution", "chrom", "first").agg(F.sum("_v").alias("_v"), F.max("_end").alias("_end")).where("_v <> 0 or _end").drop("_end")
    contig = ["resolution", "chrom"]
    placed = changes.withColumn("_b", F.expr(f"first div {width}"))
    totals = with_running(placed, contig, "_b", [F.col("first")], F.col("_v"), "total")
    # a run ends before the next change, which may lie in a later bucket
    inside = Window.partitionBy(*contig, "_b").orderBy("first")
    begins = placed.groupBy(*contig, "_b").agg(F.min("first").alias("_begin"))
    following = begins.select(*contig, "_b", F.lead("_begin").over(Window.partitionBy(*contig).orderBy("_b")).alias("_after"))
    known = totals.join(following, [*contig, "_b"]).withColumn("last", F.coalesce(F.lead("first").over(inside), F.col("_after")) - 1)
    return known.where("last is not null").select(*contig, "first", "last", "total")


def window_sums(cells: DataFrame, chrom_sizes: DataFrame, half: int = 10, least: int = 1) -> DataFrame:
    """(resolution, chrom, pos, total): the sum of each window with at least `least`; mirrored cells count twice.

    With `least` 0 or below, windows without contacts are listed too, at all resolutions of cells; their
    number follows the lengths (see window_sum_runs).
    """
    runs = window_sum_runs(cells, chrom_sizes, half).where(F.col("total") >= least)
    return spread(runs, F.col("first"), F.col("last"), 1, "pos").select(*WINDOW, "total")


def window_cells(cells: DataFrame, chrom_sizes: DataFrame, half: int = 10) -> DataFrame:
    """(resolution, chrom, pos, r, c, cnt): the cells of each window, both mirror cells; corner C2."""
    at = positions(cells, chrom_sizes, half)
    base = F.col("pos") - half
    at = at.select(*WINDOW, (F.col("lo") - base).alias("r"), (F.col("hi") - base).alias("c"), "cnt")
    return at.select(*WINDOW, F.explode(both_mirrors("r", "c")).alias("_at"), "cnt").select(*WINDOW, "_at.r", "_at.c", "cnt")


def rotated(window: DataFrame, half: int = 10) -> DataFrame:
    """Window cells turned by 180 degrees: corner C3."""
    last = 2 * half - 1
    return window.withColumns({"r": F.lit(last) - F.col("r"), "c": F.lit(last) - F.col("c")})


def with_contacts(cells: DataFrame, chrom_sizes: DataFrame, half: int = 10, least: int = 1) -> DataFrame:
    """(resolution, chrom, pos): the windows that images has for the same `least`, told by their sums alone."""
    both = F.when(F.col("lo") == F.col("hi"), F.col("cnt")).otherwise(2 * F.col("cnt"))
    totals = positions(cells, chrom_sizes, half).groupBy(*WINDOW).agg(F.sum(both).alias("_total"))
    return (totals.where(F.col("_total") >= least) if least > 1 else totals).select(*WINDOW)


def images(window: DataFrame, half: int = 10, key: list[str] | None = None, every: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(key, x): dense images of window cells, row by row, missing cells 0. A window holds 4 S^2 cells at most.

    Windows without cells have an image only if `every` (key; see every_position) lists them. With
    `least` beyond 1 only windows whose cells add up to that much have one.
    """
    side = 2 * half
    cells = window.groupBy(*(key or WINDOW)).agg(sorted_cells(F.col("r") * side + F.col("c"), F.col("cnt")).alias("_cells"), F.sum("cnt").alias("_total"))
    if least > 1:
        cells = cells.where(F.col("_total") >= least)
    made = cells.select(*(key or WINDOW), dense("_cells", side * side).alias("x"))
    if every is None:
        return made
    blank = F.array_repeat(F.lit(0), side * side).cast(made.schema["x"].dataType)
    return every.join(made, key or WINDOW, "left").withColumn("x", F.coalesce("x", blank))


def labelled(windows: DataFrame, breakpoints: DataFrame, half: int = 10, tolerance: int = 7) -> DataFrame:
    """Adds y to (chrom, pos) rows: 0 if a breakpoint of the contig is in view, else 1.

    breakpoints is (chrom, bin). In view is |bin - pos| <= S - tolerance; each breakpoint lists the few
    positions it reaches, so windows meet it by an equi-join.
    """
    reach = half - tolerance
    seen = (
        breakpoints.dropna().select("chrom", F.explode(F.sequence((F.col("bin") - reach).cast("long"), (F.col("bin") + reach).cast("long"))).alias("pos"))
        .distinct().withColumn("_cut", F.lit(True))
    )
    return windows.join(seen, ["chrom", "pos"], "left").withColumn("y", F.when(F.col("_cut"), 0).otherwise(1)).drop("_cut")
