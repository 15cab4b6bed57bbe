"""Fragments, their ends, and images of pairs of ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions import names
from contactloom.functions.images import both_mirrors, dense, sorted_cells
from contactloom.operators import contacts
from contactloom.operators.pairing import paired
from contactloom.operators.ranking import spread
from contactloom.session import cut


def parsed_fragments(lines: DataFrame, column: str = "line") -> DataFrame:
    """(chrom, start, end, name) of fragment names chrom:start-end; lines that do not fit are left out (see rejected)."""
    part = names.fragment(F.col(column))
    return lines.select(part.alias("_f"), F.col(column).alias("name")).where("_f is not null").select("_f.*", "name")


def rejected(lines: DataFrame, column: str = "line") -> DataFrame:
    """The lines that parsed_fragments leaves out."""
    return lines.where(names.fragment(F.col(column)).isNull())


def large_enough(fragments: DataFrame, resolution: int, least_bins: int = 4) -> DataFrame:
    """Fragments (chrom, start, end in bp) of at least so many bins, with bin0 and bin1."""
    binned = fragments.withColumns({"bin0": F.expr(f"start div {resolution}"), "bin1": F.expr(f"end div {resolution}")})
    return binned.where(F.col("bin1") - F.col("bin0") >= least_bins)


def with_unseen(fragments: DataFrame, chrom_sizes: DataFrame, resolution: int, least_bins: int = 4) -> DataFrame:
    """(chrom, bin0, bin1): the large enough fragments, and whole contigs that no fragment mentions."""
    kept = large_enough(fragments, resolution, least_bins).select("chrom", "bin0", "bin1")
    unseen = contacts.sizes(chrom_sizes).join(fragments.select("chrom").distinct(), "chrom", "left_anti")
    whole = unseen.select("chrom", F.lit(0).cast("long").alias("bin0"), F.expr(f"length div {resolution}").alias("bin1"))
    return kept.union(whole.where(F.col("bin1") >= least_bins))


def sub_positions(chrom_sizes: DataFrame, resolution: int, steps: int) -> DataFrame:
    """(chrom, bin0, bin1): pieces of `steps` bins of each contig; the last incomplete one is dropped."""
    whole = contacts.sizes(chrom_sizes).withColumn("_n", F.expr(f"length div {resolution}"))
    pieces = spread(whole, F.lit(0), F.col("_n") - steps, steps, "bin0")
    return pieces.select("chrom", "bin0", (F.col("bin0") + steps).alias("bin1"))


def contiguous(a0: Column, a1: Column, b0: Column, b1: Column, same_chrom: Column) -> Column:
    """Whether two fragments of one contig touch."""
    return same_chrom & ((b0 == a1) | (a0 == b1))


def noncontiguous_pairs(chrom_sizes: DataFrame, resolution: int, steps: int) -> DataFrame:
    """(chrom, a0, a1, b0, b1): all pairs of pieces (see sub_positions) of one contig that do not touch, a0 < b0.

    The pieces that do not touch a piece begin one piece beyond its end, so they are listed for each piece
    without a join; the first pieces are dealt out to all tasks. The pairs grow with the square of a contig's length.
    """
    whole = contacts.sizes(chrom_sizes).select("chrom", (F.expr(f"length div {resolution}") - steps).alias("_end"))
    first = spread(whole, F.lit(0), F.col("_end") - 2 * steps, steps, "a0", width=50)
    beyond = F.sequence(F.col("a0") + 2 * steps, F.col("_end"), F.lit(steps).cast("long"))
    pairs = first.select("chrom", "a0", (F.col("a0") + steps).alias("a1"), F.explode(beyond).alias("b0"))
    return pairs.withColumn("b1", F.col("b0") + steps)


def touching_pairs(cells: DataFrame) -> DataFrame:
    """(resolution, chrom1, chrom2, contacts): pairs of different contigs that have contacts at all.

    Pairs without any are not listed: their images are empty, and their number grows with the square
    of the contigs.
    """
    return (
        cells.where((F.col("chrom1") != F.col("chrom2")) & (F.col("cnt") > 0))
        .groupBy("resolution", "chrom1", "chrom2").agg(F.sum("cnt").alias("contacts"))
    )


PAIR = ["resolution", "piece1", "side1", "piece2", "side2"]


def touching_pieces(cells: DataFrame, steps: int) -> DataFrame:
    """(resolution, chrom1, a0, chrom2, b0, contacts): pairs of different pieces of `steps` bins that have contacts and are not neighbours.

    a0 and b0 are the first bins of the pieces; pieces of one contig that follow each other are left out.
    Pairs without contacts are not listed, as their number grows with the square of the lengths.
    """
    first = lambda c: (F.floor(F.col(c) / steps) * steps).cast("long")
    sums = cells.where("cnt > 0").groupBy("resolution", "chrom1", first("bin1").alias("a0"), "chrom2", first("bin2").alias("b0")).agg(F.sum("cnt").alias("contacts"))
    same = F.col("chrom1") == F.col("chrom2")
    alone = same & (F.col("a0") == F.col("b0"))
    return sums.where(~alone & ~contiguous(F.col("a0"), F.col("a0") + steps, F.col("b0"), F.col("b0") + steps, same))


def noncontiguous_ranges(chrom_sizes: DataFrame, resolution: int, steps: int) -> DataFrame:
    """(chrom, a0, b_first, b_last, pairs): of each piece (see sub_positions) the pieces further on that do not touch it, as a range.

    They begin at b_first, b_first + steps, ... b_last: the pairs of noncontiguous_pairs, as one row per piece.
    """
    whole = contacts.sizes(chrom_sizes).select("chrom", (F.expr(f"length div {resolution}") - steps).alias("_end"))
    first = spread(whole, F.lit(0), F.col("_end") - 2 * steps, steps, "a0")
    last = F.expr(f"_end div {steps} * {steps}")
    return first.select("chrom", "a0", (F.col("a0") + 2 * steps).alias("b_first"), last.alias("b_last")).withColumn(
        "pairs", F.expr(f"(b_last - b_first) div {steps} + 1")
    )


def whole_pieces(chrom_sizes: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(resolution, piece, chrom, bin0, bin1): each contig as a piece of its own, at all resolutions of a table."""
    every = contacts.sizes(chrom_sizes).crossJoin(F.broadcast(resolutions.select("resolution").distinct()))
    return every.select("resolution", F.col("chrom").alias("piece"), "chrom", F.lit(0).cast("long").alias("bin0"), F.expr("length div resolution").alias("bin1"))


def fragment_pieces(fragments: DataFrame, chrom_sizes: DataFrame, resolutions: DataFrame, least_bins: int = 4) -> DataFrame:
    """(resolution, piece, chrom, bin0, bin1): fragments (chrom, start, end) in bp, and contigs that no fragment mentions.

    A piece is called chrom:start-end, in bp as given, or chrom:0-length for a whole contig; its bins
    are those of each resolution. Pieces of fewer than least_bins bins are left out at that resolution.
    """
    given = fragments.dropna(subset=["chrom", "start", "end"]).select("chrom", "start", "end").distinct()
    unseen = contacts.sizes(chrom_sizes).join(given.select("chrom").distinct(), "chrom", "left_anti")
    every = given.union(unseen.select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end")))
    at = every.crossJoin(F.broadcast(resolutions.select("resolution").distinct()))
    binned = at.withColumns({"bin0": F.expr("start div resolution"), "bin1": F.expr("end div resolution"), "piece": F.format_string("%s:%d-%d", "chrom", "start", "end")})
    return binned.where(F.col("bin1") - F.col("bin0") >= least_bins).select("resolution", "piece", "chrom", "bin0", "bin1")


def named_pieces(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds name to pieces in bins (chrom, bin0, bin1, resolution, length): the line chrom:start-end that has these bins, else one made of them.

    A made name ends with the contig's length where the piece ends with its last whole bin.
    """
    part = names.fragment(F.col("line"))
    known = lines.select(part.alias("_f"), "line").where("_f is not null").select("_f.*", "line")
    at = known.join(F.broadcast(pieces.select("resolution").distinct())).select(
        "resolution", "chrom", F.expr("start div resolution").alias("bin0"), F.expr("end div resolution").alias("bin1"), "line"
    ).groupBy("resolution", "chrom", "bin0", "bin1").agg(F.min("line").alias("_line"))
    end = F.when(F.expr("length div resolution") == F.col("bin1"), F.col("length")).otherwise(F.col("bin1") * F.col("resolution"))
    made = F.format_string("%s:%d-%d", "chrom", F.col("bin0") * F.col("resolution"), end.cast("long"))
    return pieces.join(at, ["resolution", "chrom", "bin0", "bin1"], "left").withColumn("name", F.coalesce("_line", made)).drop("_line")


def end_bins(pieces: DataFrame, half: int = 10) -> DataFrame:
    """(resolution, chrom, bin, piece, side, d): the bins at most `half` from an end of each piece; side 0 is the start, 1 the end."""
    size = F.least(F.col("bin1") - F.col("bin0"), F.lit(half))
    near = pieces.where("bin1 > bin0").withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    sides = F.array(*(F.struct(F.lit(k).alias("side"), b.alias("bin")) for k, b in ((0, F.col("bin0") + F.col("d")), (1, F.col("bin1") - 1 - F.col("d")))))
    return near.withColumn("_s", F.explode(sides)).select("resolution", "chrom", "_s.bin", "piece", "_s.side", F.col("d").cast("int").alias("d"))


def piece_pair_cells(cells: DataFrame, pieces: DataFrame, half: int = 10, least: int = 1) -> DataFrame:
    """(resolution, piece1, side1, piece2, side2, r, c, cnt): cells of the images of all pairs of ends of pieces that touch.

    pieces is (resolution, piece, chrom, bin0, bin1), bin1 excluded; pieces of one contig must not overlap.
    With d the distance of a bin from its end, the first piece has index S - 1 - d and the second S + d, so
    the contacts between both fill one block (r < S <= c) and those within each piece the two blocks on
    the diagonal. Mirror cells are not repeated (r <= c). A pair is listed for the sides between which
    there are at least `least` contacts; the smaller name comes first, the other order is this image
    turned by 180 degrees. Pairs without contacts are not listed.

    Cells meet the ends by their bins, twice; no contig, piece or end comes together in one task.
    """
    near = end_bins(pieces, half)
    side = lambda k: near.select("resolution", *(F.col(c).alias(f"{c}{k}") for c in ("chrom", "bin", "piece", "side", "d")))
    at = (
        cells.where("cnt > 0").withColumns({"bin1": F.col("bin1").cast("long"), "bin2": F.col("bin2").cast("long")})
        .join(side(1), ["resolution", "chrom1", "bin1"]).join(side(2), ["resolution", "chrom2", "bin2"])
    )
    # four parts of the result follow from these cells
    at = cut(at.select("resolution", "piece1", "side1", "d1", "piece2", "side2", "d2", "cnt"))
    turned = F.col("piece1") > F.col("piece2")
    ordered = lambda c: (F.when(turned, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}1"), F.when(turned, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}2"))
    between = at.where("piece1 <> piece2").select("resolution", *ordered("piece"), *ordered("side"), *ordered("d"), "cnt")
    pairs = between.groupBy(*PAIR).agg(F.sum("cnt").alias("_n")).where(F.col("_n") >= least).select(*PAIR)
    if least > 1:
        between = between.join(pairs, PAIR, "left_semi")
    # cells within a piece near one of its ends; an end has at most S * S of them
    within = at.where("piece1 = piece2 and side1 = side2").select(
        "resolution", F.col("piece1").alias("piece"), F.col("side1").alias("side"), F.least("d1", "d2").alias("d0"), F.greatest("d1", "d2").alias("d1"), "cnt"
    )

    def own(k: int, r: Column, c: Column) -> DataFrame:
        cells_of = within.select("resolution", F.col("piece").alias(f"piece{k}"), F.col("side").alias(f"side{k}"), r.alias("r"), c.alias("c"), "cnt")
        return paired(pairs, cells_of, ["resolution", f"piece{k}", f"side{k}"]).select(*PAIR, "r", "c", "cnt")

    first = own(1, F.lit(half - 1) - F.col("d1"), F.lit(half - 1) - F.col("d0"))
    second = own(2, F.lit(half) + F.col("d0"), F.lit(half) + F.col("d1"))
    across = between.select(*PAIR, (F.lit(half - 1) - F.col("d1")).alias("r"), (F.lit(half) + F.col("d2")).alias("c"), "cnt")
    return across.union(first).union(second)


def end_pair_cells(cells: DataFrame, chrom_sizes: DataFrame, half: int = 10) -> DataFrame:
    """(resolution, chrom1, side1, chrom2, side2, r, c, cnt): piece_pair_cells of whole contigs; those without a length are left out."""
    made = piece_pair_cells(cells, whole_pieces(chrom_sizes, cells), half)
    return made.withColumnsRenamed({"piece1": "chrom1", "piece2": "chrom2"})


def piece_pair_images(pair_cells: DataFrame, pieces: DataFrame, half: int = 10) -> DataFrame:
    """(resolution, piece1, side1, piece2, side2, name, x): dense images of piece_pair_cells.

    Cells beyond a piece shorter than S bins are -1, other missing cells 0. name is piece1:side1|piece2:side2.
    """
    side = 2 * half
    whole = pair_cells.select(*PAIR, F.explode(both_mirrors("r", "c")).alias("_at"), "cnt").select(*PAIR, "_at.r", "_at.c", "cnt")
    made = whole.groupBy(*PAIR).agg(sorted_cells(F.col("r") * side + F.col("c"), F.col("cnt")).alias("_cells"))
    # only pieces shorter than an image have padding
    short = pieces.where(F.col("bin1") - F.col("bin0") < half).select("resolution", "piece", (F.col("bin1") - F.col("bin0")).alias("_n"))
    for k in (1, 2):
        made = made.join(short.withColumnsRenamed({"piece": f"piece{k}", "_n": f"_n{k}"}), ["resolution", f"piece{k}"], "left")
    n1, n2 = F.coalesce("_n1", F.lit(half)), F.coalesce("_n2", F.lit(half))
    beyond = lambda k: F.when(k < half, half - 1 - k >= n1).otherwise(k - half >= n2)

    def cell(value: Column, i: Column) -> Column:
        return F.when(beyond(F.floor(i / side)) | beyond(i % side), F.lit(-1).cast("long")).otherwise(value)

    x = dense("_cells", side * side)
    x = F.when(F.col("_n1").isNull() & F.col("_n2").isNull(), x).otherwise(F.transform(x, cell))
    end = lambda k: F.concat_ws(":", f"piece{k}", f"side{k}")
    return made.select(*PAIR, F.concat_ws("|", end(1), end(2)).alias("name"), x.alias("x"))


def tiled(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(view, resolution, r, c, cnt), r <= c: regions of contigs side by side, each forward or turned.

    regions is (view, place, chrom, bin0, bin1, turned), bin1 excluded: the regions of a view follow each
    other by place. Of a turned region the last bin comes first. A view has few regions, their offsets
    are a running sum within it.
    """
    order = Window.partitionBy("view").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = regions.where("bin0 < bin1").withColumn("_off", F.coalesce(F.sum(F.col("bin1") - F.col("bin0")).over(order), F.lit(0)))

    def side(k: int) -> tuple[DataFrame, Column, Column]:
        at = F.col(f"bin{k}")
        inside = F.when(F.col("_t"), F.col("_e") - 1 - at).otherwise(at - F.col("_s"))
        own = placed.select("view", F.col("chrom").alias(f"chrom{k}"), F.col("bin0").alias("_s"), F.col("bin1").alias("_e"), F.col("turned").alias("_t"), "_off")
        return own, (at >= F.col("_s")) & (at < F.col("_e")), F.col("_off") + inside

    one, in_one, at_one = side(1)
    two, in_two, at_two = side(2)
    first = cells.join(one, "chrom1").where(in_one).withColumn("_i", at_one).drop("_s", "_e", "_t", "_off")
    both = first.join(two, ["view", "chrom2"]).where(in_two).withColumn("_j", at_two)
    return both.select(
        "view", "resolution", F.least("_i", "_j").cast("long").alias("r"), F.greatest("_i", "_j").cast("long").alias("c"), "cnt"
    )


def letters_contiguous(a: Column, b: Column) -> Column:
    """F or R if fragments named by a contig and a letter (ctg_A, ctg_B) follow each other, else null."""
    same = F.substring_index(a, "_", 1) == F.substring_index(b, "_", 1)
    step = F.ascii(F.substring_index(b, "_", -1)) - F.ascii(F.substring_index(a, "_", -1))
    return F.when(same & (step == 1), "F").when(same & (step == -1), "R")
