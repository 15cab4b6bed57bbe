"""From window scores along a contig to its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.ranking import spread


def corner_mean(scores: DataFrame) -> DataFrame:
    """(chrom, bin, p): the mean of both corners (chrom, bin, p2, p3); rows without both are left out."""
    both = scores.where(F.col("p2").isNotNull() & F.col("p3").isNotNull())
    return both.select("chrom", "bin", ((F.col("p2") + F.col("p3")) / 2).alias("p"))


def stretches(curve: DataFrame, spans: DataFrame, blank: float | None) -> DataFrame:
    """(chrom, bin, last, p): the scored bins of a curve and the stretches of bins without a score between them, with p = blank.

    Together they cover the bins first to last of each contig of spans (chrom, first, last); a scored bin is a
    stretch of its own, so the rows follow the scores, not the lengths.
    """
    scored = curve.select("chrom", F.col("bin").cast("long").alias("bin"), F.col("p").cast("double").alias("p"))
    starts = spans.select("chrom", F.col("first").cast("long").alias("bin"), F.col("last").cast("long").alias("_last"))
    both = scored.withColumn("_last", F.lit(None).cast("long")).unionByName(starts.withColumn("p", F.lit(None).cast("double")))
    marks = both.groupBy("chrom", "bin").agg(F.max("p").alias("p"), F.max("_last").alias("_last"))
    along = Window.partitionBy("chrom").orderBy("bin")
    upto = F.coalesce(F.lead("bin").over(along) - 1, F.max("_last").over(Window.partitionBy("chrom")))
    row = lambda a, b, p: F.struct(a.alias("bin"), b.alias("last"), p.alias("p"))
    told = marks.withColumn("_to", upto)
    empty = F.lit(blank).cast("double")
    both = F.when(F.col("p").isNull(), F.array(row(F.col("bin"), F.col("_to"), empty))).otherwise(
        F.array(row(F.col("bin"), F.col("bin"), F.col("p")), row(F.col("bin") + 1, F.col("_to"), empty))
    )
    return told.select("chrom", F.explode(both).alias("_r")).select("chrom", "_r.*").where("bin <= last")


def filled(curve: DataFrame, spans: DataFrame, blank: float | None) -> DataFrame:
    """(chrom, bin, p): all bins of stretches, one by one."""
    rows = stretches(curve, spans, blank)
    return spread(rows.withColumnRenamed("bin", "_bin"), F.col("_bin"), F.col("last"), 1, "bin").select("chrom", "bin", "p")


def smoothed(curve: DataFrame, window: int = 20, least: float = 1.0) -> DataFrame:
    """(chrom, bin, p): the moving average over `window` bins, zeros beyond both ends; contigs with fewer than least * window bins stay as they are."""
    along = Window.partitionBy("chrom").orderBy("bin").rowsBetween(-(window // 2), window - window // 2 - 1)
    whole = Window.partitionBy("chrom")
    return curve.select(
        "chrom", "bin", F.when(F.count(F.lit(1)).over(whole) >= least * window, F.sum("p").over(along) / window).otherwise(F.col("p")).alias("p")
    )


def masked(curve: DataFrame, regions: DataFrame, tolerance: int = 5) -> DataFrame:
    """Adds masked: whether the bin is within `tolerance` of a region (chrom, b0, b1) of its contig.

    Every region lists the bins it reaches, so bins meet it by an equi-join.
    """
    reached = (
        regions.where("b0 <= b1")
        .select("chrom", F.explode(F.sequence((F.col("b0") - tolerance).cast("long"), (F.col("b1") + tolerance).cast("long"))).alias("bin"))
        .distinct()
        .withColumn("_in", F.lit(True))
    )
    at = curve.withColumn("bin", F.col("bin").cast("long"))
    return at.join(reached, ["chrom", "bin"], "left").withColumn("masked", F.coalesce("_in", F.lit(False))).drop("_in")


def runs(curve: DataFrame, threshold: float = 0.05, emit_trailing: bool = False) -> DataFrame:
    """(chrom, part_id, chimeric, b0, b1): maximal runs of kept or bad bins of (chrom, bin, p, masked), or of stretches of bins with a column last.

    A bin is kept if p >= threshold or it is masked. A run reaches to the first bin of the next one; the
    last run ends with its last bin. A last run of bad bins is not a part, unless emit_trailing is set.
    """
    along = Window.partitionBy("chrom").orderBy("bin")
    keep = (F.col("p") >= threshold) | F.coalesce("masked", F.lit(False))
    flagged = curve.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    started = flagged.withColumn("_new", F.when(F.lag("_keep").over(along) == F.col("_keep"), 0).otherwise(1))
    numbered = started.withColumn("_run", F.sum("_new").over(along))
    per_run = numbered.groupBy("chrom", "_run").agg(F.min("bin").alias("b0"), F.max("last" if "last" in curve.columns else "bin").alias("_last"), F.first("_keep").alias("_keep"))
    order = Window.partitionBy("chrom").orderBy("_run")
    parts = per_run.withColumn("_next", F.lead("b0").over(order))
    if not emit_trailing:
        parts = parts.where(F.col("_next").isNotNull() | F.col("_keep"))
    return parts.select(
        "chrom", F.row_number().over(order).alias("part_id"), (~F.col("_keep")).alias("chimeric"), "b0", F.coalesce("_next", "_last").alias("b1")
    )


def merged_parts(parts: DataFrame, least: int = 20) -> DataFrame:
    """(chrom, part_id, b0, b1): parts after short ones were merged into their neighbours, from left to right.

    While a part that is not the last is shorter than `least` bins: a first part gives its bins to the
    next, another is halved between the previous and the next. The order matters, so a contig's parts
    are folded as one sorted array; a contig has few parts.
    """
    ordered = parts.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("b0", "b1"))).alias("_p"))
    kind = "array<struct<b0:bigint,b1:bigint>>"
    # done: finished parts; at: the part that may still grow at its start
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<b0:bigint,b1:bigint>").alias("at"))

    def step(state, part):
        done, at = state["done"], state["at"]
        part = F.struct(part["b0"].cast("long").alias("b0"), part["b1"].cast("long").alias("b1"))
        short = at["b1"] - at["b0"] < least
        middle = at["b0"] + F.floor((at["b1"] - at["b0"]) / 2)
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["b0"].alias("b0"), middle.alias("b1"))))
        is_first = F.size(done) == 0
        return (
            F.when(at.isNull(), F.struct(done.alias("done"), part.alias("at")))
            .when(~short, F.struct(F.concat(done, F.array(at)).alias("done"), part.alias("at")))
            .when(is_first, F.struct(done.alias("done"), F.struct(at["b0"].alias("b0"), part["b1"].alias("b1")).alias("at")))
            .otherwise(F.struct(grown.alias("done"), F.struct(middle.alias("b0"), part["b1"].alias("b1")).alias("at")))
        )

    folded = ordered.select("chrom", F.aggregate("_p", start, step, lambda s: F.concat(s["done"], F.array(s["at"]))).alias("_p"))
    return folded.select("chrom", F.posexplode("_p").alias("_i", "_s")).select(
        "chrom", (F.col("_i") + 1).alias("part_id"), F.col("_s.b0").alias("b0"), F.col("_s.b1").alias("b1")
    )


def trimmed(parts: DataFrame, curve: DataFrame, chrom_sizes: DataFrame, resolution: int, legacy: bool = False) -> DataFrame:
    """(chrom, start, end) in bp: the first part begins at 0 and the last ends with the contig, where they reach the scored bins' ends.

    legacy lets every part that reaches the last scored bin end with the contig: if the last part is that bin
    alone, the part before it then overlaps it.
    """
    ends = curve.groupBy("chrom").agg(F.min("bin").alias("_first"), F.max("bin").alias("_last"))
    last_part = parts.groupBy("chrom").agg(F.max("b0").alias("_last_b0"))
    known = parts.join(ends, "chrom").join(chrom_sizes, "chrom").join(last_part, "chrom")
    at_end = (F.col("b1") == F.col("_last")) & (F.lit(legacy) | (F.col("b0") == F.col("_last_b0")))
    return known.select(
        "chrom",
        F.when(F.col("b0") == F.col("_first"), F.lit(0).cast("long")).otherwise(F.col("b0") * resolution).cast("long").alias("start"),
        F.when(at_end, F.col("length")).otherwise(F.col("b1") * resolution).cast("long").alias("end"),
    )


def fragment_lines(fragments: DataFrame) -> DataFrame:
    """(line): chrom:start-end of each fragment."""
    return fragments.select(F.format_string("%s:%d-%d", "chrom", "start", "end").alias("line"))


def cutting_position(curve: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(chrom, cut): the middle between the first and the last bin below the threshold."""
    return curve.where(F.col("p") < threshold).groupBy("chrom").agg(((F.min("bin") + F.max("bin")) / 2).alias("cut"))


def spliced(curve: DataFrame, full: DataFrame, margin: int = 10) -> DataFrame:
    """(chrom, bin, p): the curve, with the outer `margin` bins of each contig taken from the full run."""
    ends = full.groupBy("chrom").agg(F.min("bin").alias("_f"), F.max("bin").alias("_l"))
    outer = (F.col("bin") < F.col("_f") + margin) | (F.col("bin") > F.col("_l") - margin)
    inner = curve.join(ends, "chrom").where(~outer).select("chrom", "bin", "p")
    return inner.union(full.join(ends, "chrom").where(outer).select("chrom", "bin", "p"))
