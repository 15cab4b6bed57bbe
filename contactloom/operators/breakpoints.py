"""Breakpoints of contigs from alignments, and one-dimensional clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def maximal_intervals(intervals: DataFrame, key: str = "q") -> DataFrame:
    """(key, s, e): different intervals that lie within no other of their key; rows with nulls or s > e are left out.

    In order of start (the longest first), an interval lies within another exactly if an earlier one
    ends as late: one sort per key, and no pairs.
    """
    earlier = Window.partitionBy(key).orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.dropna(subset=[key, "s", "e"]).where("s <= e").select(key, "s", "e").distinct()
    return rows.withColumn("_reach", F.max("e").over(earlier)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("e"))).drop("_reach")


def overlaps(intervals: DataFrame, key: str = "q") -> DataFrame:
    """(key, s, e): where neighbouring maximal intervals overlap or touch.

    Maximal intervals have starts and ends in the same order, so the ends of an overlap that no interval
    interrupts are those of neighbours.
    """
    order = Window.partitionBy(key).orderBy("s")
    following = maximal_intervals(intervals, key).withColumn("_s", F.lead("s").over(order))
    return following.where(F.col("_s") <= F.col("e")).select(key, F.col("_s").alias("s"), "e")


def breakpoints(alignments: DataFrame, dead_zone: int = 0, least_length: int = 0) -> DataFrame:
    """(name, bp): ends of overlaps between the aligned pieces of a contig, outside its dead zones.

    alignments is (Q_name, Q_len, Q_start, Q_end). Alignments shorter than least_length do not count.
    """
    rows = alignments.where(F.col("Q_end") - F.col("Q_start") >= least_length)
    pieces = rows.select(F.col("Q_name").alias("q"), F.col("Q_start").alias("s"), F.col("Q_end").alias("e"))
    found = overlaps(pieces).select("q", F.explode(F.array("s", "e")).alias("bp")).distinct()
    lengths = rows.groupBy(F.col("Q_name").alias("q")).agg(F.max("Q_len").alias("_len"))
    return found.join(lengths, "q").where(F.col("bp").between(dead_zone, F.col("_len") - dead_zone)).select(F.col("q").alias("name"), "bp")


def clusters(points: DataFrame, eps: float, key: str = "name", at: str = "bp") -> DataFrame:
    """(key, cluster, low, high, centre, n): points with gaps of at most eps; centre is their mean, rounded down.

    The same as density clustering where a single point makes a cluster. Equal points count each.
    """
    along = Window.partitionBy(key).orderBy(at)
    gaps = points.dropna(subset=[key, at]).withColumn("_new", F.when(F.col(at) - F.lag(at).over(along) <= eps, 0).otherwise(1))
    numbered = gaps.withColumn("cluster", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "cluster").agg(
        F.min(at).alias("low"), F.max(at).alias("high"), F.floor(F.avg(at)).alias("centre"), F.count(F.lit(1)).alias("n")
    )


def breakpoint_bins(contig_breakpoints: DataFrame, resolution: int) -> DataFrame:
    """(chrom, bin) of (name, bp)."""
    return contig_breakpoints.select(F.col("name").alias("chrom"), F.expr(f"bp div {resolution}").alias("bin")).distinct()
