"""Metrics of a binary classifier over (y, prob), with y 0 or 1.

Rows with a null or NaN probability or another y are left out. Nothing sorts all rows in one task: rows
are first counted by probability, and running totals go through buckets of probability.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.session import cut

#: Cells that probabilities are dealt to; each is ordered by itself.
CELLS = 256


def usable(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("y").isin(0, 1) & F.col("prob").isNotNull() & ~F.isnan("prob"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn for prob >= threshold."""
    yes, one = F.col("prob") >= threshold, F.col("y") == 1
    return usable(scored).agg(
        F.count_if(yes & one).alias("tp"), F.count_if(yes & ~one).alias("fp"),
        F.count_if(~yes & one).alias("fn"), F.count_if(~yes & ~one).alias("tn"),
    )


def scores(table: DataFrame) -> DataFrame:
    """Balanced accuracy, weighted precision, recall and F1, macro F1 and NPV of a confusion table; 0 for an empty denominator."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, n = tp + fn, tn + fp
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1, f0 = part(2 * tp, 2 * tp + fp + fn), part(2 * tn, 2 * tn + fn + fp)
    return table.select(
        ((part(tp, p) + part(tn, n)) / 2).alias("balanced_accuracy"),
        part(p * part(tp, tp + fp) + n * part(tn, tn + fn), p + n).alias("weighted_precision"),
        part(tp + tn, p + n).alias("weighted_recall"),
        part(p * f1 + n * f0, p + n).alias("weighted_f1"),
        ((f1 + f0) / 2).alias("macro_f1"),
        part(tn, tn + fn).alias("npv"),
    )


def _placed(counts: DataFrame, value: str, cells: int = CELLS) -> DataFrame:
    """Adds _cell: cells of value that hold about as many rows of counts each, in order of value.

    Their limits are quantiles, so values that crowd at one place are spread over many cells.
    """
    limits = counts.agg(F.percentile_approx(F.col(value).cast("double"), [k / cells for k in range(1, cells)], 20 * cells).alias("_q"))
    # one row with as many limits as cells
    placed = counts.crossJoin(F.broadcast(limits))
    below = F.array_size(F.filter("_q", lambda q: q < F.col(value).cast("double")))
    return placed.withColumn("_cell", F.coalesce(below, F.lit(0)).cast("long")).drop("_q")


def _running(placed: DataFrame, value: str, sums: dict[str, str]) -> DataFrame:
    """Adds for each entry (name: column) the running total of the column in order of value, own row included; one window for all."""
    per_cell = placed.groupBy("_cell").agg(*(F.sum(c).alias(c) for c in sums.values()))
    # as many rows as cells
    lower = Window.partitionBy(F.lit(1)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = per_cell.select("_cell", *(F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"_before{c}") for c in sums.values()))
    inside = Window.partitionBy("_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(before), "_cell").withColumns({name: F.col(f"_before{c}") + F.sum(c).over(inside) for name, c in sums.items()})


def curve(scored: DataFrame) -> DataFrame:
    """(prob, tp, fp, p, n): of each different probability, how many of both labels are at least as probable, and all of both."""
    counts = usable(scored).groupBy("prob").agg(F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") == 0).alias("_n"))
    # read several times below; one row per probability is all that is kept
    counts = cut(counts.withColumn("_less", -F.col("prob")))
    running = _running(_placed(counts, "_less"), "_less", {"tp": "_p", "fp": "_n"})
    totals = counts.agg(F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    return running.crossJoin(F.broadcast(totals)).select("prob", "tp", "fp", "p", "n", "_p", "_n")


def curve_points(scored: DataFrame) -> DataFrame:
    """(prob, tpr, fpr, precision): the points of the ROC and the precision-recall curve."""
    return curve(scored).select(
        "prob", F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "n").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """(auc, u): area under the ROC curve, ties counting half, and the Mann-Whitney U of the positives."""
    points = curve(scored)
    # a positive beats the negatives below its probability and half of those with the same
    p = F.col("_p").cast("double")
    won = p * (F.col("n") - F.col("fp")) + p * F.col("_n") / 2
    return points.agg(F.sum(won.cast("double")).alias("u"), F.max("p").alias("p"), F.max("n").alias("n")).select(
        F.try_divide("u", F.col("p").cast("double") * F.col("n")).alias("auc"), "u"
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """(ap): sum of recall steps times precision, ties merged."""
    return curve(scored).agg(F.sum(F.try_divide("_p", "p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def mann_whitney(values: DataFrame, group: str, value: str, greater: str, than: str) -> DataFrame:
    """(u, z, p_value): whether values of one group are greater; normal approximation with tie correction."""
    rows = values.where(F.col(group).isin(greater, than) & F.col(value).isNotNull())
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == greater).alias("a"), F.count_if(F.col(group) == than).alias("b"))
    counts = cut(counts)
    below = _running(_placed(counts, "v"), "v", {"_upto": "b"})
    # products of counts beyond 64 bits
    one, two = F.col("a").cast("double"), F.col("b").cast("double")
    t = one + two
    found = below.agg(
        F.sum(one * (F.col("_upto") - F.col("b")) + one * two / 2).alias("u"), F.sum(one).alias("n1"), F.sum(two).alias("n2"), F.sum(t * t * t - t).alias("ties")
    )

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if v != v else 0.5 * math.erfc(v / math.sqrt(2)))

    n = F.col("n1") + F.col("n2")
    variance = F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide("ties", n * (n - 1)))
    z = F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2 - 0.5, F.sqrt(variance))
    return found.select("u", z.alias("z")).select("u", "z", tail(F.col("z")).alias("p_value"))


def focal_loss(y: Column, prob: Column, gamma: float = 1.0, positive: float = 1.0, negative: float = 1.2, alpha: float | None = None) -> Column:
    """weight * (1 - p_t)^gamma * cross-entropy of one sample; with alpha the weights are 1 - alpha for y = 1 and alpha for y = 0."""
    p = F.least(F.greatest(prob, F.lit(1e-7)), F.lit(1 - 1e-7))
    pt = F.when(y == 1, p).otherwise(1 - p)
    one, zero = (1 - alpha, alpha) if alpha is not None else (positive, negative)
    return F.when(y == 1, one).otherwise(zero) * F.pow(1 - pt, F.lit(gamma)) * -F.log(pt)


def described(values: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, mean, std (sample), least, quartiles and greatest value; quartiles are exact, from counts by value."""
    counts = values.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").cast("double")
    mean = F.sum(F.col("v") * F.col("c")) / n
    quart = lambda q: F.percentile("v", q, F.col("c"))
    around = values.where(F.col(value).isNotNull()).groupBy(group).agg(F.stddev_samp(F.col(value).cast("double")).alias("std"))
    return (
        counts.groupBy(group).agg(F.sum("c").alias("n"), mean.alias("mean"), F.min("v").alias("least"), quart(0.25).alias("q25"),
                                  quart(0.5).alias("q50"), quart(0.75).alias("q75"), F.max("v").alias("greatest"))
        .join(around, group)
    )
