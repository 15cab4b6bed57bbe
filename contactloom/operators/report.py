"""Tables of tools, data sets and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_table(wide: DataFrame, keys: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per key and other column."""
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], name, value)


def decimal_comma(text: Column) -> Column:
    """A number written with a decimal comma; null where there is none."""
    return F.try_to_number(F.replace(text, F.lit(","), F.lit(".")), F.lit("999999999999999.999999")).cast("double")


def ranked(values: DataFrame, per: list[str], value: str, descending: bool = True) -> DataFrame:
    """Adds rank within `per`; equal values share the least rank."""
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    return values.withColumn("rank", F.rank().over(Window.partitionBy(*per).orderBy(order)))


def mean_ranks(ranks: DataFrame, tool: str = "tool") -> DataFrame:
    """(tool, mean_rank)."""
    return ranks.groupBy(tool).agg(F.avg("rank").alias("mean_rank"))


def relative_difference(a: Column, b: Column) -> Column:
    """(a - b) / b in percent, with two digits and a percent sign; null where b is 0 or null."""
    return F.when(F.try_divide(a - b, b).isNotNull(), F.format_string("%.2f%%", F.try_divide(a - b, b) * 100))


def seconds(text: Column) -> Column:
    """Seconds of a duration [D-]HH:MM:SS; null where it does not fit."""
    fits = text.rlike(r"^(\d+-)?\d+:\d\d:\d\d$")
    part = lambda i: F.coalesce(F.regexp_extract(text, r"^(?:(\d+)-)?(\d+):(\d\d):(\d\d)$", i).try_cast("long"), F.lit(0).cast("long"))
    return F.when(fits, part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def cpu_hours(steps: DataFrame) -> DataFrame:
    """(tool, dataset, hours): seconds times threads over all steps of (tool, dataset, time, threads), in whole hours."""
    spent = seconds(F.col("time")) * F.col("threads")
    return steps.groupBy("tool", "dataset").agg(F.sum(spent).alias("_s")).select("tool", "dataset", F.expr("_s div 3600").alias("hours"))


def gap_length(first: Column, second: Column) -> Column:
    """Distance between the middles of two fragments chrom:start-end."""
    mid = lambda f: (F.regexp_extract(f, r"(\d+)-(\d+)$", 1).try_cast("double") + F.regexp_extract(f, r"(\d+)-(\d+)$", 2).try_cast("double")) / 2
    return mid(second) - mid(first)


def coverage(percent: Column, full: float = 0.12) -> Column:
    """Coverage of a subsample given in percent."""
    return percent / 100 * full


def wide_table(rows: DataFrame, keys: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """One row per key, one column per listed name; the inverse of long_table."""
    return rows.groupBy(*keys).pivot(name, columns).agg(F.first(value))


def joined(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables beside each other: all keys of both, other columns null where a table has no row."""
    return first.join(second, keys, "full")


def combined_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both by key; of columns that both have, the value of first, and that of second where it is null."""
    ours = first.select(*keys, *(F.col(c).alias(f"_1{c}") for c in first.columns if c not in keys))
    theirs = second.select(*keys, *(F.col(c).alias(f"_2{c}") for c in second.columns if c not in keys))
    columns = [*first.columns, *(c for c in second.columns if c not in first.columns)]
    value = lambda c: F.coalesce(*(F.col(f"_{k}{c}") for k, t in ((1, first), (2, second)) if c in t.columns)).alias(c)
    return ours.join(theirs, keys, "full").select(*(c if c in keys else value(c) for c in columns))


def melted(rows: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """(type, value): several columns below each other, without nulls."""
    entries = F.array(*(F.struct(F.lit(k).alias("type"), c.cast("double").alias("value")) for k, c in pairs.items()))
    return rows.select(F.explode(entries).alias("_e")).select("_e.*").where(F.col("value").isNotNull())
