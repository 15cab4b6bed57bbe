"""Ranks and running totals within groups of any size.

A window over a group puts the whole group into one task. Here each group is cut into ordered
buckets; totals per bucket give what lies before a bucket, and windows run inside buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int, rows_per_bucket: int = 50_000) -> int:
    """How many buckets a table of so many rows needs for buckets of a bounded size."""
    return max(1, -(-rows // rows_per_bucket))


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """An ordered bucket of a 64-bit hash: a lower hash never lies in a higher bucket."""
    # the shift keeps 32 bits, so that the product stays within a long
    top = F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(2**63))), 32)
    return F.shiftright(top * F.lit(buckets), 32).cast("int")


def before_buckets(df: DataFrame, group: list[str], bucket: str, value: Column, name: str) -> DataFrame:
    """Per group and bucket, the sum of value over all lower buckets of the group; one row each."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    lower = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(lower), F.lit(0).cast("long")).alias(name))


def with_running(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Adds the running total of value, own row included, in the order (bucket, order) within each group.

    group and bucket must hold no nulls: rows with a null there are left out.
    """
    offsets = before_buckets(df, group, bucket, value, "_before")
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(offsets, [*group, bucket])
        .withColumn(name, F.col("_before") + F.sum(value).over(inside))
        .drop("_before")
    )


def with_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the rank from 1 in the order (bucket, order) within each group; order must have no ties."""
    return with_running(df, group, bucket, order, F.lit(1).cast("long"), name)


def shuffled(df: DataFrame, group: list[str], key: str, rows: int, seed: int = 7, name: str = "rank", rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds the rank from 1 within each group in a random order that follows from the seed and the key alone.

    The order is that of the MD5 of seed:key, so it can be repeated anywhere. rows is the number of rows,
    about. The key must be different for all rows of a group; group and key must hold no nulls.
    """
    hashed = df.withColumn("_md5", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    # an ordered bucket of the first 32 bits
    top = F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long")
    bucketed = hashed.withColumn("_b", F.shiftright(top * F.lit(buckets_for(rows, rows_per_bucket)), 32).cast("int"))
    return with_rank(bucketed, group, "_b", [F.col("_md5"), F.col(key)], name).drop("_md5", "_b")


def spread(df: DataFrame, first: Column, last: Column, step: int, name: str, width: int = 10_000) -> DataFrame:
    """Each row once for every number first, first + step, ... up to last, in the new column `name`.

    The numbers are first listed in ranges of `width`, which are dealt out to all tasks, so no row's numbers
    come together in one task. Rows with last < first are left out.
    """
    ranged = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).where("_first <= _last")
    dealt = ranged.withColumn("_from", F.explode(F.sequence("_first", "_last", F.lit(step * width).cast("long"))))
    # a given number of tasks, as small ranges would be put together again
    dealt = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns, "_from")
    upto = F.least(F.col("_last"), F.col("_from") + step * (width - 1))
    return dealt.withColumn(name, F.explode(F.sequence(F.col("_from"), upto, F.lit(step).cast("long")))).select(*df.columns, name)
