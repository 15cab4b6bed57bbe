"""Pairs of rows with one key, where a key may have any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.session import small


def paired(left: DataFrame, right: DataFrame, key: list[str], rows_per_task: int = 10_000) -> DataFrame:
    """The inner join of left and right on key, in which no task holds more than about rows_per_task left rows of a key.

    The left rows of a key that has more of them are dealt to parts by a hash, and the right rows of this
    key are repeated for every part. Such keys are at most one in rows_per_task rows; they are broadcast
    only if they are counted to be few. Null keys meet nothing.
    """
    counts = left.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
    many = small(counts.select(*key, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(many, key, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    repeated = right.join(many, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated, [*key, "_part"]).drop("_part")
