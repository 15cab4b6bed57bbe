"""Results per key where a handful of keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT = "n_rows"


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The keys (null included) that hold at least `share` of all rows, with n_rows and n_all.

    At most 1/share rows come out, whatever the input: that bounds a broadcast of them.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(COUNT))
    total = df.count()
    return counts.where(F.col(COUNT) >= F.lit(share) * F.lit(total)).withColumn("n_all", F.lit(total).cast("long"))


def salted_aggregate(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    distinct: str | None = None,
    share: float = 0.001,
    salts: int = 64,
    row_id: Column | None = None,
) -> DataFrame:
    """Per key: n_rows, and for each entry of sums its sum, number of values, mean, least and greatest value.

    Stage 1 appends a salt to every heavy key (at least `share` of all rows) and aggregates per
    (key, salt); light keys keep salt 0. Stage 2 merges the partial results by the original key. With
    `distinct`, n_distinct counts its different values: rows of one value get the same salt, so the
    partial counts add up. The salt is a hash of `distinct` or of row_id, not a random number, so a
    task that runs again gives the same rows.

    Null keys form a key of their own; null values count in n_rows only; an empty table gives no rows.
    Columns of df with the names used here do no harm, as only the needed ones are taken along.
    """
    spread = F.col(distinct) if distinct else row_id
    columns = [F.col(key).alias("_key")] + [c.alias(f"_v{i}") for i, c in enumerate(sums.values())]
    if spread is not None:
        columns.append(spread.alias("_spread"))
    rows = df.select(*columns)
    salt = F.pmod(F.xxhash64("_spread") if spread is not None else F.xxhash64(*rows.columns), F.lit(salts))
    heavy = heavy_keys(df.select(key), key, share).select(F.col(key).alias("_heavy"), F.lit(True).alias("_is_heavy"))
    salted = rows.join(F.broadcast(heavy), F.col("_key").eqNullSafe(F.col("_heavy")), "left").select(
        *rows.columns, F.when(F.col("_is_heavy"), salt).otherwise(F.lit(0)).alias("_salt")
    )
    partial = [F.count(F.lit(1)).alias("_n")]
    for i in range(len(sums)):
        v = F.col(f"_v{i}")
        partial += [
            F.sum(v).alias(f"_s{i}"),
            F.count(v).alias(f"_c{i}"),
            F.min(v).alias(f"_l{i}"),
            F.max(v).alias(f"_g{i}"),
        ]
    if distinct:
        # stage 1 first makes each (key, salt, value) one row, which also spreads over all tasks
        per_value = salted.groupBy("_key", "_salt", "_spread").agg(*partial)
        again = [F.sum("_n").alias("_n"), F.count("_spread").alias("_d")]
        for i in range(len(sums)):
            again += [
                F.sum(f"_s{i}").alias(f"_s{i}"),
                F.sum(f"_c{i}").alias(f"_c{i}"),
                F.min(f"_l{i}").alias(f"_l{i}"),
                F.max(f"_g{i}").alias(f"_g{i}"),
            ]
        first = per_value.groupBy("_key", "_salt").agg(*again)
    else:
        first = salted.groupBy("_key", "_salt").agg(*partial)
    merged = [F.sum("_n").alias(COUNT)]
    if distinct:
        merged.append(F.sum("_d").alias("n_distinct"))
    for i, name in enumerate(sums):
        merged += [
            F.sum(f"_s{i}").alias(f"{name}_sum"),
            F.sum(f"_c{i}").alias(f"{name}_count"),
            F.try_divide(F.sum(f"_s{i}"), F.sum(f"_c{i}")).alias(f"{name}_mean"),
            F.min(f"_l{i}").alias(f"{name}_min"),
            F.max(f"_g{i}").alias(f"{name}_max"),
        ]
    return first.groupBy("_key").agg(*merged).withColumnRenamed("_key", key)
