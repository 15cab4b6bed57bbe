"""A sample whose categories have given shares, with a minimum of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions import names
from contactloom.operators.ranking import before_buckets, buckets_for, hash_bucket, with_rank
from contactloom.session import small

CATEGORY = ["y", "grp_type", "bin_size"]
TARGET = ["target_id", "target_set", *CATEGORY, "share", "min_rows", "sample_rows"]


def categorised(images: DataFrame) -> DataFrame:
    """(sample_id, y, grp_type, bin_size) of each record that belongs to a category.

    Records with null name, null bin_size, or y other than 0 and 1 belong to none. Repeated rows count once.
    """
    return (
        images.where(F.col("y").isin(0, 1) & F.col("name").isNotNull() & F.col("bin_size").isNotNull())
        .select("sample_id", "y", F.when(names.is_inter(F.col("name")), "inter").otherwise("intra").alias("grp_type"), "bin_size")
        .dropDuplicates(["sample_id"])
    )


def prioritised(images: DataFrame, targets: DataFrame, seed: int = 7, rows_per_bucket: int = 50_000) -> DataFrame:
    """Every record of every wanted category with its random rank there and its priority in the target set.

    priority is (rank - 1/2) / share: the divisor method, by which the smallest priorities of a set have
    the wanted shares. Records within the minimum of their category have priority 0 and so come first.
    A share of 0 gives no priority beyond the minimum.
    """
    total = images.count()
    records = categorised(images)
    shuffled = records.withColumn("_hash", F.xxhash64(F.lit(seed), "sample_id")).withColumn(
        "_bucket", hash_bucket(F.col("_hash"), buckets_for(total, rows_per_bucket))
    )
    ranked = with_rank(shuffled, CATEGORY, "_bucket", [F.col("_hash"), F.col("sample_id")]).drop("_hash", "_bucket")
    wanted = small(targets.select(*TARGET).dropDuplicates(["target_id"]))
    return ranked.join(wanted, CATEGORY).withColumn(
        "priority",
        F.when(F.col("rank") <= F.coalesce("min_rows", F.lit(0)), F.lit(0.0)).when(
            F.col("share") > 0, (F.col("rank") - 0.5) / F.col("share")
        ),
    )


def proportional_sample(
    images: DataFrame, targets: DataFrame, seed: int = 7, rows_per_bucket: int = 50_000
) -> DataFrame:
    """(target_set, target_id, sample_id, rank, priority): the sample of each target set.

    Of each set the sample_rows smallest priorities are taken; seats that an exhausted category leaves
    go to the others by themselves. The minimum of each category is taken even where these alone are
    more than sample_rows. The choice is the same in every run with the same seed; ties of priority are
    settled by target and rank. An empty table of records or targets gives no rows.

    No step sorts a whole set or category in one task: priorities of one category lie 1/share apart, so
    an interval of priorities holds a bounded number of rows, whole intervals are taken by their counts,
    and only the interval where the sample ends is ordered.
    """
    seats = prioritised(images, targets, seed, rows_per_bucket).where(F.col("priority").isNotNull())
    is_minimum = F.col("rank") <= F.coalesce("min_rows", F.lit(0))
    # minimum rows come first, as interval -1; they are all taken, so they need no order
    cells = seats.withColumn("_cell", F.when(is_minimum, F.lit(-1).cast("long")).otherwise(F.floor(F.col("priority") / rows_per_bucket).cast("long")))
    before = before_buckets(cells, ["target_set"], "_cell", F.lit(1).cast("long"), "_before")
    columns = ["target_set", "target_id", "sample_id", "rank", "priority"]
    open_cells = cells.where("_cell >= 0").join(before, ["target_set", "_cell"]).where(F.col("_before") < F.col("sample_rows"))
    inside = Window.partitionBy("target_set", "_cell").orderBy("priority", "target_id", "rank")
    chosen = open_cells.withColumn("_place", F.col("_before") + F.row_number().over(inside)).where(F.col("_place") <= F.col("sample_rows"))
    return cells.where("_cell < 0").select(*columns).union(chosen.select(*columns))


def sample_report(
    images: DataFrame, targets: DataFrame, seed: int = 7, rows_per_bucket: int = 50_000
) -> DataFrame:
    """One row per target: how many records the category has, wants and got, whether it falls short or is squeezed.

    A category falls short if the sample has taken less than the larger of min_rows and share * sample_rows
    from it and there are not as many records. It is squeezed if there are more records than taken, but the minima of
    the others left it more than a seat below its share. Categories without any record are reported with 0.
    """
    ranks = prioritised(images, targets, seed, rows_per_bucket)
    have = ranks.groupBy("target_id").agg(F.max("rank").alias("have"))
    taken = (
        proportional_sample(images, targets, seed, rows_per_bucket)
        .groupBy("target_id")
        .agg(F.count(F.lit(1)).alias("taken"))
    )
    want = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("double"), F.coalesce("share", F.lit(0.0)) * F.coalesce("sample_rows", F.lit(0)))
    return (
        targets.select(*TARGET).dropDuplicates(["target_id"])
        .join(have, "target_id", "left")
        .join(taken, "target_id", "left")
        .select(*TARGET, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("have", "taken")), want.alias("want"))
        .withColumn("short", (F.col("taken") < F.col("want")) & (F.col("have") < F.col("want")))
        .withColumn("squeezed", (F.col("taken") < F.col("have")) & (F.col("taken") + 1 < F.col("want")))
    )
