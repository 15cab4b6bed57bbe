"""A mix of documents in which each source has its weight in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.tokens import token_counts
from contactloom.operators.ranking import before_buckets, buckets_for, hash_bucket, with_running
from contactloom.session import cut, small


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens) of every document, kept in the checkpoint folder as it is read more than once."""
    return cut(token_counts(documents, ["doc_id", "source"]))


def full_budget(sized: DataFrame, targets: DataFrame) -> int:
    """The largest total at which no source that has documents runs out of its repeats before its share is full."""
    totals = sized.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("_all"))
    found = (
        targets.where("weight > 0 and max_repeats > 0").select("source", "weight", "max_repeats").dropDuplicates(["source"]).join(totals, "source")
        .agg(F.min(F.col("_all") * F.col("max_repeats") / F.col("weight")).alias("v"), F.sum("weight").alias("w"))
        .first()
    )
    return int((found.v or 0) * (found.w or 0))


def fair_mix(
    documents: DataFrame, targets: DataFrame, budget: int | str | None = None, seed: int = 7, rows_per_bucket: int = 50_000
) -> DataFrame:
    """(doc_id, source, turn, tokens, finish): the documents of the mix, each as often as it is taken.

    Weighted fair queueing: the documents of a source queue in random order, once per turn up to
    max_repeats, and each has a virtual finish time: the tokens of its source up to its end, divided by
    the weight. Documents are taken by finish time until `budget` tokens are reached (default: see
    full_budget; "all": as many as the wanted sources have, each counted once, so that sources run out). Sources that are exhausted leave their part to the others. The mix is the same in
    every run with the same seed.

    Null and empty texts have size 0 and are not taken, as they add nothing. Documents of sources that
    are null or have no weight are not taken. A source without documents adds no rows. Empty tables
    give no rows.
    """
    sized = sized_documents(documents)
    if budget is None:
        budget = full_budget(sized, targets)
    rows = sized.count()
    wanted = small(targets.where("weight > 0 and max_repeats > 0").dropDuplicates(["source"]).select("source", "weight", "max_repeats"))
    queued = with_running(
        sized.where("tokens > 0 and source is not null")
        .withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("_bucket", hash_bucket(F.col("_hash"), buckets_for(rows, rows_per_bucket))),
        ["source"], "_bucket", [F.col("_hash"), F.col("doc_id")], F.col("tokens"), "_end",
    )
    totals = sized.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("_all"))
    per_source = small(totals.join(wanted, "source").select("source", "weight", "max_repeats", "_all"))
    # when the queue closes: the virtual time at which all sources together have budget tokens, at most
    queues = [(r["weight"], r["_all"] * r["max_repeats"], r["_all"]) for r in per_source.collect()]
    if budget == "all":
        budget = sum(once for _, _, once in queues)
    closes = closing_time([(weight, most) for weight, most, _ in queues], budget)
    turns = (
        queued.join(per_source, "source")
        .withColumn("turn", F.explode(F.expr("sequence(1, max_repeats)")))
        .withColumn("finish", ((F.col("turn") - 1) * F.col("_all") + F.col("_end")) / F.col("weight"))
        .where(F.col("finish") - F.col("tokens") / F.col("weight") <= F.lit(closes))
    )
    # a unit of virtual time holds as many tokens as the weights add up to, so cells of time are even
    cells = buckets_for(rows, rows_per_bucket)
    timed = turns.withColumn("_cell", F.floor(F.least(F.col("finish") / F.lit(max(closes, 1e-9)), F.lit(2.0)) * cells).cast("long"))
    before = before_buckets(timed.withColumn("_one", F.lit(1)), ["_one"], "_cell", F.col("tokens"), "_before").drop("_one")
    inside = Window.partitionBy("_cell").orderBy("finish", "source", "turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        timed.join(before, "_cell")
        .where(F.col("_before") < F.lit(budget))
        .withColumn("_total", F.col("_before") + F.sum("tokens").over(inside))
        .where(F.col("_total") <= F.lit(budget))
        .select("doc_id", "source", "turn", "tokens", "finish")
    )


def closing_time(sources: list[tuple[float, int]], budget: int) -> float:
    """The virtual time at which sources of (weight, tokens at most) have given `budget` tokens."""
    time, given = 0.0, 0.0
    ends = sorted((most / weight, weight) for weight, most in sources)
    active = sum(weight for _, weight in ends)
    for end, weight in ends:
        if given + (end - time) * active >= budget:
            return time + (budget - given) / active
        given += (end - time) * active
        time, active = end, active - weight
    return time


def mix_shares(
    documents: DataFrame, targets: DataFrame, budget: int | str | None = None, seed: int = 7, rows_per_bucket: int = 50_000
) -> DataFrame:
    """One row per wanted source: its weight, what it has, what the mix took of it, and the share reached."""
    mix = fair_mix(documents, targets, budget, seed, rows_per_bucket)
    taken = mix.groupBy("source").agg(
        F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("rows"),
        F.sum("tokens").alias("tokens"), F.max("turn").alias("turns"),
    )
    # as many rows as there are wanted sources
    whole = Window.partitionBy(F.lit(1))
    return targets.select("source", "weight", "max_repeats").dropDuplicates(["source"]).join(taken, "source", "left").select(
        "source", "weight", "max_repeats",
        # the part of the weights that were wanted
        F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(whole)), F.lit(0.0)).alias("wanted"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "rows", "tokens", "turns")),
        F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0)).alias("share"),
    )
