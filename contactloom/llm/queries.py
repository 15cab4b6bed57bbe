"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import cutoff, mix, overlap, sample, splits, tokens, topn
from contactloom.llm.sql import SQL
from contactloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

LINK_END = ["resolution", "a", "oa"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, sf, "images"))


def p1_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf, "images"))


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_records(table(spark, sf, "images"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf, "images"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    report = sample.sample_report(table(spark, sf, "images"), table(spark, sf, "sample_targets"))
    return report.where("short").select("target_id")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return sample.sample_report(table(spark, sf, "images"), table(spark, sf, "sample_targets"))


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.proportional_sample(table(spark, sf, "images"), table(spark, sf, "sample_targets"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    placed = splits.grouped_splits(table(spark, sf, "images"), table(spark, sf, "name_table"), table(spark, sf, "split_targets"))
    return splits.placed_pairs(placed)


def p3_components(spark: SparkSession, sf: str) -> DataFrame:
    return splits.tied_components(table(spark, sf, "images"), table(spark, sf, "name_table"))


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.grouped_splits(table(spark, sf, "images"), table(spark, sf, "name_table"), table(spark, sf, "split_targets")).drop("grp")


def p3_placed(spark: SparkSession, sf: str) -> DataFrame:
    """How many records of each component were placed, and in how many splits."""
    placed = splits.grouped_splits(table(spark, sf, "images"), table(spark, sf, "name_table"), table(spark, sf, "split_targets"))
    return placed.groupBy("scheme", "component").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("split").alias("splits"))


def p3_balance(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_balance(table(spark, sf, "images"), table(spark, sf, "name_table"), table(spark, sf, "split_targets"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "prob_net").select("link_id", *LINK_END, "prob")
    return topn.top_n(links, LINK_END, "prob", "link_id", 5).select("link_id")


def p4_best_links(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "prob_net").select("link_id", *LINK_END, "b", "ob", "prob")
    return topn.top_n(links, LINK_END, "prob", "link_id", 5).withColumn("place", F.col("place").cast("long"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix.fair_mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mix_shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_all_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached by a mix as large as all wanted sources together: small ones run out of their repeats."""
    documents, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    return mix.mix_shares(documents, targets, budget="all")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff.truncated(table(spark, sf, "documents")).where("is_cut").select("doc_id")


def p8_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What each document found was found by."""
    return cutoff.truncated(table(spark, sf, "documents")).where("is_cut").drop("is_cut")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff.truncation_rates(table(spark, sf, "documents"))


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff.hidden_limits(cutoff.measured(table(spark, sf, "documents")))


def queries() -> dict[str, Query]:
    """All queries of this package by name."""
    return {
        f.__name__: f
        for f in (
            p1_found, p1_overlaps, p1_records, p1_report, p2_found, p2_report, p2_sample, p3_found, p3_components, p3_splits, p3_placed, p3_balance, p4_found, p4_best_links,
            p6_ids, p7_mix, p7_shares, p7_all_shares, p8_found, p8_evidence, p8_rates, p8_limits,
        )
    }


def sql() -> dict[str, str]:
    """SQL by query, where there is one."""
    return dict(SQL)
