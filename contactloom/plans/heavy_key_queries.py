"""Results per key where a handful of keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions import names
from contactloom.operators import heavykeys
from contactloom.plans.registry import Registry
from contactloom.sources.tables import table

REGISTRY = Registry()

TOTAL = "list_sum(list_transform(x, lambda v: greatest(coalesce(v, 0), 0)))"
#: the contigs in a name, as functions.names.contigs_of gives them
CONTIGS = """c as (
  select sample_id, y, n, case when contains(n, '|') then list_distinct(list_transform(string_split(n, '|'), lambda p:
      case when regexp_matches(p, '^(.*):([0-9]+)-([0-9]+):([01])$') then regexp_extract(p, '^(.*):([0-9]+)-([0-9]+):([01])$', 1) else p end))
    when regexp_matches(n, '^(.*)_([0-9]+)_c([23])$') then [regexp_extract(n, '^(.*)_([0-9]+)_c([23])$', 1)]
    when regexp_matches(n, '^(.*):([0-9]+)-([0-9]+):([01])$') then [regexp_extract(n, '^(.*):([0-9]+)-([0-9]+):([01])$', 1)] else [n] end as l
  from (select sample_id, y, lower(regexp_replace(name, '\\s+', '', 'g')) as n from images where name is not null))"""


@REGISTRY.query("select grp from images where grp is not null group by grp having count(*) * 20 >= (select count(*) from images)")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "images")
    per_group = heavykeys.salted_aggregate(images, "grp", {}, row_id=F.col("sample_id"))
    return per_group.where(F.col("grp").isNotNull() & (F.col("n_rows") * 20 >= F.lit(images.count()))).select("grp")


@REGISTRY.query(f"""select grp, count(*)::bigint as n_rows, count(distinct sample_id)::bigint as n_distinct, sum(y)::bigint as y_sum, count(y)::bigint as y_count,
  round(avg(y), 6) as y_mean, min(y)::bigint as y_min, max(y)::bigint as y_max, sum({TOTAL})::bigint as total_sum, count({TOTAL})::bigint as total_count,
  round(avg({TOTAL}), 6) as total_mean, min({TOTAL})::bigint as total_min, max({TOTAL})::bigint as total_max from images group by grp""")
def p5_by_group(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "images")
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)))
    per_group = heavykeys.salted_aggregate(images, "grp", {"y": F.col("y").cast("long"), "total": total}, distinct="sample_id")
    return per_group.withColumns({c: F.round(c, 6) for c in ("y_mean", "total_mean")})


@REGISTRY.query(f"""with {CONTIGS}, r as (select sample_id, y, unnest(l) as contig from c)
select contig, count(*)::bigint as n_rows, count(distinct sample_id)::bigint as n_distinct, sum(y)::bigint as y_sum, count(y)::bigint as y_count,
  round(avg(y), 6) as y_mean, min(y)::bigint as y_min, max(y)::bigint as y_max from r group by contig""")
def p5_by_contig(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "images").select("sample_id", F.col("y").cast("long").alias("y"), F.explode(names.contigs_of(F.col("name"))).alias("contig"))
    per_contig = heavykeys.salted_aggregate(images, "contig", {"y": F.col("y")}, distinct="sample_id")
    return per_contig.withColumn("y_mean", F.round("y_mean", 6))
