"""Queries on image datasets, links, metrics, intervals and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.operators import breakpoints, contacts, dataset, features, links, metrics, report, scorer, simulate, training
from contactloom.functions import names
from contactloom.plans.contact_queries import UPPER, _cells, _sizes, _whole
from contactloom.plans.registry import Registry
from contactloom.sources.tables import table

REGISTRY = Registry()

#: each record once; repeated rows differ in loaded_at only
RECORDS = "i as (select * from images qualify row_number() over (partition by sample_id order by loaded_at desc nulls last) = 1)"
SUMS = RECORDS + ", s as (select *, list_sum(list_transform(x, lambda v: coalesce(v, 0)))::bigint as total from i where x is not null)"
JOINED = "array_to_string({}, ',')"
#: label and block score of each record
SCORED = RECORDS + """, sc as (
  select sample_id, y, source, x, least(coalesce(cross_ / nullif(own, 0), 0), 1) as prob from (
    select sample_id, y, source, x,
      list_sum([greatest(v, 0) for v, k in x if ((k - 1) // 20 < 10) <> ((k - 1) % 20 < 10)])::double as cross_,
      list_sum([greatest(v, 0) for v, k in x if ((k - 1) // 20 < 10) = ((k - 1) % 20 < 10)])::double as own
    from i where x is not null)),
ok as (select * from sc where y in (0, 1) and prob is not null)"""
CONFUSION = SCORED + """, cf as (
  select count(*) filter (where prob >= 0.5 and y = 1)::bigint as tp, count(*) filter (where prob >= 0.5 and y = 0)::bigint as fp,
    count(*) filter (where prob < 0.5 and y = 1)::bigint as fn, count(*) filter (where prob < 0.5 and y = 0)::bigint as tn from ok)"""
CURVE = SCORED + """, cv as (
  select prob, sum(sum(y)) over (order by prob desc) as tp, sum(sum(1 - y)) over (order by prob desc) as fp, sum(y) as p1, sum(1 - y) as n1,
    (select sum(y) from ok) as p, (select sum(1 - y) from ok) as n from ok group by prob)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.latest(table(spark, sf, "images"))


def _joined(images: DataFrame) -> DataFrame:
    return images.withColumn("x", F.array_join(F.col("x").cast("array<string>"), ","))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).where("x is not null").select("sample_id", "y", "source", "x", scorer.block_score(F.col("x")).alias("prob"))


@REGISTRY.query(f"with {RECORDS} select sample_id, name, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') as loaded from i")
def latest_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("sample_id", "name", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


@REGISTRY.query(f"with {RECORDS} select sample_id, name from i where image_size = 10 and bin_size = 25000")
def dataset_load(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.load(_records(spark, sf), 10, 25000).select("sample_id", "name")


@REGISTRY.query(f"with {SUMS} select sample_id, total from s where total > 0.5 * (select median(total) from s)")
def median_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = dataset.filtered(_records(spark, sf), 0.5)
    return kept.select("sample_id", dataset.image_sum(F.col("x")).alias("total"))


@REGISTRY.query(f"with {SUMS} select sample_id, total from s where total <= 700")
def absolute_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = dataset.filtered(_records(spark, sf), absolute=700, dump=False)
    return kept.select("sample_id", dataset.image_sum(F.col("x")).alias("total"))


@REGISTRY.query(f"with {RECORDS} select sample_id, name from i where contains(lower(name), 'alpha') and contains(lower(name), 'eps')")
def name_search(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.search(_records(spark, sf), "ALPHA", "eps").select("sample_id", "name")


@REGISTRY.query(f"with {RECORDS} select sample_id, name from i where name in (select name from i where split = 'test')")
def name_selection(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    return dataset.chosen(records, records.where("split = 'test'")).select("sample_id", "name")


@REGISTRY.query(f"""with {RECORDS}, t as (select sample_id, lower(regexp_replace(name, '\\s+', '', 'g')) as n from i)
select sample_id, case when contains(n, '|') then 'inter' when n is not null then 'intra' end as grp_type,
  case when regexp_matches(n, '^(.*)_([0-9]+)_c([23])$') then 'C' || right(n, 1) end as corner from t""")
def corner_split(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.with_type(_records(spark, sf)).select("sample_id", "grp_type", "corner")


@REGISTRY.query(f"""with {RECORDS}, c as (select x, min(sample_id) as class_id, count(*)::bigint as copies from i where x is not null group by x having count(*) > 1)
select sample_id, class_id, copies from i join c using (x)""")
def duplicate_images(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.duplicates(table(spark, sf, "images"))


@REGISTRY.query("select grp, count(distinct y)::bigint as labels from images where grp is not null group by grp having count(distinct y) > 1")
def group_label_check(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.mixed_label_groups(table(spark, sf, "images"))


@REGISTRY.query(f"with {RECORDS} select sample_id, name, case when name is null then grp else coalesce(min(grp) over (partition by name), grp) end as grp from i")
def fix_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.fixed_groups(_records(spark, sf))


@REGISTRY.query(f"""with {RECORDS}, a as (select * from i where bin_size = 5000), b as (select * from i where bin_size = 25000)
select sample_id, name, grp, y::bigint as y, 'fine' as dataset from a
union all select sample_id, name, grp + (select coalesce(max(grp), 0) + 1 from a), y::bigint, 'coarse' from b""")
def union_offset_groups(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    return _whole(dataset.united({"fine": records.where("bin_size = 5000"), "coarse": records.where("bin_size = 25000")}))


@REGISTRY.query(f"""with {SUMS}, e as (select min(total)::double as l, (max(total) - min(total)) / 100 as w from s)
select least(floor((total - l) / w), 99)::bigint as bin, round(l + least(floor((total - l) / w), 99) * w, 6) as low, count(*)::bigint as n from s, e group by 1, 2""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    sums = _records(spark, sf).where("x is not null").select(dataset.image_sum(F.col("x")).alias("total"))
    return _whole(dataset.histogram(sums, "total"))


@REGISTRY.query(f"""with {SUMS}, e as (select min(total)::double as l, (max(total) - min(total)) / 100 as w from s)
select sample_id, name, total, least(floor((total - l) / w), 99)::bigint as bin from s, e
qualify row_number() over (partition by bin order by name nulls first, sample_id) <= 20""")
def equalize_cap(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.equalised(_records(spark, sf), 20, seed=None)


@REGISTRY.query("""with g as (select grp, max(y)::bigint as y from images where grp is not null and y is not null group by grp),
r as (select *, row_number() over (partition by y order by md5('42:' || grp)) as k, ceil(count(*) over (partition by y) * (0.1::double + 0.05::double)) as held from g)
select grp, y, case when k <= ceil(held * (0.1::double / (0.1::double + 0.05::double))) then 'val' when k <= held then 'test' else 'train' end as split from r""")
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(dataset.group_split(table(spark, sf, "images"), val=0.1, test=0.05))


@REGISTRY.query("""with g as (select distinct grp from images where grp is not null),
r as (select *, row_number() over (order by md5('42:' || grp)) as k, count(*) over () as n from g)
select grp, case when k <= trunc(0.05::double * n) + 1 then 'test' when k <= trunc(0.05::double * n) + 1 + trunc(0.1::double * n) + 1 then 'val' else 'train' end as split from r""")
def group_split_legacy(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.group_split_legacy(table(spark, sf, "images"), val=0.1, test=0.05)


@REGISTRY.query(f"with {RECORDS} select sample_id, name from i order by md5('42:' || sample_id) limit 9")
def sample_draw(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.drawn(_records(spark, sf).select("sample_id", "name"), 9)


@REGISTRY.query(r"""select 'group' as kind, grp::varchar as value, count(distinct split)::bigint as splits from images where grp is not null and split is not null group by grp having count(distinct split) > 1
union all select 'name', n, count(distinct split)::bigint from (select lower(regexp_replace(name, '\s+', '', 'g')) as n, split from images where name is not null and split is not null) group by n having count(distinct split) > 1""")
def split_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and names that are in more than one split."""
    images = table(spark, sf, "images")
    groups = dataset.shared_between_splits(images, F.col("grp").cast("string")).select(F.lit("group").alias("kind"), "value", "splits")
    return groups.union(dataset.shared_between_splits(images, names.plain(F.col("name"))).select(F.lit("name").alias("kind"), "value", "splits"))


@REGISTRY.query(f"with {RECORDS} select split, count(*)::bigint as n, round(avg(y) * 100, 6) as positive from i where y in (0, 1) group by split")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(dataset.class_balance(table(spark, sf, "images")))


@REGISTRY.query("""with v as (select unnest(x) as v from images), c as (select v, sum(count(*)) over (order by v) as upto, (select count(v) from v) as t from v where v is not null group by v)
select round(greatest(lo + (place - floor(place)) * (hi - lo), 1.0), 6) as vmax from (
  select any_value(0.995 * (t - 1)) as place, min(v) filter (where upto > floor(0.995 * (t - 1)))::double as lo, min(v) filter (where upto > ceil(0.995 * (t - 1)))::double as hi from c)""")
def image_vmax(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(dataset.top_value(table(spark, sf, "images")))


@REGISTRY.query(f"with {RECORDS} select sample_id, array_to_string([v for v, k in x if (k - 1) % 20 < 6 and k - 1 < 120], ',') as x from i where x is not null")
def image_crop(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(dataset.cropped(_records(spark, sf).where("x is not null").select("sample_id", "x"), 20, 6))


@REGISTRY.query(f"with {RECORDS} select sample_id, array_to_string([case when (k - 1) // 20 < 3 or (k - 1) % 20 < 3 then -1 else v end for v, k in x], ',') as x from i where x is not null")
def border_mask(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).where("x is not null")
    return _joined(rows.select("sample_id", dataset.border_masked(F.col("x"), 20, 3).alias("x")))


@REGISTRY.query(f"""with {RECORDS} select sample_id, array_to_string([round(1e6 * case when v = -1 then -1 else least(greatest(v / 31.0, 0), 1) end)::bigint for v in x], ',') as x from i where x is not null""")
def minmax_clip(spark: SparkSession, sf: str) -> DataFrame:
    scaled = _records(spark, sf).where("x is not null").select("sample_id", dataset.minmax(F.col("x"), F.lit(31.0)).alias("x"))
    # in millionths
    return _joined(scaled.withColumn("x", F.transform("x", lambda v: F.round(v * 1e6).cast("long"))))


@REGISTRY.query(f"""with {UPPER}, {RECORDS},
v as (select resolution, ln(1 + cnt) as v from u where chrom1 = chrom2 and cnt > 0),
a as (select resolution, avg(v) as mean, stddev_pop(v) as std, min(v) as l, max(v) as g from v group by 1),
t as (select sample_id, len([v for v in x if v = -1])::bigint as padded,
  list_sum([case when v = -1 then 0.0 else coalesce((ln(1 + v) - l) / nullif(g - l, 0), 0) end for v in x])::double as total
  from i left join a on resolution = bin_size where x is not null)
select sample_id, padded, round(total, 4) as total from t""")
def zscore_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Images standardised by the contacts of their resolution; those without any give 0."""
    stats = contacts.whole_stats(_cells(spark, sf)).withColumnRenamed("resolution", "bin_size")
    rows = _records(spark, sf).where("x is not null").join(F.broadcast(stats), "bin_size", "left")
    scaled = rows.select("sample_id", dataset.standardised(F.col("x"), *map(F.col, ("mean", "std", "least", "greatest"))).alias("x"))
    padded = F.size(F.filter("x", lambda v: v == -1)).cast("long")
    # padding is -1
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) + padded
    return scaled.select("sample_id", padded.alias("padded"), F.round(total, 4).alias("total"))


@REGISTRY.query(f"with {SCORED} select sample_id, round(prob, 6) as prob from sc")
def block_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_scored(spark, sf).select("sample_id", "prob"))


@REGISTRY.query()
def cnn_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scorer.network_scores(_records(spark, sf))


@REGISTRY.query()
def feature_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the evaluation splits by a logistic regression over the training split."""
    images = _records(spark, sf)
    held = images.where(F.col("split").isin("val", "test"))
    scored = features.feature_scores(held, features.fitted(images.where("split = 'train'")))
    return scored.join(held.select("sample_id", "split", "y"), "sample_id")


@REGISTRY.query()
def trained_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the evaluation splits by a network trained on the training split."""
    images = _records(spark, sf)
    held = images.where(F.col("split").isin("val", "test"))
    scored = scorer.network_scores(held, network=training.trained(images.where("split = 'train'"), epochs=5))
    return scored.join(held.select("sample_id", "split", "y"), "sample_id")


@REGISTRY.query(f"with {SCORED} select sample_id, y::bigint as y, round(prob, 6) as prob from ok where (prob >= 0.5)::int <> y")
def misclassified(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(dataset.misclassified(_scored(spark, sf)).select("sample_id", "y", "prob"))


@REGISTRY.query(f"with {SUMS} select unnest([0.2, 0.4, 0.5, 0.6, 0.8])::double as quantile, round(unnest(quantile_cont(total, [0.2, 0.4, 0.5, 0.6, 0.8])), 6) as marker from s")
def quantile_markers(spark: SparkSession, sf: str) -> DataFrame:
    sums = _records(spark, sf).where("x is not null").select(dataset.image_sum(F.col("x")).alias("total"))
    return _whole(dataset.quantile_markers(sums, "total"))


@REGISTRY.query(f"with {CONFUSION} select * from cf")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf))


@REGISTRY.query(f"""with {CONFUSION},
d as (select tp::double as tp, fp::double as fp, fn::double as fn, tn::double as tn, (tp + fn)::double as p, (tn + fp)::double as n from cf)
select round((coalesce(tp / nullif(p, 0), 0) + coalesce(tn / nullif(n, 0), 0)) / 2, 6) as balanced_accuracy,
  round((p * coalesce(tp / nullif(tp + fp, 0), 0) + n * coalesce(tn / nullif(tn + fn, 0), 0)) / (p + n), 6) as weighted_precision,
  round((tp + tn) / (p + n), 6) as weighted_recall,
  round((p * 2 * tp / (2 * tp + fp + fn) + n * 2 * tn / (2 * tn + fn + fp)) / (p + n), 6) as weighted_f1,
  round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, 6) as macro_f1,
  round(coalesce(tn / nullif(tn + fn, 0), 0), 6) as npv from d""")
def weighted_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(metrics.scores(metrics.confusion(_scored(spark, sf))))


@REGISTRY.query(f"""with {CURVE} select round(sum(p1 * (n - fp) + p1 * n1 / 2)::double / (any_value(p) * any_value(n)), 6) as auc,
  round(sum(p1 * (n - fp) + p1 * n1 / 2)::double, 6) as u from cv""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(metrics.roc_auc(_scored(spark, sf)))


@REGISTRY.query(f"with {CURVE} select round(sum(p1 / p * tp / (tp + fp))::double, 6) as ap from cv")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(metrics.average_precision(_scored(spark, sf)))


@REGISTRY.query(f"with {CURVE} select round(prob, 6) as prob, round((tp / p)::double, 6) as tpr, round((fp / n)::double, 6) as fpr, round((tp / (tp + fp))::double, 6) as precision from cv")
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(metrics.curve_points(_scored(spark, sf)))


@REGISTRY.query(f"""with {SCORED}, r as (select y, (y = 1)::int as g, rank() over (order by prob) + (count(*) over (partition by prob) - 1) / 2 as k from ok),
c as (select count(*) filter (where g = 1)::double as n1, count(*) filter (where g = 0)::double as n2, sum(k) filter (where g = 1)::double as s from r),
t as (select sum(n * n * n - n) as ties from (select count(*)::double as n from ok group by prob))
select round(s - n1 * (n1 + 1) / 2, 6) as u, round((s - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5)
  / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) as z from c, t""")
def mann_whitney_u(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.usable(_scored(spark, sf)).withColumn("label", F.col("y").cast("string"))
    return _whole(metrics.mann_whitney(rows, "label", "prob", "1", "0").select("u", "z"))


@REGISTRY.query(f"""with {SCORED}, f as (select y, greatest(least(prob, 1 - 1e-7), 1e-7) as p from ok), g as (select y, case when y = 1 then p else 1 - p end as pt from f)
select round(avg(case when y = 1 then 1.0 else 1.2 end * (1 - pt) * -ln(pt)), 6) as loss from g""")
def focal_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.usable(_scored(spark, sf))
    return _whole(rows.agg(F.avg(metrics.focal_loss(F.col("y"), F.col("prob"))).alias("loss")))


@REGISTRY.query(f"""with {SCORED} select source, count(prob)::bigint as n, round(avg(prob), 6) as mean, round(min(prob), 6) as least, round(quantile_cont(prob, 0.25), 6) as q25,
  round(quantile_cont(prob, 0.5), 6) as q50, round(quantile_cont(prob, 0.75), 6) as q75, round(max(prob), 6) as greatest, round(stddev_samp(prob), 6) as std from sc group by source""")
def describe_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(metrics.described(_scored(spark, sf), "source", "prob"))


# links
VALID = "v as (select * from prob_net where prob is not null and not isnan(prob) qualify row_number() over (partition by link_id order by loaded_at) = 1)"
CANONICAL = VALID + """, c as (
  select resolution, case when sw then b else a end as a, case when sw then a else b end as b, case when sw then ob else oa end as oa, case when sw then oa else ob end as ob, avg(prob) as prob, count(*) as n
  from (select *, (a > b or (a = b and oa > ob)) as sw from v) group by 1, 2, 3, 4, 5)"""
ACROSS = CANONICAL + ", m as (select a, b, oa, ob, avg(prob) as prob from c group by 1, 2, 3, 4)"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return links.canonical(links.valid(table(spark, sf, "prob_net")))


@REGISTRY.query(f"with {CANONICAL} select resolution::bigint as resolution, a, b, oa, ob, round(prob, 6) as prob, n::bigint as n from c")
def pair_canonical_avg(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_links(spark, sf))


@REGISTRY.query(f"with {ACROSS} select a, b, oa, ob, round(prob, 6) as prob from m")
def resolution_avg(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(links.across_resolutions(_links(spark, sf)))


@REGISTRY.query(f"with {CANONICAL} select resolution::bigint as resolution, a, b, oa, ob, round(prob, 6) as prob from c where round(prob + 1e-9, 4) >= 0.3")
def edge_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(links.strong(_links(spark, sf), 0.3).drop("weight", "n"))


@REGISTRY.query(f"""with {ACROSS}, e as (select *, (oa = 'Start' and ob = 'End') as sw from m)
select case when sw then b else a end as a, case when sw then a else b end as b, case when sw then 'End-Start' else oa || '-' || ob end as type,
  case when oa = 'End' or sw then '+' else '-' end as sign_a, case when sw or ob = 'Start' then '+' else '-' end as sign_b, round(prob + 1e-9, 4) as weight from e""")
def orient_edges(spark: SparkSession, sf: str) -> DataFrame:
    return links.edges(links.across_resolutions(_links(spark, sf)))


@REGISTRY.query("""with l as (select a as node from prob_net union select b from prob_net),
n as (select node, case when regexp_matches(node, '^(.*):([0-9]+)-([0-9]+)$') then regexp_extract(node, '^(.*):([0-9]+)-([0-9]+)$', 1) else node end as chrom from l),
z as (select chrom, max(length) as length from chrom_sizes where chrom is not null and length is not null group by chrom)
select node, chrom from n union all select chrom || ':0-' || length, chrom from z where chrom not in (select chrom from n)""")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return links.nodes(table(spark, sf, "prob_net"), _sizes(spark, sf))


#: lines of the graph with nodes n (node, chrom) and edges ed (a, b, sign_a, sign_b, weight)
GFA = r"""select 0::bigint as rank, 'H' || chr(9) || 'VN:Z:1.0' as line
union all select 1, concat_ws(chr(9), 'S', node, '*', 'LN:i:' || coalesce(nullif(regexp_extract(node, '^(.*):([0-9]+)-([0-9]+)$', 3), '')::bigint - regexp_extract(node, '^(.*):([0-9]+)-([0-9]+)$', 2)::bigint, 0)) from nd
union all select 2, concat_ws(chr(9), 'L', a, sign_a, b, sign_b, '0M', 'FC:i:' || regexp_replace(printf('%.4f', weight), '(\.\d+?)0+$', '\1')) from ed where weight >= {least}"""
#: nodes and edges of the links m (a, b, oa, ob, prob)
GRAPH = """ed as (select case when oa = 'Start' and ob = 'End' then b else a end as a, case when oa = 'Start' and ob = 'End' then a else b end as b,
  case when oa = 'End' or ob = 'End' and oa = 'Start' then '+' else '-' end as sign_a, case when oa = 'Start' and ob = 'End' or ob = 'Start' then '+' else '-' end as sign_b,
  round(prob + 1e-9, 4) as weight from m),
nd as (with n as (select node, case when regexp_matches(node, '^(.*):([0-9]+)-([0-9]+)$') then regexp_extract(node, '^(.*):([0-9]+)-([0-9]+)$', 1) else node end as chrom
    from (select a as node from m union select b from m)),
  z as (select chrom, max(length) as length from chrom_sizes where chrom is not null and length is not null group by chrom)
  select node, chrom from n union all select chrom || ':0-' || length, chrom from z where chrom not in (select chrom from n))"""


@REGISTRY.query(f"with {ACROSS}, {GRAPH} {GFA.format(least=0.2)}")
def gfa_lines(spark: SparkSession, sf: str) -> DataFrame:
    merged = links.across_resolutions(_links(spark, sf))
    return _whole(links.gfa_lines(links.nodes(merged, _sizes(spark, sf)), links.edges(merged)))


@REGISTRY.query(f"""with {RECORDS}, p as (select split_part(name, '|', 1) as l, split_part(name, '|', 2) as r, (sample_id % 100) / 100 as prob from i where len(string_split(name, '|')) = 2)
select regexp_extract(l, '^(.*):([01])$', 1) as a, case when right(l, 1) = '0' then 'Start' else 'End' end as oa,
  regexp_extract(r, '^(.*):([01])$', 1) as b, case when right(r, 1) = '0' then 'Start' else 'End' end as ob, round(prob, 6) as prob
from p where regexp_matches(l, '^(.*):([0-9]+)-([0-9]+):([01])$') and regexp_matches(r, '^(.*):([0-9]+)-([0-9]+):([01])$')""")
def parse_link_names(spark: SparkSession, sf: str) -> DataFrame:
    samples = _records(spark, sf).select("name", (F.col("sample_id") % 100 / 100).alias("prob"))
    return _whole(links.scored_links(samples))


# intervals: line items as pieces of an order
INTERVALS = "t as (select distinct l_orderkey as q, l_partkey as s, l_partkey + l_quantity::bigint as e from lineitem)"
MAXIMAL = INTERVALS + ", x as (select * from t qualify coalesce(max(e) over (partition by q order by s, e desc rows between unbounded preceding and 1 preceding) < e, true))"


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e")
    )


@REGISTRY.query(f"with {INTERVALS} select q, s, e from t a where not exists (select 1 from t b where b.q = a.q and b.s <= a.s and b.e >= a.e and (b.s, b.e) <> (a.s, a.e))")
def interval_inclusion(spark: SparkSession, sf: str) -> DataFrame:
    return breakpoints.maximal_intervals(_intervals(spark, sf))


@REGISTRY.query(f"with {MAXIMAL} select q, n as s, e from (select *, lead(s) over (partition by q order by s) as n from x) where n <= e")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return breakpoints.overlaps(_intervals(spark, sf))


@REGISTRY.query(f"""with {MAXIMAL}, o as (select q, n as s, e from (select *, lead(s) over (partition by q order by s) as n from x) where n <= e),
b as (select q, s as bp from o union select q, e from o), z as (select q, max(e) as m from t group by q)
select q as name, bp from b join z using (q) where bp between 20 and m - 20""")
def alignment_breakpoints(spark: SparkSession, sf: str) -> DataFrame:
    longest = Window.partitionBy("q")
    paf = _intervals(spark, sf).select(
        F.col("q").alias("Q_name"), F.max("e").over(longest).alias("Q_len"), F.col("s").alias("Q_start"), F.col("e").alias("Q_end")
    )
    return breakpoints.breakpoints(paf, dead_zone=20)


@REGISTRY.query("""with p as (select user_id as name, event_id as bp from events), g as (select *, case when bp - lag(bp) over (partition by name order by bp) <= 150 then 0 else 1 end as new from p),
h as (select *, sum(new) over (partition by name order by bp rows unbounded preceding) as cluster from g)
select name, cluster::bigint as cluster, min(bp) as low, max(bp) as high, floor(avg(bp))::bigint as centre, count(*)::bigint as n from h group by name, cluster""")
def cluster_1d(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("bp"))
    return breakpoints.clusters(points, 150)


# sequences
@REGISTRY.query("""with z as (select chrom, max(length) as length from chrom_sizes where chrom is not null and length is not null group by chrom),
p as (select chrom, length, length // (length // 50000) as step, length // 50000 as n, unnest(generate_series(0, length // 50000 - 1)) as piece from z where length >= 50000)
select chrom, piece, piece * step as start, case when piece = n - 1 then length else (piece + 1) * step end as "end" from p""")
def contig_break(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.broken(contacts.sizes(_sizes(spark, sf)), 50_000)


@REGISTRY.query(r"""with p as (select doc_id as name, list_filter(string_split(replace(text, chr(10), 'NNNN'), 'NNN'), lambda s: s <> '') as a from documents where text is not null)
select name, unnest(generate_series(1, len(a))) as piece, unnest(a) as seq from p""")
def seq_split(spark: SparkSession, sf: str) -> DataFrame:
    # lines as contigs of a scaffold, with four N between them, of which one stays with the next
    return simulate.split_sequences(table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.replace("text", F.lit("\n"), F.lit("NNNN")).alias("seq")))


@REGISTRY.query("""with s as (select doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') as seq from documents where text is not null)
select doc_id, translate(reverse(seq), 'ACGT', 'TGCA') as seq from s""")
def reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.regexp_replace(F.upper("text"), "[^ACGTN]", "")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", simulate.reverse_complement(letters).alias("seq"))


@REGISTRY.query()
def simulate_chimeras(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.chimeras(contacts.sizes(_sizes(spark, sf)), 50_000, rounds=2)


# reports: priorities of orders as tools, years as data sets
TOOLS = """o as (select o_orderpriority as tool, cast(year(o_orderdate) as varchar) as dataset, round(sum(o_totalprice), 2) as value, count(*) as n from orders group by 1, 2)"""


def _tools(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("tool"), F.year("o_orderdate").cast("string").alias("dataset")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("n")
    )


@REGISTRY.query(f"with {TOOLS} select tool, dataset, round(value, 2) as value, (rank() over (partition by dataset order by value desc nulls last))::bigint as rank from o")
def tool_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(report.ranked(_tools(spark, sf), ["dataset"], "value").drop("n"))


@REGISTRY.query(f"with {TOOLS}, r as (select *, rank() over (partition by dataset order by value desc) as rank from o) select tool, round(avg(rank), 6) as mean_rank from r group by tool")
def mean_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(report.mean_ranks(report.ranked(_tools(spark, sf), ["dataset"], "value")))


@REGISTRY.query(f"with {TOOLS}, r as (select tool, dataset, n, lag(n) over (partition by tool order by dataset) as before from o) select tool, dataset, printf('%.2f%%', (n - before) / before * 100) as change from r where before is not null")
def relative_diff(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("n").over(Window.partitionBy("tool").orderBy("dataset"))
    rows = _tools(spark, sf).withColumn("_before", before).where("_before is not null")
    return rows.select("tool", "dataset", report.relative_difference(F.col("n"), F.col("_before")).alias("change"))


@REGISTRY.query("""with s as (select o_orderpriority as tool, o_orderstatus as dataset, hour(ts) * 3600 + minute(ts) * 60 + second(ts) as s, c_nationkey % 4 + 1 as threads
  from orders join customer on o_custkey = c_custkey join (select event_id, ts from events) on event_id = o_orderkey)
select tool, dataset, (sum(s * threads) // 3600)::bigint as hours from s group by 1, 2""")
def cpu_time(spark: SparkSession, sf: str) -> DataFrame:
    steps = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "events"), F.col("event_id") == F.col("o_orderkey"))
        .select(F.col("o_orderpriority").alias("tool"), F.col("o_orderstatus").alias("dataset"), F.date_format("ts", "HH:mm:ss").alias("time"),
                (F.col("c_nationkey") % 4 + 1).alias("threads"))
    )
    return report.cpu_hours(steps)


@REGISTRY.query("""with p as (select link_id, a, b from prob_net)
select distinct link_id, round((regexp_extract(b, '([0-9]+)-([0-9]+)$', 1)::double + regexp_extract(b, '([0-9]+)-([0-9]+)$', 2)::double) / 2
  - (regexp_extract(a, '([0-9]+)-([0-9]+)$', 1)::double + regexp_extract(a, '([0-9]+)-([0-9]+)$', 2)::double) / 2, 6) as gap from p""")
def gap_length(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(table(spark, sf, "prob_net").select("link_id", report.gap_length(F.col("a"), F.col("b")).alias("gap")).distinct())


@REGISTRY.query(f"with {TOOLS}, h as (select o_orderpriority as tool, avg(o_totalprice) as price from orders where o_orderstatus = 'F' group by 1) select tool, dataset, value, round(price, 4) as price from o full join h using (tool)")
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables of tools beside each other."""
    price = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("tool")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    return report.joined(_tools(spark, sf).drop("n"), price, ["tool"])


@REGISTRY.query("""with a as (select o_orderkey as key, max(case when o_orderstatus = 'F' then o_totalprice end) as value, max(o_orderpriority) as priority from orders group by 1),
b as (select event_id as key, max(value) as value, max(event_type) as event_type from events group by 1)
select key, coalesce(a.value, b.value) as value, priority, event_type from a full join b using (key)""")
def combine_first(spark: SparkSession, sf: str) -> DataFrame:
    price = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("value")
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("key")).agg(price, F.max("o_orderpriority").alias("priority"))
    events = table(spark, sf, "events").groupBy(F.col("event_id").alias("key")).agg(F.max("value").alias("value"), F.max("event_type").alias("event_type"))
    return report.combined_first(orders, events, ["key"])


@REGISTRY.query("""with w as (select c_mktsegment as segment, count(*)::double as n, sum(c_acctbal) as total, max(c_acctbal) as most from customer group by 1)
select segment, metric, round(value, 2) as value from (unpivot w on n, total, most into name metric value value)""")
def metric_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("c_acctbal").alias("total"), F.max("c_acctbal").alias("most")
    )
    return report.long_table(wide, ["segment"]).withColumn("value", F.round("value", 2))


@REGISTRY.query("""with o as (select lower(regexp_replace(new, '\\s+', '', 'g')) as new, min(lower(regexp_replace(old, '\\s+', '', 'g'))) as old from name_table where new is not null and old is not null group by 1),
z as (select chrom as contig, max(length) as length from chrom_sizes where chrom is not null and length is not null group by chrom union all select distinct trim(new), 0 from name_table where new is not null)
select coalesce(o.old, z.contig) as contig, length from z left join o on o.new = lower(regexp_replace(z.contig, '\\s+', '', 'g'))""")
def rename_contigs(spark: SparkSession, sf: str) -> DataFrame:
    table_ = table(spark, sf, "name_table")
    known = contacts.sizes(_sizes(spark, sf)).withColumnRenamed("chrom", "contig")
    new = table_.where("new is not null").select(F.trim("new").alias("contig")).distinct().withColumn("length", F.lit(0).cast("long"))
    return dataset.renamed(known.union(new), table_)


@REGISTRY.query("""with a as (select o_orderkey as key, o_totalprice as value from orders), b as (select event_id as key, value from events)
select key, value from b union all select key, value from a where key not in (select key from b where key is not null)""")
def dict_update(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    return dataset.updated(old, table(spark, sf, "events").select(F.col("event_id").alias("key"), "value"), "key")


@REGISTRY.query("""select o_orderpriority as tool, max(o_totalprice) filter (where o_orderstatus = 'F') as "F", max(o_totalprice) filter (where o_orderstatus = 'O') as "O" from orders group by 1""")
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    most = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("tool"), "o_orderstatus").agg(F.max("o_totalprice").alias("value"))
    return report.wide_table(most, ["tool"], "o_orderstatus", "value", ["F", "O"])


@REGISTRY.query("""select 'strong' as type, prob as value from prob_net where prob is not null and not isnan(prob) and prob >= 0.5
union all select 'weak', prob from prob_net where prob is not null and not isnan(prob) and prob < 0.5""")
def melt_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(~F.isnan("prob"), F.col("prob"))
    return report.melted(table(spark, sf, "prob_net"), {"strong": F.when(p >= 0.5, p), "weak": F.when(p < 0.5, p)})


@REGISTRY.query("""select event_id, case when f & 64 <> 0 then 1 else 2 end::bigint as mate from (select event_id, event_id % 256 as f from events) where f & 64 <> 0 or f & 128 <> 0""")
def read_mates(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "events").select("event_id", (F.col("event_id") % 256).alias("flag"))
    return _whole(contacts.mates(reads).select("event_id", "mate"))
