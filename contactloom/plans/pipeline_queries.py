"""Whole pipelines as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import contacts
from contactloom.plans import pipelines
from contactloom.plans.contact_queries import PIECES, POSITIONS, SEVENTHS, UPPER, WINDOW_CELLS, _sevenths, _sizes, _whole, merged_sql
from contactloom.plans.dataset_queries import GFA, GRAPH
from contactloom.plans.registry import Registry
from contactloom.sources.tables import table

REGISTRY = Registry()

#: parts of contigs: windows with contacts are scored, all others are empty and have the score 0
CORRECTED = POSITIONS + """,
sc as (select chrom, pos, sum(case when lo < pos and hi >= pos then 2 * cnt else 0 end)::double as cross_,
  sum(case when lo < pos and hi >= pos then 0 when lo = hi then cnt else 2 * cnt end)::double as own from w where resolution = 5000 group by 1, 2),
kp as (select chrom, pos from sc where least(coalesce(cross_ / nullif(own, 0), 0), 1) >= 0.05),
isl as (select chrom, min(pos) as s, max(pos) as e from (select *, pos - row_number() over (partition by chrom order by pos) as g from kp) group by chrom, g),
sp as (select chrom, 10 as f, length // 5000 - 10 as l, length from sz where length // 5000 >= 20),
il as (select isl.*, f, l, lag(e) over (partition by isl.chrom order by s) as pe from isl join sp on sp.chrom = isl.chrom),
cut as (select chrom, s as b0, case when e = l then e else e + 1 end as b1 from il union all select chrom, coalesce(pe + 1, f), s from il where s > coalesce(pe + 1, f)),
""" + merged_sql("cut", 20) + """,
frg as (select mp.chrom, case when b0 = sp.f then 0 else b0 * 5000 end as s, case when b1 = l and b0 = max(b0) over (partition by mp.chrom) then length else b1 * 5000 end as e from mp join sp on sp.chrom = mp.chrom)"""
#: links between the ends of pieces, by the block scores of their images, averaged over resolutions
LINKS = PIECES + """,
ow as (select resolution, piece, side, sum(case when d0 = d1 then cnt else 2 * cnt end) as own from wi group by 1, 2, 3),
cr as (select resolution, p1, s1, p2, s2, 2 * sum(cnt) as cross_ from bt group by 1, 2, 3, 4, 5),
pr as (select cr.*, least(coalesce(cross_::double / nullif(coalesce(a.own, 0) + coalesce(b.own, 0), 0), 0), 1) as prob from cr
  left join ow a on a.resolution = cr.resolution and a.piece = p1 and a.side = s1 left join ow b on b.resolution = cr.resolution and b.piece = p2 and b.side = s2),
m as (select p1 as a, p2 as b, case when s1 = 0 then 'Start' else 'End' end as oa, case when s2 = 0 then 'Start' else 'End' end as ob, avg(prob) as prob from pr group by 1, 2, 3, 4)"""


@REGISTRY.query(f'with recursive {CORRECTED} select chrom, s::bigint as start, e::bigint as "end" from frg')
def corrected_contigs(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.corrected_contigs(table(spark, sf, "pixels"), table(spark, sf, "chrom_sizes"))


@REGISTRY.query(f"with {UPPER}, frg as (select chrom, 0::bigint as s, 0::bigint as e from sz limit 0), {LINKS}, {GRAPH} {GFA.format(least=0.0)}")
def scaffolding_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(pipelines.scaffolding_graph(table(spark, sf, "pixels"), table(spark, sf, "chrom_sizes"))[2])


@REGISTRY.query(f"with recursive {CORRECTED}, {LINKS}, {GRAPH} {GFA.format(least=0.0)}")
def scaffolded(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run: contigs are corrected, and the graph is made of their parts."""
    return _whole(pipelines.scaffolded(table(spark, sf, "pixels"), table(spark, sf, "chrom_sizes")))


@REGISTRY.query(f"""with {WINDOW_CELLS},
g as (select chrom, row_number() over (order by md5('0:' || chrom)) as grp from (select distinct chrom from wc where resolution = 25000)),
br as (select distinct chrom1 as chrom, (bin1 // 50) * 50 + 25 as bin from u where resolution = 25000 and chrom1 <> chrom2),
im as (select chrom, pos, map_from_entries(list((r * 20 + c, cnt))) as m from wc where resolution = 25000 group by 1, 2 having sum(cnt) >= 3),
d as (select im.*, case when exists (select 1 from br where br.chrom = im.chrom and abs(br.bin - im.pos) <= 3) then 0 else 1 end as y from im),
x as (select *, list_transform(generate_series(0, 399), lambda i: coalesce(map_extract(m, i)[1], 0)) as x from d),
k as (select distinct chrom from d),
n as (select k.chrom, row_number() over (order by md5('0:' || k.chrom)) as grp from k)
select x.chrom || '_' || pos || '_C2' as name, grp, y::bigint as y, array_to_string(x, ',') as x, 10::bigint as image_size, 25000::bigint as bin_size from x join n on n.chrom = x.chrom
union all select x.chrom || '_' || pos || '_C3', grp, y::bigint, array_to_string(list_reverse(x), ','), 10, 25000 from x join n on n.chrom = x.chrom""")
def intra_dataset(spark: SparkSession, sf: str) -> DataFrame:
    pixels = table(spark, sf, "pixels")
    cells = contacts.upper(pixels.where("resolution = 25000"))
    breaks = cells.where("chrom1 <> chrom2").select(F.col("chrom1").alias("chrom"), F.expr("(bin1 div 50) * 50 + 25").alias("bin")).distinct()
    made = pipelines.intra_dataset(pixels, _sizes(spark, sf), 25000, breakpoints=breaks, least=3)
    return _whole(made.withColumn("x", F.array_join(F.col("x").cast("array<string>"), ",")))


@REGISTRY.query(f"""with {UPPER}, {SEVENTHS}, {PIECES},
s as (select resolution, p1, s1, p2, s2, sum(cnt) as n from bt where resolution = 5000 group by all having sum(cnt) >= 2),
g as (select p1, p2, row_number() over (order by md5('0:' || p1 || '|' || p2)) as grp from (select distinct p1, p2 from s)),
t as (select s.*, grp, 2 * n + coalesce((select sum(case when d0 = d1 then cnt else 2 * cnt end) from wi where wi.resolution = 5000 and piece = s.p1 and side = s.s1), 0)
    + coalesce((select sum(case when d0 = d1 then cnt else 2 * cnt end) from wi where wi.resolution = 5000 and piece = s.p2 and side = s.s2), 0) as total
  from s join g on g.p1 = s.p1 and g.p2 = s.p2)
select p1 || ':' || s1 || '|' || p2 || ':' || s2 as name, grp, 0::bigint as y, total::bigint as total from t
union all select p2 || ':' || s2 || '|' || p1 || ':' || s1, grp, 0, total::bigint from t""")
def inter_dataset(spark: SparkSession, sf: str) -> DataFrame:
    made = pipelines.inter_dataset(table(spark, sf, "pixels"), _sizes(spark, sf), 5000, fragments=_sevenths(spark, sf), least=2)
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + F.greatest(v, F.lit(0)))
    return _whole(made.select("name", "grp", "y", total.alias("total")))


@REGISTRY.query(f"""with {UPPER},
q as (select * from u where resolution = 5000 and chrom1 <> chrom2 and chrom1 in (select chrom from sz where length >= 50000) and chrom2 in (select chrom from sz where length >= 50000)),
b as (select chrom1, chrom2, bin1 // 100 as block1, bin2 // 100 as block2, sum(cnt) as total from q group by 1, 2, 3, 4),
k as (select * from (select *, max(total) over (partition by chrom1, chrom2) as most from b) where total * 2 >= most),
s as (select q.chrom1, q.chrom2, k.block1, k.block2, (bin1 % 100) // 25 as sub1, (bin2 % 100) // 25 as sub2, sum(cnt) as total
  from q join k on q.chrom1 = k.chrom1 and q.chrom2 = k.chrom2 and bin1 // 100 = block1 and bin2 // 100 = block2
  where (bin1 % 100) % 25 < 20 and (bin2 % 100) % 25 < 20 group by all),
h as (select chrom1, chrom2, block1 * 100 + sub1 * 25 as s1, block2 * 100 + sub2 * 25 as s2 from s qualify row_number() over (partition by chrom1, chrom2, block1, block2 order by total desc, sub1, sub2) = 1),
p as (select chrom1, s1 + k1 as pos1, chrom2, s2 + k2 as pos2 from h, (values (0), (5)) a(k1), (values (0), (5)) c(k2)),
a as (select p.*, bin1 - pos1 as r, 10 + bin2 - pos2 as c, cnt from p join q on q.chrom1 = p.chrom1 and q.chrom2 = p.chrom2 and bin1 between pos1 and pos1 + 9 and bin2 between pos2 and pos2 + 9 where cnt > 0),
im as (select distinct chrom1, pos1, chrom2, pos2 from a),
e as (select * from a
  union all select im.*, bin1 - pos1, bin2 - pos1, cnt from im join u on u.resolution = 5000 and u.chrom1 = im.chrom1 and u.chrom2 = im.chrom1 and bin1 >= pos1 and bin2 < pos1 + 10 where cnt > 0
  union all select im.*, 10 + bin1 - pos2, 10 + bin2 - pos2, cnt from im join u on u.resolution = 5000 and u.chrom1 = im.chrom2 and u.chrom2 = im.chrom2 and bin1 >= pos2 and bin2 < pos2 + 10 where cnt > 0)
select chrom1, pos1::bigint as pos1, chrom2, pos2::bigint as pos2, r::bigint as r, c::bigint as c, cnt from e""")
def hotspot_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of images placed where two contigs touch most."""
    return _whole(pipelines.hotspot_cells(table(spark, sf, "pixels"), _sizes(spark, sf), 5000, block=100, size=20, stride=25, steps=5))


@REGISTRY.query()
def simulated_breakpoints(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.found_breakpoints(table(spark, sf, "chrom_sizes"))
