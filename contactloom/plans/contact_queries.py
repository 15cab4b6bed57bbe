"""Queries on contact maps, windows, ends and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.operators import contacts, ends, segment, windows
from contactloom.plans.registry import Registry
from contactloom.sources.tables import table

REGISTRY = Registry()

#: cells of the upper triangle, each once
UPPER = """u as (
  select resolution,
    case when (chrom1, bin1) > (chrom2, bin2) then chrom2 else chrom1 end as chrom1,
    case when (chrom1, bin1) > (chrom2, bin2) then bin2 else bin1 end as bin1,
    case when (chrom1, bin1) > (chrom2, bin2) then chrom1 else chrom2 end as chrom2,
    case when (chrom1, bin1) > (chrom2, bin2) then bin1 else bin2 end as bin2,
    sum(cnt)::bigint as cnt
  from (select distinct * from pixels where resolution is not null and chrom1 is not null and bin1 is not null
        and chrom2 is not null and bin2 is not null and cnt is not null)
  group by 1, 2, 3, 4, 5),
sz as (select chrom, max(length) as length from chrom_sizes where chrom is not null and length is not null group by chrom)"""
#: cells near the diagonal with all window positions they belong to
POSITIONS = UPPER + """, w as (
  select resolution, chrom, unnest(generate_series(greatest(hi - 9, 10), least(lo + 10, length // resolution - 10))) as pos, lo, hi, cnt
  from (select resolution, chrom1 as chrom, bin1::bigint as lo, bin2::bigint as hi, cnt from u where chrom1 = chrom2 and bin2 - bin1 <= 19)
  join sz using (chrom)
  where greatest(hi - 9, 10) <= least(lo + 10, length // resolution - 10))"""
#: scores along a contig, from events: the contig is the user, the bin the place of an event from 10 on
SERIES = """s as (
  select user_id as chrom, 9 + row_number() over (partition by user_id order by ts, event_id) as bin,
    least(value / 100, 1.0) as p2,
    coalesce(lag(least(value / 100, 1.0)) over (partition by user_id order by ts, event_id), least(value / 100, 1.0)) as p3
  from events where user_id is not null and value is not null),
m as (select chrom, bin, (p2 + p3) / 2 as p from s),
rg as (
  select user_id as chrom, 9 + n as b from (
    select user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as n
    from events where user_id is not null and value is not null) where event_type = 'error' and value > 60)"""
MASKED = SERIES + """, k as (
  select m.chrom, m.bin, p, exists (select 1 from rg where rg.chrom = m.chrom and m.bin between rg.b - 1 and rg.b + 1) as masked from m)"""
RUNS = MASKED + """, f as (select *, (p >= 0.1 or masked) as keep from k),
g as (select *, case when lag(keep) over (partition by chrom order by bin) = keep then 0 else 1 end as new from f),
h as (select *, sum(new) over (partition by chrom order by bin) as run from g),
r as (select chrom, run, min(bin) as b0, max(bin) as last, any_value(keep) as keep from h group by chrom, run),
parts as (
  select chrom, row_number() over (partition by chrom order by run) as part_id, not keep as chimeric, b0, coalesce(next, last) as b1
  from (select *, lead(b0) over (partition by chrom order by run) as next from r) where next is not null or keep)"""
_INTEGERS = "bigint"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.upper(table(spark, sf, "pixels"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chrom_sizes")


def _whole(df: DataFrame) -> DataFrame:
    """All integers as BIGINT and doubles to six digits, so that engines agree."""
    change = {n: F.col(n).cast(_INTEGERS) for n, t in df.dtypes if t in ("int", "smallint", "tinyint")}
    change |= {n: F.round(n, 6) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(change) if change else df


@REGISTRY.query("""
with p as (
  select 's' || (l_suppkey % 20) as a, l_partkey * 100 as pa, 's' || l_linenumber as b, (l_quantity * 1000)::bigint as pb
  from lineitem where l_returnflag <> 'A'),
q as (select r, a, pa // r as ba, b, pb // r as bb from p, (values (5000), (10000), (25000)) t(r))
select r::bigint as resolution,
  case when (a, ba) > (b, bb) then b else a end as chrom1, (case when (a, ba) > (b, bb) then bb else ba end)::bigint as bin1,
  case when (a, ba) > (b, bb) then a else b end as chrom2, (case when (a, ba) > (b, bb) then ba else bb end)::bigint as bin2,
  count(*)::bigint as cnt
from q group by all""")
def contact_binning(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "lineitem").select(
        F.format_string("s%d", F.col("l_suppkey") % 20).alias("chrom1"), (F.col("l_partkey") * 100).alias("pos1"),
        F.format_string("s%d", F.col("l_linenumber")).alias("chrom2"), (F.col("l_quantity") * 1000).cast("long").alias("pos2"),
        F.when(F.col("l_returnflag") == "A", 1024).otherwise(0).alias("flag"),
    )
    return _whole(contacts.binned(reads, [5000, 10000, 25000]))



@REGISTRY.query(f"with {UPPER} select resolution::bigint as resolution, chrom1, bin1::bigint as bin1, chrom2, bin2::bigint as bin2, cnt from u")
def upper_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_cells(spark, sf))


@REGISTRY.query(f"""with {UPPER}
select resolution::bigint as resolution, chrom1, bin1::bigint as bin1, chrom2, bin2::bigint as bin2, cnt from u
union all
select resolution::bigint, chrom2, bin2::bigint, chrom1, bin1::bigint, cnt from u where (chrom1, bin1) <> (chrom2, bin2)""")
def symmetrise(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(contacts.symmetrised(_cells(spark, sf)))


@REGISTRY.query(f"""with {UPPER}
select (resolution * 5)::bigint as resolution, chrom1, (bin1 // 5)::bigint as bin1, chrom2, (bin2 // 5)::bigint as bin2, sum(cnt)::bigint as cnt
from u where resolution = 5000 group by 1, 2, 3, 4, 5""")
def coarsen_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(contacts.coarsened(_cells(spark, sf).where("resolution = 5000"), 5))


@REGISTRY.query(f"""with {UPPER}
select resolution::bigint as resolution, chrom1, bin1::bigint as bin1, bin2::bigint as bin2, cnt from u
where resolution = 5000 and chrom1 = 'super_alpha' and chrom2 = 'super_alpha' and bin1 >= 100 and bin1 < 400 and bin2 >= 100 and bin2 < 400""")
def region_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(contacts.region(_cells(spark, sf), 5000, "super_alpha", 100, 400).drop("chrom2"))


@REGISTRY.query(f"""with {POSITIONS}
select resolution::bigint as resolution, chrom, pos, sum(case when lo = hi then cnt else 2 * cnt end)::bigint as total
from w group by 1, 2, 3 having sum(cnt) >= 1""")
def window_sums(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(windows.window_sums(_cells(spark, sf), _sizes(spark, sf)))


@REGISTRY.query(f"""with {UPPER},
ev as (select resolution, chrom, unnest([f, t + 1]) as first, unnest([v, -v]) as v from (
  select resolution, chrom1 as chrom, greatest(bin2 - 9, 10)::bigint as f, least(bin1 + 10, length // resolution - 10)::bigint as t,
    case when bin1 = bin2 then cnt else 2 * cnt end as v from u join sz on chrom = chrom1 where chrom1 = chrom2 and bin2 - bin1 <= 19) where f <= t),
li as (select resolution, chrom, unnest([10, length // resolution - 9])::bigint as first from sz, (select distinct resolution from u) where length // resolution >= 20),
ch as (select resolution, chrom, first, sum(v) as v from (
  select *, false as e from ev union all select resolution, chrom, first, 0, true from li) group by 1, 2, 3 having sum(v) <> 0 or bool_or(e))
select resolution::bigint as resolution, chrom, first, last, total::bigint as total from (
  select resolution, chrom, first, lead(first) over w - 1 as last, sum(v) over w as total from ch window w as (partition by resolution, chrom order by first)) where last is not null""")
def window_sums_all(spark: SparkSession, sf: str) -> DataFrame:
    """All windows, with contacts or without, as runs of positions with equal sums."""
    return _whole(windows.window_sum_runs(_cells(spark, sf), _sizes(spark, sf)))


WINDOW_CELLS = POSITIONS + """, wc as (
  select resolution::bigint as resolution, chrom, pos, lo - pos + 10 as r, hi - pos + 10 as c, cnt from w
  union all select resolution::bigint, chrom, pos, hi - pos + 10, lo - pos + 10, cnt from w where lo <> hi)"""


@REGISTRY.query(f"with {WINDOW_CELLS} select * from wc")
def window_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(windows.window_cells(_cells(spark, sf), _sizes(spark, sf)))


@REGISTRY.query(f"with {WINDOW_CELLS} select resolution, chrom, pos, 19 - r as r, 19 - c as c, cnt from wc")
def corner_rotate(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(windows.rotated(windows.window_cells(_cells(spark, sf), _sizes(spark, sf))))


@REGISTRY.query(f"""with {WINDOW_CELLS}
select resolution, chrom, pos, array_to_string(list_transform(generate_series(0, 399), lambda i: coalesce(map_extract(m, i)[1], 0)), ',') as x
from (select resolution, chrom, pos, map_from_entries(list((r * 20 + c, cnt))) as m from wc group by 1, 2, 3)""")
def window_images(spark: SparkSession, sf: str) -> DataFrame:
    made = windows.images(windows.window_cells(_cells(spark, sf), _sizes(spark, sf)))
    return _whole(made.withColumn("x", F.array_join(F.col("x").cast("array<string>"), ",")))


@REGISTRY.query(f"""with {UPPER},
b as (select distinct chrom1 as chrom, (bin1 // 50) * 50 + 25 as bin from u where resolution = 5000 and chrom1 <> chrom2),
p as (select distinct chrom1 as chrom, bin1::bigint as pos from u where resolution = 5000 and chrom1 = chrom2)
select chrom, pos, (case when exists (select 1 from b where b.chrom = p.chrom and abs(b.bin - p.pos) <= 3) then 0 else 1 end)::bigint as y from p""")
def breakpoint_label(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf).where("resolution = 5000")
    breaks = cells.where("chrom1 <> chrom2").select(F.col("chrom1").alias("chrom"), F.expr("(bin1 div 50) * 50 + 25").alias("bin")).distinct()
    at = cells.where("chrom1 = chrom2").select(F.col("chrom1").alias("chrom"), F.col("bin1").cast("long").alias("pos")).distinct()
    return _whole(windows.labelled(at, breaks))


def _weighted_quantile(counts: str, q: float) -> str:
    """The q-quantile by linear interpolation of values v that occur n times, in SQL."""
    return f"""
cum as (select resolution, v, sum(n) over (partition by resolution order by v) as upto, sum(n) over (partition by resolution) as total
        from (select resolution, v, sum(n) as n from ({counts}) group by 1, 2) where n > 0),
places as (select distinct resolution, {q} * (total - 1) as place from cum)
select resolution::bigint as resolution, round(lo + (place - floor(place)) * (hi - lo), 6) as quantile from (
  select places.resolution, place,
    min(v) filter (where upto > floor(place))::double as lo, min(v) filter (where upto > ceil(place))::double as hi
  from places join cum using (resolution) group by 1, 2)"""


BAND_COUNTS = """
  select resolution, cnt as v, case when bin1 = bin2 then 1 else 2 end as n from u where chrom1 = chrom2 and bin2 - bin1 <= 10
  union all
  select a.resolution, 0, a.n - coalesce(b.n, 0) from
    (select resolution, sum(n + 2 * (select sum(greatest(n - k, 0)) from generate_series(1, 10) t(k))) as n
     from (select resolution, (length + resolution - 1) // resolution as n from sz, (select distinct resolution from u)) group by 1) a
    left join (select resolution, sum(case when bin1 = bin2 then 1 else 2 end) as n from u where chrom1 = chrom2 and bin2 - bin1 <= 10 group by 1) b using (resolution)"""


@REGISTRY.query(f"with {UPPER}, {_weighted_quantile(BAND_COUNTS, 0.9999)}")
def diag_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(contacts.diagonal_quantile(_cells(spark, sf), _sizes(spark, sf), 10, 0.9999))


@REGISTRY.query(
    f"with {UPPER}, "
    + _weighted_quantile("select resolution, cnt as v, case when bin1 = bin2 then 1 else 2 end as n from u where chrom1 = chrom2 and cnt > 0", 0.95)
)
def nonzero_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(contacts.nonzero_quantile(_cells(spark, sf), 0.95))


@REGISTRY.query(f"""with {UPPER},
v as (select resolution, ln(1 + cnt) as v from u where chrom1 = chrom2 and cnt > 0),
a as (select resolution, avg(v) as mean, stddev_pop(v) as std, min(v) as l, max(v) as g from v group by 1)
select resolution::bigint as resolution, round(mean, 6) as mean, round(std, 6) as std, round((l - mean) / std, 6) as least, round((g - mean) / std, 6) as greatest from a""")
def whole_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(contacts.whole_stats(_cells(spark, sf)))


@REGISTRY.query(f"""with {UPPER}
select resolution::bigint as resolution, chrom1, chrom2, (bin1 // 10)::bigint as block1, (bin2 // 10)::bigint as block2, sum(cnt)::bigint as total
from u group by 1, 2, 3, 4, 5""")
def block_sums(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(contacts.block_sums(_cells(spark, sf), 10))


@REGISTRY.query(f"""with {UPPER},
b as (select resolution, chrom1, chrom2, bin1 // 100 as block1, bin2 // 100 as block2, sum(cnt) as total from u where chrom1 <> chrom2 group by 1, 2, 3, 4, 5),
k as (select * from (select *, max(total) over (partition by resolution, chrom1, chrom2) as most from b) where total * 2 >= most),
s as (select u.resolution, u.chrom1, u.chrom2, k.block1, k.block2, (bin1 % 100) // 25 as sub1, (bin2 % 100) // 25 as sub2, sum(cnt) as total
  from u join k on u.resolution = k.resolution and u.chrom1 = k.chrom1 and u.chrom2 = k.chrom2 and bin1 // 100 = block1 and bin2 // 100 = block2
  where (bin1 % 100) % 25 < 20 and (bin2 % 100) % 25 < 20 group by all)
select resolution::bigint as resolution, chrom1, chrom2, block1::bigint as block1, block2::bigint as block2, sub1::bigint as sub1, sub2::bigint as sub2, total::bigint as total
from s qualify row_number() over (partition by resolution, chrom1, chrom2, block1, block2 order by total desc, sub1, sub2) = 1""")
def hotspot_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(contacts.hotspots(_cells(spark, sf), 100, 20, 25))


FRAGMENTS = """fr as (
  select distinct regexp_extract(a, '^(.*):([0-9]+)-([0-9]+)$', 1) as chrom, regexp_extract(a, '^(.*):([0-9]+)-([0-9]+)$', 2)::bigint as s,
    regexp_extract(a, '^(.*):([0-9]+)-([0-9]+)$', 3)::bigint as e from prob_net where regexp_matches(a, '^(.*):([0-9]+)-([0-9]+)$'))"""


def _fragments(spark: SparkSession, sf: str) -> DataFrame:
    return ends.parsed_fragments(table(spark, sf, "prob_net").select(F.col("a").alias("line")).distinct()).drop("name")


@REGISTRY.query(f"with {FRAGMENTS} select chrom, s as start, e as \"end\", s // 25000 as bin0, e // 25000 as bin1 from fr where e // 25000 - s // 25000 >= 4")
def min_size_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(ends.large_enough(_fragments(spark, sf), 25000))


@REGISTRY.query(f"""with {FRAGMENTS}, {UPPER}
select chrom, s // 25000 as bin0, e // 25000 as bin1 from fr where e // 25000 - s // 25000 >= 4
union all
select chrom, 0, length // 25000 from sz where length // 25000 >= 4 and chrom not in (select chrom from fr)""")
def unseen_contigs_anti(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(ends.with_unseen(_fragments(spark, sf), _sizes(spark, sf), 25000))


@REGISTRY.query(f"with {UPPER} select resolution::bigint as resolution, chrom1, chrom2, sum(cnt)::bigint as contacts from u where chrom1 <> chrom2 and cnt > 0 group by 1, 2, 3")
def fragment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(ends.touching_pairs(_cells(spark, sf)))


@REGISTRY.query(f"""with {UPPER},
p as (select resolution, chrom1, bin1 // 40 * 40 as a0, chrom2, bin2 // 40 * 40 as b0, sum(cnt) as contacts from u where cnt > 0 group by all)
select resolution::bigint as resolution, chrom1, a0::bigint as a0, chrom2, b0::bigint as b0, contacts::bigint as contacts from p
where not (chrom1 = chrom2 and abs(b0 - a0) <= 40)""")
def noncontiguous_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(ends.touching_pieces(_cells(spark, sf), 40))


@REGISTRY.query(f"""with {UPPER},
p as (select chrom, length // 25000 - 40 as last, unnest(generate_series(0, length // 25000 - 120, 40)) as a0 from sz where length // 25000 >= 120)
select chrom, a0, a0 + 80 as b_first, last // 40 * 40 as b_last, (last // 40 * 40 - a0 - 80) // 40 + 1 as pairs from p""")
def noncontiguous_pairs_all(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of pieces of one contig that do not touch, with contacts or without, as one range per piece."""
    return _whole(ends.noncontiguous_ranges(_sizes(spark, sf), 25000, 40))


SUB_POSITIONS = f"with {UPPER} select chrom, unnest(generate_series(0, length // 25000 - 20, 20)) as bin0, bin0 + 20 as bin1 from sz where length // 25000 >= 20"


@REGISTRY.query(SUB_POSITIONS)
def sub_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(ends.sub_positions(_sizes(spark, sf), 25000, 20))


@REGISTRY.query(SUB_POSITIONS)
def sub_positions_all(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(ends.sub_positions(_sizes(spark, sf), 25000, 20))


END_PAIRS = UPPER + """,
e as (select chrom, resolution, length // resolution as n, side from sz, (select distinct resolution from u), (values (0), (1)) t(side)),
x as (
  select u.resolution, chrom1, e1.side as side1, chrom2, e2.side as side2,
    9 - (case when e1.side = 0 then bin1 else e1.n - 1 - bin1 end) as r, 10 + (case when e2.side = 0 then bin2 else e2.n - 1 - bin2 end) as c, cnt
  from u join e e1 on e1.chrom = chrom1 and e1.resolution = u.resolution join e e2 on e2.chrom = chrom2 and e2.resolution = u.resolution
  where chrom1 <> chrom2 and cnt > 0
    and (case when e1.side = 0 then bin1 else e1.n - 1 - bin1 end) between 0 and least(e1.n, 10) - 1
    and (case when e2.side = 0 then bin2 else e2.n - 1 - bin2 end) between 0 and least(e2.n, 10) - 1),
pr as (select distinct resolution, chrom1, side1, chrom2, side2 from x),
i as (
  select u.resolution, e.chrom, e.side, case when side = 0 then bin1 else n - 1 - bin1 end as da, case when side = 0 then bin2 else n - 1 - bin2 end as db, cnt
  from u join e on e.chrom = chrom1 and e.resolution = u.resolution where chrom1 = chrom2 and cnt > 0),
j as (select resolution, chrom, side, least(da, db) as d0, greatest(da, db) as d1, cnt from i join sz using (chrom)
  where least(da, db) >= 0 and greatest(da, db) < least(length // resolution, 10)),
ep as (
  select * from x
  union all select pr.*, 9 - d1, 9 - d0, cnt from pr join j on j.resolution = pr.resolution and j.chrom = chrom1 and j.side = side1
  union all select pr.*, 10 + d0, 10 + d1, cnt from pr join j on j.resolution = pr.resolution and j.chrom = chrom2 and j.side = side2)"""


@REGISTRY.query(f"with {END_PAIRS} select resolution::bigint as resolution, chrom1, side1::bigint as side1, chrom2, side2::bigint as side2, r::bigint as r, c::bigint as c, cnt from ep")
def end_pair_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(ends.end_pair_cells(_cells(spark, sf), _sizes(spark, sf)))


@REGISTRY.query(f"""with {END_PAIRS}
select resolution::bigint as resolution, chrom1, side1::bigint as side1, chrom2, side2::bigint as side2,
  sum(case when r = c then cnt else 2 * cnt end)::bigint as total from ep group by 1, 2, 3, 4, 5""")
def end_pair_sums(spark: SparkSession, sf: str) -> DataFrame:
    cells = ends.end_pair_cells(_cells(spark, sf), _sizes(spark, sf))
    twice = F.when(F.col("r") == F.col("c"), F.col("cnt")).otherwise(2 * F.col("cnt"))
    return _whole(cells.groupBy("resolution", "chrom1", "side1", "chrom2", "side2").agg(F.sum(twice).alias("total")))


#: seven even fragments of each contig, but for those that begin with u, which no fragment mentions
SEVENTHS = "frg as (select chrom, length * k // 7 as s, length * (k + 1) // 7 as e from sz, (select unnest(generate_series(0, 6)) as k) where chrom not like 'u%')"
#: pieces of fragments and of contigs without any, their end bins, and cells between and within them
PIECES = """rs as (select distinct resolution from u),
pc as materialized (select resolution, chrom || ':' || s || '-' || e as piece, chrom, s // resolution as bin0, e // resolution as bin1 from (
  select distinct chrom, s, e from frg union all select chrom, 0, length from sz where chrom not in (select chrom from frg)), rs where e // resolution - s // resolution >= 4),
eb as (select resolution, chrom, piece, side, d, case when side = 0 then bin0 + d else bin1 - 1 - d end as bin
  from (select *, unnest(generate_series(0, least(bin1 - bin0, 10) - 1)) as d from pc), (values (0), (1)) t(side)),
pe as materialized (select u.resolution, a.piece as p1, a.side as s1, a.d as d1, b.piece as p2, b.side as s2, b.d as d2, cnt,
    case when a.piece < b.piece then -1 when a.piece > b.piece then 1 else 0 end as turn
  from u join eb a on a.resolution = u.resolution and a.chrom = chrom1 and a.bin = bin1 join eb b on b.resolution = u.resolution and b.chrom = chrom2 and b.bin = bin2 where cnt > 0),
bt as (select resolution, p1, s1, d1, p2, s2, d2, cnt from pe where turn = -1 union all select resolution, p2, s2, d2, p1, s1, d1, cnt from pe where turn = 1),
pp as (select distinct resolution, p1, s1, p2, s2 from bt),
wi as (select resolution, p1 as piece, s1 as side, least(d1, d2) as d0, greatest(d1, d2) as d1, cnt from pe where turn = 0 and s1 = s2)"""


@REGISTRY.query(f"""with {UPPER}, {SEVENTHS}, {PIECES},
x as (select resolution, p1, s1, p2, s2, 9 - d1 as r, 10 + d2 as c, cnt from bt
  union all select pp.*, 9 - d1, 9 - d0, cnt from pp join wi on wi.resolution = pp.resolution and piece = p1 and side = s1
  union all select pp.*, 10 + d0, 10 + d1, cnt from pp join wi on wi.resolution = pp.resolution and piece = p2 and side = s2),
m as materialized (select resolution, p1, s1, p2, s2, map_from_entries(list((k, cnt))) as m from (
  select resolution, p1, s1, p2, s2, r * 20 + c as k, cnt from x union all select resolution, p1, s1, p2, s2, c * 20 + r, cnt from x where r <> c) group by all)
select m.resolution::bigint as resolution, p1 || ':' || s1 || '|' || p2 || ':' || s2 as name, array_to_string(list_transform(generate_series(0, 399), lambda i: case
  when i // 20 < 10 and 9 - i // 20 >= a.bin1 - a.bin0 or i // 20 >= 10 and i // 20 - 10 >= b.bin1 - b.bin0
    or i % 20 < 10 and 9 - i % 20 >= a.bin1 - a.bin0 or i % 20 >= 10 and i % 20 - 10 >= b.bin1 - b.bin0 then -1 else coalesce(map_extract(m, i)[1], 0) end), ',') as x
from m join pc a on a.resolution = m.resolution and a.piece = p1 join pc b on b.resolution = m.resolution and b.piece = p2""")
def fragment_end_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images of the ends of fragments; what lies beyond a short one is padding."""
    cells = _cells(spark, sf)
    fragments = _sevenths(spark, sf)
    pieces = ends.fragment_pieces(fragments, _sizes(spark, sf), cells)
    made = ends.piece_pair_images(ends.piece_pair_cells(cells, pieces), pieces)
    return _whole(made.select("resolution", "name", F.array_join(F.col("x").cast("array<string>"), ",").alias("x")))


def _sevenths(spark: SparkSession, sf: str) -> DataFrame:
    sizes = contacts.sizes(_sizes(spark, sf)).where("chrom not like 'u%'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return sizes.select("chrom", F.expr("length * k div 7").alias("start"), F.expr("length * (k + 1) div 7").alias("end"))


@REGISTRY.query(f"""with {UPPER}, {FRAGMENTS},
z as (select chrom, s // 25000 as bin0, e // 25000 as bin1, min(chrom || ':' || s || '-' || e) as line from fr group by 1, 2, 3),
p as (select chrom, length, unnest(generate_series(0, length // 25000 - 20, 20)) as bin0, bin0 + 20 as bin1 from sz where length // 25000 >= 20
  union all select chrom, length, 0, length // 25000 from sz)
select p.chrom, p.bin0, p.bin1, coalesce(line, p.chrom || ':' || (p.bin0 * 25000) || '-' || (case when length // 25000 = p.bin1 then length else p.bin1 * 25000 end)) as name
from p left join z on z.chrom = p.chrom and z.bin0 = p.bin0 and z.bin1 = p.bin1""")
def base_names(spark: SparkSession, sf: str) -> DataFrame:
    """The names in bp of pieces in bins: those of the corrected contigs where there are any."""
    sizes = contacts.sizes(_sizes(spark, sf))
    pieces = ends.sub_positions(_sizes(spark, sf), 25000, 20).union(sizes.select("chrom", F.lit(0).cast("long"), F.expr("length div 25000")))
    lines = table(spark, sf, "prob_net").select(F.col("a").alias("line")).distinct()
    named = ends.named_pieces(lines, pieces.join(sizes, "chrom").withColumn("resolution", F.lit(25000)))
    return _whole(named.select("chrom", "bin0", "bin1", "name"))


def _series(spark: SparkSession, sf: str) -> DataFrame:
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = F.least(F.col("value") / 100, F.lit(1.0))
    events = table(spark, sf, "events").where("user_id is not null and value is not null")
    return events.select(
        F.col("user_id").alias("chrom"), (9 + F.row_number().over(along)).cast("long").alias("bin"), p.alias("p2"),
        F.coalesce(F.lag(p).over(along), p).alias("p3"), "event_type", "value",
    )


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    series = _series(spark, sf)
    regions = series.where("event_type = 'error' and value > 60").select("chrom", F.col("bin").alias("b0"), F.col("bin").alias("b1"))
    return segment.masked(segment.corner_mean(series), regions, 1)


@REGISTRY.query(f"with {SERIES} select chrom, bin, round(p, 6) as p from m")
def corner_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(segment.corner_mean(_series(spark, sf)))


@REGISTRY.query(f"""with {SERIES}
select chrom, bin, round(case when count(*) over (partition by chrom) >= 20
  then sum(p) over (partition by chrom order by bin rows between 10 preceding and 9 following) / 20 else p end, 8) as p from m""")
def smooth20(spark: SparkSession, sf: str) -> DataFrame:
    # eight digits are exact here, so no engine has a half to round
    return segment.smoothed(segment.corner_mean(_series(spark, sf))).withColumn("p", F.round("p", 8))


@REGISTRY.query(f"with {MASKED} select chrom, bin, round(p, 6) as p, masked from k")
def lowcomplex_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_masked(spark, sf))


@REGISTRY.query(f"with {RUNS} select chrom, part_id, chimeric, b0, b1 from parts")
def segment_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(segment.runs(_masked(spark, sf), 0.1))


def merged_sql(parts: str, least: int) -> str:
    """CTEs that merge the short ones of parts (chrom, b0, b1) from left to right, one part of every contig at a time; mp is the result."""
    middle, last = "a0 + (a1 - a0) // 2", "{'b0': done[-1].b0, 'b1': a0 + (a1 - a0) // 2}"
    return f"""mo as (select chrom, row_number() over (partition by chrom order by b0, b1) as k, b0::bigint as b0, b1::bigint as b1 from {parts}),
mf as (select chrom, k, b0 as a0, b1 as a1, []::struct(b0 bigint, b1 bigint)[] as done from mo where k = 1
  union all
  select mf.chrom, mo.k, case when a1 - a0 >= {least} then mo.b0 when len(done) = 0 then a0 else {middle} end, mo.b1,
    case when a1 - a0 >= {least} then list_append(done, {{'b0': a0, 'b1': a1}}) when len(done) = 0 then done else list_append(done[:-2], {last}) end
  from mf join mo on mo.chrom = mf.chrom and mo.k = mf.k + 1),
mz as (select chrom, list_append(done, {{'b0': a0, 'b1': a1}}) as l from mf qualify k = max(k) over (partition by chrom)),
mp as (select chrom, part_id, p.b0 as b0, p.b1 as b1 from (select chrom, unnest(generate_series(1, len(l))) as part_id, unnest(l) as p from mz))"""


@REGISTRY.query(f"with recursive {RUNS}, {merged_sql('parts', 5)} select chrom, part_id, b0, b1 from mp")
def merge_short_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(segment.merged_parts(segment.runs(_masked(spark, sf), 0.1), 5))


@REGISTRY.query(f"""with {SERIES}
select chrom, bin, round(case when count(*) over (partition by chrom) >= 30
  then sum(p) over (partition by chrom order by bin rows between 10 preceding and 9 following) / 20 else p end, 8) as p from m""")
def smooth20_long(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed only where a contig has one and a half windows."""
    return segment.smoothed(segment.corner_mean(_series(spark, sf)), least=1.5).withColumn("p", F.round("p", 8))


@REGISTRY.query(f"""with {RUNS}, b as (select chrom, min(bin) as f, max(bin) as l from k group by chrom)
select chrom, case when b0 = f then 0 else b0 * 5000 end as start, case when b1 = l and b0 = max(b0) over (partition by chrom) then (l + 11) * 5000 - 7 else b1 * 5000 end as "end" from parts join b using (chrom)""")
def edge_trim(spark: SparkSession, sf: str) -> DataFrame:
    curve = _masked(spark, sf)
    lengths = curve.groupBy("chrom").agg(((F.max("bin") + 11) * 5000 - 7).alias("length"))
    return _whole(segment.trimmed(segment.runs(curve, 0.1), curve, lengths, 5000))


@REGISTRY.query(f"with {SERIES} select chrom, round((min(bin) + max(bin)) / 2, 6) as cut from m where p < 0.1 group by chrom")
def cutting_position(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(segment.cutting_position(segment.corner_mean(_series(spark, sf)), 0.1))


@REGISTRY.query(f"""with {SERIES}, e as (select chrom, min(bin) as f, max(bin) as l from m group by chrom)
select chrom, bin, round(case when bin < f + 10 or bin > l - 10 then p / 2 else p end, 6) as p from m join e using (chrom)""")
def curve_splice(spark: SparkSession, sf: str) -> DataFrame:
    curve = segment.corner_mean(_series(spark, sf))
    return _whole(segment.spliced(curve, curve.withColumn("p", F.col("p") / 2)))


@REGISTRY.query(f"with {UPPER} select resolution::bigint as resolution, chrom1 as chrom, bin1::bigint as bin, (bin1::bigint * resolution // 40000)::bigint as bin_40k from u group by 1, 2, 3, 4")
def bin_rescale(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf)
    scaled = contacts.rescaled(F.col("bin1"), F.col("resolution"), 40000)
    return _whole(cells.select("resolution", F.col("chrom1").alias("chrom"), F.col("bin1").alias("bin"), scaled.alias("bin_40k")).distinct())


@REGISTRY.query(f"with {UPPER} select chrom1 as chrom from u union select chrom2 from u")
def distinct_contigs(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.contigs(_cells(spark, sf))


TILES = """rg as (select chrom1 as chrom, min(bin1) as s, min(bin1) + 40 as e, (ascii(right(chrom1, 1)) % 2 = 1) as turned,
  case when chrom1 like 'super%' then 'super' else left(chrom1, 3) end as view from u where resolution = 5000 group by chrom1),
pl as (select *, coalesce(sum(e - s) over (partition by view order by chrom rows between unbounded preceding and 1 preceding), 0) as o from rg)"""


@REGISTRY.query(f"""with {UPPER}, {TILES}, t as (
  select a.view, u.resolution, a.o + case when a.turned then a.e - 1 - bin1 else bin1 - a.s end as i, b.o + case when b.turned then b.e - 1 - bin2 else bin2 - b.s end as j, cnt
  from u join pl a on a.chrom = chrom1 and bin1 >= a.s and bin1 < a.e join pl b on b.chrom = chrom2 and b.view = a.view and bin2 >= b.s and bin2 < b.e where u.resolution = 5000)
select view, resolution::bigint as resolution, least(i, j)::bigint as r, greatest(i, j)::bigint as c, cnt from t""")
def tiled_regions(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf).where("resolution = 5000")
    view = F.when(F.col("chrom1").startswith("super"), "super").otherwise(F.substring("chrom1", 1, 3))
    regions = cells.groupBy("chrom1").agg(F.min("bin1").alias("bin0")).select(
        view.alias("view"), F.col("chrom1").alias("place"), F.col("chrom1").alias("chrom"), "bin0", (F.col("bin0") + 40).alias("bin1"),
        (F.ascii(F.substring("chrom1", -1, 1)) % 2 == 1).alias("turned"),
    )
    return _whole(ends.tiled(cells, regions))
