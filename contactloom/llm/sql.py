"""SQL of the queries of this package, where SQL can express them on whole tables."""

from __future__ import annotations

#: records that belong to a category, with the target rows of it
_CATEGORIES = """r as (
  select distinct sample_id, y, bin_size, case when contains(name, '|') then 'inter' else 'intra' end as grp_type
  from images where y in (0, 1) and name is not null and bin_size is not null),
h as (select y, grp_type, bin_size, count(*) as have from r group by all),
t as (select distinct on (target_id) *, greatest(coalesce(min_rows, 0)::double, coalesce(share, 0) * coalesce(sample_rows, 0)) as want from sample_targets)"""

_LINKS = """(select distinct link_id, resolution, a, oa, b, ob, prob from prob_net where prob is not null and not isnan(prob))"""

#: names by plain renaming and a recursive walk, components by the least node reached
_TIES = r"""with recursive nt as (
  select distinct lower(regexp_replace(new, '\s+', '', 'g')) as new, lower(regexp_replace(old, '\s+', '', 'g')) as old from name_table
  where new is not null and old is not null),
n as (select coalesce(grp * 2, sample_id * 2 + 1) as node, lower(regexp_replace(name, '\s+', '', 'g')) as n from images where name is not null),
c as (
  select distinct node, unnest(case when contains(n, '|') then list_transform(string_split(n, '|'), lambda p: regexp_extract(p, '^(.*):([0-9]+)-([0-9]+):([01])$', 1))
    else [regexp_extract(n, '^(.*)_([0-9]+)_c([23])$', 1)] end) as contig from n),
walk as (select distinct contig, contig as at_ from c union select contig, old from walk join nt on at_ = new),
o as (select distinct node, at_ as origin from c join walk using (contig) where at_ not in (select new from nt)),
e as (select distinct a.node as a, b.node as b from o a join (select origin, min(node) as node from o group by origin) b using (origin)),
g as (select a, b from e union select b, a from e),
reach as (select distinct a as node, a as far from g union select node, b from reach join g on far = a),
k as (select node, min(far) as comp from reach group by node)
"""

SQL = {
    "p2_found": f"""with {_CATEGORIES}
select target_id from t left join h using (y, grp_type, bin_size) where coalesce(have, 0) < want""",
    # the number of seats of a category does not depend on which records are drawn
    "p2_report": f"""with {_CATEGORIES},
s as (select *, case when rank <= coalesce(min_rows, 0) then 0 when share > 0 then (rank - 0.5) / share end as priority
  from (select t.*, unnest(generate_series(1, have)) as rank from t join h using (y, grp_type, bin_size))),
m as (select target_set, count(*) as floors from s where rank <= coalesce(min_rows, 0) group by 1),
o as (select s.*, coalesce(floors, 0) + row_number() over (partition by target_set order by priority, target_id, rank) as place
  from s left join m using (target_set) where rank > coalesce(min_rows, 0) and priority is not null),
k as (select target_id, count(*) as taken from (select target_id from s where rank <= coalesce(min_rows, 0) union all select target_id from o where place <= sample_rows) group by 1),
e as (select t.target_id, target_set, y, grp_type, bin_size, share, min_rows, sample_rows, coalesce(have, 0) as have, coalesce(taken, 0) as taken, want
  from t left join h using (y, grp_type, bin_size) left join k using (target_id))
select *, have < want and taken < want as short, taken < have and taken + 1 < want as squeezed from e""",
    "p4_found": f"""select link_id from {_LINKS}
qualify row_number() over (partition by resolution, a, oa order by prob desc, link_id) <= 5""",
    "p4_best_links": f"""select link_id, resolution, a, oa, b, ob, prob, row_number() over (partition by resolution, a, oa order by prob desc, link_id) as place
from {_LINKS} qualify place <= 5""",
    "p3_found": _TIES
    + "select x.node // 2 as grp_a, y.node // 2 as grp_b from k x join k y using (comp) where x.node < y.node and x.node % 2 = 0 and y.node % 2 = 0",
    "p3_components": _TIES
    + """select comp as component, count(*) filter (where node % 2 = 0) as groups, count(*) filter (where node % 2 = 1) as lone_records,
  count(*) filter (where node % 2 = 0) * (count(*) filter (where node % 2 = 0) - 1) // 2 as pairs from k group by comp having count(*) > 1""",
    # every record is placed in each scheme, and no component lies in two splits
    "p3_placed": _TIES
    + """, r as (select sample_id, coalesce(max(grp) * 2, sample_id * 2 + 1) as node from images group by sample_id)
select scheme, coalesce(comp, node) as component, count(*) as records, 1::bigint as splits
from r left join k using (node), (select distinct scheme from split_targets where split is not null and share is not null) group by all""",
}
