"""DuckDB SQL of the substring dedup query."""

OP4 = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select rid, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20
), x as (
  select rid, doc_id, i, array_to_string(w[i : i + 19], ' ') as k from s join d using (rid)
), f as (
  select rid, doc_id, i, first_value(doc_id) over (partition by k order by doc_id nulls first, i) as d0,
    first_value(i) over (partition by k order by doc_id nulls first, i) as i0
  from x
), gone as (
  select distinct rid, unnest(range(i, i + 20)) as p from f where doc_id is distinct from d0 or i <> i0
), word as (
  select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d
), kept as (
  select a.rid, string_agg(a.word, ' ' order by a.p) as t, count(*) as n
  from word a left join gone g on a.rid = g.rid and a.p = g.p where g.p is null group by a.rid
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (rid)
"""
