"""DuckDB SQL of the quality query."""

OP9 = r"""
with docs as (
  select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as t from documents
), split as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from docs
), starts as (
  select rid, unnest(range(1, len(w) - 6)) as i from split where len(w) >= 8
), windows as (
  select s.rid, s.i, array_to_string(d.w[s.i : s.i + 7], ' ') as x from starts s join split d using (rid)
), again as (
  select rid, i from windows qualify count(*) over (partition by rid, x) > 1
), gaps as (
  select rid, least(8, coalesce(lead(i) over (partition by rid order by i) - i, 8)) as g from again
), rep as (
  select rid, sum(g)::bigint as n from gaps group by rid
), line as (
  select rid, host, t, trim(regexp_replace(lower(unnest(ls)), '[\x20\x09-\x0D]+', ' ', 'g')) as l from split
), per_host as (
  select host, count(distinct t) as docs from docs group by host
), often as (
  select c.host, c.l from (select host, l, count(distinct t) as n from line group by host, l) c
  join per_host p on c.host is not distinct from p.host where c.n >= 10 and c.n > least(0.1 * p.docs, 10)
), lost as (
  select a.rid, sum(length(a.l)) as chars, sum(case when o.l is not null then length(a.l) else 0 end) as gone,
    count(o.l) as lines
  from line a left join often o on a.l = o.l and a.host is not distinct from o.host group by a.rid
), base as (
  select d.rid, d.doc_id, len(d.w)::bigint as n_words, length(array_to_string(d.w, ''))::bigint as word_chars,
    (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(d.ls) - len(list_distinct(d.ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
    coalesce(l.lines, 0)::bigint as n_lines_removed, coalesce(l.gone > 0 and 100 * l.gone > 70 * l.chars, false) as depleted
  from split d left join rep r using (rid) left join lost l using (rid)
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not depleted as kept, n_lines_removed
from judged
"""
