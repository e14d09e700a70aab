"""DuckDB SQL of the WARC query."""

OP1 = r"""
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex,
    max(page_id) over (partition by coalesce(html, '')) as last
  from pages
), bits as (
  select *, list_transform(range(0, 32), lambda i: (('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) as v from p
)
select page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::int + 1, 1)), '') as payload_digest,
  case when page_id is not distinct from last then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from last then null else last end as refers_to
from bits
"""
