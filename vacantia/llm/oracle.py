"""DuckDB SQL of the numbered operators that SQL can express."""

from __future__ import annotations

from vacantia.llm.url_lists import EPOCH_DAYS, LIST_NAMES, START  # noqa: F401

HOST = """nullif(regexp_replace(regexp_extract(lower({url}), '^\\s*[a-z][a-z0-9+.-]*://([^/?#\\\\]*@)?([^/?#\\\\:@]*)', 2), '\\.+$', ''), '')"""
PARENTS = """list_transform(range(1, greatest(len(string_split({host}, '.')) - 1, 1) + 1),
    lambda i: array_to_string(string_split({host}, '.')[i:], '.'))"""

OP6 = f"""
with captures as (
    select page_id, {HOST.format(url="url")} as host, url,
        make_timestamp((epoch(timestamp '{START}')::bigint + (page_id * 7919) % 31536000) * 1000000) as fetched_at from pages),
named as (select page_id, unnest({PARENTS.format(host="host")}) as name from captures where host is not null),
hosts as (select name, min(page_id) as low, count(*) as n from named group by name),
events as (
    select ['{"', '".join(LIST_NAMES)}'][low % 3 + 1] as list_name, name, step % 2 = 0 as added,
        epoch(timestamp '{START}')::bigint + (low * 104729) % 2592000 + step * (864000 + (n * 86400) % 5184000) as s
    from hosts, range(5) t(step) where low % 3 <> 0),
spans as (
    select list_name, name, added, make_timestamp(s * 1000000) as valid_from,
        lead(make_timestamp(s * 1000000)) over (partition by list_name, name order by s) as valid_to from events),
asked as (select page_id, url, fetched_at, host, count(*) as copies from captures group by all),
probes as (select *, unnest(case when host is null then [null] else {PARENTS.format(host="host")} end) as name from asked),
met as (
    select p.page_id, p.url, p.fetched_at, p.host, p.copies, s.list_name from probes p
    left join spans s on s.name = p.name and s.added and s.valid_from <= p.fetched_at and (s.valid_to is null or p.fetched_at < s.valid_to))
select page_id, host, copies, count(distinct list_name) as n_lists,
    coalesce(array_to_string(list_sort(list(distinct list_name) filter (list_name is not null)), ','), '') as lists,
    count(list_name) > 0 as blocked
from met group by page_id, url, fetched_at, host, copies
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_temporal_url_lists": OP6}
