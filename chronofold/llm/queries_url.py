"""Query op8.

``pages`` has neither fetch times nor a list, so both are derived by rule: a capture's time from page_id within 2024, and the
list from the hosts that occur, with up to three dated entries for a host and two for each of the domains below example.*.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .urlfilter import host_of, temporal_list_join

YEAR, SECONDS, DAY = 1704067200, 31536000, 86400


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.col("page_id") * 3607 % SECONDS + YEAR).alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    code = hosts.withColumn("k", F.expr("ascii(host) * 7 + length(host) * 13 + ascii(substring(host, 4, 1)) * 5"))
    rule = F.expr("""explode(filter(array(
        if(k % 3 = 0, struct(host as key, 'block' as action, k % 200 as day), null),
        if(k % 2 = 0, struct(host as key, 'allow' as action, k % 200 + 60 as day), null),
        if(k % 5 < 2, struct(host as key, 'block' as action, k % 200 + 120 as day), null)), x -> x is not null))""")
    of_hosts = code.select(rule.alias("e")).select("e.*")
    domains = spark.sql("select * from values ('example.org', 'block', 100), ('example.org', 'allow', 250), ('example.net', 'review', 40), ('example.net', 'allow', 300) as t(key, action, day)")
    entries = of_hosts.unionByName(domains).select("key", "action", (F.col("day").cast("long") * DAY + YEAR).alias("time"))
    return temporal_list_join(captures, entries)


ORACLE = rf"""
with captures as (
  select page_id, url, page_id * 3607 % {SECONDS} + {YEAR} as fetched_at,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') as host,
         row_number() over () as r from pages),
code as (
  select host, ascii(host) * 7 + length(host) * 13 + ascii(substring(host, 4, 1)) * 5 as k
  from (select distinct host from captures where host is not null)),
entries as (
  select host as key, 'block' as action, k % 200 as day from code where k % 3 = 0
  union all select host, 'allow', k % 200 + 60 from code where k % 2 = 0
  union all select host, 'block', k % 200 + 120 from code where k % 5 < 2
  union all select * from (values ('example.org', 'block', 100), ('example.org', 'allow', 250), ('example.net', 'review', 40), ('example.net', 'allow', 300))),
one as (select key, max(action) as action, day::bigint * {DAY} + {YEAR} as valid_from from entries group by key, day),
intervals as (select *, lead(valid_from) over (partition by key order by valid_from) as valid_to from one),
labels as (select r, fetched_at, string_split(host, '.') as l from captures where host is not null),
asked as (select r, fetched_at, unnest(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.'))) as key from labels),
met as (
  select r, i.key, i.action, i.valid_from, row_number() over (partition by r order by length(i.key) desc) as n
  from asked a join intervals i on a.key = i.key and i.valid_from <= a.fetched_at and (i.valid_to is null or a.fetched_at < i.valid_to))
select c.page_id, c.url, c.fetched_at, c.host, m.key as matched_key, m.action, m.valid_from
from captures c left join met m on c.r = m.r and m.n = 1
"""

QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": ORACLE}
