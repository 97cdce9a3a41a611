"""Query op13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .treaps import ranked


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), query_id="item_id")
    return found.select(F.col("query_id").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_SQL = r"""
with cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), sized as (
  select doc_id, terms, len(terms)::bigint as n from cut where len(terms) > 0
), whole as (
  select count(*)::bigint as docs, sum(n)::bigint as words from sized
), asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), wanted as (
  select item_id, term, count(*)::bigint as times from asked group by all
), postings as (
  select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(terms) as term from sized) where term in (select term from wanted) group by all
), weighed as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*)::bigint as df from postings group by term), whole
), scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::bigint as score
  from wanted join weighed using (term) join postings using (term), whole group by item_id, doc_id
), placed as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from placed where rank <= 10
"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES: dict[str, str] = {"op13_ranked_search": _SQL}
