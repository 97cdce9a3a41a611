"""Query op11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fim import fill_in_middle, restored


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two ranks of its units, with digests of the output and of the text restored from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


# every number of eight hexadecimal digits is read by a cast; units are matched by the same pattern
_SQL = r"""
with hashed as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id::varchar) as sha, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units from documents
), ranked as (
  select doc_id, text, units, len(units) as n, ('0x' || sha[1:8])::bigint as h1, ('0x' || sha[9:16])::bigint as h2, ('0x' || sha[17:24])::bigint as h3, ('0x' || sha[25:32])::bigint as h4
  from hashed
), cut as (
  select doc_id, text, n, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') as prefix,
    array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') as middle,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') as suffix,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from ranked
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(prefix || middle || suffix) as restored_sha256
from cut
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES: dict[str, str] = {"op11_fill_in_middle": _SQL}
