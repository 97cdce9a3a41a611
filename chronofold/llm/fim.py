"""Fill-in-the-middle by a two-pass streaming matcher.

The first pass runs a lazy match iterator over the text and counts its units; the second starts a new iterator, advances it to the
rank of the first cut, notes the place, and goes on to the second. Neither keeps a unit, so memory beside the text is constant. Both passes
run in one Arrow function that gets the text and returns three numbers; hashes, cuts, output and restoring are column functions.

Ranks and forms follow from the sha256 of ``seed:id``, so they are the same in every run and on every cluster.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches

#: a unit is a run of letters or any other code point
UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: of 100 texts so many are transformed, and of 100 transformed ones so many begin with the suffix
TRANSFORMED, SUFFIX_FIRST = 90, 20


def count_units(unit: re.Pattern, text: str) -> int:
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def ends(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Places (code points) behind the first ``low`` and the first ``high`` units."""
    found, first = unit.finditer(text), 0
    if low:
        first = next(islice(found, low - 1, low)).end()
    return first, next(islice(found, high - low - 1, high - low)).end() if high > low else first


def _cuts(unit: str):
    @arrow_udf("struct<n: long, first: long, second: long>")
    def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        pattern, out = re.compile(unit), []
        for t, x, y in zip(text, h1.to_pylist(), h2.to_pylist()):
            t = t.as_py()
            n = count_units(pattern, t)
            low, high = sorted((x % (n + 1), y % (n + 1)))
            out.append((n, *ends(pattern, t, low, high)))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["n", "first", "second"])

    return cuts


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, unit: str = UNIT, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
                   transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): a row for each row of ``docs``.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``: texts that are empty or hold a marker, and those that
    the id's hash leaves as they are. A null text counts as empty; a null id is hashed as an empty id. Rows that repeat an id are cut by the
    same ranks, each in its own text. ``unit`` is a pattern that matches every code point of a text. Other columns are ignored; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    p, s, m = markers
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("sha"))
    h = [F.conv(F.substring("sha", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rows = rows.select("id", "text", h[2].alias("h3"), h[3].alias("h4"), _cuts(unit)("text", h[0], h[1]).alias("cut"))
    marked = F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= transformed)
    rows = rows.select("id", "text", "cut", F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm").alias("form"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), first), F.substr("text", first + 1, second - first), F.substr("text", second + 1)
    output = (F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
              .otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)))
    moved = F.col("form") != "plain"
    return rows.select(F.col("id").alias(id_col), F.col("cut.n").alias("n"), "form", F.when(moved, F.col("cut.first")).alias("prefix_chars"),
                       F.when(moved, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of ``fill_in_middle`` was made of. A transformed text holds no marker, so the three found are the ones put in."""
    part = F.split(output, "|".join(rf"\Q{x}\E" for x in markers), -1)
    text = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(text)
