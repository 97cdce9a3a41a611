"""Benchmark decontamination by template canonicalisation.

A benchmark question may return in the corpus as it stands or with other numbers, names and units. Both sides are
canonicalised to templates: numbers, in digits or in words, become ``<num>``, words that follow a number and are measures
``<unit>``, capitalised words ``<name>``; all else is lower-cased. A slot may be filled with more or fewer words than
in the item, so adjacent tokens of one slot type are one placeholder. Windows of ``window`` places are hashed and joined by
hash, in these channels:

0. literal: all words lower-cased, nothing replaced;
1. template: numbers, units and names replaced;
2. numbers: numbers and units replaced, all words lower-cased, which finds copies without capitals;
3. whole: texts below ``min_tokens`` tokens, which hold no window, are compared as wholes: the document is the item.

A document is a leak of an item when the windows found of that item cover at least ``coverage`` of the item's places
in one channel, wherever they lie, and the slots are consistent. Two places with one value in the item must have one value
in the document, and two places with one name in the document must have one name in the item, for at least ``slot_share`` of
the repeated values. Where no value repeats, at least ``WORDS`` of the places found must be words instead. Where the windows of
the whole document are not consistent (it may hold the item several times with different values), each offset between the
document's and the item's places is tried alone and with the offsets up to half the item's length away, of which the nearest
fills a place.

The windows of the benchmark are broadcast where their number is within ``BROADCAST_WINDOWS``; beyond that the
document's windows are joined with them by a shuffled join. Nothing is capped in either form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, mix64, token_hashes, windows_hash

WINDOW, MIN_TOKENS, COVERAGE, SLOT_SHARE, WORDS = 8, 5, 0.6, 0.8, 0.5
#: rows of benchmark windows that may be broadcast (some 200 bytes each with their slots: 100 MB at most)
BROADCAST_WINDOWS = 500_000
LITERAL, TEMPLATE, NUMBERS, WHOLE = range(4)

# fixed values: measures that count as units after a number
UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres inch inches foot feet mile miles pound pounds ounce ounces dollar dollars euro euros cent cents percent degree degrees mph kph kmh w kw v hz"
# fixed values: numbers in words
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
# byte classes of UTF-8 text: 1 letter, 2 digit, 0 anything else
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x80:] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2


def _tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased tokens; which are numbers; which begin with a capital and go on otherwise."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"  ", dtype=np.uint8)
    kind = _CLASS[b]
    for lead, size in ((0xC2, 2), (0xE2, 3), (0xE3, 3)):  # Latin-1 signs, general and CJK punctuation
        at = np.flatnonzero(b == lead)
        if size == 3:
            at = at[b[at + 1] == 0x80]
        for j in range(size):
            kind[at + j] = 0
    digit = kind == 2
    inner = np.flatnonzero(digit[:-2] & digit[2:] & ((b[1:-1] == 46) | (b[1:-1] == 44))) + 1
    kind[inner] = 2  # a point or comma between digits
    low = b.copy()
    upper = (b >= 65) & (b <= 90)
    low[upper] += 32
    accented = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
    low[accented] += 32
    upper[accented - 1] = upper[accented] = True
    # a new token also begins where letters and digits meet
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    ends = np.append(change[1:], len(kind))
    keep = kind[change] > 0
    starts, ends = change[keep], ends[keep]
    number = kind[starts] == 2
    capital = upper[starts]
    if len(starts):
        count = np.concatenate(([0], np.cumsum(upper)))
        capital = capital & ~((count[ends] - count[starts] == ends - starts) & (ends - starts > 1 + (b[starts] >= 0x80)))
    return token_hashes(low, starts, ends), number, capital


_NUM, _UNIT, _NAME = mix64(np.array([11, 12, 13], dtype=np.uint64))
_UNIT_HASHES, _NUMBER_HASHES = (np.sort(_tokens(x)[0]) for x in (UNITS, NUMBER_WORDS))
_NO_SLOT, _IS_NUM, _IS_UNIT, _IS_NAME = range(4)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Literal hashes, and the slot type of each token. Case is folded for ASCII and Latin-1 letters."""
    if not text:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint8)
    literal, number, capital = _tokens(text)
    kind = np.where(capital, _IS_NAME, _NO_SLOT).astype(np.uint8)
    if len(literal):
        number = number | _among(literal, _NUMBER_HASHES)
        kind[1:][number[:-1] & _among(literal[1:], _UNIT_HASHES)] = _IS_UNIT
        kind[number] = _IS_NUM
    return literal, kind


def _hashed(values: np.ndarray, k: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return windows_hash(values ^ np.uint64(salt), k)


_PLACEHOLDER = np.array([0, _NUM, _UNIT, _NAME], dtype=np.uint64)


def _channels(literal: np.ndarray, kind: np.ndarray, min_tokens: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(channel, values, slot types, starts, ends): the places of each channel and the tokens that each of them takes."""
    n = np.arange(len(literal) + 1)
    plain = (literal, np.zeros(len(literal), np.uint8), n[:-1], n[1:])
    if len(literal) < min_tokens:
        return [(WHOLE, *plain)] if len(literal) else []
    out = [(LITERAL, *plain)]
    for channel, of in ((TEMPLATE, kind), (NUMBERS, np.where(kind == _IS_NAME, _NO_SLOT, kind))):
        first = np.ones(len(literal), dtype=bool)
        first[1:] = (of[1:] == _NO_SLOT) | (of[1:] != of[:-1])
        starts = np.flatnonzero(first)
        k = of[starts]
        out.append((channel, np.where(k > 0, _PLACEHOLDER[k], literal[starts]), k, starts, np.append(starts[1:], len(literal))))
    return out


def benchmark_windows(bench: DataFrame, id_col: str, text_col: str, window: int, min_tokens: int) -> DataFrame:
    """(item_id, channel, size, pos, hash, n_tokens, slots): slots has the values of each place, numbered so that equal ones are alike, below 0 for names.

    A channel with fewer than ``window`` places has one window of its own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                literal, kind = canonical(text)
                number: dict = {}
                value = [number.setdefault(w, len(number)) for w in literal.tolist()]
                for channel, values, of, starts, ends in _channels(literal, kind, min_tokens):
                    n = len(values)
                    k = min(window, n)
                    slots = [[-1 - v if t == _IS_NAME else v for v in value[a:b]] if t else [] for t, a, b in zip(of.tolist(), starts.tolist(), ends.tolist())]
                    for pos, h in enumerate(_hashed(values, k, channel).view(np.int64).tolist()):
                        out.append((item, channel, k, pos, h, n, slots[pos:pos + k]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.list_(pa.int32()))))], names=["item_id", "channel", "size", "pos", "hash", "n_tokens", "slots"])

    rows = bench.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null").distinct()
    return rows.mapInArrow(run, "item_id long, channel int, size int, pos int, hash long, n_tokens int, slots array<array<int>>")


def _document_windows(docs: DataFrame, sizes: list[tuple[int, int]], known: np.ndarray | None, longest: int, min_tokens: int) -> DataFrame:
    """(doc_id, channel, size, at, hash, said) of the windows; those in ``known`` only, where given.

    sizes: channel and size of the windows. said: the values of each place; more of them than ``longest``, which no item has
    in a place, become one hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                literal, kind = canonical(text.as_py())
                said_all = literal.view(np.int64)
                places = {c[0]: c[1:] for c in _channels(literal, kind, min_tokens)}

                def said(a: int, b: int) -> list[int]:
                    return said_all[a:b].tolist() if b - a <= longest else _hashed(literal[a:b], b - a, 3).view(np.int64).tolist()

                for channel, k in sizes:
                    if channel not in places or (channel == WHOLE and k != len(literal)):
                        continue
                    values, of, starts, ends = places[channel]
                    h = _hashed(values, k, channel).view(np.int64)
                    if not len(h):
                        continue
                    if known is None:
                        at = np.arange(len(h))
                    else:
                        at = np.flatnonzero(_among(h, known))
                    for a in at.tolist():
                        out.append((doc, channel, k, a, int(h[a]), [said(int(x), int(y)) if t else [] for t, x, y in zip(of[a:a + k], starts[a:a + k], ends[a:a + k])] if channel in (TEMPLATE, NUMBERS) else []))
                        if len(out) > 20_000:
                            yield _batch(out)
                            out = []
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64()))))], names=["doc_id", "channel", "size", "at", "hash", "said"])

    return docs.mapInArrow(run, "doc_id long, channel int, size int, at int, hash long, said array<array<long>>")


def _judged(places: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_tokens, coverage, agree) of places of items found: place, slots and said of each.

    agree: of the item's values that fill several places and the document's names that do, the share that kept one value on the other
    side. Places with equally many values on both sides are compared one by one; a single value may have become several, but not at
    the item's ends, where words of the document around it may have joined. Without repeated values: 1 if enough places are words.
    """
    covered = places.groupBy(*keys, "n_tokens").agg(F.count_distinct("place").alias("covered"), F.count_distinct(F.expr("if(size(slots) = 0, place, null)")).alias("words"))
    pairs = F.expr("""case when size(slots) = size(said) then transform(slots, (x, j) -> struct(j, x as slot, said[j] as said))
        when size(slots) = 1 and place > 0 and place < n_tokens - 1 then array(struct(0 as j, slots[0] as slot, xxhash64(said) as said)) end""")
    values = places.where("size(slots) > 0").select(*keys, "place", F.explode(pairs).alias("z")).select(*keys, "place", "z.*")
    both = F.expr("explode(if(slot < 0, array(struct(0 as side, cast(slot as bigint) as one, said as other), struct(1 as side, said as one, cast(slot as bigint) as other)), array(struct(0 as side, cast(slot as bigint) as one, said as other))))")
    values = values.select(*keys, "place", "j", both.alias("v")).select(*keys, "place", "j", "v.*")
    values = values.groupBy(*keys, "side", "one").agg(F.count_distinct("place", "j").alias("k"), F.count_distinct("other").alias("kinds")).where("k > 1")
    values = values.groupBy(*keys).agg(F.avg(F.expr("if(kinds = 1, 1d, 0d)")).alias("agree"))
    alone = F.when(F.col("words") >= WORDS * F.col("covered"), 1.0).otherwise(0.0)
    return covered.join(values, keys, "left").select(*keys, "n_tokens", (F.col("covered") / F.col("n_tokens")).alias("coverage"), F.coalesce("agree", alone).alias("agree"))


def benchmark_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_tokens: int = MIN_TOKENS, coverage: float = COVERAGE, slot_share: float = SLOT_SHARE) -> DataFrame:
    """(doc_id, item_id, coverage, slots_agree, channel) of each document that holds an item.

    Edge cases: null and empty texts hold nothing; null ids are left out on both sides; rows that repeat an id count as
    one document, repeated items once; an item that several documents hold, or a document with several items, gives a row for each
    pair; texts of any length are read whole; empty tables give an empty result; other columns are ignored. Of several channels the
    one with the most coverage is named, at a tie the first in the order literal, template, numbers, whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = materialize(benchmark_windows(bench, item_col, item_text_col, window, min_tokens), "bench")
    sizes = sorted((r[0], r[1]) for r in items.select("channel", "size").distinct().collect())  # at most ``window`` values a channel
    longest = items.agg(F.max(F.array_max(F.transform("slots", F.size)))).first()[0] or 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    small = items.count() <= BROADCAST_WINDOWS
    table = np.unique(items.select("hash").toArrow()["hash"].to_numpy()) if small else None
    if small and not len(table):
        table = np.zeros(1, dtype=np.int64)
    found = _document_windows(rows, sizes, table, max(longest, 1), min_tokens)
    joined = materialize(found.join(F.broadcast(items) if small else items, ["hash", "channel", "size"]), "hits")

    pair = ["doc_id", "item_id", "channel"]
    seen = joined.select(*pair, "n_tokens", (F.col("at") - F.col("pos")).alias("offset"), "pos", F.posexplode(F.expr("if(channel in (0, 3), transform(slots, x -> struct(x as slots, cast(null as array<bigint>) as said)), arrays_zip(slots, said))")).alias("i", "z"))
    seen = seen.select(*pair, "n_tokens", "offset", (F.col("pos") + F.col("i")).alias("place"), "z.slots", "z.said")
    whole = materialize(_judged(seen, pair).where(F.col("coverage") >= coverage), "whole")
    # no part covers more than the whole, so parts matter only where the whole is not consistent
    torn = whole.where(F.col("agree") < slot_share)
    part = seen.join(torn.select(*pair), pair, "left_semi").withColumn("reach", F.greatest(F.lit(1), F.floor(F.col("n_tokens") / 2)))
    part = part.withColumn("cell", F.floor(F.col("offset") / F.col("reach")))
    anchors = part.select(*pair, "cell", F.col("offset").alias("anchor")).distinct().withColumn("cell", F.explode(F.expr("sequence(cell - 1, cell + 1)")))
    part = part.join(anchors, [*pair, "cell"]).withColumn("far", F.abs(F.col("offset") - F.col("anchor"))).where("far <= reach")
    part = part.withColumn("wide", F.explode(F.array(F.lit(0), F.lit(1)))).where("wide = 1 or far = 0")
    part = part.groupBy(*pair, "anchor", "wide", "n_tokens", "place").agg(F.min_by(F.struct("slots", "said"), F.struct("far", "offset")).alias("z"))
    part = _judged(part.select(*pair, "anchor", "wide", "n_tokens", "place", "z.slots", "z.said"), [*pair, "anchor", "wide"]).where(F.col("coverage") >= coverage)
    per = whole.select(*pair, "coverage", "agree").unionByName(part.select(*pair, "coverage", "agree")).where(F.col("agree") >= slot_share)
    best = F.struct(F.col("coverage"), (-F.col("channel")).alias("c"), F.col("agree"))
    return per.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select("doc_id", "item_id", F.col("b.coverage").alias("coverage"), F.col("b.agree").alias("slots_agree"), F.element_at(F.array(*[F.lit(x) for x in ("literal", "template", "numbers", "whole")]), 1 - F.col("b.c")).alias("channel"))
