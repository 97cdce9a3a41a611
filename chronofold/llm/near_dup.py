"""MinHash near-duplicate detection by tensored banding, with every candidate verified on its full shingle set.

Instead of one independent band of minhashes for each hash table, a document gets a few short *collections* of
minhashes, and the key of a table is a pair of collections: ``m`` collections of ``r`` minhashes give
``m (m - 1) / 2`` tables with keys of ``2 r`` minhashes. With the defaults (m = 16, r = 3) 48 minhashes stand for
120 bands of 6, which independent bands would compute from 720. Two sets share a key as soon as two of the 16
collections agree, which fails for a pair at similarity 0.8 with probability 2e-4, at 0.85 (where 14 collections do) with 4e-5.

Steps (all tables; no cap on a group's size, its candidates or its partners):

1. One scan turns each text into its set size, a 128-bit hash of the set and the collections' values.
2. Documents with equal sets form a class, represented by its least id; classes are found by a partial aggregate.
3. Collection values that no other class has are dropped first; only classes left with two or more form keys.
4. In each key's group all members are verified against the group's least id, and verified links are closed to components.
5. Classes whose groups still hold several components meet again by the rare shingles they share (an exact prefix
   filter). Each such group is resolved by 16, 64, ... pivots until every pair in it lies in one component, was verified, or cannot
   reach the limit for the shingles that only one side has. No round emits all pairs of a large group.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, dealt, discard, materialize, mix64, windows_hash, word_hashes
from .components import connected_components

COLLECTIONS, ROWS, SHINGLE = 16, 3, 5
#: ids up to this number may be broadcast for a semi join (16 MB of longs)
BROADCAST_IDS = 2_000_000


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles; the whole sequence if it has fewer words."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    return np.unique(windows_hash(w, min(k, len(w)))) if len(w) else w


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, n, dtype=np.uint64)


def _collections(s: np.ndarray, seeds: np.ndarray, m: int, r: int) -> np.ndarray:
    """m values; each hashes the r minhashes of one collection."""
    low = np.empty(len(seeds), dtype=np.uint64)
    c1, sh = np.uint64(0xFF51AFD7ED558CCD), np.uint64(33)
    for i in range(0, len(seeds), 8):  # a few seeds at once: a long text's table stays small
        y = (s[None, :] ^ seeds[i:i + 8, None]) * c1
        y ^= y >> sh
        y *= c1
        low[i:i + 8] = y.min(axis=1)
    return windows_hash_rows(low.reshape(m, r))


def windows_hash_rows(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out


_SIG = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()),
    T.StructField("h2", T.LongType()), T.StructField("c", T.ArrayType(T.LongType())),
])


def signatures(docs: DataFrame, id_col: str, text_col: str, m: int = COLLECTIONS, r: int = ROWS, k: int = SHINGLE) -> DataFrame:
    seeds = _seeds(m * r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, c = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    h1.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)) if len(s) else 0)
                    h2.append(int(mix64(s + np.uint64(12345)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                c.append(_collections(s, seeds, m, r).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(c, pa.list_(pa.int64()))],
                names=[f.name for f in _SIG])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SIG)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b, linked) of the pairs, each confirmed on both full sets: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict = OrderedDict()  # sets of recent pivots

        def of(i, text):
            key = (i, text)  # an id may have several texts
            if key not in kept:
                kept[key] = shingle_set(text, k)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[key]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = of(a, ta.as_py()), shingle_set(tb.as_py(), k)
                # both sorted and distinct: merge and count neighbours that agree
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                inter = int(np.count_nonzero(z[1:] == z[:-1]))
                out.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    # one pivot may be in very many pairs
    ends = [texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab"]
    pairs, of_a = dealt(pairs, ends[0], "a", "b")
    both = pairs.join(ends[1], "b").join(of_a, ["a", "__salt"])
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def _prefixes(ids: DataFrame, whole: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """(key, rep, n, u): the shingles by which the classes of ``ids`` can still meet.

    Shingles are ordered by how few of these classes have them. Two sets that reach the limit share one of their
    first n - ceil(percent * n / 100) + 1 shingles in that order (the prefix filter of set-similarity joins), so only these become
    keys, and only where another class has them. u counts the shingles that no other class has. ``whole``: ids with
    several texts, of which all shingles are keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(t.as_py(), k).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(s)], names=["rep", "key"])

    rows = texts.join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "rep long, key long").distinct()
    rows = materialize(rows, "active-shingles")
    df = rows.groupBy("key").agg(F.count("*").alias("df"))
    own = Window.partitionBy("rep")
    ranked = rows.join(df, "key").withColumn("r", F.row_number().over(own.orderBy("df", "key"))).withColumn("u", F.sum(F.expr("if(df = 1, 1, 0)")).over(own))
    ranked = ranked.where("df > 1").join(ids, "rep").join(whole.select(F.col("doc_id").alias("rep"), F.lit(True).alias("several")).distinct(), "rep", "left")
    some = f"several or r <= n - floor(({percent} * n + 99) / 100) + 1"
    return ranked.where(F.expr(some)).select("key", "rep", "n", F.expr("if(several, 0L, u)").alias("u"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, collections: int = COLLECTIONS, rows: int = ROWS, shingle: int = SHINGLE, max_rounds: int = 40) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased; a document's set holds its
    distinct ``shingle``-word shingles (64-bit hashes), the whole sequence where there are fewer words. Two
    documents are linked when 100 * |intersection| >= percent * |union|.

    Edge cases: a null, empty or blank text has no set, is linked with nothing and kept. A null id is never linked
    (component_id null, kept true). Rows that repeat an id are one node of
    the graph, linked by any of its texts, and each gets a row. Ties in the choice of a
    representative go to the least id. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sig = materialize(signatures(docs, id_col, text_col, collections, rows, shingle), "sig")
    full = sig.where("n > 0 and doc_id is not null")
    classes = materialize(full.groupBy("h1", "h2").agg(F.min_by(F.struct("n", "c"), "doc_id").alias("x"), F.min("doc_id").alias("rep")).select("h1", "h2", "rep", "x.n", "x.c"), "classes")

    # collections that some other class shares
    coll = classes.select("rep", "n", F.posexplode("c").alias("i", "v"))
    shared = coll.groupBy("i", "v").agg(F.count("*").alias("k")).where("k > 1").select("i", "v")
    some = coll.join(shared, ["i", "v"]).groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c")).where("size(c) > 1")
    pair_keys = F.expr("flatten(transform(c, (x, p) -> transform(slice(c, p + 2, size(c)), y -> xxhash64(x.i, y.i, x.v, y.v))))")
    keys = materialize(some.select("rep", "n", F.explode(pair_keys).alias("key")), "keys")
    crowded = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("pivot"), F.min_by("n", "rep").alias("pivot_n")).where("size > 1")
    members, pivots_of = dealt(keys, crowded, "key", "rep")
    groups = materialize(members.join(pivots_of, ["key", "__salt"]).drop("__salt"), "groups")
    discard(keys)

    ids = materialize(groups.select("rep").distinct(), "ids")
    n_ids = ids.count()
    wanted = ids.select(F.col("rep").alias("doc_id"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = source.join(F.broadcast(wanted) if n_ids <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    texts = materialize(texts, "texts")

    fits = f"100 * least(n, other_n) >= {percent} * greatest(n, other_n)"
    pairs = groups.where("rep <> pivot").withColumn("other_n", F.col("pivot_n")).where(fits).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    checked = materialize(_verified(materialize(pairs, "pairs"), texts, percent, shingle), "checked")
    # an id with several texts is one node: it links the classes of its texts
    of_id = full.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
    text = F.struct("h1", "h2")  # classes of one id may have one representative, the id itself
    own = of_id.groupBy("doc_id").agg(F.min("rep").alias("a"), F.min(text).alias("lo"), F.max(text).alias("hi"), F.collect_set("rep").alias("reps")).where("lo <> hi")
    own = materialize(own.select("doc_id", "a", F.explode("reps").alias("b")), "own")
    comps = connected_components(checked.where("linked").select("a", "b").union(own.select("a", "b")))

    # classes of groups that still hold several components; they meet again by the rare shingles they share
    def mixed(rows: DataFrame) -> DataFrame:
        state = rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        several = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
        several = materialize(several, "several")
        return state.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "key")

    active = materialize(mixed(groups.select("key", "rep", "n")).select("rep", "n").distinct(), "active")
    left = None if active.isEmpty() else materialize(_prefixes(active, own, texts, percent, shingle), "prefixes")
    pivots = 16
    for _ in range(max_rounds):
        if left is None:
            break
        active = materialize(mixed(left), "active")
        if active.isEmpty():
            break
        # the pivots of a group are its members with the least hashes, so that groups share pivots and a pair meets in one direction
        active = active.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)))
        share = F.col("h") * F.col("size") < F.lit(pivots << 40)
        chosen = active.where(share).select("key", F.col("rep").alias("p"), F.col("n").alias("other_n"), F.col("u").alias("other_u"), F.col("comp").alias("other"), F.col("h").alias("other_h"))
        # no shingle that only one of the two has is in the intersection, and all of them are in the union
        fits_u = f"100 * least(n - u, other_n - other_u) >= {percent} * greatest(n + other_u, other_n + u)"
        # a pair is taken in the first group only of those where it meets
        active_keys = active.groupBy("rep").agg(F.sort_array(F.collect_list("key")).alias("ks"))
        chosen_keys = chosen.groupBy("p").agg(F.sort_array(F.collect_list("key")).alias("pks"))
        met, chosen = dealt(materialize(active.join(active_keys, "rep"), "met"), chosen.join(chosen_keys, "p"), "key", "rep")
        chosen = chosen.withColumnsRenamed({"key": "at", "__salt": "__at"})
        pairs = met.join(chosen, F.expr(f"key = at and __salt = __at and (other_h < h or other_h = h and p < rep) and comp <> other and {fits_u} and element_at(array_intersect(ks, pks), 1) = key")).select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()
        pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        more = materialize(_verified(materialize(pairs, "pairs"), texts, percent, shingle), "checked")
        before, checked = checked, materialize(checked.unionByName(more), "checked")
        discard(before)
        if not more.where("linked").isEmpty():
            comps = connected_components(checked.where("linked").select("a", "b").union(own.select("a", "b")))
        left = active.where(~share).select("key", "rep", "n", "u")
        pivots *= 4
    else:
        raise RuntimeError("groups did not settle")

    placed = classes.select("h1", "h2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("comp", "rep").alias("comp"))
    out = sig.select("doc_id", "n", "h1", "h2").join(placed, ["h1", "h2"], "left")
    alone = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("comp"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
