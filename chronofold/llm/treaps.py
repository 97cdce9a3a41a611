"""Exact ranked search over inverted treaps.

Lists. Texts are cut into terms where they lie, without a shuffle: every task turns its rows into segments bounded in documents and in
postings, each with a list of (document, occurrences) for every term, ordered by document, and the lengths of its documents. Number and length of
documents and the frequencies of terms are summed over all segments. Where the queries are known beforehand and their terms few enough to
be broadcast (``ASKED``), only lists of terms that are asked for are kept; statistics cover everything all the same.

Treaps. With the statistics a posting has its impact. The list of a term becomes a treap: a binary search tree by document in which no
node has a smaller impact than those below it. Equal impacts are ordered at random, so that lists of like documents give no chains.

Search. A range of documents and, for each of the query's terms, the highest node in that range: the weighted sum of these nodes
bounds the score of every document in the range. If it cannot enter the k best the range is dropped with all subtrees in it. Otherwise the document of the
node that adds most splits the range: its score is the sum of its nodes in all treaps, and one descent in each treap gives the highest nodes on either
side. Ranges of many queries go down together as arrays; the k best so far of a task serve all its segments.

Scores are whole numbers (the measure is stated at ``impacts`` and ``weights``), so ties are exact; they go to the least id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, runs, token_hashes

#: documents and postings of a segment; bytes of text that are cut into terms at once
SEGMENT_DOCS, SEGMENT_POSTINGS, CUT_BYTES = 16_384, 1_000_000, 1 << 20
#: distinct terms of queries that are broadcast to leave out other lists (8 bytes each), terms of queries searched for at once, and nodes that go down together
ASKED, QUERY_TERMS, NODES = 1_000_000, 200_000, 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# ---------------------------------------------------------------- terms and lists

def terms_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of UTF-8 bytes in order, and where they begin. Terms are runs of ASCII letters and digits and all else beyond ASCII; A-Z are lower-cased."""
    b = _LOWER[np.frombuffer(data, np.uint8)]
    starts, ends = runs(_INSIDE[b])
    parts, i = [np.empty(0, np.uint64)], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CUT_BYTES, "right")))
        parts.append(token_hashes(b[starts[i]:ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]))
        i = j
    return np.concatenate(parts).view(np.int64), starts


def _counted(texts: list[bytes], asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; text, term and occurrences of each posting."""
    term, starts = terms_of(b"\x00".join(texts))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begin, starts, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    if asked is not None:
        at = np.minimum(np.searchsorted(asked, term), max(len(asked) - 1, 0))
        hit = asked[at] == term if len(asked) else np.zeros(len(term), bool)
        term, doc = term[hit], doc[hit]
    order = np.lexsort((term, doc))
    term, doc = term[order], doc[order]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.empty(0, np.int64)
    return n, doc[first], term[first], np.diff(np.append(first, len(term)))


LISTS = "ids binary, n binary, terms binary, start binary, doc binary, tf binary"
_NAMES = [c.split()[0] for c in LISTS.split(", ")]


def _row(*arrays: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)


def _segment(ids: list, n: list, doc: list, term: list, tf: list) -> pa.RecordBatch:
    ids, n, doc, term, tf = (np.concatenate(x) for x in (ids, n, doc, term, tf))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc = place[doc]
    by = np.lexsort((doc, term))
    terms, start = np.unique(term[by], return_index=True)
    return _row(ids[order].astype("<i8"), n[order].astype("<i8"), terms.astype("<i8"), np.append(start, len(term)).astype("<i8"), doc[by].astype("<u2"), tf[by].astype("<u4"), names=_NAMES)


def _listed(asked):
    """(id, text) to segments. A null id keeps the place of its row in the statistics as a segment's last documents, which are no results."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else asked.value
        held: tuple[list, ...] = ([], [], [], [], [])
        docs = postings = 0
        for batch in batches:
            text = [(x.as_py() or "").encode() for x in batch.column(1)]
            ids = np.array([_NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            a = 0
            while a < len(text):
                b, size = a + 1, len(text[a])
                while b < len(text) and size + len(text[b]) < CUT_BYTES and docs + b - a < SEGMENT_DOCS:
                    size += len(text[b])
                    b += 1
                n, doc, term, tf = _counted(text[a:b], wanted)
                for part, x in zip(held, (ids[a:b], n, doc + docs, term, tf)):
                    part.append(x)
                docs, postings, a = docs + b - a, postings + len(term), b
                if docs >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    yield _segment(*held)
                    held, docs, postings = ([], [], [], [], []), 0, 0
        if docs:
            yield _segment(*held)

    return run


_NO_ID = np.iinfo(np.int64).max


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of every segment; under a null term the numbers of its documents with a term, and of their terms."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, terms, start = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("n", "terms", "start"))
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["term", "df", "words"])
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.diff(start)), pa.array(np.zeros(len(terms), np.int64))], names=["term", "df", "words"])


# ---------------------------------------------------------------- treaps

def impacts(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a posting adds for each unit of its term's weight: (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L of its document."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        m = np.array([25 + 75 * int(x) * documents // words for x in n], np.int64)
    else:
        m = 25 + 75 * n * documents // max(words, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _nearest_greater(near: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """From the neighbours on one side (-1: none) to the nearest ones with a greater priority, by following the neighbours' own."""
    move = np.flatnonzero(near >= 0)
    move = move[priority[near[move]] < priority[move]]
    while len(move):
        near[move] = near[near[move]]
        move = move[near[move] >= 0]
        move = move[priority[near[move]] < priority[move]]
    return near


def treaps(start: np.ndarray, priority: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children and the roots of the lists between the places of ``start``; no two priorities of a list are equal, no list is empty."""
    n = len(priority)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    before[start[:-1]], after[start[1:] - 1] = -1, -1
    before, after = _nearest_greater(before, priority), _nearest_greater(after, priority)
    under_after = (after >= 0) & ((before < 0) | (priority[after] < priority[before]))
    under_before = (before >= 0) & ~under_after
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    left[after[under_after]] = np.flatnonzero(under_after)
    right[before[under_before]] = np.flatnonzero(under_before)
    return left, right, np.flatnonzero(~under_after & ~under_before)


INDEX = "ids binary, terms binary, root binary, doc binary, impact binary, left binary, right binary"


def _grown(documents: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, terms, start, doc, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in zip(_NAMES, ("<i8", "<i8", "<i8", "<i8", "<u2", "<u4")))
                impact = impacts(tf.astype(np.int64), n[doc], documents, words)
                lot = np.random.default_rng(len(ids)).permutation(len(ids))
                left, right, root = treaps(start, (impact << 16) + lot[doc])
                yield _row(ids, terms, root.astype("<i4"), doc, impact.astype("<i4"), left.astype("<i4"), right.astype("<i4"), names=[c.split()[0] for c in INDEX.split(", ")])

    return run


class Segment:
    """The treaps of one segment."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.ids, self.terms = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("ids", "terms"))
        self.root, self.impact, self.left, self.right = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i4") for c in ("root", "impact", "left", "right"))
        self.doc = np.frombuffer(batch.column("doc")[i].as_buffer(), "<u2").astype(np.int32)
        self.known = int(np.searchsorted(self.ids, _NO_ID))

    def highest(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest node at or below each node whose document lies from ``low`` to before ``high``; -1 where there is none."""
        at = node.copy()
        todo = np.flatnonzero(at >= 0)
        while len(todo):
            here = at[todo]
            doc = self.doc[here]
            up, down = doc < low[todo], doc >= high[todo]
            out = up | down
            todo, here = todo[out], here[out]
            at[todo] = np.where(up[out], self.right[here], self.left[here])
            todo = todo[at[todo] >= 0]
        return at


# ---------------------------------------------------------------- search

class Queries:
    """Ids, and for each its terms (places in the sorted ``vocabulary``) and weights."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, self.start, self.weights = ids, start, weights
        self.vocabulary, self.place = np.unique(terms, return_inverse=True)


class Best:
    """The k best (score, id) so far of each query: higher scores first, then lesser ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((n, k), np.int64), np.full((n, k), np.iinfo(np.int64).min)

    def may_enter(self, query: np.ndarray, score: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        last = self.score[query, -1]
        return (score > last) | ((score == last) & (least_id < self.id[query, -1]))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = self.may_enter(query, score, ids)
        query, ids, score = query[good], ids[good], score[good]
        touched = np.unique(query)
        q = np.concatenate((query, np.repeat(touched, self.k)))
        i, s = np.concatenate((ids, self.id[touched].ravel())), np.concatenate((score, self.score[touched].ravel()))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = rank < self.k
        self.score[q[top], rank[top]], self.id[q[top], rank[top]] = s[top], i[top]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        q, r = np.nonzero(self.score > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(self.id[q, r]), pa.array(self.score[q, r])], names=["query_id", "doc_id", "score"])


class Ranges:
    """Ranges of documents: query, first document, end, and for each the highest nodes in it with their weights (``size`` of them, one after the other)."""

    def __init__(self, query, low, high, size, node, weight):
        self.query, self.low, self.high, self.size, self.node, self.weight = query, low, high, size, node, weight

    def pick(self, keep: np.ndarray) -> Ranges:
        nodes = np.repeat(keep, self.size)
        return Ranges(self.query[keep], self.low[keep], self.high[keep], self.size[keep], self.node[nodes], self.weight[nodes])

    def parts(self, nodes: int) -> list[Ranges]:
        """In pieces of about so many nodes, those of later ranges first."""
        if len(self.node) <= nodes:
            return [self] if len(self.query) else []
        piece = (np.cumsum(self.size) - 1) // nodes
        return [self.pick(piece == p) for p in np.unique(piece)[::-1]]


def _split(s: Segment, best: Best, r: Ranges) -> Ranges | None:
    """Drop the ranges that cannot matter, score one document of each of the others, and return the ranges on both sides of it."""
    first = np.cumsum(r.size) - r.size
    bound = np.add.reduceat(r.weight * s.impact[r.node], first)
    keep = best.may_enter(r.query, bound, s.ids[r.low])
    if not keep.any():
        return None
    r, bound = r.pick(keep), bound[keep]
    first, owner = np.cumsum(r.size) - r.size, np.repeat(np.arange(len(r.query)), r.size)
    part = r.weight * s.impact[r.node]
    most = np.flatnonzero(part == np.repeat(np.maximum.reduceat(part, first), r.size))
    most = most[np.append(True, owner[most][1:] != owner[most][:-1])]
    doc = s.doc[r.node[most]]
    at, low, high = doc[owner], r.low[owner], r.high[owner]
    hit = s.highest(r.node, at, at + 1)
    score = np.add.reduceat(np.where(hit >= 0, r.weight * s.impact[hit], 0), first)
    best.add(r.query, s.ids[doc], score)
    # ranges with high bounds go first, they raise the thresholds for the others
    sides = [(r.low, doc, s.highest(r.node, low, at)), (doc + 1, r.high, s.highest(r.node, at + 1, high))]
    new = []
    for begin, end, node in sides:
        there = node >= 0
        size = np.add.reduceat(there.astype(np.int64), first)
        some = size > 0
        new.append((r.query[some], begin[some], end[some], size[some], node[there], r.weight[there]))
    return Ranges(*(np.concatenate(x) for x in zip(*new)))


def search_segment(s: Segment, queries: Queries, best: Best, nodes: int = NODES) -> None:
    """Take the segment's documents into ``best``."""
    if not len(s.terms) or not s.known or not len(queries.vocabulary):
        return
    at = np.minimum(np.searchsorted(s.terms, queries.vocabulary), len(s.terms) - 1)
    root = np.where(s.terms[at] == queries.vocabulary, s.root[at], -1)[queries.place].astype(np.int32)
    if s.known < len(s.ids):
        root = s.highest(root, np.zeros(len(root), np.int32), np.full(len(root), s.known, np.int32))
    there = (root >= 0) & (queries.weights > 0)
    size = np.add.reduceat(there.astype(np.int64), queries.start[:-1])
    some = np.flatnonzero(size > 0)
    whole = Ranges(some, np.zeros(len(some), np.int32), np.full(len(some), s.known, np.int32), size[some], root[there], queries.weights[there])
    waiting = whole.parts(nodes)
    while waiting:
        below = _split(s, best, waiting.pop())
        if below is not None:
            waiting += below.parts(nodes)


def _searched(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = queries.value
        best = Best(len(own.ids), k)
        for batch in batches:
            for i in range(batch.num_rows):
                search_segment(Segment(batch, i), own, best)
        yield best.rows(own.ids)

    return run


# ---------------------------------------------------------------- on tables

class Index:
    """``lists`` (a written table, see ``discard``), the frequencies of its terms, the number of documents with a term and that of all their terms."""

    def __init__(self, lists: DataFrame, df: DataFrame, documents: int, words: int):
        self.lists, self.df, self.documents, self.words = lists, df, documents, words

    def grown(self) -> DataFrame:
        """The treaps, a row for each segment."""
        bounded_batches(self.lists.sparkSession, 1)  # one segment at a time goes to Python
        return self.lists.mapInArrow(_grown(self.documents, self.words), INDEX)

    def discard(self) -> None:
        discard(self.lists, self.df)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: np.ndarray | None = None) -> Index:
    """Lists and statistics of all rows; ``asked``, sorted hashes of terms, limits the lists to these. Rows with a null id count in the statistics and are no results."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = None if asked is None else spark.sparkContext.broadcast(asked)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lists = materialize(rows.mapInArrow(_listed(sent), LISTS), "lists")
    bounded_batches(spark, 1)
    counts = materialize(lists.select("n", "terms", "start").mapInArrow(_statistics, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "df")
    total = counts.where("term is null").first()
    df = counts.where("term is not null").select("term", "df")
    df._written_to = counts._written_to
    return Index(lists, df, total.df if total else 0, total.words if total else 0)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            t, n = np.unique(terms_of(x.as_py().encode())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i)), pa.array(t), pa.array(n)], names=["query_id", "term", "qtf"])


def query_terms(queries: DataFrame, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, term, qtf); of a repeated id the text that comes first in order is taken, null ids and texts are left out."""
    bounded_batches(queries.sparkSession)
    rows = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_text).cast("string").alias("text")).where("query_id is not null and text is not null")
    return materialize(rows.groupBy("query_id").agg(F.min("text").alias("text")).mapInArrow(_query_terms, "query_id long, term long, qtf long"), "asked")


def weights(terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, term, w): floor(1000 ln((2 N + 2) / (2 df + 1))) for each occurrence of the term in the query."""
    w = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    return terms.join(index.df, "term").select("query_id", "term", (w * F.col("qtf")).cast("long").alias("w"))


def search(index: Index, terms: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of every query of ``terms`` (see ``query_terms``)."""
    spark = terms.sparkSession
    pairs = materialize(weights(terms, index).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("p")).select("query_id", "p.term", "p.w"), "queries")
    blocks = -(-(pairs.agg(F.sum(F.size("term"))).first()[0] or 0) // QUERY_TERMS)
    schema = "query_id long, doc_id long, score long"
    grown = index.grown()
    if blocks > 1:
        grown = materialize(grown, "treaps")
    parts = [spark.createDataFrame([], "query_id long, rank int, doc_id long, score long")]
    for block in range(blocks):
        got = pairs.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()  # about QUERY_TERMS terms
        if not got.num_rows:
            continue
        term, w = got["term"].combine_chunks(), got["w"].combine_chunks()
        start = np.concatenate(([0], np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        sent = spark.sparkContext.broadcast(Queries(got["query_id"].to_numpy(), start, np.asarray(term.flatten()), np.asarray(w.flatten())))
        parts.append(materialize(_best(grown.mapInArrow(_searched(sent, k), schema), k), "found"))
    discard(pairs, *([grown] if blocks > 1 else []))
    bounded_batches(spark)
    return reduce(DataFrame.unionByName, parts)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. Every task has found up to k; they are first reduced in many parts of each query, then in one."""
    order = [F.desc("score"), "doc_id"]
    some = found.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "__part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents with the highest score above 0 for each query, over all rows of ``docs``.

    Every occurrence of a term in a query counts. Null and empty texts, and those without a term, match nothing and do not count as documents. Rows that
    repeat a document's id are documents of their own; of a repeated query id the text that comes first in order is taken. Null ids are left out as results and as
    queries. Ties go to the least doc_id. Empty tables give an empty result; other columns are ignored. Terms are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    terms = query_terms(queries, query_id, query_text)
    distinct = terms.select("term").distinct()
    asked = np.sort(distinct.toArrow()["term"].to_numpy()) if distinct.limit(ASKED + 1).count() <= ASKED else None
    index = build_index(docs, id_col, text_col, asked)
    found = search(index, terms, k)
    index.discard()
    discard(terms)
    return found
