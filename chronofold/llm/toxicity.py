"""Toxicity scoring behind a noisy channel.

A writer who wants to slip past a filter sends a word through a channel that swaps letters for look-alikes
(``1d10t``), spreads it out (``i d i o t``, ``i.d.i.o.t``) or repeats letters (``idiooot``). A suspicious token is
turned into a lattice of the letters each character may stand for, with the channel's costs, and a Viterbi search
under a character trigram model restores the likeliest word. The model's counts come from the whole corpus. The
restored words are added to the words as they stand, and both are scored. Where letters are spread out, one word may
end and the next begin between any two of them, so the lattice also holds word edges there.

The score has two parts, both learned from a bounded sample of labelled rows (``max_train``): log odds of words and
word beginnings (3 to 6 letters, so that inflected and compounded forms share evidence), and a logistic model over
a document's strongest log odds. Each training row's odds are computed without that row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: labelled rows used for fitting at most: those with the least hash of their id
MAX_TRAIN = 20_000
#: log odds from which on a feature counts; those below are no evidence. With MAX_TRAIN this bounds the model sent to the executors
MIN_ODDS = 1.0
PREFIXES = (3, 4, 5, 6)

# fixed values: look-alike characters and the letters they stand for
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + ACCENTED

# ---------------------------------------------------------------- character model

_K = len(LETTERS) + 2  # 0: word edge, 1: any other character
_CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
_LUT = np.zeros(0x250, dtype=np.int32)
for _c, _i in _CODE.items():
    _LUT[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _LUT[ord(_c.upper())] = _i
for _o in range(0x250):
    if _LUT[_o] == 0 and chr(_o).isalpha():
        _LUT[_o] = 1


def char_codes(text: str) -> np.ndarray:
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(u < 0x250, _LUT[np.minimum(u, 0x24F)], 1)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_K ** 3, dtype=np.int64)
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:  # texts end with two edges, so that no trigram joins two of them
        if held:
            c = np.concatenate([np.zeros(2, dtype=np.int32), *held])
            total[:] += np.bincount(c[:-2] * (_K * _K) + c[1:-1] * _K + c[2:], minlength=_K ** 3)
            held.clear()

    for batch in batches:
        for t in batch.column(0):
            if t.is_valid:
                held.append(np.append(char_codes(t.as_py()), (0, 0)).astype(np.int32))
                size += len(held[-1])
                if size > 1 << 20:
                    flush()
                    size = 0
    flush()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


class CharModel:
    """Trigram log probabilities with add-``k`` smoothing backed off to bigrams."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(_K, _K, _K).astype(np.float64)
        two = n.sum(axis=0)
        one = two.sum(axis=0)
        p1 = (one + 1) / (one.sum() + _K)
        p2 = (two + 5 * p1[None, :]) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (n + 5 * p2[None, :, :]) / (n.sum(axis=2, keepdims=True) + 5)
        self.logp = np.log(p3).astype(np.float32)


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counts of all character trigrams of all texts (K ** 3 bins, summed on the executors)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_K ** 3, dtype=np.int64)
    for r in rows:  # at most K ** 3 bins
        counts[r.gram] = r.n
    return CharModel(counts)


# ---------------------------------------------------------------- lattice and search

#: costs of the channel's moves (negative log probabilities)
SWAP, KEEP_ODD, DROP_REPEAT, KEEP_REPEAT = 0.7, 4.0, 0.3, 2.5
#: a letter written twice, which most words with one have by right; a word edge between spread letters
DROP_DOUBLE, EDGE = 2.0, 2.0

_SPREAD = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]|[0-9@$!|+€])(?:[ .\-_*]{1,2}(?:[^\W\d_]|[0-9@$!|+€])){2,}(?![^\W\d_])")
# begins where a token does or behind a low line, and never gives letters back: each is read once
_MIXED = re.compile(r"(?:(?<![\w@$!|+€£¡])|(?<=_))[^\W0-9_]*+[0-9@$!|+€£¡][\w@$!|+€£¡]*")
_RUN = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"([ .\-_*]*)([^ .\-_*])")
# what a text must hold for the patterns above to find anything
_MAY_SPREAD = re.compile(r"\b\w[ .\-_*]{1,2}[\w@$!|+€][ .\-_*]|[@$!|+€][ .\-_*]{1,2}[\w@$!|+€][ .\-_*]")
_MAY_MIX = re.compile(r"[0-9@$!|+€£¡]")
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = "!$|+*#%&.,;:?\"'()[]{}<>=~^`/\\"


def lattice(token: str, edges: list[list[tuple[str, float]]] | None = None) -> list[list[tuple[str, float]]]:
    """Choices of each place: (letter or '', cost). Runs of three or more of one letter may shrink to two or one, runs of two to one.

    edges: the choices (' ' for a word edge) before each letter but the first.
    """
    out: list[list[tuple[str, float]]] = []
    i, n = 0, len(token)
    while i < n:
        c = token[i]
        j = i
        while j < n and token[j] == c:
            j += 1
        run = j - i
        if c in LOOKALIKES:
            choices = [(x, SWAP) for x in LOOKALIKES[c]] + [(c, KEEP_ODD)]
        else:
            choices = [(c, 0.0)]
        if edges and i:
            out.append(edges[i - 1])
        out.append(choices)
        if run > 1:
            if edges:
                out.append(min(edges[i:j - 1], key=lambda e: (e[0][0] == "", e[-1][1])))
            if run > 2:
                out.append([("", DROP_REPEAT)] + [(x, p + KEEP_REPEAT) for x, p in choices])
            else:
                out.append([*choices, ("", DROP_DOUBLE)])
        i = j
    return out


def viterbi(places: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The cheapest path through the lattice, with word edges before and after it. Ties go to the earlier choice."""
    logp = model.logp
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    trail: list[dict] = []
    for choices in places:
        costs: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple] = {}
        for (a, b), cost in states.items():
            for letter, price in choices:
                if letter:
                    code = _CODE.get(letter, 1) if letter != " " else 0
                    key, new = (b, code), cost + price - float(logp[a, b, code])
                else:
                    key, new = (a, b), cost + price
                if new < costs.get(key, 1e300):
                    costs[key], back[key] = new, ((a, b), letter)
        states = costs
        trail.append(back)
    if not states:
        return ""
    key = min((cost - float(logp[a, b, 0]), (a, b)) for (a, b), cost in states.items())[1]
    out = []
    for back in reversed(trail):
        key, letter = back[key]
        out.append(letter)
    return "".join(reversed(out))


def spread_words(run: str, model: CharModel) -> set[str]:
    """Words that letters spread out may stand for: one word, and cut at word edges, with and without the first letter,
    which may be a word of its own.

    An edge costs ``EDGE``, or nothing at a gap that is wider than others of the run, or a space where others are marks; these
    gaps are also taken as edges throughout. As the model may know a corpus of other words, edges are tried without cost too.
    """
    parts = _LETTER.findall(run)
    token, gaps = "".join(c for _, c in parts), [g for g, _ in parts[1:]]
    least, marks = min(map(len, gaps)), any(" " not in g for g in gaps)
    wide = [len(g) > least or (marks and " " in g) for g in gaps]
    edge, free, forced = [("", 0.0), (" ", EDGE)], [("", 0.0), (" ", 0.0)], [(" ", 0.0)]
    ways: list = [None, [free if w else edge for w in wide], [free] * len(gaps)]
    if any(wide):
        ways.append([forced if w else edge for w in wide])
        ways.append([forced if w else [("", 0.0)] for w in wide])
    return {w for way in ways for k in (0, 1) for w in _WORD.findall(viterbi(lattice(token[k:], way and way[k:]), model))}


def restored(text: str, words: set[str], model: CharModel, cache: dict) -> set[str]:
    """Words that the suspicious tokens of a lower-cased text with these words may stand for."""
    found: set[str] = set()
    tokens: set[str] = {w for w in words if _RUN.search(w)}
    if _MAY_SPREAD.search(text):
        for m in set(_SPREAD.findall(text)):  # joined letters are a new word even if nothing else changes
            if not any(c.isalpha() for c in m):
                continue
            got = cache.get(" " + m)
            if got is None:
                got = spread_words(m, model)
                if len(cache) < 200_000:
                    cache[" " + m] = got
            found |= got
    if _MAY_MIX.search(text):
        tokens.update(m.rstrip(_EDGE) for m in _MIXED.findall(text))
    for t in tokens:
        if len(t) < 3 or not any(c.isalpha() for c in t):
            continue
        got = cache.get(t)
        if got is None:
            got = viterbi(lattice(t), model)
            if len(cache) < 200_000:
                cache[t] = got
        if got != t:
            found.update(_WORD.findall(got))
    return found


def all_words(text: str | None, model: CharModel, cache: dict) -> set[str]:
    """The distinct words of the text and of its restored tokens."""
    if not text:
        return set()
    low = text.lower()
    words = set(_WORD.findall(low))
    return words | restored(low, words, model, cache)


def word_features(word: str) -> list[str]:
    """The word (marked) and its beginnings."""
    return [word + "$", *[word[:k] for k in PREFIXES if len(word) >= k]]


def features(text: str | None, model: CharModel, cache: dict) -> set[str]:
    out: set[str] = set()
    for w in all_words(text, model, cache):
        out.update(word_features(w))
    return out


# ---------------------------------------------------------------- learning

class Scorer:
    """Log odds of features and the logistic weights over a document's strongest ones."""

    TOP = 8
    STRENGTH = 2.0  # pseudo rows of a feature at the base rate

    def __init__(self, counts: dict[str, tuple[int, int]], pos: int, neg: int):
        self.pos, self.neg = pos, neg
        rate = (pos + 1) / (pos + neg + 2)
        m = self.STRENGTH
        base = np.log(rate / (1 - rate))
        names = sorted(counts)
        a, b = np.array([counts[f] for f in names], dtype=np.float64).reshape(-1, 2).T
        odds = lambda a, b: np.log((a + m * rate) / (b + m * (1 - rate))) - base
        all_three = np.stack([odds(a, b), odds(np.maximum(a - 1, 0), b), odds(a, np.maximum(b - 1, 0))], axis=1)
        self.odds = {f: tuple(o) for f, o in zip(names, all_three.tolist()) if o[0] >= MIN_ODDS}
        self.base = float(base)
        self.weights = np.zeros(4)
        self.weights[0] = base

    @staticmethod
    def evidence(pos: int, neg: int) -> Column:
        """The same log odds over columns a and b."""
        rate, m = (pos + 1) / (pos + neg + 2), Scorer.STRENGTH
        return F.log((F.col("a") + m * rate) / (F.col("b") + m * (1 - rate))) - float(np.log(rate / (1 - rate)))

    def stats(self, found: set[str], which: int = 0) -> np.ndarray:
        """1, the strongest log odds, the mean of the three strongest, the share of strong ones. which: 1 or 2 leaves out a toxic or clean row itself."""
        odds = self.odds
        got = sorted((odds[f][which] for f in found if f in odds), reverse=True)[:self.TOP]
        got = [max(x, 0.0) for x in got] + [0.0] * (self.TOP - len(got))
        return np.array([1.0, got[0], sum(got[:3]) / 3, sum(got) / self.TOP])

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> None:
        """Logistic regression by Newton steps."""
        w = self.weights.copy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (y - p) - ridge * np.r_[0, w[1:]]
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def known(self, words: set[str], memo: dict) -> set[str]:
        """The learned features of these words. memo: remembers them word by word."""
        out: set[str] = set()
        if len(memo) > 400_000:
            memo.clear()
        for w in words:
            got = memo.get(w)
            if got is None:
                got = memo[w] = tuple([f for f in word_features(w) if f in self.odds])
            if got:
                out.update(got)
        return out

    def score(self, found: set[str]) -> float:
        z = float(self.stats(found) @ self.weights)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, y) of the labelled rows: ids for which ``allowed`` (over column ``doc_id``) holds, at most ``max_train``.

    Several labels of one id count as toxic if any is; null labels and null ids are left out.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(allowed)
    ids = ids.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(ids), "doc_id").select("text", "y")  # max_train bounds what is broadcast


def fit(docs: DataFrame, labels: DataFrame, model: CharModel, allowed: Column, max_train: int = MAX_TRAIN, **cols: str) -> Scorer:
    """Two passes over the bounded training rows. Without labelled rows of both kinds every score is the base rate."""
    rows = materialize(training_rows(docs, labels, allowed, max_train, **cols), "tox-train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        seen = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(features(t, model, cache))
                n[y] += 1
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(["", *seen[y].keys()], pa.string()), pa.array([y] * (len(seen[y]) + 1), pa.int32()), pa.array([n[y], *seen[y].values()], pa.int64())], names=["f", "y", "n"])

    counts = rows.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("a"), F.sum(F.expr("if(y = 0, n, 0)")).alias("b"))
    counts = materialize(counts, "tox-counts")
    whole = counts.where("f = ''").collect()
    pos, neg = (int(whole[0].a), int(whole[0].b)) if whole else (0, 0)
    top = counts.where("f <> '' and a > 1").where(Scorer.evidence(pos, neg) >= MIN_ODDS - 1e-6).select("f", "a", "b").toArrow()
    scorer = Scorer({f: (a, b) for f, a, b in zip(*(top[c].to_pylist() for c in ("f", "a", "b")))}, pos, neg)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        memo: dict = {}
        for batch in batches:
            ys = batch.column(1).to_pylist()
            x = [scorer.stats(scorer.known(all_words(t, model, cache), memo), 1 if y else 2) for t, y in zip(batch.column(0).to_pylist(), ys)]
            x = np.array(x).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(1, 4)] + [pa.array(ys, pa.int32())], names=["x1", "x2", "x3", "y"])

    if pos and neg:
        got = rows.mapInArrow(stats, "x1 double, x2 double, x3 double, y int").toPandas()  # max_train rows of four numbers
        got = got.sort_values(["x1", "x2", "x3", "y"])
        scorer.fit(np.c_[np.ones(len(got)), got[["x1", "x2", "x3"]].to_numpy()], got.y.to_numpy(dtype=float))
    return scorer


def score_toxicity(docs: DataFrame, model: CharModel, scorer: Scorer, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score in 0 to 1 beside all its columns (a column of that name is replaced).

    Null and empty texts have no features and get the score of a document without any evidence. Rows are
    scored one by one: repeated rows get equal scores, ids play no part; texts of any length are read whole; an empty table gives
    an empty result.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        memo: dict = {}
        for texts in batches:
            yield pd.Series([scorer.score(scorer.known(all_words(t, model, cache), memo)) for t in texts], dtype="float64")

    return docs.withColumn(out_col, score(F.col(text_col)))
