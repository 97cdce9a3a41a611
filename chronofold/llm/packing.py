"""Order-preserving packing of documents into sequences by dynamic programming.

The documents of an input partition form one stream of token ids in the order in which they are read; no shuffle moves
a text. A cut between two sequences falls at the end of a document (free) or of a sentence (``SENTENCE`` tokens of padding). A cut
after a word is dearer than the padding up to any document or sentence end within ``WORD`` tokens, so it occurs only
where none is in that reach (text without punctuation); candidates are at most one for every ``GRAIN`` tokens. A word that alone
exceeds a sequence is cut anywhere (``HARD``).
With S the running token count at the allowed cuts, the least cost of the cuts up to k is

    f[k] = penalty[k] + L - S[k] + min { f[i] + S[i] : S[k] - S[i] <= L }

whose minimum over a sliding window a monotone queue gives in amortised constant time. The stream is handled in stretches of
``horizon`` sequences: all but the last of a stretch are final, the rest is solved again with what follows. What
remains at the end of a partition is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

LENGTH, END_ID = 2048, 1
#: penalties of cuts in tokens: after a sentence, after a word, inside a word
SENTENCE, WORD, HARD = 4.0, 256.0, 512.0
GRAIN, HORIZON = 16, 32

# fixed values: how the vocabulary splits a text before its merges; the second form is equal where white space stands single
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 ones stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokenizer:
    """Token ids of whole texts under a byte-level vocabulary file of the ``tokenizers`` library, as its ``encode(text, add_special_tokens=False)``.

    The merges run in another library that is several times faster; ids are equal (tested). Strings of special tokens in a text
    become those tokens. Lone surrogates are replaced before encoding.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = _byte_of()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in self.special}
        self.full = tiktoken.Encoding("full", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.single = tiktoken.Encoding("single", pat_str=SPLIT_SINGLE, mergeable_ranks=ranks, special_tokens=self.special)
        size = max(*ranks.values(), *self.special.values(), 0) + 1
        # tokens that begin with a space or line end, and those that end a sentence
        self.opens, self.closes = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, i in ranks.items():
            self.opens[i] = token[:1] in (b" ", b"\n")
            self.closes[i] = token[-1:] in (b".", b"!", b"?")
        self.closes[list(self.special.values())] = True

    def encode(self, text: str) -> np.ndarray:
        pairs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        plain = not pairs and text.replace("\n", "").isprintable()  # no other white space then
        by = self.single if plain else self.full
        special = any(s in text for s in self.special)
        return np.array(by.encode(text, allowed_special="all") if special else by.encode_ordinary(text), dtype="<u4")

    def cuts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts after which a word ends, and which of these end a sentence."""
        at = np.flatnonzero(self.opens[ids[1:]]) + 1
        return at, self.closes[ids[at - 1]]


_LOADED: dict[str, ByteTokenizer] = {}


def loaded(path: str) -> ByteTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Places in ``cuts`` of the cheapest windows' ends, the last at most ``length`` before the last cut. ``cuts`` rise from above 0, by ``length`` at most."""
    s = [0, *cuts.tolist()]
    pen = [0.0, *penalty.tolist()]
    g = [0.0] * len(s)  # f[i] + S[i]
    back = [0] * len(s)
    queue: deque[int] = deque([0])
    for k in range(1, len(s)):
        sk = s[k]
        while s[queue[0]] < sk - length:
            queue.popleft()
        i = queue[0]
        back[k] = i
        gk = g[k] = pen[k] + length + g[i]  # f[k] + S[k]
        while queue and g[queue[-1]] > gk:
            queue.pop()
        queue.append(k)
    # what follows the last cut goes on into the next stretch, at no cost yet
    k = min((k for k in range(len(s) - 1, -1, -1) if s[-1] - s[k] <= length), key=lambda k: (g[k] - s[k], -k))
    out = []
    while k > 0:
        out.append(k - 1)
        k = back[k]
    return out[::-1]


class Packer:
    """Takes documents one by one and gives pieces as rows."""

    def __init__(self, first_sequence: int, length: int = LENGTH, sentence: float = SENTENCE, word: float = WORD, hard: float = HARD, grain: int = GRAIN, horizon: int = HORIZON):
        self.length, self.sentence, self.word, self.hard, self.grain = length, sentence, word, hard, grain
        self.room = horizon * length
        self.sequence = first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids, offset of ids[0] in the stretch, tokens before ids[0] in its document, tokens of the document)
        self.cuts: list[np.ndarray] = []
        self.penalties: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_id, ids: np.ndarray, counts: np.ndarray, sentence_ends: np.ndarray) -> Iterator[tuple]:
        n = len(ids)
        # the ends of sentences, and the first word that ends in each stretch of ``grain`` tokens
        keep = sentence_ends.copy()
        keep[1:] |= counts[1:] // self.grain != counts[:-1] // self.grain
        ends = np.append(counts[keep], n)
        pen = np.append(np.where(sentence_ends[keep], self.sentence, self.word), 0.0)
        gaps = np.diff(ends, prepend=0)
        if gaps.max() > self.length:
            extra = np.concatenate([np.arange(e - g + self.length, e, self.length) for e, g in zip(ends.tolist(), gaps.tolist()) if g > self.length])
            ends = np.concatenate((ends, extra))
            pen = np.concatenate((pen, np.full(len(extra), self.hard)))
            order = np.argsort(ends, kind="stable")
            ends, pen = ends[order], pen[order]
        self.docs.append((doc_id, ids, self.total, 0, n))
        self.cuts.append(ends + self.total)
        self.penalties.append(pen)
        self.total += n
        if self.total >= self.room:
            yield from self._settle(keep=1)

    def finish(self) -> Iterator[tuple]:
        if self.total:
            yield from self._settle(keep=0)
        at = 0
        while at < self.total:  # the binary digits of what is left
            size = min(1 << ((self.total - at).bit_length() - 1), self.length)
            yield from self._window(at, at + size)
            at += size
        self.docs, self.cuts, self.penalties, self.total = [], [], [], 0

    def _settle(self, keep: int) -> Iterator[tuple]:
        cuts, pen = np.concatenate(self.cuts), np.concatenate(self.penalties)
        ends = best_cuts(cuts, pen, self.length)
        final = ends[:len(ends) - keep]
        at = 0
        for e in final:
            yield from self._window(at, int(cuts[e]))
            at = int(cuts[e])
        if at:
            rest = cuts > at
            self.cuts, self.penalties = [cuts[rest] - at], [pen[rest]]
            self.docs = [(d, ids[max(0, at - o):], max(0, o - at), before + max(0, at - o), n) for d, ids, o, before, n in self.docs if o + len(ids) > at]
            self.total -= at

    def _window(self, a: int, b: int) -> Iterator[tuple]:
        first = self._find(a)
        for d, ids, o, before, n in self.docs[first:]:
            if o >= b:
                break
            lo, hi = max(a, o), min(b, o + len(ids))
            if lo < hi:
                piece = ids[lo - o:hi - o]
                yield d, before + lo - o, hi - lo, zlib.crc32(piece.tobytes()), n, self.sequence, lo - a
        self.sequence += 1

    def _find(self, a: int) -> int:
        lo, hi = 0, len(self.docs) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.docs[mid][2] <= a:
                lo = mid
            else:
                hi = mid - 1
        return lo


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, horizon: int = HORIZON) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each text's ids are followed by ``end_id``; a null or empty text is that id alone. Rows keep the order in which their
    partition is read; a sequence holds rows of one partition, whose number fills the upper bits of sequence_id. Rows that
    repeat an id are documents of their own. Null ids stay null. An empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40, length, horizon=horizon)
        end = np.array([end_id], dtype="<u4")
        rows: list[tuple] = []
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.encode(t.as_py() or "")
                rows.extend(packer.add(d, np.concatenate((ids, end)), *tokenizer.cuts(ids)))
            if len(rows) > 4096:
                yield _pieces(rows)
                rows = []
        rows.extend(packer.finish())
        yield _pieces(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_TYPES)
