"""Byte-level byte-pair encoding and decoding under a file of ranks, with the ``tokenizers`` library.

Model. A file of ranks names tokens, not merges. The merge that makes a token is the last one left when its own bytes are merged by least
rank; what stands around a token's bytes cannot change it, since a merge across their edge would prevent the token. So one
merge for each token, in the order of ranks, gives the ids of an encoder that works on ranks. A piece that is a token as a whole is taken as it is.
The model is made once and sent to the tasks as text of about the size of the vocabulary.

Encoding. Texts come in Arrow batches and are split by the pattern; every distinct piece is mapped from bytes to characters and
merged by the library once in a while (``CACHED`` pieces are remembered, then forgotten), its ids and offsets are used again. The library runs in
one thread, as Spark gives a core to each task, and a Python worker keeps its encoder for the tasks that follow. Decoding looks up
the bytes of every id through the reversed table; a character whose bytes lie in several tokens appears when they are joined.
"""

from __future__ import annotations

import base64
import codecs
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, unused

#: pieces remembered in a task, the longest of them in characters, and pieces of a text that are handled at once
CACHED, LONGEST, AT_ONCE = 250_000, 64, 1 << 16
#: bytes that stand for an id without a token (U+FFFD)
UNKNOWN = b"\xef\xbf\xbd"


def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 ones stand for themselves, the others for those from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts from which ``token`` is merged; None where merging never leads to it."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1))
        if rank == np.inf:
            return None
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def shown_tokens(ranks: dict[bytes, int]) -> dict[bytes, str]:
    """Each token's bytes as characters."""
    char = byte_characters()
    return {token: "".join(char[b] for b in token) for token in ranks}


def model_of(ranks: dict[bytes, int]) -> str:
    """The library's model of a file of ranks, as text."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = shown_tokens(ranks)
    merges = [pair for token in sorted(ranks, key=ranks.get) if len(token) > 1 and (pair := last_merge(token, ranks))]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[(shown[a], shown[b]) for a, b in merges], ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made.to_str()


class Encoder:
    """Ids of whole texts, each piece of the pattern merged separately; no string is a special token."""

    def __init__(self, model: str, pattern: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # small batches: its threads cost more than they save
        from tokenizers import Tokenizer

        self.model, self.pattern, self.cached = Tokenizer.from_str(model), regex.compile(pattern), cached
        self.ids: dict[str, bytes] = {}
        self.places: dict[str, np.ndarray] = {}

    def _learn(self, pieces: list[str], offsets: bool = False) -> None:
        known = self.places if offsets else self.ids
        new = [p for p in set(pieces) if p not in known]
        merged = self.model.encode_batch if offsets else self.model.encode_batch_fast
        for a in range(0, len(new), 1024):
            part = new[a:a + 1024]
            for p, e in zip(part, merged(part, add_special_tokens=False)):
                found = e.ids
                self.ids[p] = struct.pack(f"<{len(found)}I", *found)
                if offsets:
                    self.places[p] = np.array(e.offsets, "<u4").reshape(-1, 2)

    def _forget(self, pieces: list[str]) -> None:
        if len(self.ids) > self.cached:
            self.ids, self.places = {}, {}
            return
        for p in {p for p in pieces if len(p) > LONGEST}:
            del self.ids[p]
            self.places.pop(p, None)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= AT_ONCE:
            if text:
                yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, AT_ONCE)]:
            yield part

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out = []
        for pieces in self._pieces(text):
            self._learn(pieces)
            out.append(b"".join(map(self.ids.__getitem__, pieces)))
            self._forget(pieces)
        return b"".join(out)

    def encode_with_offsets(self, text: str) -> tuple[bytes, bytes]:
        """Ids, and start and end of each token in code points; tokens of one split character share its place."""
        ids, places, at = [], [], 0
        for pieces in self._pieces(text):
            self._learn(pieces, True)
            ids.append(b"".join(map(self.ids.__getitem__, pieces)))
            size = np.array([len(p) for p in pieces], np.int64)
            own = [self.places[p] for p in pieces]
            places.append((np.concatenate(own) + np.repeat(at + np.cumsum(size) - size, [len(x) for x in own])[:, None]).astype("<u4").tobytes())
            at += int(size.sum())
            self._forget(pieces)
        return b"".join(ids), b"".join(places)


class Decoder:
    """Bytes of ids, by the reversed table of a model's tokens, whose characters stand for bytes."""

    def __init__(self, tokens: dict[str, int]):
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.table = [UNKNOWN] * (max(tokens.values(), default=-1) + 1)
        for token, i in tokens.items():
            self.table[i] = bytes(byte[c] for c in token)

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").tolist()
        try:
            return b"".join(map(self.table.__getitem__, at))
        except IndexError:
            return b"".join(self.table[i] if i < len(self.table) else UNKNOWN for i in at)


@lru_cache(maxsize=1)
def encoder_of(model: str, pattern: str) -> Encoder:
    """The worker's encoder; what it remembers stays below its bound for as long as the worker lives."""
    return Encoder(model, pattern)


@lru_cache(maxsize=1)
def decoder_of(model: str) -> Decoder:
    from tokenizers import Tokenizer

    return Decoder(Tokenizer.from_str(model).get_vocab())


def split_ends(data: bytes) -> tuple[bytes, str, bytes]:
    """Bytes that continue a character begun before, the whole characters, and the bytes of a character that goes on after.

    Bytes in between that are no UTF-8 become U+FFFD.
    """
    head = next((i for i, b in enumerate(data[:3]) if b & 0xC0 != 0x80), min(3, len(data)))
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    text = reader.decode(data[head:])
    rest = reader.getstate()[0]
    return data[:head], text, rest


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids): ``ids`` holds little-endian unsigned 32-bit numbers; with ``offsets`` also ``places``, start and end of each token in code points alike.

    With ``decoded`` also the bytes of the ids, decoded from them in the same pass: a round trip needs one Python worker for a task instead of two.

    One row for each row, in place and without a shuffle. A null text is encoded as empty: no tokens. Null and repeated ids are kept as they are, other
    columns ignored; an empty table gives none. Only the driver reads the file of ranks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(model_of(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value, pattern)
        decoder = decoder_of(model.value) if decoded else None
        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            found = [encoder.encode_with_offsets(t) if offsets else (encoder.encode(t),) for t in texts]
            more = [pa.array([f[i] for f in found], pa.binary()) for i in range(2 if offsets else 1)]
            if decoder:
                more.append(pa.array([decoder.decode(f[0]) for f in found], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f[0]) // 4 for f in found], pa.int64()), *more], names=names)

    names = [id_col, "n_tokens", "ids"] + (["places"] if offsets else []) + (["decoded"] if decoded else [])
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(unused(docs.select(id_col), "text")))
    schema = T.StructType([rows.schema[0], *(T.StructField(n, T.LongType() if n == "n_tokens" else T.BinaryType()) for n in names[1:])])
    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", text: bool = False) -> DataFrame:
    """The other columns of ``tokens`` and ``decoded``, the bytes of the ids; with ``text`` also ``head``, ``text`` and ``tail`` (see ``split_ends``).

    The sequences may be windows cut anywhere: where a cut splits a character, its bytes lie in the ``tail`` of one window and in the ``head`` of the next, and the
    bytes of all windows in their order are those of the whole. Null ids are decoded as none, an id without a token as U+FFFD. Columns of ``tokens`` that bear a new
    column's name are replaced.
    """
    spark = tokens.sparkSession
    bounded_batches(spark)
    ranks = read_ranks(ranks_path)
    vocabulary = spark.sparkContext.broadcast({shown: ranks[token] for token, shown in shown_tokens(ranks).items()})
    new = ["decoded", "head", "text", "tail"] if text else ["decoded"]
    kept = [c for c in tokens.columns if c.lower() not in {ids_col.lower(), *new}]
    rows = tokens.select(*kept, F.coalesce(F.col(ids_col), F.lit(b"")).alias(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            data = [decoder.decode(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            more = [pa.array(data, pa.binary())]
            if text:
                found = [split_ends(d) for d in data]
                more += [pa.array([f[i] for f in found], pa.string() if i == 1 else pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*kept, *new])

    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(n, T.StringType() if n == "text" else T.BinaryType()) for n in new)])
    return rows.mapInArrow(run, schema)
