"""Fill-in-the-middle, byte-level encoding and ranked search against brute force, round trips and SQL, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import bytebpe, fim, treaps
from chronofold.llm.queries_bpe import op12_byte_bpe
from chronofold.llm.queries_fim import ORACLES as FIM_SQL
from chronofold.llm.queries_fim import op11_fill_in_middle
from chronofold.llm.queries_treaps import ORACLES as SEARCH_SQL
from chronofold.llm.queries_treaps import op13_ranked_search
from tests.compare import of_frame, of_sql

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n \t", "a", "<", "<S", "<P", "x<S>y", "<M>", ">P>", "é", "日本語 のテキスト", "😀😀👩‍👩‍👧‍👦", "é́", "a\x00b", "it's we'll 12345 ...   end  ", "word" * 5000, " " * 3000, "ab1 " * 3000,
       "  　x", "\U0010ffff�", "ｆｕｌｌ　ｗｉｄｔｈ"]


def odd_docs(spark):
    return spark.createDataFrame(list(enumerate(ODD)) + [(None, "null id"), (3, "same id"), (3, "same id")], DOCS)


# ---------------------------------------------------------------- fill in the middle

def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, sha = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_brute_force_and_is_undone(spark):
    rng = random.Random(6)
    docs = list(enumerate(ODD)) + [(None, "null id"), (3, "same id"), (3, "same id")] + [(100 + i, "".join(rng.choice("ab<>PSM é\n😀") for _ in range(rng.randrange(60)))) for i in range(300)]
    made = fim.fill_in_middle(spark.createDataFrame(docs, DOCS)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((brute_fim(*d) for d in docs), key=key)
    assert Counter(r.back for r in made) == Counter(t or "" for _, t in docs)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_fill_in_middle_with_other_parameters(spark):
    docs = spark.createDataFrame([(i, f"one two [s] {i} three") for i in range(50)], DOCS).withColumn("form", F.lit("clash")).withColumn("N", F.lit(1))
    made = fim.fill_in_middle(docs, seed=7, unit=r"\w+|\W", markers=("[p.]", "[s+]", "[m*]"), transformed=100, suffix_first=50)
    got = made.select("n", "form", fim.restored(F.col("output"), F.col("form"), ("[p.]", "[s+]", "[m*]")).alias("back"), "doc_id").collect()
    assert all(r.back == f"one two [s] {r.doc_id} three" and r.n == 11 for r in got) and {r.form for r in got} == {"psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_matcher_keeps_no_units():
    import tracemalloc

    pattern, text = re.compile(fim.UNIT), "ab c" * 500_000
    tracemalloc.start()
    n = fim.count_units(pattern, text)
    fim.ends(pattern, text, n // 3, 2 * n // 3)
    assert n == 1_000_001 and tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def test_query_fill_in_middle(spark, sf_dir):
    assert of_frame(op11_fill_in_middle(spark, sf_dir)) == of_sql(FIM_SQL["op11_fill_in_middle"], sf_dir)


# ---------------------------------------------------------------- byte-level encoding

@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def model():
    return bytebpe.model_of(bytebpe.read_ranks(RANKS))


def tokens_of(path):
    ranks = bytebpe.read_ranks(path)
    return {shown: ranks[token] for token, shown in bytebpe.shown_tokens(ranks).items()}


def test_ids_equal_the_reference_encoder(reference, model):
    rng = random.Random(8)
    alphabets = ["ab ", "aA'st 1\n", "éñü日本語", "😀‍́क्ष", " \t\n ", "0123456789.,-", "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(300)), "".join(map(chr, rng.sample(range(0x10000, 0x110000), 300)))]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(a) for _ in range(rng.randrange(80))) for a in alphabets for _ in range(400)] + ["a" * n for n in range(1, 60)]
    encoder, decoder = bytebpe.Encoder(model, public_tokenizers.PATTERN, cached=50), bytebpe.Decoder(tokens_of(RANKS))
    for t in texts:
        want = np.array(reference.encode_ordinary(t), "<u4").tobytes()
        assert encoder.encode(t) == want, t
        assert decoder.decode(want) == t.encode()


def test_every_token_is_reached(reference, model):
    ranks, encoder = bytebpe.read_ranks(RANKS), bytebpe.Encoder(model, public_tokenizers.PATTERN)
    for token, rank in list(ranks.items())[::7]:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert encoder.encode(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes(), (token, rank)


def test_offsets(model, monkeypatch):
    monkeypatch.setattr(bytebpe, "AT_ONCE", 5)
    encoder, decoder = bytebpe.Encoder(model, public_tokenizers.PATTERN), bytebpe.Decoder(tokens_of(RANKS))
    for text in (t or "" for t in ODD):
        ids, places = encoder.encode_with_offsets(text)
        assert ids == encoder.encode(text)
        at = np.frombuffer(places, "<u4").reshape(-1, 2)
        assert len(at) == len(ids) // 4
        whole = [decoder.decode(ids[4 * i:4 * i + 4]) for i in range(len(at))]
        for (a, b), data in zip(at.tolist(), whole):
            assert data in text[a:b].encode()
        assert not len(at) or (at[0, 0] == 0 and at[-1, 1] == len(text) and (at[1:, 0] <= at[:-1, 1]).all())


def test_round_trip_on_tables(spark, reference):
    docs = odd_docs(spark).withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit("clash"))
    tokens = bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    got = bytebpe.decode(tokens, RANKS, text=True).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode(), r.text, r.n_tokens) for r in got) == Counter((r.doc_id, r.text or "", r.text or "", len(reference.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert bytebpe.decode(bytebpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    trip = bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True, decoded=True)
    assert trip.columns == [*tokens.columns, "decoded"] and sorted(map(str, trip.drop("decoded").collect())) == sorted(map(str, tokens.collect()))
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in trip.collect()) == sorted((bytes(i), bytes(r.decoded)) for i, r in zip([r.ids for r in tokens.collect()], bytebpe.decode(tokens, RANKS).collect()))


def test_windows_that_split_characters(spark, reference):
    text = "日本語😀 naïve ☃ 👩‍👩‍👧‍👦 текст क्ष" * 3
    ids = reference.encode_ordinary(text)
    for step in (1, 2, 3, 7):
        cut = [(i, bytearray(np.array(ids[i:i + step], "<u4").tobytes())) for i in range(0, len(ids), step)]
        got = sorted(bytebpe.decode(spark.createDataFrame(cut, "at int, ids binary"), RANKS, text=True).collect())
        assert b"".join(bytes(r.decoded) for r in got).decode() == text
        assert all(bytes(r.head) + r.text.encode() + bytes(r.tail) == bytes(r.decoded) for r in got)
        assert any(r.head for r in got) and "�" not in "".join(r.text for r in got)
    assert bytebpe.split_ends(b"\x80\x80") == (b"\x80\x80", "", b"") and bytebpe.split_ends(b"a\xffb\xe6") == (b"", "a�b", b"\xe6")
    assert [bytes(r.decoded) for r in bytebpe.decode(spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),), (None,)], "ids binary"), RANKS).collect()] == [bytebpe.UNKNOWN, b""]


def test_query_byte_bpe(spark, sf_dir, reference):
    got = {r.doc_id: tuple(r)[1:] for r in op12_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        assert got[d.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    assert len(got) == len(docs)


# ---------------------------------------------------------------- ranked search

def cut(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_ranked(docs, queries, k=10):
    terms = [(i, Counter(cut(t))) for i, t in docs]
    size = [sum(c.values()) for _, c in terms]
    docs_n, words = sum(n > 0 for n in size), sum(size)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for q, text in queries:
        found = []
        for (i, c), n in zip(terms, size):
            if i is None or not n:
                continue
            m = 25 + 75 * n * docs_n // words
            score = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if score > 0:
                found.append((-score, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("segment", "nodes", "asked", "block"), [(16_384, 200_000, 10**6, 200_000), (40, 30, 10**6, 25), (25, 7, 3, 200_000), (60, 500, 0, 10)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, segment, nodes, asked, block):
    monkeypatch.setattr(treaps, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(treaps, "ASKED", asked)
    monkeypatch.setattr(treaps, "QUERY_TERMS", block)
    monkeypatch.setattr(treaps.search_segment, "__defaults__", (nodes,))
    rng = random.Random(segment)
    words = [f"{rng.choice(['A', 'b', 'é', '7', '語'])}{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), 59)] + rng.choice(["", ",", ".-"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(250)]
    docs += [(1000 + i, docs[5][1]) for i in range(120)] + [(2000, None), (2001, ""), (2002, " .,"), (7, "A1 b2"), (None, docs[5][1]), (None, "é3"), (-4, docs[5][1])]
    queries = [(i, text(rng.randrange(1, 25))) for i in range(20)] + [(50, docs[5][1]), (51, None), (52, ""), (53, "absent"), (54, words[0]), (None, "A1"), (55, "b2 B2 b2")]
    got = treaps.ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(queries, "query_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_ranked(docs, [q for q in queries if q[0] is not None])


def test_ranked_search_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b c")], DOCS)
    queries = spark.createDataFrame([(9, "a"), (9, "c"), (8, "zz")], "query_id long, text string")
    got = treaps.ranked(docs.withColumn("SCORE", F.lit(1)), queries.withColumn("rank", F.lit(1)), k=5).collect()
    assert [tuple(r)[:3] for r in got] == [(9, 1, 1), (9, 2, 1)]  # of a repeated query id the first text, repeated documents one by one
    assert treaps.ranked(docs.limit(0), queries).count() == treaps.ranked(docs, queries.limit(0)).count() == 0
    assert treaps.ranked(spark.createDataFrame([(1, None), (2, "..")], DOCS), queries).count() == 0


def test_terms_of_long_texts(monkeypatch):
    text = ("Aé1 b_c " * 2000 + "x" * 5000).encode()
    whole = treaps.terms_of(text)[0].tolist()
    monkeypatch.setattr(treaps, "CUT_BYTES", 100)
    assert treaps.terms_of(text)[0].tolist() == whole and len(whole) == 6001 and len(set(whole)) == 4
    assert treaps.terms_of(b"")[0].tolist() == [] == treaps.terms_of(b" ;.")[0].tolist()


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 200, 30)
    start = np.concatenate(([0], np.cumsum(sizes)))
    priority = np.concatenate([rng.permutation(n) for n in sizes[:-1]] + [np.arange(sizes[-1])])
    left, right, root = treaps.treaps(start, priority)
    for r, a, b in zip(root.tolist(), start[:-1].tolist(), start[1:].tolist()):
        order, stack, at = [], [], r
        while stack or at >= 0:  # in order
            while at >= 0:
                for child in (left[at], right[at]):
                    assert child < 0 or priority[child] < priority[at]
                stack.append(at)
                at = int(left[at])
            order.append(at := stack.pop())
            at = int(right[at])
        assert order == list(range(a, b))


def test_only_a_part_of_long_lists_is_looked_at():
    """Ranges that cannot enter the best are dropped with all below them."""
    rng, n = np.random.default_rng(1), 16_000
    impact = rng.integers(1, 1000, n)
    impact[700] = 100_000
    left, right, root = treaps.treaps(np.array([0, n]), (impact << 16) + rng.permutation(n))
    s = object.__new__(treaps.Segment)
    s.ids, s.terms, s.root, s.impact, s.left, s.right, s.doc, s.known = np.arange(n), np.array([5]), root.astype(np.int32), impact.astype(np.int32), left, right, np.arange(n, dtype=np.int32), n
    seen, best = [], treaps.Best(1, 10)
    whole = treaps._split
    try:
        treaps._split = lambda s, b, r: (seen.append(len(r.query)), whole(s, b, r))[1]
        treaps.search_segment(s, treaps.Queries(np.array([0]), np.array([0, 1]), np.array([5]), np.array([3])), best)
    finally:
        treaps._split = whole
    want = sorted(zip((-3 * impact).tolist(), range(n)))[:10]
    assert list(zip((-best.score[0]).tolist(), best.id[0].tolist())) == want and sum(seen) < 200


def test_query_ranked_search(spark, sf_dir):
    assert of_frame(op13_ranked_search(spark, sf_dir)) == of_sql(SEARCH_SQL["op13_ranked_search"], sf_dir)
