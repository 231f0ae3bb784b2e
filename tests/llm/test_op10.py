import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from colloquy.llm import bpe, op10_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  two  spaces ", "a\nb", "a \nb", "tab\tx ", "it's 'tis we'll", "x" * 3000, "ab" * 900 + " end", "éèê ß ñ 日本語 🙂🙂", "12 345,6", " nb  x", "a b\n", "\n\n\nq", "\x1c x", "naïve" * 300]



def _twins(n):
    """Two strings whose polynomial hashes modulo 2^64 agree for every odd base, from 1,024 characters on."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return tuple("".join("ab"[b ^ flip] for b in signs) for flip in (0, 1))


TWINS = tuple(" ".join(["x", first, "y", second]) for first, second in zip(_twins(1024), _twins(2048)))


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    ids, counts = bpe.cached(PATH, P.PATTERN).encode_texts(texts)
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_same_ids_as_the_library(library):
    assert encoded(ODD) == [library.encode_ordinary(t) for t in ODD]


def test_chunks_of_one_hash_are_told_apart(library, monkeypatch):
    coder = bpe.load_ranks(PATH, P.PATTERN)
    made = lambda: bpe.ChunkCache(bpe.PieceCache(coder.pattern, lambda new: coder.encode_pieces([p.encode() for p in new])))

    def ids(cache, texts):
        flat, counts = cache.encode_texts(texts)
        return [a.tolist() for a in np.split(flat, counts.cumsum()[:-1])]

    for texts in (TWINS, TWINS[::-1], ("x " + _twins(1024)[0], "x " + _twins(1024)[1])):
        cache = made()
        assert ids(cache, list(texts)) == [library.encode_ordinary(t) for t in texts]
        assert [ids(cache, [t])[0] for t in texts] == [library.encode_ordinary(t) for t in texts]
    # every hash the same
    monkeypatch.setattr(bpe.RollingHash, "spans", lambda self, at, length: np.zeros(len(at), "uint64"))
    cache = made()
    for _ in range(2):
        assert ids(cache, [t for t in ODD if t]) == [library.encode_ordinary(t) for t in ODD if t]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab thé\n '.1９ \t　ñ🙂"), max_size=40), max_size=5))
def test_random_texts(texts):
    ours = encoded(texts)
    coder = bpe.load_ranks(PATH, P.PATTERN)
    assert [coder.decode(i) for i in ours] == [t.encode() for t in texts]
    for t, ids in zip(texts, ours):
        assert ids == _LIB().encode_ordinary(t)


def _LIB(made=[]):
    if not made:
        with open(PATH, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made.append(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return made[0]


def test_cache_is_dropped_and_results_stay(library):
    coder = bpe.load_ranks(PATH, P.PATTERN)
    cache = bpe.ChunkCache(bpe.PieceCache(coder.pattern, lambda new: coder.encode_pieces([p.encode() for p in new]), most=2), most=3)
    for _ in range(3):
        ids, counts = cache.encode_texts(["one two three four five", "six seven one"])
        assert ids.tolist() == library.encode_ordinary("one two three four five") + library.encode_ordinary("six seven one")


def test_frame_digests_and_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, "again"), (None, "no id"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids_sha256")
    got = sorted(tuple(r) for r in op10_bpe.digests(df).collect() if r.doc_id is not None)
    want = []
    for i, t in rows:
        if i is not None:
            ids = library.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = op10_bpe.decode(op10_bpe.encode(df)).select("text", "decoded", "ids_sha256").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == len(rows)


def test_empty_table(spark):
    assert op10_bpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_the_library_on_all_documents(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op10_bpe.op10_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
