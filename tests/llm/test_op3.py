import collections
import hashlib

import numpy as np
import pytest

from colloquy.llm import common, op3_repeats as op
from colloquy.llm.common import Staging
from tests.llm.test_op10 import _twins


def brute(rows):
    """By counting every 200-byte string."""
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 199):
            if seen[b[a : a + 200]] > 1:
                gone[a : a + 200] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ours(spark, rows):
    staging = Staging(spark, "test-repeats")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h1", "'x' as shard", "3 as n_bytes")
    got = sorted((tuple(r) for r in op.removals(df, staging).collect()), key=repr)
    staging.drop()
    return got


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


@pytest.mark.parametrize("shard", [1500, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(op, "SHARD", shard)
    monkeypatch.setattr(op, "RANGE_KEYS", 50)
    rng = np.random.default_rng(5)
    shared = [words(rng, n) for n in (30, 35, 60, 200)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.integers(1, 60)) for _ in range(3)]
        for _ in range(rng.integers(0, 3)):
            s = shared[rng.integers(4)]
            a, z = sorted(rng.integers(0, len(s) + 1, 2))
            parts.insert(rng.integers(len(parts) + 1), s[a:z] if rng.random() < 0.7 else s)
        rows.append((i, " ".join(parts)))
    copy = list(rows[3][1])
    for at in range(50, len(copy), 333):
        copy[at] = "#"
    rows += [(100, "".join(copy)), (101, rows[4][1]), (101, rows[4][1]), (102, "a" * 1000), (103, "b" * 200), (104, "c" * 201), (105, "xy" * 300 + "end"), (106, "é" * 150), (107, "zé" * 99 + "é" * 150), (108, None), (109, ""), (None, "short"), (110, "short"), (111, rows[5][1][:200]), (112, rows[6][1][1:201] + "!")]
    assert ours(spark, rows) == brute(rows)


def test_one_passage_in_most_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD", 4000)
    rng = np.random.default_rng(6)
    passage = words(rng, 70)
    rows = [(i, words(rng, 20) + "\n" + passage + "\n" + words(rng, 20)) for i in range(80)]
    got = ours(spark, rows)
    assert got == brute(rows) and all(r[2] >= len(passage) for r in got)


def test_nothing(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None)]) == brute([(1, None)])


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op.op3_repeated_bytes(spark, sf).collect()), key=repr) == brute(rows)


def test_spans_that_agree_modulo_2_64_are_told_apart(spark):
    rng = np.random.default_rng(8)
    first, second = _twins(2048)
    hashes = common.RollingHash(np.frombuffer((first + second).encode(), np.uint8))
    at, n = np.array([0, 2048]), np.array([2048, 2048])
    assert len(set(hashes.spans(at, n).tolist())) == 1
    assert len(set(common.PrimeHash(hashes_body := np.frombuffer((first + second).encode(), np.uint8)).spans(at, n).tolist())) == 2 and len(hashes_body) == 4096
    # without the twins' own repeats: letters of a random text in their places
    noise = words(rng, 900)[:2048]
    rows = [(1, first), (2, second), (3, noise + first[:300]), (4, noise[::-1] + second[100:700])]
    assert ours(spark, rows) == brute(rows)


def test_prime_hashes_of_equal_spans_agree():
    body = np.frombuffer(b"q" * 50 + b"the same span of bytes" * 3 + b"zz" + b"the same span of bytes", np.uint8)
    at = np.array([50, 72, 94, 118])
    assert len(set(common.PrimeHash(body).spans(at, 22).tolist())) == 1
    assert len(set(common.PrimeHash(body).spans(np.arange(50), 22).tolist())) > 20
