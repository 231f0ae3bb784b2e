import collections
import math
import re

import numpy as np
import pytest

from colloquy.llm import op1_bm25 as op
from colloquy.llm.common import Staging


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k):
    """(query_id, rank, doc_id, score) by scoring every pair."""
    bags = [collections.Counter(words(t)) for _, t in docs]
    df = collections.Counter(w for b in bags for w in b)
    mean = sum(b.total() for b in bags) / max(1, len(bags))
    out = []
    for q, text in queries:
        kinds, scored = set(words(text)), []
        for (d, _), bag in zip(docs, bags):
            s = sum(math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 * bag[w] / (bag[w] + 1.2 * (0.25 + 0.75 * bag.total() / mean)) for w in kinds if w in bag)
            if s > 0:
                scored.append((-round(s, 8), d is None, d))
        out += [(q, i + 1, d, round(-s, 5)) for i, (s, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return sorted(out, key=repr)


def ours(spark, docs, queries, k):
    staging = Staging(spark, "test-bm25")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as query", "2 as score", "3 as n")
    got = sorted(((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in op.search(frame(docs), frame(queries), staging, k).collect()), key=repr)
    staging.drop()
    return got


@pytest.mark.parametrize(("shard", "block", "terms"), [(4000, 4, 300), (1 << 20, 64, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, shard, block, terms):
    for name, value in (("SHARD_BYTES", shard), ("BLOCK", block), ("BLOCK_TERMS", terms)):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 120)) if x < 500)) for i in range(300)]
    docs += [(300, docs[7][1]), (301, docs[7][1]), (301, docs[7][1]), (None, docs[8][1]), (302, None), (303, ""), (304, "w1 " * 5000), (305, "Éa éa é-a, 7x")]
    queries = docs[::9] + [(7, "w1"), (8, None), (9, "nothing-of-this"), (10, "éa 7X"), (7, docs[7][1]), (None, "w2 w3")]
    assert ours(spark, docs, queries, 5) == brute(docs, queries, 5)


def test_empty(spark):
    assert ours(spark, [], [], 3) == [] and ours(spark, [], [(1, "a")], 3) == [] and ours(spark, [(1, "a")], [], 3) == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in op.op1_bm25_top_k(spark, sf).collect()), key=repr)
    want = brute(docs, [d for d in docs if d[0] % 50 == 0], 10)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-4 for a, b in zip(got, want))


def test_blocks_are_skipped_and_nothing_is_lost():
    """Texts about topics: most blocks can't reach the k-th best of a query about one."""
    rng = np.random.default_rng(6)
    texts = []
    for i in range(6_000):
        own = [f"topic{i % 40}x{int(x)}" for x in rng.zipf(1.5, 40) if x < 300]
        texts.append(" ".join([*own, *(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 2_000)]))
    bags = [collections.Counter(op.terms_of(t.encode()).tolist()) for t in texts]
    df, mean = collections.Counter(w for b in bags for w in b), sum(b.total() for b in bags) / len(bags)
    shards = [op.Shard(op._build([(i, op.terms_of(texts[i].encode())) for i in part]), mean) for part in (range(3_000), range(3_000, 6_000))]
    asked = [np.unique(op.terms_of(texts[i].encode())) for i in range(0, 6_000, 100)]
    weight = lambda t: np.array([math.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) for w in t.tolist()])
    best, found, scored, total = [np.empty(0)] * len(asked), [np.empty((0, 2), np.int64)] * len(asked), 0, 0
    for shard in shards:
        queries = []
        for terms in asked:
            at = np.searchsorted(shard.terms, terms)
            here = shard.terms[np.minimum(at, len(shard.terms) - 1)] == terms
            queries.append((at[here], weight(terms[here])))
        one, all_ = shard.search(queries, best, found, 10)
        scored, total = scored + one, total + all_
    assert scored < 0.5 * total, (scored, total)
    for terms, score, ids in zip(asked, best, found):
        exact = []
        for i, bag in enumerate(bags):
            s = sum(w * 2.2 * bag[t] / (bag[t] + 1.2 * (0.25 + 0.75 * bag.total() / mean)) for t, w in zip(terms.tolist(), weight(terms)) if t in bag)
            exact.append((-round(s, 8), i))
        assert [i for _, i in sorted(exact)[:10]] == ids[:, 1].tolist()
        assert np.allclose([-s for s, _ in sorted(exact)[:10]], score)


def test_a_million_empty_texts(spark):
    docs = spark.range(1_000_000).selectExpr("id AS doc_id", "CASE WHEN id % 400000 = 7 THEN 'a b' WHEN id % 3 = 0 THEN '' END AS text")
    staging = Staging(spark, "test-bm25")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in op.search(docs, docs.where("doc_id % 50 = 0 OR doc_id = 7"), staging, 5).collect())
    staging.drop()
    assert got == [(7, 1, 7), (7, 2, 400_007), (7, 3, 800_007)]


def test_few_cells_for_frequent_terms(spark, monkeypatch):
    monkeypatch.setattr(op, "CELLS", 2_000)
    docs = [(i, f"a b c d e f g h {'x' * (i % 5)} {'y' * (i % 7)}") for i in range(200)]
    assert ours(spark, docs, docs[::20], 5) == brute(docs, docs[::20], 5)


def test_texts_of_other_languages_are_skipped_and_nothing_is_lost():
    """Four languages of 60 common words each: a query's own is a quarter of the blocks, though texts' commonest words differ."""
    rng = np.random.default_rng(8)
    words_of = lambda: [*rng.integers(0, 60, rng.integers(30, 90)), *rng.integers(60, 3_000, 20)]
    texts = [" ".join(f"{'abcd'[i % 4]}{int(x)}" for x in words_of()) + " all share these" for i in range(4_000)]
    bags = [collections.Counter(op.terms_of(t.encode()).tolist()) for t in texts]
    df, mean = collections.Counter(w for b in bags for w in b), sum(b.total() for b in bags) / len(bags)
    shards = [op.Shard(op._build([(i, op.terms_of(texts[i].encode())) for i in part]), mean) for part in (range(2_000), range(2_000, 4_000))]
    asked = [np.unique(op.terms_of(texts[i].encode())) for i in range(0, 4_000, 50)]
    weight = lambda t: np.array([math.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) for w in t.tolist()])
    best, found, scored, total = [np.empty(0)] * len(asked), [np.empty((0, 2), np.int64)] * len(asked), 0, 0
    for shard in shards:
        queries = []
        for terms in asked:
            at = np.searchsorted(shard.terms, terms)
            here = shard.terms[np.minimum(at, len(shard.terms) - 1)] == terms
            queries.append((at[here], weight(terms[here])))
        one, all_ = shard.search(queries, best, found, 10)
        scored, total = scored + one, total + all_
    assert scored < 0.35 * total, (scored, total)
    for terms, score, ids in zip(asked, best, found):
        exact = []
        for i, bag in enumerate(bags):
            s = sum(w * 2.2 * bag[t] / (bag[t] + 1.2 * (0.25 + 0.75 * bag.total() / mean)) for t, w in zip(terms.tolist(), weight(terms)) if t in bag)
            exact.append((-round(s, 8), i))
        assert [i for _, i in sorted(exact)[:10]] == ids[:, 1].tolist()
        assert np.allclose([-s for s, _ in sorted(exact)[:10]], score)


def test_shards_that_go_first_and_small_batches(spark, monkeypatch):
    """What the first shards reach holds for all tasks; ties with it, and queries with few matches, lose nothing."""
    for name, value in (("SHARD_BYTES", 1_500), ("BLOCK", 4), ("AHEAD", 3), ("TOGETHER", 7), ("GRID", 40), ("BLOCK_TERMS", 700)):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) if x < 300)) for i in range(400)]
    docs += [(400 + i, docs[i % 5][1]) for i in range(60)] + [(None, docs[3][1]), (500, None), (501, "")]
    queries = docs[::11] + [docs[0], docs[3], (9, "nothing-of-this"), (None, "a1 b1"), (8, "a299")]
    assert ours(spark, docs, queries, 5) == brute(docs, queries, 5)


def test_floor_keeps_ties_and_leaves_out_what_is_under_it():
    texts = ["a b c", "a b c", "a b", "a x", "c x y", "x y z"] * 20
    shard = op.Shard(op._build([(i, op.terms_of(t.encode())) for i, t in enumerate(texts)]), 2.5)
    terms = np.unique(op.terms_of(b"a b c"))
    at, all_ = np.searchsorted(shard.terms, terms), np.ones(3)
    first, ids = [np.empty(0)], [np.empty((0, 2), np.int64)]
    shard.search_flat(np.array([0, 3]), at, all_, first, ids, 50)
    best, found = [np.empty(0)], [np.empty((0, 2), np.int64)]
    shard.search_flat(np.array([0, 3]), at, all_, best, found, 50, first[0][39:40])
    assert best[0].tolist() == first[0][:40].tolist() and found[0][:, 1].tolist() == [i for i in range(120) if i % 6 < 2]
