import collections

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from colloquy.llm import graph, op7_jaccard as op
from colloquy.llm.common import Staging


def brute(rows, k, p, q):
    """(doc_id, size, component) by comparing every pair."""
    sets = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for t in s:
            by.setdefault(t, []).append(i)
    for i, a in enumerate(sets):
        seen = {j for t in a for j in by[t] if j < i}
        for j in seen:
            both = len(a & sets[j])
            if q * both >= p * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near(rng, n_docs, vocabulary=200):
    """Texts with copies that differ in a few words, in chains and stars."""
    texts = []
    for i in range(n_docs):
        if texts and rng.random() < 0.7:
            words = texts[rng.integers(len(texts))].split()
            for _ in range(rng.integers(0, 1 + len(words) // 25)):
                words[rng.integers(len(words))] = f"w{rng.integers(vocabulary)}"
        else:
            words = [f"w{rng.integers(vocabulary)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 20, 40, 80, 150, 400]))]
        texts.append(" ".join(words))
    return texts


def ours(spark, rows, k, p, q):
    staging = Staging(spark, "test-jaccard")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as n", "2 as component")
    got = [tuple(r) for r in op.classes(df, staging, k, p, q).collect()]
    staging.drop()
    return sorted(got, key=repr)


def agree(sets, p, q):
    """Whether two sets share a key that both keep, when each leaves out its `spare` most frequent shared keys."""
    keys, owners, _, spare = op.keys_of(sets, p, q)
    of = collections.defaultdict(set)
    for key, owner in zip(keys.tolist(), owners.tolist()):
        of[key].add(owner // 2)
    kept = [set() for _ in sets]
    for owner in range(2 * len(sets)):
        own = sorted((k for k in keys[owners == owner].tolist() if len(of[k]) > 1), key=lambda k: (-len(of[k]), k))
        kept[owner // 2] |= set(own[spare[owner] :])
    return lambda i, j: bool(kept[i] & kept[j])


@pytest.mark.parametrize(("p", "q", "k"), [(90, 100, 3), (4, 5, 5), (1, 2, 2)])
def test_linked_pairs_share_a_key(p, q, k):
    """The index loses no pair: every linked pair agrees in a key that both keep."""
    rng = np.random.default_rng(p)
    sets = [op.shingles(t.encode(), k) for t in near(rng, 600)]
    sets = [s for s in {s.tobytes(): s for s in sets if len(s)}.values()]
    meet, n = agree(sets, p, q), 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if q * both >= p * (len(sets[i]) + len(sets[j]) - both):
                n += 1
                assert meet(i, j), (len(sets[i]), len(sets[j]), both)
    assert n > 15


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=6), st.sampled_from([(9, 10), (4, 5), (1, 2)]))
def test_random_small_sets_share_a_key(sets, ratio):
    p, q = ratio
    sets = list({frozenset(s) for s in sets})
    meet = agree([np.sort(op.mix64(np.array(sorted(s), np.uint64))) for s in sets], p, q)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if q * both >= p * (len(a) + len(sets[j]) - both):
                assert meet(i, j)


@pytest.mark.parametrize(("k", "p", "q"), [(3, 90, 100), (5, 4, 5)])
def test_classes_equal_brute_force(spark, k, p, q):
    texts = near(np.random.default_rng(7), 300)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n\t "), (903, "One"), (904, "oNE"), (905, "one two"), (None, texts[0]), (None, "only one without id"), (3, texts[5]), (906, "x " * 5000), (907, "é É"), (908, "é é")]
    assert ours(spark, rows, k, p, q) == sorted(brute(rows, k, p, q), key=repr)


def test_large_components_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "CAP", 3000)
    monkeypatch.setattr(op, "SMALL", 0)
    base = [f"w{i}" for i in range(100)]
    rng, rows = np.random.default_rng(3), []
    for i in range(150):
        words = list(base)
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(100)] = f"v{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    assert ours(spark, rows, 3, 90, 100) == sorted(brute(rows, 3, 90, 100), key=repr)


def test_keys_of_most_sets_are_salted(spark, monkeypatch):
    for name, value in (("MANY", 3), ("SALT_SETS", 40)):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(5)
    # a passage that most texts hold, and near copies in chains and stars
    common = " ".join(f"c{i}" for i in range(40))
    texts = [f"{common} {t}" if rng.random() < 0.8 else t for t in near(rng, 250)]
    rows = [*enumerate(texts), (900, common), (901, common + " x"), (None, texts[0])]
    assert ours(spark, rows, 5, 4, 5) == sorted(brute(rows, 5, 4, 5), key=repr)


def test_hubs_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST", 3)
    monkeypatch.setattr(graph, "HUBS", 20)
    edges = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(150, 300)] + [(1000 + i, 1001 + i) for i in range(30)]
    staging = Staging(spark, "test-graph")
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long"), staging, "g").collect()}
    staging.drop()
    assert got == {(i, 0) for i in [*range(300), 500]} | {(i, 1000) for i in range(1000, 1031)}


def test_sets_of_one_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(op, "NODE_MASK", 7)
    texts = near(np.random.default_rng(11), 120)
    rows = list(enumerate(texts)) + [(500, texts[3]), (None, texts[4]), (501, "")]
    assert ours(spark, rows, 3, 90, 100) == sorted(brute(rows, 3, 90, 100), key=repr)


def test_empty_table(spark):
    assert ours(spark, [], 3, 90, 100) == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    staging = Staging(spark, "test-graph")
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long"), staging, "g").collect()}
    staging.drop()
    assert got == {(i, 0) for i in range(51)} | {(i, 100) for i in range(100, 150)}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op.op7_jaccard_join(spark, sf).collect()), key=repr) == sorted(brute(rows, 3, 90, 100), key=repr)
