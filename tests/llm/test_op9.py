import hashlib
import random
import re
from collections import Counter

import pytest

from colloquy.llm import op9_phrases as op
from colloquy.llm.common import Staging
from tests.oracle import same

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)):
            if w:
                phrases.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit |= set(range(k, k + n))
                    named |= phrases[p]
        names = sorted(str(i) for i in named if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def ours(spark, docs, items):
    staging = Staging(spark, "test-phrases")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pos", "'q' as term", "2 as item_id")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as w", "'x' as phrase")
    got = sorted((tuple(r) for r in op.decontaminate(d, i, staging).drop("marks").collect()), key=repr)
    staging.drop()
    return got


LONG = " ".join(f"word{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "the Quick brown fox"), (30, "of"), (4, None), (5, ""), (6, "..."), (None, "no id here"), (7, LONG), (8, "a a a a a a a a a a a a a a a"), (9, "Äpfel und Öl 7x"), (10, "word5 word6")]


def test_equals_brute_force(spark):
    docs = [
        (1, "x " + LONG + " y"),
        (2, LONG[:100]),
        (3, "The quick, BROWN-fox! of of"),
        (4, None),
        (5, ""),
        (6, " ,, "),
        (None, "there is no id here at all"),
        (7, "a " * 30),
        (7, "a " * 12 + "b"),
        (7, "a " * 12 + "b"),
        (8, "äpfel und Öl 7X, Äpfel und öl 7x. Äpfel_und Öl 7x Äpfel und Öl\n7X"),
        (9, ". word5.word6 " + "filler " * 3000 + " fox brown quick the"),
        (10, ",".join(f"word{i}" for i in [*range(10, 22), 23, *range(20, 40)])),
        (11, "\x00 of \x00"),
    ]
    assert ours(spark, docs, ITEMS) == brute(docs, ITEMS)


@pytest.mark.parametrize(("docs", "items"), [([], ITEMS), ([(1, "of x")], []), ([], []), ([(1, "q")], [(1, "of")])])
def test_empty(spark, docs, items):
    assert ours(spark, docs, items) == brute(docs, items)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "SMALL", -1)
    docs = [(i, f"t{i} " + " ".join(LONG.split()[i % 20 : i % 20 + 5 + i % 17])) for i in range(60)]
    assert ours(spark, docs, ITEMS) == brute(docs, ITEMS)


def test_proximity(spark):
    staging = Staging(spark, "test-phrases")
    docs = spark.createDataFrame([(1, "fox quick the x brown"), (2, "fox a b c d e f g h quick the brown")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    index = op.PhraseIndex(docs, items, staging)
    got = index.within(index.phrases()[0], 6).join(index.documents(), "doc").select("doc_id", "low", "high").collect()
    staging.drop()
    assert [tuple(r) for r in got] == [(1, 0, 4)]


def test_proximity_equals_brute_force(spark):
    rng, items, span = random.Random(9), ["r a b", "r a a b", "r"], 5
    texts = ["z z z z z z z a z z r z z b a c", "r a b", "r a b a", *(" ".join(rng.choices("rabcz", [1, 2, 2, 2, 6], k=40)) for _ in range(30))]
    staging = Staging(spark, "test-phrases")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = op.PhraseIndex(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), staging)
    phrases, owners = index.phrases()
    found = index.within(phrases, span).join(index.documents(), "doc").join(owners, "phrase")
    got = sorted((r.item_id, r.doc_id, r.low, r.high) for r in found.collect())
    keys = {r.item_id: r.word for r in phrases.join(owners, "phrase").selectExpr("item_id", "parts[0].term as term").join(index.terms, "term").collect()}
    staging.drop()
    want = []
    for i, item in enumerate(items):
        need = Counter(item.split())
        for d, text in enumerate(texts):
            w = text.split()
            for c in (k for k, x in enumerate(w) if x == keys[i]):
                fits = [(high - low, low, high) for low in range(max(0, c - span + 1), c + 1) for high in range(c, min(len(w), low + span)) if not need - Counter(w[low : high + 1])]
                want += [(i, d, *min(fits)[1:])] if fits else []
    assert (0, 0, 10, 14) in want and got == sorted(want)
    assert any(r[:2] == (1, 2) for r in want) and not any(r[:2] == (1, 1) for r in want)


def test_a_window_longer_than_any_fixed_cut(spark):
    item = " ".join(f"w{i}" for i in range(1_500))
    staging = Staging(spark, "test-phrases")
    d = spark.createDataFrame([(1, "x " + item), (2, item[:-1])], "doc_id long, text string")
    got = op.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string"), staging, window=1_400).collect()
    staging.drop()
    assert sorted((r.doc_id, r.n_hit) for r in got) == [(1, 1_500), (2, 1_499)]


def test_native_plan(spark):
    plan = op.op9_phrase_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_equals_sql(spark):
    assert any(r[0] for r in same(spark, "op9_phrase_decontamination")[1])
