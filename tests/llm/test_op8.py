import collections
import math
import re

import numpy as np
import xxhash

from colloquy.llm import op8_quality as op
from colloquy.llm.common import Staging

PROSE = "The cat sat on the mat, and then it went to sleep. A dog came by; nobody else had seen it before. " * 3


def fitted(spark, df):
    staging = Staging(spark, "test-quality")
    model = op.fit(df, staging)
    staging.drop()
    return model


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.8
    patterns = np.zeros(len(good), np.int64)
    for j, (_, vote, *_) in enumerate(op.LABELLERS):
        rate = np.where(good == (vote == op.GOOD), 0.8 if vote == op.GOOD else 0.35, 0.3 if vote == op.GOOD else 0.02)
        patterns |= (rng.random(len(good)) < rate).astype(np.int64) << j
    kinds, counts = np.unique(patterns, return_counts=True)
    accuracy, share, posterior = op.estimate(kinds, counts.astype(float))
    for j, (_, vote, *_) in enumerate(op.LABELLERS):
        fired = patterns >> j & 1 > 0
        assert abs(accuracy[j] - (good[fired] == (vote == op.GOOD)).mean()) < 0.05
    assert abs(share - 0.8) < 0.05
    hard = dict(zip(kinds.tolist(), (posterior > 0.5).tolist()))
    assert np.mean([hard[p] == g for p, g in zip(patterns.tolist(), good)]) > 0.9


def test_held_out_accuracy(spark):
    """True labels are never used in the fit."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op.classify(docs.select("doc_id", "text"), fitted(spark, docs)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("keep", "quality").collect()
    right = {q: np.mean([r.keep == bool(q) for r in got if r.quality == q]) for q in (0, 1)}
    assert right[0] > 0.97 and right[1] > 0.995, right


def test_edges(spark):
    rows = [(i, PROSE + f" number {i}.") for i in range(40)] + [(50 + i, "BUY NOW!! " * 30 + str(i)) for i in range(6)] + [(90, None), (91, ""), (92, " \n"), (93, "Short."), (93, "Short."), (94, " ".join(f"w{i * 7919 % 50021}a x{i % 97}y and{i % 31}so" + "." * (i % 4 == 0) for i in range(20_000))), (None, PROSE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as mark", "2 as pattern")
    model = fitted(spark, df)
    got = op.classify(df, model).collect()
    assert len(got) == len(rows)
    keep = [(r.doc_id, r.keep) for r in got]
    assert all(k == (i is None or i < 50 or i in (93, 94)) for i, k in keep), keep
    empty = df.limit(0)
    assert op.classify(empty, fitted(spark, empty)).collect() == []


def test_query_covers_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    got = op.op8_weak_quality(spark, sf)
    assert got.count() == 200 and got.where("keep").count() > 150


def plain_votes(text):
    """The labellers' rules restated, and the figures that they look at."""
    words, n = text.split(), len(text.split())
    counts = collections.Counter(words)
    letters = [b for b in text if 65 <= b <= 90 or 97 <= b <= 122]
    f = {
        "upper": sum(b <= 90 for b in letters) / max(1, len(letters)),
        "symbols": sum(b in op.SYMBOLS for b in text) / len(text),
        "shouts": sum(w[-1:] in (b"!", b"?") for w in words) / n,
        "again": sum(a == b for a, b in zip(words, words[1:])) / n,
        "top": max(counts.values()) / n,
        "fresh": len(counts) / n**0.75,
        "ends": sum(w[-1:] in (b".", b",", b";", b":") for w in words) / n,
        "odd": sum(w[-1] in op.SYMBOLS for w in words) / n,
    }
    rules = {
        "capitals": f["upper"] > 0.5, "shouting": f["shouts"] > 0.3, "symbols": f["symbols"] > 0.03, "odd_words": f["odd"] > 0.15, "stutter": f["again"] > 0.2, "few_words": f["fresh"] < 0.35, "one_word": f["top"] > 0.5,
        "variety": f["again"] < 0.05 and f["top"] < 0.4 and f["fresh"] > 0.6, "prose": 0.01 < f["ends"] < 0.4 and f["upper"] < 0.3 and f["odd"] < 0.02 and f["again"] < 0.1,
    }
    return tuple(name for name, yes in rules.items() if yes and n >= 20), f


GUESS = {"capitals": (0, 0.9), "shouting": (0, 0.9), "symbols": (0, 0.9), "odd_words": (0, 0.9), "stutter": (0, 0.9), "few_words": (0, 0.8), "one_word": (0, 0.8), "variety": (1, 0.7), "prose": (1, 0.7)}


def plain_posteriors(counts):
    """Expectation-maximisation over {fired labellers: texts}, one number at a time."""
    first = {(name, good): (0.8 if vote else 0.3) if good == vote else (0.4 if vote else 0.3 * (1 - a)) for name, (vote, a) in GUESS.items() for good in (0, 1)}
    rate, share, known = dict(first), 0.8, {p: n for p, n in counts.items() if p}
    for _ in range(300):
        good = {}
        for p in known:
            like = [math.prod(rate[name, g] if name in p else 1 - rate[name, g] for name in GUESS) for g in (0, 1)]
            good[p] = share * like[1] / (share * like[1] + (1 - share) * like[0])
        for g in (0, 1):
            mass = {p: n * (good[p] if g else 1 - good[p]) for p, n in known.items()}
            for name in GUESS:
                hit = sum(m for p, m in mass.items() if name in p)
                rate[name, g] = min(1 - 1e-4, max(1e-4, (hit + 5 * first[name, g]) / (sum(mass.values()) + 5)))
        share = (sum(n * good[p] for p, n in known.items()) + 4) / (sum(known.values()) + 5)
    return {p: good.get(p, share) for p in counts}


def plain_features(text, f):
    def shape(word):
        for pattern, to in ((rb"[0-9]+", b"0"), (rb"[a-z\x80-\xff]+", b"a"), (rb"[A-Z]+", b"A")):
            word = re.sub(pattern, to, word)
        return re.sub(rb"(.)\1+", rb"\1\1", word)[:40]

    words = text.split()
    out = collections.defaultdict(float)
    for w in words:
        out[xxhash.xxh32_intdigest(shape(w)) % op.SPACE] += 1 / len(words)
    for name, value in (("u", f["upper"]), ("s", f["symbols"] * 3), ("x", f["shouts"]), ("a", f["again"]), ("t", f["top"]), ("f", f["fresh"] / 2), ("e", f["ends"]), ("o", f["odd"])):
        out[xxhash.xxh32_intdigest(f"{name}:{min(9, int(value * 10))}".encode()) % op.SPACE] += 0.5
    return out


def plain_weights(rows, target):
    w, look = collections.defaultdict(float), collections.defaultdict(float)
    for k in range(300):
        step = collections.defaultdict(float)
        for row, t in zip(rows, target):
            slope = 1 / (1 + math.exp(-sum(v * look[at] for at, v in row.items()) - look["bias"])) - t
            for at, v in [*row.items(), ("bias", 1)]:
                step[at] += v * slope / len(rows)
        new = {at: look[at] - s - (1e-4 * look[at] if at != "bias" else 0) for at, s in step.items()}
        look, w = collections.defaultdict(float, {at: x + k / (k + 3) * (x - w[at]) for at, x in new.items()}), collections.defaultdict(float, new)
    return w


def test_query_equals_brute_force(spark):
    """Votes, posteriors, fit and scores of the whole table, which is under the bound of the fit."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    said = {d: plain_votes(t) for d, t in texts.items() if t.split()}
    posterior = plain_posteriors(collections.Counter(v for v, _ in said.values()))
    once = {texts[d]: d for d in said}.values()  # copies of a text are one row
    made = {d: plain_features(texts[d], said[d][1]) for d in said}
    weights = plain_weights([made[d] for d in once], [posterior[said[d][0]] for d in once])
    got = {r.doc_id: r for r in op.op8_weak_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, r in got.items():
        if d not in said:
            assert (r.votes, r.posterior, r.quality_score, r.keep) == ("", 0.0, 0.0, False)
            continue
        score = 1 / (1 + math.exp(-sum(v * weights[at] for at, v in made[d].items()) - weights["bias"]))
        assert r.votes == ",".join(said[d][0])
        assert abs(r.posterior - posterior[said[d][0]]) < 2e-6 and abs(r.quality_score - score) < 2e-5
        assert r.keep == (score >= op.CUT) or abs(score - op.CUT) < 1e-6
