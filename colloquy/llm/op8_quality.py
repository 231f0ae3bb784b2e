"""Quality classifier from weak labels: labellers' accuracies by expectation-maximisation, then a hashed linear scorer.

Labellers look at a whole text and vote good, bad or not at all. Votes are counted over all rows by
pattern (at most 2^labellers patterns, whatever the input); EM on these counts estimates each labeller's
accuracy and the share of good texts without any true label. A pattern's posterior labels its rows.
A logistic scorer on hashed features (shapes of words, repetition, spread) learns the posteriors on
the TRAIN_ROWS rows of least hash, a documented bound, and scores every row; a score below CUT rejects.

Null, empty or blank text: no votes, score 0, rejected. Texts of few words: no votes on ratios. Ties and
repeated rows: a row each, equal texts score alike. Empty table: empty result. Others' columns pass
`classify`; a clash with its own raises. Long texts are whole.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colloquy.llm.common import Staging, cache, claim, read_table, slices, tune

#: Rows that the scorer is fitted on at most; size of the hashed space; words from which ratios count.
TRAIN_ROWS, SPACE, ENOUGH = 10_000, 1 << 12, 20
#: Below even, since a clean text lost costs more than a poor one kept.
CUT = 0.4
SYMBOLS = bytes(b"%$#&*|@^~<>{}[]=+\\_")
GOOD, BAD = 1, 0


@dataclass
class Figures:
    """What the labellers look at."""

    words: int
    upper: float  # capitals among ASCII letters
    symbols: float  # symbols among bytes
    shouts: float  # words that end with ! or ?
    again: float  # words equal to the one before
    top: float  # share of the most frequent word
    fresh: float  # distinct words over the words to the power 3/4
    ends: float  # words that end with . , ; or :
    odd: float  # words with a symbol at an end
    counts: Counter  # of the words


def figures(words: list[bytes], text: bytes) -> Figures:
    n = len(words)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(by[65:91].sum()), int(by[97:123].sum())
    counts, last = Counter(words), [0] * 256
    for w, k in counts.items():
        last[w[-1]] += k
    odd = sum(last[c] for c in SYMBOLS)
    return Figures(
        n,
        upper / max(1, upper + lower),
        int(by[list(SYMBOLS)].sum()) / max(1, len(text)),
        (last[33] + last[63]) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        max(counts.values()) / n,
        # distinct words grow slower than words
        len(counts) / n**0.75,
        sum(last[c] for c in b".,;:") / n,
        odd / n,
        counts,
    )


#: name, vote, rule, first guess of the accuracy
LABELLERS = (
    ("capitals", BAD, lambda f: f.words >= ENOUGH and f.upper > 0.5, 0.9),
    ("shouting", BAD, lambda f: f.words >= ENOUGH and f.shouts > 0.3, 0.9),
    ("symbols", BAD, lambda f: f.words >= ENOUGH and f.symbols > 0.03, 0.9),
    ("odd_words", BAD, lambda f: f.words >= ENOUGH and f.odd > 0.15, 0.9),
    ("stutter", BAD, lambda f: f.words >= ENOUGH and f.again > 0.2, 0.9),
    ("few_words", BAD, lambda f: f.words >= ENOUGH and f.fresh < 0.35, 0.8),
    ("one_word", BAD, lambda f: f.words >= ENOUGH and f.top > 0.5, 0.8),
    ("variety", GOOD, lambda f: f.words >= ENOUGH and f.again < 0.05 and f.top < 0.4 and f.fresh > 0.6, 0.7),
    ("prose", GOOD, lambda f: f.words >= ENOUGH and 0.01 < f.ends < 0.4 and f.upper < 0.3 and f.odd < 0.02 and f.again < 0.1, 0.7),
)


def votes(f: Figures) -> int:
    return sum(1 << j for j, (_, _, rule, _) in enumerate(LABELLERS) if rule(f))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """Labellers' accuracies (how often a vote is right), the share of good texts, and each pattern's posterior of good.

    The model: a text is good with the probability `share`; given that, labellers fire independently,
    each with its own rate for good and for bad texts. First guesses say which class is which; they
    stay as a few made-up votes. Texts without any vote don't count, and get the share as posterior.
    """
    fired = (patterns[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
    counts = np.where(patterns > 0, counts, 0.0)
    vote, guess = np.array([v for _, v, _, _ in LABELLERS]), np.array([a for *_, a in LABELLERS])
    # rates for bad and for good texts
    right, wrong = np.where(vote == GOOD, 0.8, 0.3), np.where(vote == GOOD, 0.4, 0.3 * (1 - guess))
    first = np.stack((np.where(vote == BAD, right, wrong), np.where(vote == GOOD, right, wrong)))
    rate, share = first, 0.8
    for _ in range(rounds):
        like = [fired @ np.log(r) + (1 - fired) @ np.log1p(-r) for r in rate]
        good = 1 / (1 + np.exp(np.clip(like[BAD] - like[GOOD] + np.log1p(-share) - np.log(share), -700, 700)))
        weight = np.stack(((1 - good) * counts, good * counts))
        rate = np.clip((weight @ fired + 5 * first) / (weight.sum(1, keepdims=True) + 5), 1e-4, 1 - 1e-4)
        share = float((weight[GOOD].sum() + 4) / (counts.sum() + 5))
    hits = (weight @ fired)[vote, np.arange(len(vote))]
    return (hits + 2 * guess) / ((weight.sum(0) @ fired) + 2), share, np.where(patterns > 0, good, share)


#: Letters as a or A, digits as 0.
_KINDS = bytes(97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


class _Places(dict):
    """Words of a, A, 0 and marks to a place in the hashed space: runs of a kind count once, of a mark twice."""

    def __missing__(self, kinds: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        shape = re.sub(rb"([^aA0])\1+", rb"\1\1", re.sub(rb"([aA0])\1+", rb"\1", kinds))
        at = self[kinds] = xxhash.xxh32_intdigest(shape[:40]) % SPACE
        return at


class _Shapes(dict):
    """Words to the place of their shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        at = self[word] = _places[word.translate(_KINDS)]
        return at


_places, _shapes = _Places(), _Shapes()
cache("quality", lambda: (_shapes.clear(), _places.clear()))


def features(words: list[bytes], f: Figures) -> tuple[np.ndarray, np.ndarray]:
    """Places and values in the hashed space: mean counts of the words' shapes, which may share a place, and one place for each figure's bin."""
    at = np.fromiter(map(_shapes.__getitem__, f.counts), np.int64, len(f.counts))
    n = np.fromiter(f.counts.values(), np.int64, len(f.counts))
    bins = [f"{name}:{min(9, int(value * 10))}" for name, value in (("u", f.upper), ("s", f.symbols * 3), ("x", f.shouts), ("a", f.again), ("t", f.top), ("f", f.fresh / 2), ("e", f.ends), ("o", f.odd))]
    places = np.array([xxhash.xxh32_intdigest(b) % SPACE for b in bins], np.int64)
    return np.concatenate((at, places)), np.concatenate((n / len(words), np.full(len(bins), 0.5)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by accelerated gradient steps."""
    sizes = np.array([len(a) for a, _ in rows])
    at, value, owner = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(len(rows)), sizes)
    w = look = np.zeros(SPACE + 1)
    for k in range(rounds):
        z = np.bincount(owner, value * look[at], len(rows)) + look[-1]
        slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        step = np.append(np.bincount(at, value * slope[owner], SPACE), slope.sum()) / len(rows)
        new = look - 1.0 * (step + 1e-4 * np.append(look[:-1], 0))
        look, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Model:
    accuracy: dict[str, float]
    share: float
    posterior: dict[int, float]
    weights: np.ndarray

    def score(self, words: list[bytes], f: Figures) -> float:
        at, value = features(words, f)
        return float(1 / (1 + np.exp(-np.clip(value @ self.weights[at] + self.weights[-1], -30, 30))))


def fit(df: DataFrame, staging: Staging, most: int = TRAIN_ROWS) -> Model:
    texts = df.select(F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))

    def look(batches):
        claim("quality")
        for batch in batches:
            for part in slices(batch, "text"):
                found = [votes(figures(w, t)) if (w := (t or b"").split()) else -1 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("mark"), pa.array(found, pa.int32())], ["mark", "pattern"])

    seen = staging.write(texts.mapInArrow(look, "mark long, pattern int").where("pattern >= 0"), "votes")
    counted = seen.groupBy("pattern").count().orderBy("pattern").collect()
    if not counted:
        return Model({}, 0.8, {}, np.zeros(SPACE + 1))
    patterns = np.array([r["pattern"] for r in counted])
    accuracy, share, good = estimate(patterns, np.array([r["count"] for r in counted], float))
    posterior = dict(zip(patterns.tolist(), good.tolist()))
    chosen = F.broadcast(seen.select("mark").distinct().orderBy("mark").limit(most))  # bounded by `most`

    def sample(batches):
        for batch in batches:
            out = []
            for mark, t in zip(batch.column("mark").to_pylist(), batch.column("text").to_pylist()):
                words = (t or b"").split()
                if words:
                    f = figures(words, t)
                    at, value = features(words, f)
                    at, of = np.unique(at, return_inverse=True)  # what goes to the driver has each place once
                    out.append({"mark": mark, "pattern": votes(f), "at": at.tolist(), "value": np.bincount(of, value).tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("mark", pa.int64()), ("pattern", pa.int32()), ("at", pa.list_(pa.int64())), ("value", pa.list_(pa.float64()))]))

    # copies of a text are one row
    rows = texts.join(chosen, "mark").mapInArrow(sample, "mark long, pattern int, at array<long>, value array<double>").dropDuplicates(["mark"]).orderBy("mark").collect()
    weights = train([(np.array(r["at"]), np.array(r["value"])) for r in rows], np.array([posterior[r["pattern"]] for r in rows]))
    return Model({name: float(a) for (name, *_), a in zip(LABELLERS, accuracy)}, share, posterior, weights)


def classify(df: DataFrame, model: Model) -> DataFrame:
    """All columns, and votes (the labellers that fired), posterior, quality_score and keep."""
    own = ["votes", "posterior", "quality_score", "keep"]
    if clash := {*own} & {*df.columns}:
        raise ValueError(f"columns exist: {sorted(clash)}")

    def run(batches):
        claim("quality")
        names = [name for name, *_ in LABELLERS]
        for batch in batches:
            for part in slices(batch, "text"):
                said, posterior, score = [], [], []
                for t in part.column("text").to_pylist():
                    raw = (t or "").encode()
                    words = raw.split()
                    f = figures(words, raw) if words else None
                    v = votes(f) if f else -1
                    said.append(",".join(n for j, n in enumerate(names) if f and v >> j & 1))
                    posterior.append(model.posterior.get(v, model.share) if f else 0.0)
                    score.append(model.score(words, f) if f else 0.0)
                more = [pa.array(said), pa.array(posterior), pa.array(score, pa.float64()), pa.array([s >= CUT for s in score], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *own])

    fields = [T.StructField(n, t) for n, t in zip(own, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()))]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, Staging(spark, "quality"))
    return classify(docs, model).select("doc_id", "votes", F.round("posterior", 6).alias("posterior"), F.round("quality_score", 6).alias("quality_score"), "keep")
