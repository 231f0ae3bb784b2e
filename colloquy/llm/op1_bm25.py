"""Exact BM25 top-k on inverted shards with block-max pruning.

A shard is a run of texts in scan order. It is cut into segments of texts that share frequent terms (those
of one language, say), and within these texts are sorted by their commonest word and their size, so that like
texts share blocks of BLOCK. A segment holds its frequent terms as a matrix, with the largest impact for each
term and block, and the others as postings. Document frequencies, the number of rows and the mean length are
those of the whole table.

Queries go in blocks of about BLOCK_TERMS terms, each broadcast; their number follows the query set, and
for each the shards are read once. Rare terms are added up by their postings, for a few queries at once. For
a query, the most that they give in a block, and the block maxima of its frequent terms, bound every score
there. A query's k-th best score is first raised by the block of its highest bound, and a task keeps
it across its shards; one shard of AHEAD goes first, and what a query's k best reach there, the others start with.
Blocks with a bound under it are skipped. In the others, frequent terms are scored for many queries at once as
matrix products in single precision; what then may be among the k best is scored again in double precision, term
by term. Tasks' best are merged by score and id.

Terms: A-Z lowered, `[0-9a-z]` and all beyond ASCII; each distinct term of a query counts once. Scores sum
in the order of terms, so equal texts score alike; ties go by doc_id, nulls last.

Null or empty text: matches nothing and asks nothing. Null doc_id: found, not a query. Repeated rows: each
found, each asks. Fewer matches than k: those. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import Staging, cache, claim, ragged, read_table, tune

K1, B, TOP, EVERY = 1.2, 0.75, 10, 50
SHARD_BYTES, SHARD_ROWS, BLOCK, BLOCK_TERMS = 24 << 20, 1 << 15, 64, 4_000_000
#: Cells of a shard's matrix of frequent terms at most.
CELLS = 24_000_000
#: Groups of texts that share frequent terms in a shard, by so many of these; (query, text) pairs that are scored at once, and whose rare terms are added up at once.
SEGMENTS, FEATURES, PAIRS, GRID = 6, 256, 4_000_000, 50_000
#: One shard of so many goes first.
AHEAD = 16
#: Tasks' lists that are merged at once.
MERGED = 100_000
#: Queries scored together; the share of a shard's texts from which a term is frequent; what single precision may miss.
TOGETHER, DENSE, SLACK = 512, 0.05, 2e-4
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_terms = _Terms()
cache("bm25", _terms.clear)


def terms_of(text: bytes | None) -> np.ndarray:
    return np.fromiter(map(_terms.__getitem__, (text or b"").translate(_LETTERS).split()), np.uint64)


SHARD = "shard long, n long, ids binary, known binary, lengths binary, terms binary, frequencies binary, docs binary, tfs binary, segments binary"


def _grouped(common: np.ndarray, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """A segment for each text: texts of one commonest word stay together, and words whose texts share frequent terms meet."""
    _, group, size = np.unique(common, return_inverse=True, return_counts=True)
    kinds, owner, often = np.unique(term, return_inverse=True, return_counts=True)
    top = np.argsort(-often, kind="stable")[:FEATURES]
    top = top[often[top] > max(1, DENSE * n)]
    if n < SEGMENTS * BLOCK or not len(top):
        return np.zeros(n, np.int64)
    feature = np.full(len(kinds), -1)
    feature[top] = np.arange(len(top))
    own = feature[owner]
    cell = group[doc[own >= 0]] * len(top) + own[own >= 0]
    x = np.bincount(cell, minlength=len(size) * len(top)).reshape(len(size), len(top)).astype(np.float32)
    x *= np.log(n / often[top]).astype(np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    centres = x[[int(size.argmax())]]
    for _ in range(1, SEGMENTS):  # the heaviest of those that are far from all centres
        centres = np.concatenate((centres, x[[int((size * (1 - (x @ centres.T).max(1))).argmax())]]))
    for _ in range(5):
        near = (x @ centres.T).argmax(1)
        for c in np.unique(near).tolist():
            mid = size[near == c] @ x[near == c]
            centres[c] = mid / max(1e-9, float(np.sqrt(mid @ mid)))
    near = (x @ centres.T).argmax(1)
    texts = np.bincount(near, size, len(centres))
    near[texts[near] < n / 20] = int(texts.argmin())  # small ones are one
    return near[group]


def _build(rows: list[tuple[int | None, np.ndarray]]) -> dict:
    """A shard of (doc_id, terms)."""
    kinds = [np.unique(t, return_counts=True) for _, t in rows]
    common = np.array([t[c.argmax()] if len(t) else 0 for t, c in kinds], np.uint64)
    n = np.array([len(t) for t, _ in kinds])
    term = np.concatenate([t for t, _ in kinds])
    tf = np.concatenate([c for _, c in kinds])
    doc = np.repeat(np.arange(len(rows)), n)
    segment = _grouped(common, doc, term, len(rows))
    _, group, size = np.unique(common, return_inverse=True, return_counts=True)
    order = np.lexsort((n, np.where(size[group] >= BLOCK // 2, common, 0), segment))
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    doc = place[doc]
    by = np.lexsort((doc, term))
    term, doc, tf = term[by], doc[by], tf[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), term[1:] != term[:-1])))
    ids = [rows[i][0] for i in order]
    return {
        "n": len(rows),
        "ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
        "known": np.array([i is not None for i in ids], bool).tobytes(),
        "lengths": np.array([len(rows[i][1]) for i in order], np.int64).tobytes(),
        "terms": term[first].tobytes(),
        "frequencies": np.diff(np.append(first, len(term))).astype(np.int32).tobytes(),
        "docs": doc.astype(np.int32).tobytes(),
        "tfs": tf.astype(np.int32).tobytes(),
        "segments": np.bincount(segment, minlength=1).astype(np.int32).tobytes(),
    }


_SHARD_SCHEMA = pa.schema([("shard", pa.int64()), ("n", pa.int64()), *((n, pa.binary()) for n in ("ids", "known", "lengths", "terms", "frequencies", "docs", "tfs", "segments"))])


class Segment:
    """The texts from `lo` on of a shard: their frequent terms as a matrix, the others as postings."""

    def __init__(self, lo: int, n: int, terms: int, owner: np.ndarray, docs: np.ndarray, impact: np.ndarray, cells: int):
        self.lo, self.n, self.blocks = lo, n, -(-n // BLOCK)
        frequency = np.bincount(owner, minlength=terms)
        often = np.flatnonzero(frequency >= max(2, DENSE * n))
        most = cells // max(1, self.blocks * BLOCK)
        if len(often) > most:  # the most frequent; the others count as rare
            often = np.sort(often[np.argsort(-frequency[often], kind="stable")[:most]])
        # a term's row of the matrix, -1 for a rare term and -2 for one that isn't here
        self.kind = np.where(frequency > 0, -1, -2).astype(np.int32)
        self.kind[often] = np.arange(len(often))
        place = self.kind[owner]
        dense = place >= 0
        self.rows = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        self.rows[place[dense], docs[dense]] = impact[dense]
        self.tops = self.rows.reshape(len(often), self.blocks, BLOCK).max(2)
        # all postings by text, for exact scores
        by = np.argsort(docs.astype(np.uint16) if n < 1 << 16 else docs, kind="stable")
        self.terms_of, self.impact_of = owner[by], impact[by]
        self.text = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=n)))).astype(np.int32)
        # rare ones by term
        self.docs, self.impact = docs[~dense], impact[~dense].astype(np.float32)
        self.many = np.where(self.kind == -1, frequency, 0).astype(np.int32)
        self.first = (np.cumsum(self.many) - self.many).astype(np.int32)
        self.share = (frequency / n).astype(np.float32)
        self.asked = np.full(terms, -1.0)

    def search(self, who: np.ndarray, places: np.ndarray, weights: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(query, text) pairs that may be among the k best, and how many (query, block) pairs were multiplied, and how many have a term.
        who, places, weights: the queries' terms, by query; worst: what a score must reach, by query."""
        count, width = len(worst), self.blocks * BLOCK
        kind = self.kind[places]
        often, rare = np.flatnonzero(kind >= 0), np.flatnonzero(kind == -1)
        frequent = np.zeros((count, len(self.rows)), np.float32)
        frequent[who[often], kind[often]] = weights[often]
        who, places, weights = who[rare], places[rare], weights[rare].astype(np.float32)
        first, many, score = self.first[places], self.many[places], np.empty((count, width), np.float32)
        step = max(1, GRID // width)
        edges = np.searchsorted(who, np.arange(0, count + step, step))
        for i, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):  # few queries at once, for the processor's cache
            low, high = i * step, min(count, (i + 1) * step)
            posting = runs(first[a:z], many[a:z])
            cell = self.docs[posting] + np.repeat(((who[a:z] - low) * width).astype(np.int32), many[a:z])
            score[low:high] = np.bincount(cell, self.impact[posting] * np.repeat(weights[a:z], many[a:z]), (high - low) * width).reshape(-1, width)
        bound = frequent @ self.tops + score.reshape(count, self.blocks, BLOCK).max(2)
        worst = np.maximum(worst, self._raised(bound, worst, frequent, score, k))
        todo = (bound > 0) & (bound * (1 + SLACK) >= worst[:, None])
        for b in np.flatnonzero(todo.any(0)).tolist():
            own = np.flatnonzero(todo[:, b])
            some, cut = slice(None) if len(own) == count else own, slice(b * BLOCK, (b + 1) * BLOCK)
            score[some, cut] += frequent[some] @ self.rows[:, cut]
        # what wasn't multiplied is under its true score, and that under the least
        score = score[:, : self.n]
        hit = (score > 0) & (score >= (worst * (1 - SLACK))[:, None])
        if self.n > k:
            for q in np.flatnonzero(hit.sum(1) > k).tolist():
                own = score[q]
                hit[q] &= own >= np.partition(own, self.n - k)[self.n - k] * (1 - SLACK)
        return *np.nonzero(hit), int(todo.sum()), int((bound > 0).sum())

    def _raised(self, bound: np.ndarray, worst: np.ndarray, frequent: np.ndarray, rare: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score in the block of the highest bound, for queries that have no k-th best yet."""
        out = np.zeros(len(worst), np.float32)
        if self.blocks < 2 or BLOCK < k:
            return out
        leading = bound.argmax(1)
        for q in np.flatnonzero((worst == 0) & bound.any(1)).tolist():
            cut = slice(leading[q] * BLOCK, (leading[q] + 1) * BLOCK)
            # single precision may be a little over the true score
            out[q] = np.partition(rare[q, cut] + frequent[q] @ self.rows[:, cut], -k)[-k] * (1 - SLACK)
        return out

    def exact(self, places: np.ndarray, weights: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Scores of texts in double precision, summed in the order of terms."""
        self.asked[places] = weights
        many = self.text[texts + 1] - self.text[texts]
        posting = runs(self.text[texts], many)
        weight = self.asked[self.terms_of[posting]]
        there = np.flatnonzero(weight > 0)
        self.asked[places] = -1
        return np.bincount(np.repeat(np.arange(len(texts)), many)[there], weight[there] * self.impact_of[posting[there]], len(texts))


class Shard:
    def __init__(self, row: dict, mean: float):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.known, lengths = read("ids", np.int64), read("known", bool), read("lengths", np.int64)
        self.terms, docs, tf = read("terms", np.uint64), read("docs", np.int32), read("tfs", np.int32)
        impact = (K1 + 1) * tf / (tf + K1 * (1 - B + B * lengths[docs] / mean))
        owner = np.repeat(np.arange(len(self.terms), dtype=np.int32), read("frequencies", np.int32))
        self.segments, lo = [], 0
        for n in read("segments", np.int32).tolist():
            if n:
                own = np.flatnonzero((docs >= lo) & (docs < lo + n))
                self.segments.append(Segment(lo, n, len(self.terms), owner[own], docs[own] - np.int32(lo), impact[own], CELLS * n // row["n"]))
            lo += n

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], best: list[np.ndarray], found: list[np.ndarray], k: int) -> tuple[int, int]:
        """Merges the shard's matches of (term places, weights) into best scores and (null flag, id) pairs.
        Gives how many (query, block) pairs were scored, and how many there are with a term."""
        ends = np.concatenate(([0], np.cumsum([len(p) for p, _ in queries]))).astype(np.int64)
        return self.search_flat(ends, *(np.concatenate(x) for x in zip(*queries)), best, found, k) if queries else (0, 0)

    def search_flat(self, ends: np.ndarray, places: np.ndarray, weights: np.ndarray, best: list[np.ndarray], found: list[np.ndarray], k: int, floor: np.ndarray | None = None) -> tuple[int, int]:
        """The same with the queries' terms one after another, those of query q from ends[q] to ends[q + 1].
        floor: scores by query that k texts are known to reach."""
        count, scored, total = len(ends) - 1, 0, 0
        who = np.repeat(np.arange(count), np.diff(ends))
        worst = np.array([b[-1] if len(b) == k else 0.0 for b in best], np.float32)
        if floor is not None:
            worst = np.maximum(worst, floor.astype(np.float32))
        order = self.segments
        if not worst.all():  # the likeliest first, as what they give raises what the others must reach
            order = sorted(order, key=lambda s: -float(weights @ s.share[places]))
        for segment in order:
            query, text, seen, all_ = segment.search(who, places, weights, worst, k)
            scored, total = scored + seen, total + all_
            cuts = np.flatnonzero(np.diff(query, prepend=-1, append=count))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                q, hit = int(query[a]), text[a:z]
                own = slice(ends[q], ends[q + 1])
                best[q], found[q] = self._merged(hit + segment.lo, segment.exact(places[own], weights[own], hit), best[q], found[q], k)
                if len(best[q]) == k:
                    worst[q] = max(worst[q], best[q][-1])
        return scored, total

    def _merged(self, hit: np.ndarray, score: np.ndarray, best: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates' scores, summed row by row in the order of terms, among the best so far."""
        best = np.concatenate((best, score))
        found = np.concatenate((found, np.stack((~self.known[hit], self.ids[hit]), 1)))
        order = np.lexsort((found[:, 1], found[:, 0], -best))[:k]
        return best[order], found[order]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """`ragged` in 32 bits."""
    ends = np.cumsum(lengths, dtype=np.int32)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def search(df: DataFrame, queries: DataFrame, staging: Staging, k: int = TOP) -> DataFrame:
    """query_id, rank, doc_id and score of the k best rows of df for each row of queries (doc_id, text)."""
    spark = df.sparkSession

    def index(batches):
        claim("bm25")
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append((i, terms_of(text)))
                size += len(text or b"")
                if size >= SHARD_BYTES or len(held) >= SHARD_ROWS:
                    yield pa.RecordBatch.from_pylist([_build(held) | {"shard": number}], _SHARD_SCHEMA)
                    held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pylist([_build(held) | {"shard": number}], _SHARD_SCHEMA)

    raw = lambda d: d.select("doc_id", F.col("text").cast("binary").alias("text"))
    shards = staging.write(raw(df).mapInArrow(index, SHARD), "index", compression="zstd")

    def spell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["terms"], np.int64)), pa.array(np.frombuffer(row["frequencies"], np.int32).astype(np.int64))], ["term", "n"])

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["n"]]), pa.array([int(np.frombuffer(row["lengths"], np.int64).sum())])], ["n", "words"])

    df_of = staging.write(shards.select("terms", "frequencies").mapInArrow(spell, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
    rows, words = (x or 0 for x in shards.select("n", "lengths").mapInArrow(count, "n long, words long").agg(F.sum("n"), F.sum("words")).first())

    def ask(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                kinds = np.unique(terms_of(text)).view(np.int64)
                out.append({"query": part << 32 | seq, "query_id": i, "terms": kinds.tolist()})
                seq += 1
            yield pa.RecordBatch.from_pylist(out, pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("terms", pa.list_(pa.int64()))]))

    asked = staging.write(raw(queries).mapInArrow(ask, "query long, query_id long, terms array<long>"), "queries")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    # every so many shards go first
    numbers = sorted(r.shard for r in shards.select("shard").collect())
    ahead = numbers[AHEAD // 2 :: AHEAD] if len(numbers) >= 2 * AHEAD else []
    blocks, parts = 1 + total // BLOCK_TERMS, []
    for b in range(blocks if total else 0):
        own = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        listed = own.select(F.explode("terms").alias("term")).distinct().join(df_of, "term").toArrow()
        term, n = listed.column("term").to_numpy().view(np.uint64), listed.column("n").to_numpy()
        order = np.argsort(term)
        term, held, weight = term[order], n[order], np.log1p((rows - n[order] + 0.5) / (n[order] + 0.5))
        table = own.select("query", "terms").orderBy("query").toArrow()
        names, lists = table.column("query").to_numpy(), table.column("terms").combine_chunks()
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        flat = lists.flatten().to_numpy().view(np.uint64)
        place = np.searchsorted(term, flat)
        there = (term[np.minimum(place, max(0, len(term) - 1))] == flat) if len(term) else np.zeros(len(flat), bool)
        place = np.where(there, place, -1).astype(np.int32)
        # like queries together: by their commonest term, then by length
        size = np.diff(at)
        common = np.zeros(len(names), np.int64)
        common[size > 0] = np.maximum.reduceat(np.where(there, held[place], 0), at[:-1][size > 0]) if len(place) and len(term) else 0
        turn = np.lexsort((size, common))
        names, place = names[turn], place[ragged(at[turn], size[turn])]
        at = np.concatenate(([0], np.cumsum(size[turn])))
        sent = spark.sparkContext.broadcast((names, at, place, term, weight))

        def run(batches, sent=sent, floors=None, mean=(words or 1) / max(1, rows)):
            claim("search")
            names, at, place, term, weight = sent.value
            floor = floors.value if floors else np.zeros(len(names))
            best, found = [np.empty(0)] * len(names), [np.empty((0, 2), np.int64)] * len(names)
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = None  # one at a time
                    shard = Shard(batch.slice(i, 1).to_pylist()[0], mean)
                    where = np.searchsorted(shard.terms, term)
                    where = np.where(shard.terms[np.minimum(where, max(0, len(shard.terms) - 1))] == term, where, -1) if len(shard.terms) else np.full(len(term), -1)
                    step = max(1, min(TOGETHER, PAIRS // max(1, len(shard.ids))))
                    for a in range(0, len(names), step):
                        z = min(a + step, len(names))
                        own = place[at[a] : at[z]]
                        there = np.where(own >= 0, where[own], -1) >= 0 if len(where) else np.zeros(len(own), bool)
                        ends = np.concatenate(([0], np.cumsum(there)))[at[a : z + 1] - at[a]]
                        own = own[there]
                        own_best, own_found = best[a:z], found[a:z]
                        shard.search_flat(ends, where[own], weight[own], own_best, own_found, k, floor[a:z])
                        best[a:z], found[a:z] = own_best, own_found
            sizes = np.array([len(x) for x in best])
            if sizes.sum():
                some, pairs = sizes > 0, np.concatenate(found)
                ends = np.concatenate(([0], np.cumsum(sizes[some]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (pa.array(pairs[:, 1]), pa.array(pairs[:, 0] > 0), pa.array(np.concatenate(best)))]
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), *lists], ["query", "ids", "unnamed", "scores"])

        kind, rest, floors = "query long, ids array<long>, unnamed array<boolean>, scores array<double>", shards, None
        if ahead:  # what k texts of some shards reach, the best of the others must
            rest = shards.where(~F.col("shard").isin(ahead))
            parts.append(staging.write(shards.where(F.col("shard").isin(ahead)).mapInArrow(run, kind), f"ahead-{b}"))
            reached = parts[-1].groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("scores")), False).alias("s")).where(F.size("s") >= k).select("query", F.col("s")[k - 1].alias("s")).toArrow()
            floor, turn = np.zeros(len(names)), np.argsort(names)
            floor[turn[np.searchsorted(names, reached.column("query").to_numpy(), sorter=turn)]] = reached.column("s").to_numpy()
            floors = spark.sparkContext.broadcast(floor)
        parts.append(staging.write(rest.mapInArrow(functools.partial(run, floors=floors), kind), f"found-{b}"))
        for x in (sent, floors):
            if x:
                x.unpersist()
    if not parts:
        return asked.select("query_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    staging.drop("index", "frequencies")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query among its tasks' best."""
        query = np.repeat(pdf["query"].to_numpy(), pdf["scores"].map(len))
        score, ids, null = (np.concatenate(pdf[c].to_numpy()) for c in ("scores", "ids", "unnamed"))
        null = null.astype(bool)
        order = np.lexsort((ids, null, -score, query))
        query = query[order]
        new = np.concatenate(([True], query[1:] != query[:-1]))
        rank = np.arange(len(query)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
        keep = rank <= k
        return pd.DataFrame({"query": query[keep], "rank": rank[keep].astype(np.int32), "doc_id": pd.arrays.IntegerArray(ids[order][keep], null[order][keep]), "score": score[order][keep]})

    bins = 1 + every.count() // MERGED
    ranked = every.groupBy(F.pmod(F.xxhash64("query"), F.lit(bins))).applyInPandas(merge, "query long, rank int, doc_id long, score double")
    return ranked.join(asked.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", "score")


def op1_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of every document whose id is divisible by EVERY, against all documents."""
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % EVERY == 0), Staging(spark, "bm25")).withColumn("score", F.round("score", 6))
