"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

Bands. Set sizes are cut into bands of ratio 1/threshold, so that the larger set of a linked pair
lies in the smaller one's band or in the next; a set is indexed for its own band and for the one below.
For a band, H bounds the symmetric difference of any linked pair.

Segments. Shingles hash into m ranges of the universe; a segment is what a set has in one range.
Each range is allocated a number of differences that it may take: 1 (index the segment itself) or 2 (the
segment and its one-deletion neighbourhood). With allocations that sum to H+1, a linked pair agrees in at
least one indexed key. The cheaper of the two allocations is taken for each band, by a cost of keys plus
the collisions expected of segments with at most one shingle. Ranges of allocation 1 are half as many
again as H+1: a linked pair then agrees in more than `slack` of them, so a set may leave out the `slack`
keys that the most sets share (allocation 0): its empty segments first, then by counted frequency. What
no other set shares, or what is left out, costs nothing more; most sets with a few common passages end here.

Candidates. Keys go, packed by slice of documents, to buckets, which count them; keys that many sets of a
slice have go by salts of their sets, and are counted in a second step; sets with too few shared keys drop out; the others' remaining keys give star edges. Components of these edges hold every linked
pair. Equal sets are one node from the start, so copies never multiply.

Verification is exact, on the sets themselves: a component (or, of one over CAP shingles, each pair of
its blocks) is one task's group, in which every pair of unconnected sets within the size bounds is counted
from the set that most others share down; links leave as a spanning forest, whose components are the classes.

Null or empty text, or no words: an empty set, linked with nothing. Fewer words than a shingle: the
whole sequence is one shingle. Null doc_id: linked like others; a class of only such is null. Repeated
rows: a row each. Empty table: empty result. Other columns are not read. Long texts are whole.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colloquy.llm.common import Staging, cache, claim, mix64, read_table, slices, tune
from colloquy.llm.graph import components, with_group
from colloquy.llm.packed import cut

#: Shingles of a verification task; keys of a bucket; nodes up to which the labels are broadcast.
CAP, BUCKET_KEYS, SMALL = 2_000_000, 1_000_000, 500_000
#: Sets of a slice of texts from which a key's holders are dealt out by salts; distinct sets a salt.
MANY, SALT_SETS = 32, 200_000
#: What a weak segment costs in keys.
WEAK_COST = 2.0
WORDS_KEPT = 300_000
#: A set's name is a digest of 64 bits; a second one tells sets of one name apart.
NODE_SEED, PROOF_SEED, NODE_MASK = 0x51, 0xA7, 2**64 - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()
cache("jaccard", _words.clear)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""
    words = np.fromiter(map(_words.__getitem__, (text or b"").lower().split()), np.uint64)
    if not len(words):
        return words
    width = min(k, len(words))
    made = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        made = mix64(made * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i])
    return np.unique(made)


def digest_of(s: np.ndarray, seed: int) -> int:
    """A 64-bit digest of a set of shingles."""
    return int(mix64(np.array([mix64(s ^ np.uint64(seed)).sum() + np.uint64(len(s) * 2)], np.uint64))[0])


def names_of(sets: list[np.ndarray], moved: dict, mask: int) -> list[int]:
    """The node of each set that isn't empty: its digest, or, where another set has the same, what `moved` has for it."""
    out = []
    for s in sets:
        node = digest_of(s, NODE_SEED) & mask
        out.append(moved.get((node, digest_of(s, PROOF_SEED)), node) if node in moved else node)
    return out


class Scheme:
    """The bands' allocations for a threshold of p/q."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.edges, self.plans = p, q, [1, 1 + q // p], []

    def band(self, sizes: np.ndarray) -> np.ndarray:
        most = int(sizes.max(initial=1))
        while self.edges[-1] <= most * self.q // self.p + 1:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * self.q // self.p + 1))
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def plan(self, band: int) -> tuple[int, bool, int]:
        """(ranges, whether with deletions, slack); no ranges where only equal sets link."""
        while len(self.plans) <= band:
            low, high = self.edges[len(self.plans)], self.edges[len(self.plans) + 1] - 1
            self.plans.append(self._cheapest(low, (high + high * self.q // self.p) * (self.q - self.p) // (self.q + self.p)))
        return self.plans[band]

    @staticmethod
    def _cheapest(low: int, differences: int) -> tuple[int, bool, int]:
        if not differences:
            return 0, False, 0
        need = differences + 1
        slack = 1 + need // 2
        ranges = need + slack
        mean = low / ranges
        weak = ranges * math.exp(-mean) * (1 + mean)
        pairs = -(-need // 2)
        return (pairs, True, 0) if low + pairs < ranges + WEAK_COST * max(0.0, weak - slack / 2) else (ranges, False, slack)


@lru_cache(maxsize=8)
def scheme(p: int, q: int) -> Scheme:
    return Scheme(p, q)


def keys_of(sets: list[np.ndarray], p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of sorted sets and the owner of each: twice a set's number, plus 1 for the band below;
    the owners' bands, and how many shared keys an owner may still leave out."""
    made, sizes = scheme(p, q), np.array([len(s) for s in sets], np.int64)
    band = made.band(sizes)
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    bands, spare = np.repeat(band, 2), np.zeros(2 * len(sets), np.int64)
    bands[1::2] -= 1
    for below in (0, 1):
        plans = [made.plan(b - below) if n and b >= below else (0, False, 0) for b, n in zip(band.tolist(), sizes.tolist())]
        for deletions in (False, True):
            who = np.array([i for i, plan in enumerate(plans) if plan[0] and plan[1] == deletions], np.int64)
            if not len(who):
                continue
            ranges, slack = np.array([plans[i][0] for i in who], np.uint64), np.array([plans[i][2] for i in who])
            tokens, owner = np.concatenate([sets[i] for i in who]), np.repeat(np.arange(len(who)), sizes[who])
            segment = ((tokens >> np.uint64(32)) * ranges[owner] >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1]))))
            lengths = np.diff(np.append(starts, len(tokens)))
            mixed = mix64(tokens)
            sums, of, place = np.add.reduceat(mixed, starts), owner[starts], segment[starts]
            tag = mix64((band[who][of] - below).astype(np.uint64) << np.uint64(40) | place.astype(np.uint64))
            keys.append(mix64(sums ^ tag))
            owners.append(2 * who[of] + below)
            empties = ranges.astype(np.int64) - np.bincount(of, minlength=len(who))
            left = slack - empties
            if deletions:
                keys.append(mix64((np.repeat(sums, lengths) - mixed) ^ np.repeat(tag, lengths)))
                owners.append(2 * who[owner] + below)
            spare[2 * who + below] = np.maximum(left, 0)
            # empty segments that can't be left out: those in the last ranges
            for j in np.flatnonzero(left < 0).tolist():
                empty = np.setdiff1d(np.arange(int(ranges[j])), place[of == j], assume_unique=True)[left[j] :]
                keys.append(mix64(mix64(np.uint64(int(band[who[j]]) - below) << np.uint64(40) | empty.astype(np.uint64))))
                owners.append(np.full(len(empty), 2 * who[j] + below))
    return np.concatenate(keys), np.concatenate(owners), bands, spare


def links_within(sets: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """A class number for each set: linked sets share it, directly or through others."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    tokens, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    shared = np.bincount(flat)
    popular = np.add.reduceat(shared[flat], starts) / sizes
    label, marks = np.arange(len(sets)), np.zeros(len(tokens), np.int32)
    last = np.searchsorted(sizes, sizes * q // p, side="right")
    first = np.searchsorted(sizes, -(-sizes * p // q), side="left")
    for pivot in np.argsort(-popular, kind="stable").tolist():
        a, z = int(first[pivot]), int(last[pivot])
        other = label[a:z] != label[pivot]
        if not other.any():
            continue
        own = flat[starts[pivot] : ends[pivot]]
        marks[own] = 1
        both = np.add.reduceat(marks[flat[starts[a] : ends[z - 1]]], starts[a:z] - starts[a])
        marks[own] = 0
        linked = other & (q * both >= p * (sizes[a:z] + sizes[pivot] - both))
        if linked.any():
            old = np.unique(np.append(label[a:z][linked], label[pivot]))
            label[np.isin(label, old)] = old[0]
    out = np.empty(len(sets), np.int64)
    out[order] = label
    return out


def _apart(sums: DataFrame, nodes: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame, dict]:
    """The tables with a node for each (digest, proof), and where sets of one digest went: all but one
    of them get new names. Chance makes about n^2 / 2^65 such among n distinct sets."""
    twice = nodes.groupBy("node").agg(F.count("*").alias("k"), F.min("proof").alias("keeps")).where("k > 1")
    others = nodes.join(twice, "node").where("proof <> keeps").select("node", "proof").collect()
    if not others:
        return sums, nodes, {}
    unsigned = lambda x: x & (2**64 - 1)
    moved = {}
    for r in sorted((unsigned(r["node"]), unsigned(r["proof"])) for r in others):
        # names that digests don't take: those of sets are spread over all 64 bits
        moved[r] = int(mix64(np.array([r[1]], np.uint64) ^ mix64(np.array([r[0]], np.uint64)))[0])
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = [(signed(a), signed(b), signed(c)) for (a, b), c in moved.items()]
    names = F.broadcast(sums.sparkSession.createDataFrame(rows, "node long, proof long, other long"))
    renamed = [t.join(names, ["node", "proof"], "left").withColumn("node", F.coalesce("other", "node")).drop("other") for t in (sums, nodes)]
    return staging.write(renamed[0], "sums-apart"), staging.write(renamed[1], "nodes-apart"), moved | {node: True for node, _ in moved}


def classes(df: DataFrame, staging: Staging, k: int, p: int, q: int) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; links are q * intersection >= p * union."""
    texts = df.select("doc_id", F.col("text").cast("binary").alias("text"))

    def summarise(batches):
        claim("jaccard")
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, k) for t in part.column("text").to_pylist()]
                said = [[digest_of(x, seed) & mask if len(x) else 0 for x in sets] for seed, mask in ((NODE_SEED, NODE_MASK), (PROOF_SEED, 2**64 - 1))]
                said = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in said]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), *said], ["doc_id", "n", "node", "proof"])

    sums = staging.write(texts.mapInArrow(summarise, "doc_id long, n long, node long, proof long"), "sums")
    own = sums.where("n > 0").groupBy("node", "proof").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    nodes = staging.write(own, "nodes")
    sums, nodes, moved = _apart(sums, nodes, staging)
    figures = nodes.agg(F.sum("n"), F.count("*")).first()
    total = figures[0] or 0
    salts = 1 + (figures[1] or 0) // SALT_SETS
    buckets = 1 + int(total * 6 * (q - p) / (q + p) / BUCKET_KEYS)

    def index(batches):
        claim("jaccard")
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [x for t in part.column("text").to_pylist() if len(x := shingles(t, k))]
                seen = dict(zip(names_of(sets, moved, NODE_MASK), sets))  # copies are one
                if not seen:
                    continue
                keys, owners, bands, spare = keys_of(list(seen.values()), p, q)
                names = np.repeat(np.array(list(seen), np.uint64).view(np.int64), 2)
                order, rows = np.argsort(keys, kind="stable"), []
                for b, first, end in cut(keys[order], buckets):
                    take = order[first:end]
                    # 32 bits of a key suffice beside its bucket: a chance meeting only costs time
                    short = keys[take].astype(np.uint32)
                    kinds, of, count = np.unique(short, return_inverse=True, return_counts=True)
                    salt = np.where(count[of] >= MANY, 1 + names[owners[take]].view(np.uint64) % np.uint64(salts), np.uint64(0))
                    for s in np.unique(salt).tolist() if len(kinds) else []:
                        own = salt == s
                        used, local = np.unique(owners[take[own]], return_inverse=True)
                        marks = kinds[count >= MANY] if s == 0 else kinds[:0]
                        rows.append((b, int(s), short[own].tobytes(), local.astype(np.uint32 if len(used) >> 16 else np.uint16).tobytes(), names[used].tobytes(), bands[used].astype(np.int32).tobytes(), spare[used].astype(np.int32).tobytes(), marks.tobytes()))
                    if len(kinds) and salt.all():
                        rows.append((b, 0, b"", b"", b"", b"", b"", kinds.tobytes()))
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 6))], ["bucket", "salt", "keys", "owners", "names", "bands", "spare", "marks"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Keys that several nodes share: one row a key and node. Those that MANY nodes of a slice share
        come by salts of the nodes, and are only marked where the others are."""
        keys, nodes_, bands, spare = [], [], [], []
        for raw, owners, names, band, left in zip(pdf["keys"], pdf["owners"], pdf["names"], pdf["bands"], pdf["spare"]):
            n = len(raw) // 4
            own = np.frombuffer(owners, np.uint16 if len(owners) == 2 * n else np.uint32)
            keys.append(np.frombuffer(raw, np.uint32))
            nodes_.append(np.frombuffer(names, np.int64)[own])
            bands.append(np.frombuffer(band, np.int32)[own])
            spare.append(np.frombuffer(left, np.int32)[own])
        keys, nodes_, bands, spare = (np.concatenate(x) for x in (keys, nodes_, bands, spare))
        order = np.lexsort((nodes_, keys))
        keys, nodes_, bands, spare = keys[order], nodes_[order], bands[order], spare[order]
        once = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes_[1:] != nodes_[:-1])))
        keys, nodes_, bands, spare = keys[once], nodes_[once], bands[once], spare[once]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        of = np.cumsum(new) - 1
        count = np.bincount(of)[of]
        bucket, salt = int(pdf["bucket"].iloc[0]), int(pdf["salt"].iloc[0])
        hot = np.full(len(keys), salt > 0)
        if not salt:
            hot = np.isin(keys, np.frombuffer(b"".join(pdf["marks"]), np.uint32))
        shared = hot | (count > 1)
        return pd.DataFrame({"key": keys[shared].astype(np.int64) | bucket << 32, "node": nodes_[shared], "band": bands[shared], "spare": spare[shared], "count": count[shared].astype(np.int64), "hot": hot[shared]})

    packed = texts.mapInArrow(index, "bucket int, salt int, keys binary, owners binary, names binary, bands binary, spare binary, marks binary")
    shared = staging.write(packed.groupBy("bucket", "salt").applyInPandas(meet, "key long, node long, band int, spare int, count long, hot boolean"), "met")
    hot = shared.where("hot")
    if not hot.isEmpty():
        # the same order of keys for all their nodes needs their whole counts
        once = staging.write(hot.drop("hot", "count").dropDuplicates(["key", "node", "band"]), "hot")
        counted = with_group(once, "key", count=F.count("*"))
        shared = staging.write(shared.where("NOT hot").drop("hot").unionByName(counted), "shared")
        staging.drop("met", "hot")
    enough = shared.groupBy("node", "band").agg(F.count("*").alias("k"), F.max("spare").alias("s")).where("k > s").select("node", "band")
    ranked = shared.join(enough, ["node", "band"], "left_semi")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("count"), "key"))).where("place > spare")
    kept = staging.write(ranked.select("key", "node"), "kept")
    stars = with_group(kept, "key", a=F.min("node")).where("node <> a").select("a", F.col("node").alias("b"))
    near = staging.write(components(stars, staging, "near").join(nodes.select("node", "rep", "n"), "node"), "candidates")

    sizes = near.groupBy("component").agg(F.sum("n").alias("tokens"))
    active = sizes.agg(F.sum("tokens"), F.count("*")).first()
    bins = max(1, -(-(active[0] or 0) * 2 // CAP))
    large = staging.write(sizes.where(F.col("tokens") > CAP), "large")  # at most bins of them
    large = F.broadcast(large) if large.count() <= SMALL else large
    blocks = F.ceil(F.col("tokens") * 2 / CAP).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = F.transform(F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: j != own), lambda j: F.struct(F.col("component").alias("group"), F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    alone = F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("group"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    tasks = near.join(large, "component", "left").select("rep", "component", "node", F.when(F.col("tokens").isNull(), alone).otherwise(spread).alias("tasks"))
    tasks = F.broadcast(tasks) if (tasks.agg(F.sum(F.size("tasks"))).first()[0] or 0) <= SMALL else tasks
    chosen = texts.join(tasks, texts.doc_id.eqNullSafe(tasks.rep))

    def sets_of(batches):
        claim("jaccard")
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, k) for t in part.column("text").to_pylist()]
                found = [x.tobytes() for x in sets]
                digest = names_of(sets, moved, NODE_MASK)
                # of several rows with the representative's id, those with its set
                same = np.array(digest, np.uint64).view(np.int64) == part.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("component"), part.column("node"), part.column("tasks"), pa.array(found, pa.binary())], ["component", "node", "tasks", "shingles"]).filter(pa.array(same))

    shipped = chosen.select("text", "component", "node", "tasks").mapInArrow(sets_of, "component long, node long, tasks array<struct<group:long,i:int,j:int>>, shingles binary")
    shipped = shipped.select("component", "node", "shingles", F.explode("tasks").alias("t")).select("component", "node", "shingles", "t.*")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("verify")
        a, b = [], []
        for _, group in pdf.drop_duplicates("node").groupby("component", sort=False):
            names = group["node"].to_numpy()
            label = links_within([np.frombuffer(s, np.uint64) for s in group["shingles"]], p, q)
            _, first, of = np.unique(label, return_index=True, return_inverse=True)
            root = names[first][of]
            a.append(names[root != names])
            b.append(root[root != names])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    linked = shipped.groupBy("group", "i", "j").applyInPandas(verify, "a long, b long")
    found = components(linked, staging, "links").join(nodes.select("node", "rep"), "node")
    found = staging.write(with_group(staging.write(found, "linked"), "component", least=F.min("rep")).select("node", "least"), "classes")
    staging.drop("met", "shared", "kept", "candidates", "large", "linked")
    own = nodes.select("node", "rep").join(found, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    empty = sums.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return sums.where("n > 0").join(own, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return classes(read_table(spark, sf_dir, "documents"), Staging(spark, "jaccard"), 3, 90, 100)
