"""Removal of every byte that a repeated LENGTH-byte string covers, by prefix-free parsing.

Texts are bytes. A rolling hash of TRIGGER bytes that is 0 modulo SPACING triggers a phrase end;
phrases overlap by a trigger, so equal strings hold equal phrases. Three questions about the corpus
follow, each over a smaller part of it:

1. Dictionary. Which distinct phrases occur more than once? A string with a phrase inside that
   occurs once can't repeat; what is left is runs of strings that share their first trigger.
2. Parse. Runs are put in the order of what follows their trigger (anchor) and of their whole context
   (the run's bytes and what its last string reaches). Runs of an equal context repeat as a whole. A run is
   opened only if its anchor has several contexts, and then once for each context.
3. Suffixes. The strings of opened runs, that is, dictionary suffixes with their parse context, are compared one by one.

The order of suffixes is that of fingerprints, not the alphabet's: with one fixed length, only equality of
prefixes counts. Contexts and strings are equal if two hashes of no common structure are, 126 bits
together: distinct ones among n meet with a chance of n^2 / 2^127. Phrases and anchors go by one of 64 bits, since
a chance meeting there only has more compared.

Texts are packed in shards of SHARD bytes. A shard sends its sorted distinct fingerprints, cut into
ranges; a range's task answers each shard with a bit or two per fingerprint, so that a fingerprint that
a third of all texts hold arrives once a shard. Equal texts are one from the start.

Null or empty text: no bytes, nothing removed. Repeated rows and equal ids: a row each. Short texts
(under LENGTH) stay whole. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import PrimeHash, RollingHash, Staging, claim, mix64, ragged, read_table, tune
from colloquy.llm.packed import ask, bits, questions

LENGTH, TRIGGER, SPACING, NEAR = 200, 16, 24, 100
SHARD, RANGE_KEYS = 1 << 20, 1 << 20


class Texts(RollingHash):
    """Texts one after another, with rolling hashes of any span."""

    def __init__(self, body: bytes, lengths: np.ndarray):
        self.body, self.lengths = np.frombuffer(body, np.uint8), lengths
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.prime: PrimeHash | None = None
        super().__init__(self.body)

    def proofs(self, at: np.ndarray, length) -> np.ndarray:
        self.prime = self.prime or PrimeHash(self.body)
        return self.prime.spans(at, length)

    def fits(self, length: int) -> np.ndarray:
        """Whether a span from each byte stays in its text."""
        out = np.ones(len(self.body), bool)
        short = np.minimum(self.lengths, length - 1)
        out[ragged(self.ends - short, short)] = False
        return out

    def triggers(self) -> np.ndarray:
        n = len(self.body) - TRIGGER + 1
        if n <= 0:
            return np.empty(0, np.int64)
        x = (self.sums[TRIGGER:] - self.sums[:n]) * self.down[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return np.flatnonzero(((x >> np.uint64(32)) * np.uint64(SPACING) >> np.uint64(32) == 0) & self.fits(TRIGGER)[:n])

    def phrases(self, triggers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and fingerprint of the phrases that a string can hold."""
        at, end = triggers[:-1], triggers[1:] + TRIGGER
        inside = (np.searchsorted(self.ends, at, "right") == np.searchsorted(self.ends, triggers[1:], "right")) & (end - at <= LENGTH)
        at, end = at[inside], end[inside]
        return at, end, self.spans(at, end - at)

    def runs(self, triggers: np.ndarray, at: np.ndarray, end: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last string start of each run that may repeat, and its trigger, or -1 if that is far off."""
        lone_at, lone_end = at[~repeated], end[~repeated]
        low = np.maximum(lone_end - LENGTH, 0)
        change = np.bincount(low, minlength=len(self.body) + 1) - np.bincount(lone_at + 1, minlength=len(self.body) + 1)
        found = np.flatnonzero(self.fits(LENGTH) & (np.cumsum(change)[:-1] == 0))
        if not len(found):
            return found, found, found
        trigger = np.append(triggers, 2**60)[np.searchsorted(triggers, found)]
        near = trigger - found <= NEAR
        new = np.concatenate(([True], (np.diff(found) > 1) | (np.diff(trigger) != 0) | (near[1:] != near[:-1])))
        text = np.searchsorted(self.ends, found, "right")
        new[1:] |= text[1:] != text[:-1]
        first = np.flatnonzero(new)
        return found[first], found[np.append(first[1:], len(found)) - 1], np.where(near, trigger, -1)[first]

    def keys(self, low: np.ndarray, high: np.ndarray, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor and context (two hashes) of each run, and whether it has no near trigger."""
        length, far = high - low + LENGTH, trigger < 0
        context = self.spans(low, length)
        return np.where(far, mix64(context), self.spans(np.where(far, low, trigger), NEAR)), context, self.proofs(low, length), far


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the sorted distinct keys, each key's place among them, and whether it occurs again."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    rows = order[new]
    return rows, place, np.bincount(place, minlength=len(rows)) > 1


def _twice(shard: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """1 for a key that occurs again."""
    _, place, again = distinct(keys)
    return again[place].astype(np.uint8) | flags & 1


def _again(shard: np.ndarray, keys: np.ndarray, proof: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """1 for a string that occurs again."""
    _, place, again = distinct(keys, proof)
    return again[place].astype(np.uint8) | flags & 1


def _contexts(shard: np.ndarray, keys: np.ndarray, context: np.ndarray, proof: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """1 for a context that occurs again, 2 for a run that is to be opened: the first of its context, if its anchor has several."""
    rows, place, again = distinct(keys, context, proof)
    _, of_anchor, several = distinct(keys[rows])
    first = np.zeros(len(keys), bool)
    first[rows] = True  # distinct() keeps the order of shards, so this is a context's first
    return (again[place] | (flags & 1 > 0)).astype(np.uint8) | (first & (several[of_anchor][place] | (flags & 2 > 0))).astype(np.uint8) << 1


def _texts(row: dict, body: str = "body") -> Texts:
    return Texts(row[body], np.frombuffer(row["lengths"], np.int64))


def _runs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row["runs"], np.int64).reshape(3, -1))


SHARDS = "shard long, names array<struct<h1:long,h2:long>>, copies array<long>, lengths binary, body binary"
SUSPECTS = "shard long, names array<struct<h1:long,h2:long>>, lengths binary, body binary, runs binary, n_runs long, n_strings long, done array<struct<h1:long,h2:long,n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>>"
RESULT = "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _batch(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, like)


_NAMES = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())]))
_DONE = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def _pack(batches):
    claim("repeats")
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
    schema = pa.schema([("shard", pa.int64()), ("names", _NAMES), ("copies", pa.list_(pa.int64())), ("lengths", pa.binary()), ("body", pa.binary())])

    def close():
        nonlocal seq, held, size
        row = {"shard": part << 24 | seq, "names": [{"h1": r["h1"], "h2": r["h2"]} for r in held], "copies": [r["copies"] for r in held], "lengths": np.array([len(r["text"]) for r in held], np.int64).tobytes(), "body": b"".join(r["text"] for r in held)}
        seq, held, size = seq + 1, [], 0
        return _batch([row], schema)

    for batch in batches:
        for i in range(batch.num_rows):
            held += batch.slice(i, 1).to_pylist()
            size += len(held[-1]["text"])
            if size >= SHARD:
                yield close()
    if held:
        yield close()


def _result(name: dict, text: bytes, gone: np.ndarray | None) -> dict:
    """A text's row; gone: which bytes go."""
    removed = int(gone.sum()) if gone is not None else 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if removed else 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if removed else text
    return name | {"n_bytes": len(text), "n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def covered(length: int, starts: np.ndarray) -> np.ndarray:
    """Which bytes the strings that start at `starts` cover."""
    change = np.bincount(starts, minlength=length + 1) - np.bincount(starts + LENGTH, minlength=length + 1)
    return np.cumsum(change)[:-1] > 0


def removals(df: DataFrame, staging: Staging) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = df.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = named.groupBy("h1", "h2").agg(F.max("text").alias("text"), F.count("*").alias("copies"))
    shards = staging.write(texts.mapInArrow(_pack, SHARDS), "shards", compression="zstd")
    ranges = 1 + size // SPACING // RANGE_KEYS

    def dictionary(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = _texts(row)
                hashes = t.phrases(t.triggers())[2]
                rows, _, twice = distinct(hashes)
                yield questions(row["shard"], ranges, hashes[rows], flags=twice.astype(np.uint8))

    known = ask(shards.select("shard", "lengths", "body"), dictionary, {"flags": np.uint8}, _twice, staging, "phrases")

    def narrow(batches):
        schema = pa.schema([("shard", pa.int64()), ("names", _NAMES), ("lengths", pa.binary()), ("body", pa.binary()), ("runs", pa.binary()), ("n_runs", pa.int64()), ("n_strings", pa.int64()), ("done", _DONE)])
        for batch in batches:
            for row in batch.to_pylist():
                t = _texts(row)
                triggers = t.triggers()
                at, end, hashes = t.phrases(triggers)
                _, place, _ = distinct(hashes)
                low, high, trigger = t.runs(triggers, at, end, (bits(row["phrases"])[place] & 1) > 0)
                own = np.searchsorted(t.ends, low, "right")
                suspect = np.zeros(len(t.ends), bool)
                suspect[own] = True
                done = []
                for i in np.flatnonzero(~suspect | (np.array(row["copies"]) > 1)).tolist():
                    one = row["body"][t.starts[i] : t.ends[i]]
                    # every string of a text with copies starts elsewhere too
                    done.append(_result(row["names"][i], one, np.ones(len(one), bool) if row["copies"][i] > 1 and len(one) >= LENGTH else None))
                kept = np.flatnonzero(suspect)
                shift = np.zeros(len(t.ends), np.int64)
                shift[kept] = t.starts[kept] - (np.cumsum(t.lengths[kept]) - t.lengths[kept])
                runs = np.stack((low - shift[own], high - shift[own], np.where(trigger < 0, -1, trigger - shift[own])))
                # a name of null: the text is done, and only there for the others
                names = [row["names"][i] if row["copies"][i] == 1 else None for i in kept.tolist()]
                body = b"".join(row["body"][t.starts[i] : t.ends[i]] for i in kept.tolist())
                yield _batch([{"shard": row["shard"], "names": names, "lengths": t.lengths[kept].tobytes(), "body": body, "runs": runs.astype(np.int64).tobytes(), "n_runs": len(low), "n_strings": int((high - low + 1).sum()), "done": done}], schema)

    suspects = staging.write(shards.join(known.hint("shuffle_hash"), "shard", "left").mapInArrow(narrow, SUSPECTS), "suspects", compression="zstd")
    staging.drop("shards", "phrases")
    n_runs, n_strings = suspects.agg(F.coalesce(F.sum("n_runs"), F.lit(0)), F.coalesce(F.sum("n_strings"), F.lit(0))).first()
    run_ranges, string_ranges = 1 + n_runs // RANGE_KEYS, 1 + n_strings // (4 * RANGE_KEYS)
    work = suspects.select("shard", "lengths", "body", "runs").where("n_runs > 0")

    def parse(batches):
        for batch in batches:
            for row in batch.to_pylist():
                anchor, context, proof, far = _texts(row).keys(*_runs(row))
                rows, _, twice = distinct(anchor, context, proof)
                yield questions(row["shard"], run_ranges, anchor[rows], context=context[rows], proof=proof[rows], flags=twice.astype(np.uint8) | far[rows].astype(np.uint8) << 1)

    contexts = ask(work, parse, {"context": np.uint64, "proof": np.uint64, "flags": np.uint8}, _contexts, staging, "contexts")

    def opened(row: dict, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Run bounds, whether each repeats, and the string starts that are asked for."""
        low, high, trigger = _runs(row)
        rows, place, _ = distinct(*t.keys(low, high, trigger)[:3])
        said, first = bits(row["contexts"]), np.zeros(len(low), bool)
        first[rows] = True
        asked = first & (said[place] & 2 > 0)
        return low, high, said[place] & 1 > 0, ragged(low[asked], (high - low + 1)[asked])

    def suffixes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = _texts(row)
                asked = opened(row, t)[3]
                hashes, proof = t.spans(asked, LENGTH), t.proofs(asked, LENGTH)
                rows, _, twice = distinct(hashes, proof)
                yield questions(row["shard"], string_ranges, hashes[rows], proof=proof[rows], flags=twice.astype(np.uint8))

    judged = work.join(contexts.hint("shuffle_hash"), "shard")
    strings = ask(judged, suffixes, {"proof": np.uint64, "flags": np.uint8}, _again, staging, "strings")

    def finish(batches):
        kinds = [(n, _DONE.value_type.field(n).type) for n in ("h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
        for batch in batches:
            for row in batch.to_pylist():
                t = _texts(row)
                low, high, repeated, asked = opened(row, t)
                _, place, _ = distinct(t.spans(asked, LENGTH), t.proofs(asked, LENGTH))
                said = bits(row["strings"])
                starts = np.concatenate((asked[said[place] & 1 > 0], ragged(low[repeated], (high - low + 1)[repeated])))
                gone = covered(len(t.body), starts)
                out = [_result(name, row["body"][a:z], gone[a:z]) for name, a, z in zip(row["names"], t.starts.tolist(), t.ends.tolist()) if name]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    last = suspects.where("n_runs > 0").select("shard", "names", "lengths", "body", "runs").join(contexts.hint("shuffle_hash"), "shard").join(strings.hint("shuffle_hash"), "shard", "left")
    results = staging.write(last.mapInArrow(finish, RESULT).unionByName(suspects.select(F.explode("done").alias("d")).select("d.*")), "results")
    staging.drop("suspects", "contexts", "strings")
    return named.select("doc_id", "h1", "h2").join(results, ["h1", "h2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return removals(read_table(spark, sf_dir, "documents"), Staging(spark, "repeats"))
