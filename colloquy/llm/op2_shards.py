"""Token-id shards: raw id payloads with a minimal perfect hash from document key to offset.

Format. A folder of Parquet containers; each row is one shard:
    part, seq       place in the global order (range partition, then number within it)
    first, last     least and greatest key: what leads from a key to its shard, by the files' statistics
    before          ids of the partition before this shard
    n_docs, n_ids
    width           bytes of an id: 2 if the vocabulary allows it, else 4
    payload         ids of the shard's documents one after another, little-endian unsigned
    keys            document keys in ascending order
    others          numbers of ids of the documents that the index doesn't hold, in order
    index           mph.Index: key -> (fingerprint, ordinal, offset, length)
Parquet is only the envelope, because executors reach a shared store through Spark's own
readers and writers; payload and index are the raw bytes.

Writing: one range shuffle by key, encoding in the sorted partitions. Reading: no shuffle; the
driver sees one number a partition. `lookup` opens a shard's index and cuts the ids out of the payload.

Encoding calls the tokenizers library for the distinct pieces of the chunks between spaces (see bpe.py),
which gives the ids of whole texts; texts with uneven white space go to the library whole.
So do texts that hold the string of a special token.

Null text: only the end id. Null keys: first, stored and returned, not indexed. Repeated keys: a
row each, in the order of their texts' hashes, dealt out by it over shards; each shard's index holds its
first, and `find` gives the first of all. Empty table: no shards, empty result. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.bpe import ChunkCache, PieceCache
from colloquy.llm.common import Staging, cache, claim, ragged, read_table, slices, tune
from colloquy.llm.mph import Index

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Text bytes of a range partition; ids of a shard.
PARTITION_BYTES, SHARD_IDS = 24 << 20, 1 << 20
SHARD_SCHEMA = "part int, seq int, first long, last long, before long, n_docs long, n_ids long, width int, payload binary, keys array<long>, others array<long>, index binary"


class LibraryEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        #: Strings that the library takes for one token wherever they stand.
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of whole texts, by the library alone."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers. Pieces that begin with a space are encoded in one string: each
        is split off again as it is, and its first token is the only one with a space."""
        spaced = np.fromiter((len(p) > 1 and p[0] == " " and not p[1].isspace() for p in pieces), bool, len(pieces))
        counts, parts = np.zeros(len(pieces), np.int64), []
        where = np.flatnonzero(spaced)
        for a in range(0, len(where), 20_000):
            part = where[a : a + 20_000]
            ids = np.array(self.library.encode_batch_fast(["".join([pieces[i] for i in part.tolist()])], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):
                spaced[part] = False
                continue
            counts[part] = np.diff(np.append(at, len(ids)))
            parts.append((part, ids))
        rest = np.flatnonzero(~spaced)
        for i, e in zip(rest.tolist(), self.library.encode_batch_fast([pieces[i] for i in rest.tolist()], add_special_tokens=False)):
            counts[i] = len(e.ids)
            parts.append((np.array([i]), np.array(e.ids, np.int32)))
        out, starts = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for part, ids in parts:
            out[ragged(starts[part], counts[part])] = ids
        return out, counts


@lru_cache(maxsize=2)
def _cache(path: str) -> tuple[ChunkCache, int]:
    encoder = LibraryEncoder(path)
    return ChunkCache(PieceCache(regex.compile(public_tokenizers.PATTERN), encoder.encode), special=encoder.special, encode_whole=encoder.whole), encoder.width


cache("shards", _cache.cache_clear)


def _shard(part: int, seq: int, before: int, keys: list, ids: np.ndarray, counts: np.ndarray, width: int) -> dict:
    starts = np.cumsum(counts) - counts
    known = [i for i, k in enumerate(keys) if k is not None and (i == 0 or keys[i - 1] != k)]
    index = Index.build(np.array([keys[i] for i in known], np.int64).astype(np.uint64), np.array(known, np.int64), starts[known], counts[known])
    return {"part": part, "seq": seq, "first": keys[known[0]] if known else None, "last": keys[-1], "before": before, "n_docs": len(keys), "n_ids": len(ids), "width": width, "payload": ids.astype(f"<u{width}").tobytes(), "keys": keys, "others": np.delete(counts, known).tolist(), "index": index.dumps()}


def write_shards(df: DataFrame, staging: Staging, name: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the shards of a table below the staging folder and returns them as read back."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the last deals out even repeated rows of one key
    rows = rows.withColumns({"hash": F.xxhash64("text"), "deal": F.pmod(F.monotonically_increasing_id(), F.lit(64))})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        claim("shards")
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys, held, counts, width = [], [], [], _cache(path)[1]
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()), ("keys", pa.list_(pa.int64())), ("others", pa.list_(pa.int64())), ("index", pa.binary())])

        def close():
            nonlocal seq, before, keys, held, counts
            ids = np.concatenate(held)
            row = _shard(part, seq, before, keys, ids, np.concatenate(counts), width)
            seq, before, keys, held, counts = seq + 1, before + len(ids), [], [], []
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                ids, own = _cache(path)[0].encode_array(piece.column("text"))
                ended = np.full(len(ids) + len(own), end_id, np.int32)
                keep = np.ones(len(ended), bool)
                keep[np.cumsum(own + 1) - 1] = False
                ended[keep] = ids
                keys += piece.column("key").to_pylist()
                held.append(ended)
                counts.append(own + 1)
                if sum(map(len, held)) >= SHARD_IDS:
                    yield close()
        if keys:
            yield close()

    ordered = rows.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), "key", "hash", "deal").sortWithinPartitions("key", "hash", "deal").select("key", "text")
    return staging.write(ordered.mapInArrow(run, SHARD_SCHEMA), name, compression="zstd")


def lookup(shard: dict, keys: np.ndarray) -> list[np.ndarray | None]:
    """The ids of each key in a shard's row, or None."""
    known, _, offset, length = Index.loads(shard["index"]).get(np.asarray(keys, np.int64))
    payload = np.frombuffer(shard["payload"], f"<u{shard['width']}")
    return [payload[o : o + n] if k else None for k, o, n in zip(known, offset, length)]


def find(shards: DataFrame, keys: list[int]) -> DataFrame:
    """key and ids of each of a few given keys that a table of shards holds: only shards that span one are read."""
    wanted = sorted(set(keys))
    spanned = F.lit(False)
    for k in wanted:
        spanned = spanned | ((F.col("first") <= k) & (F.col("last") >= k))

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                found = [(k, shard["part"], shard["seq"], ids.tolist()) for k, ids in zip(wanted, lookup(shard, wanted)) if ids is not None and k in set(shard["keys"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())))], ["key", "part", "seq", "ids"])

    found = shards.where(spanned).select("part", "seq", "width", "payload", "keys", "index").mapInArrow(run, "key long, part int, seq int, ids array<int>")
    return found.groupBy("key").agg(F.min_by("ids", F.struct("part", "seq")).alias("ids"))


def read_digests(shards: DataFrame) -> DataFrame:
    """Per document, from the files: its place among all ids, its number of ids and their crc32."""
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                index, payload = Index.loads(shard["index"]), np.frombuffer(shard["payload"], f"<u{shard['width']}").astype("<u4")
                keys = shard["keys"]
                known = np.array([k is not None and (i == 0 or keys[i - 1] != k) for i, k in enumerate(keys)], bool)
                found, ordinal, offset, length = index.get(np.array([k or 0 for k in keys], np.int64))
                if not (found & (ordinal == np.arange(len(keys))))[known].all():
                    raise ValueError("a stored key is not in its index")
                others, end, out, first = iter(shard["others"]), 0, [], base[shard["part"]] + shard["before"]
                for key, held, o, n in zip(keys, known.tolist(), offset.tolist(), length.tolist()):
                    o, n = (o, n) if held else (end, next(others))
                    end = o + n
                    out.append((key, first + o, n, zlib.crc32(payload[o:end].tobytes())))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "width", "payload", "keys", "others", "index").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return read_digests(write_shards(read_table(spark, sf_dir, "documents"), Staging(spark, "shards"), "ids"))
