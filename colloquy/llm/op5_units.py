r"""Line or paragraph dedup: of equal units the earliest stays, with offsets into the original.

A unit is a line, or a paragraph, or (the default) a line cut further after sentence and clause marks, so
that a passage is found inside a line too. Units are normalised (lower case, white space runs as one
space, trimmed). A unit's digest is that of the unit and of as many after it as bring CONTEXT words
together, so that short units that coincide by chance are not taken for copies. Digests (128 bits) are
grouped globally; the occurrence of the least (doc_id, place) stays, and all others are late. The units of late
digests form runs of neighbours; a run of RUN words or more goes. A passage of 50 words keeps
half of them in whole units wherever it is cut off, while a common line, a licence or a signature alone stays.
A word counts one, or one for twelve bytes of the unit if that is more (scripts without spaces, addresses).
context = run = 1 removes every repeated unit by itself (op5_every_line, on lines).

Every unit that goes has an earlier copy that stays: a late digest has an earlier occurrence, whose units
stay or are themselves late to one still earlier.

Shards of rows send each distinct digest once, with its least doc_id, to a range of digests (packed.py), and get back
whether it is late. No group is gathered beyond one entry a shard.

Null text: null kept text, no units. Null doc_id: ranks after all others. Rows of one doc_id, repeated
rows too, rank in the order read, so of repeated rows one stays. Blank units are none and go only between
units that go. Empty table: empty result. Long texts are whole. Other columns pass through, whatever their
names but kept, n_units, n_removed and spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colloquy.llm import packed
from colloquy.llm.common import Staging, read_table, tune

CONTEXT, RUN = 8, 25
SHARD, RANGE_BYTES, RANGES = 4 << 20, 16 << 20, 32
#: Ends of units.
ENDS = {"sentence": re.compile(r"[.!?;:,][ \t]+|[。！？；，]|\n"), "line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}
NULL_LAST = np.uint64(2**64 - 1)


class Units:
    """The units of a shard's texts, blank ones left out, as arrays over all texts."""

    def __init__(self, texts: list[str | None], unit: str):
        ends, starts, stops, sizes, norms, counts = ENDS[unit], [], [], [], [], []
        for text in texts:
            before, a = len(norms), 0
            if text:
                for b in [*(m.end() for m in ends.finditer(text)), len(text)]:
                    if words := text[a:b].split():
                        norm = " ".join(words).lower().encode()
                        starts.append(a)
                        stops.append(b)
                        sizes.append(max(len(words), len(norm) // 12))
                        norms.append(norm)
                    a = b
            counts.append(len(norms) - before)
        self.starts, self.stops = np.array(starts, np.int64), np.array(stops, np.int64)
        self.sizes, self.counts = np.array(sizes, np.int64), np.array(counts, np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.body = b"\n".join(norms)
        lengths = np.fromiter(map(len, norms), np.int64, len(norms)) + 1
        self.at = np.cumsum(lengths) - lengths
        self.to = self.at + lengths - 1

    def windows(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """The end (exclusive) and the digest, as two columns, of the window that each unit opens."""
        # texts lie `context` words apart, so no window reaches into the next one
        before = np.cumsum(self.sizes) - self.sizes + self.text * context
        last = np.searchsorted(before, before + context)
        body, digest = memoryview(self.body), xxhash.xxh3_128_digest
        found = b"".join([digest(body[a:b]) for a, b in zip(self.at.tolist(), self.to[last - 1].tolist())])
        return last, np.frombuffer(found, np.uint64).reshape(-1, 2)

    def gone(self, late: np.ndarray, last: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last unit of each run of late windows' units with `run` words or more, and its text."""
        n = len(self.sizes)
        i = np.flatnonzero(late)
        covered = np.cumsum(np.bincount(i, minlength=n + 1) - np.bincount(last[i], minlength=n + 1))[:n] > 0
        edge = np.concatenate(([True], self.text[1:] != self.text[:-1])) if n else np.empty(0, bool)
        first = np.flatnonzero(covered & (edge | ~np.concatenate(([False], covered[:-1]))))
        final = np.flatnonzero(covered & (np.concatenate((edge[1:], [True])) | ~np.concatenate((covered[1:], [False]))))
        words = np.concatenate(([0], np.cumsum(self.sizes)))
        long = words[final + 1] - words[first] >= run
        return first[long], final[long], self.text[first[long]]


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    """64-bit numbers in the order of the ids, null last."""
    signed = ids.cast(pa.int64()).to_pandas()
    low = signed.fillna(0).to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.where(signed.isna().to_numpy(), NULL_LAST, low)


def _distinct(digests: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each distinct digest's earliest occurrence, in order of digests, and each occurrence's place among them."""
    order = np.lexsort((np.arange(len(rank)), rank, digests[:, 1], digests[:, 0]))
    new = np.concatenate(([True], (digests[order][1:] != digests[order][:-1]).any(axis=1))) if len(order) else np.empty(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _late(shard: np.ndarray, high: np.ndarray, low: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """1 for a digest that another shard has with a lower rank; of equal ranks the lowest shard's is the first."""
    order = np.lexsort((shard, rank, low, high))
    high, low = high[order], low[order]
    out = np.zeros(len(order), bool)
    out[order[1:]] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    return out


def dedup(df: DataFrame, staging: Staging, unit: str = "sentence", context: int = CONTEXT, run: int = RUN) -> DataFrame:
    """All columns with the kept text, n_units, n_removed and the removed runs' character spans [start, end)."""
    if clash := {"kept", "n_units", "n_removed", "spans"} & {*df.columns}:
        raise ValueError(f"columns exist: {sorted(clash)}")
    tune(df.sparkSession)
    shards = packed.pack(df, "text", SHARD, staging)
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = RANGES + size // RANGE_BYTES

    def read(row: dict) -> tuple[pa.Table, Units, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = packed.unpack(row["rows"])
        units = Units(rows.column("text").to_pylist(), unit)
        last, digests = units.windows(context)
        rank = _ranks(rows.column("doc_id"))[units.text]
        return rows, units, last, digests, rank, *_distinct(digests, rank)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, digests, rank, firsts, _ = read(row)
                yield packed.questions(row["shard"], ranges, digests[firsts, 0], low=digests[firsts, 1], rank=rank[firsts])

    late = packed.ask(shards, send, {"low": np.uint64, "rank": np.uint64}, _late, staging, "late")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, units, last, _, _, firsts, place = read(row)
                is_late = np.ones(len(place), bool)
                is_late[firsts] = packed.bits(row["late"]) > 0
                first, final, text = units.gone(is_late, last, run)
                kept, spans = rows.column("text").to_pylist(), [[] for _ in range(rows.num_rows)]
                for k, a, b in zip(text.tolist(), units.starts[first].tolist(), units.stops[final].tolist()):
                    spans[k].append({"start": a, "end": b})
                for k in set(text.tolist()):
                    edges = [0, *(x for s in spans[k] for x in (s["start"], s["end"])), len(kept[k])]
                    kept[k] = "".join([kept[k][a:b] for a, b in zip(edges[::2], edges[1::2])])
                removed = np.bincount(text, weights=final - first + 1, minlength=rows.num_rows).astype(np.int64)
                for name, values in (("kept", pa.array(kept, pa.string())), ("n_units", pa.array(units.counts)), ("n_removed", pa.array(removed)), ("spans", pa.array(spans, spans_type))):
                    rows = rows.append_column(name, values)
                yield from rows.combine_chunks().to_batches()

    more = T.StructType.fromDDL("kept string, n_units long, n_removed long, spans array<struct<start:int,end:int>>")
    joined = shards.join(late.hint("shuffle_hash"), "shard", "left").select("rows", "late")
    return joined.mapInArrow(finish, T.StructType([*df.schema.fields, *more.fields]))


def _told(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    out = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), Staging(spark, "units"), **how)
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.start, s.end)), ",")
    return out.select("doc_id", "n_units", "n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start).alias("chars_removed"), said.alias("removed_spans"), F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir)


def op5_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line that isn't blank, however short."""
    return _told(spark, sf_dir, unit="line", context=1, run=1)


#: The same rows by windows over the normalised units themselves. CUT, CONTEXT and RUN stand for the parameters.
_SQL = r"""
WITH c AS (SELECT doc_id, regexp_extract_all(text, 'CUT') AS pieces FROM documents),
p AS (SELECT doc_id, i AS pos, pieces[i] AS piece, trim(regexp_replace(lower(pieces[i]), '\s+', ' ', 'g')) AS unit
      FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM c)),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) - length(piece) AS start,
                  greatest(length(unit) - length(replace(unit, ' ', '')) + 1, strlen(unit) // 12) AS size FROM p),
n AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY pos) - size AS before, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM placed WHERE unit <> ''),
w AS (SELECT *, string_agg(unit, chr(10)) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND CONTEXT - 1 FOLLOWING) AS win FROM n),
l AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS late FROM w),
v AS (SELECT *, coalesce(max(CASE WHEN late THEN before END) OVER (PARTITION BY doc_id ORDER BY pos) > before - CONTEXT, false) AS covered FROM l),
r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM v WHERE covered),
g AS (SELECT doc_id, min(pos) AS first, max(pos) AS last, min(start) AS a, arg_max(start + length(piece), pos) AS b, count(*) AS units
      FROM r GROUP BY doc_id, run HAVING sum(size) >= RUN),
put AS (SELECT doc_id, sum(units)::BIGINT AS n_removed, sum(b - a)::BIGINT AS chars_removed, string_agg(a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a) AS removed_spans FROM g GROUP BY doc_id),
kept AS (SELECT p.doc_id, string_agg(piece, '' ORDER BY pos) FILTER (WHERE g.doc_id IS NULL) AS kept, count(*) FILTER (WHERE unit <> '') AS n_units
         FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND pos BETWEEN g.first AND g.last GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(chars_removed, 0)::BIGINT AS chars_removed,
       coalesce(removed_spans, '') AS removed_spans, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN put ON d.doc_id = put.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
OP5_SQL = _SQL.replace("CUT", r"[^\n]*?(?:[.!?;:,][ \t]+|[。！？；，]|\n)|[^\n]+").replace("CONTEXT", str(CONTEXT)).replace("RUN", str(RUN))
OP5_EVERY_SQL = _SQL.replace("CUT", r"[^\n]*\n|[^\n]+").replace("CONTEXT", "1").replace("RUN", "1")
