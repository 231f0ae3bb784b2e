"""Byte-level BPE encoding and decoding over a text column.

`encode(df)` adds the ids of each text; `decode(df)` turns ids back into bytes. Both are narrow:
no shuffle, one Arrow pass, memory bounded by a slice of texts and a cache of chunks per worker.

Null text: as an empty one (no ids, empty bytes). Empty table: empty result. Repeated rows and
equal ids: a row each. Long texts are whole; single pieces of any length are merged exactly.
Further columns are dropped by the digest and kept by `encode`; a clash with `ids_column` raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, types as T

from colloquy.llm import bpe
from colloquy.llm.common import claim, read_table, slices, tune

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def encode(df: DataFrame, text_column: str = "text", ids_column: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns and the ids as array<int>."""
    if ids_column in df.columns:
        raise ValueError(f"column {ids_column} exists")
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_column):
                ids, counts = bpe.cached(path, pattern).encode_array(part.column(text_column))
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids))], [*part.schema.names, ids_column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids_column, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids_column: str = "ids", out_column: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns and the decoded bytes."""
    if out_column in df.columns:
        raise ValueError(f"column {out_column} exists")
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for batch in batches:
            coder = bpe.load_ranks(path, pattern)
            out = [coder.decode(ids or []) for ids in batch.column(ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_column, T.BinaryType())]))


def digests(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Per document: its number of ids, and the digests of the ids and of the decoded bytes; the ids too if asked for."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        claim("bpe")
        cache, coder = bpe.cached(path, pattern), bpe.load_ranks(path, pattern)
        decimal = [str(i) for i in range(len(coder.bytes_of))]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                flat, counts = cache.encode_array(part.column("text"))
                ids, edges = flat.tolist(), np.concatenate(([0], np.cumsum(counts))).tolist()
                said, back = [], []
                for a, b in zip(edges, edges[1:]):
                    own = ids[a:b]
                    said.append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(coder.decode(own)).hexdigest())
                out, names = [part.column("doc_id"), pa.array(counts), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.array(edges, np.int32)), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return digests(read_table(spark, sf_dir, "documents"))
