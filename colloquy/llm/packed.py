"""Questions of packed shards to ranges of a key space, and the answers.

A shard is a row: a number and a slice of the input. It sends its distinct keys once, cut by the range
of the key space that they fall in, so that a key of very many rows arrives once a shard; a range's task
answers each shard with a byte a key. Work and rows follow the keys, not shards times ranges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import Staging, claim, slices

SHARDS = "shard long, rows binary"


def pack(df: DataFrame, column: str, most: int, staging: Staging, name: str = "shards") -> DataFrame:
    """The frame's rows, whole and with all columns, as shards of about `most` bytes of `column`."""
    def run(batches):
        claim(name)
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            row = [pa.array([part << 24 | seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            seq, held, size = seq + 1, [], 0
            return pa.RecordBatch.from_arrays(row, ["shard", "rows"])

        for batch in batches:
            for one in slices(batch, column, most):
                held.append(one)
                size += one.column(column).nbytes
                if size >= most:
                    yield close()
        if held:
            yield close()

    return staging.write(df.mapInArrow(run, SHARDS), name, compression="none")


def unpack(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def cut(sorted_keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of each range of the 64-bit space that sorted keys fall in."""
    if not len(sorted_keys):
        return []
    of = (sorted_keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return list(zip(of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(of)]))


def questions(shard: int, ranges: int, keys: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row a range that the keys (sorted) fall in; columns are arrays beside the keys."""
    parts = cut(keys, ranges)
    arrays = [pa.array([r for r, _, _ in parts], pa.int32()), pa.array([shard] * len(parts), pa.int64())]
    for values in (keys, *columns.values()):
        arrays.append(pa.array([values[a:b].tobytes() for _, a, b in parts], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["range", "shard", "keys", *columns])


def ask(shards: DataFrame, run: Callable, columns: dict[str, type], answer: Callable[..., np.ndarray], staging: Staging, name: str) -> DataFrame:
    """shard and `name`: one shard's answers in the order of its keys, a row a range at most.

    run: of batches of shards to questions; answer: of shard (ascending), keys and columns (a value a key) to a byte a key.
    """
    def of_range(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        sizes = [len(k) // 8 for k in pdf["keys"]]
        given = [np.frombuffer(b"".join(pdf[c]), kind) for c, kind in {"keys": np.uint64, **columns}.items()]
        out = answer(np.repeat(pdf["shard"].to_numpy(), sizes), *given).astype(np.uint8)
        edges = np.cumsum([0, *sizes]).tolist()
        return pd.DataFrame({"shard": pdf["shard"].to_numpy(), "range": pdf["range"].to_numpy(), "bits": [out[a:b].tobytes() for a, b in zip(edges, edges[1:])]})

    schema = "range int, shard long, keys binary" + "".join(f", {c} binary" for c in columns)
    answers = shards.mapInArrow(run, schema).groupBy("range").applyInPandas(of_range, "shard long, range int, bits binary")
    return staging.write(answers.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("range", "bits"))).alias(name)), name)


def bits(answers: list[dict] | None) -> np.ndarray:
    return np.frombuffer(b"".join(a["bits"] for a in answers or []), np.uint8)
