"""Shared plumbing: tables, the shared staging folder, batches of bounded size, ragged gathers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from colloquy.sources.shared import shared_dir
from colloquy.sources.tables import spread, table

#: Bytes of text that a Python worker holds as Python objects at once.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out over the cores if it lies in fewer partitions."""
    return spread(table(spark, sf_dir, name))


def tune(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes as well as rows, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


class Staging:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive executors.

    An operator drops a table as soon as nothing reads it; what a lazy result still reads goes when
    the driver's JVM ends, if `drop` doesn't come before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").options(**options).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names the whole folder."""
        for where in [f"{self.path}/{n}" for n in names] or [self.path]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_caches: dict[str, Callable[[], None]] = {}


def cache(owner: str, clear: Callable[[], None]) -> None:
    """Registers how to empty an operator's per-worker cache."""
    _caches[owner] = clear


def claim(owner: str) -> None:
    """Empties the caches of all other operators: workers are reused, and their memory is bounded."""
    for name, clear in _caches.items():
        if name != owner:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library gives freed memory back on demand
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts sum to about `most` bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... starts[i]+lengths[i]-1 for all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class PrimeHash:
    """Polynomial hashes modulo two primes of any span of bytes: 62 bits beside RollingHash's, with which they
    share no structure (texts that agree modulo 2^64 for any base are easily made)."""

    PRIMES, BASES = (2**31 - 1, 2**31 - 19), (1_103_515_245, 1_664_525_017)
    _powers: dict[int, np.ndarray] = {}

    @classmethod
    def _upto(cls, base: int, prime: int, n: int) -> np.ndarray:
        known = cls._powers.get(base * prime, np.ones(1, np.uint64))
        while len(known) <= n:
            known = np.concatenate((known, known * np.uint64(pow(base, len(known), prime)) % np.uint64(prime)))
        cls._powers[base * prime] = known
        return known

    def __init__(self, body: np.ndarray):
        self.parts, value = [], body.astype(np.uint64) + np.uint64(1)
        for base, prime in zip(self.BASES, self.PRIMES):
            sums = np.zeros(len(body) + 1, np.uint64)
            np.cumsum(value * self._upto(base, prime, len(body))[: len(body)] % np.uint64(prime), out=sums[1:])
            self.parts.append((sums, self._upto(pow(base, -1, prime), prime, len(body)), np.uint64(prime)))

    def spans(self, at: np.ndarray, length) -> np.ndarray:
        high, low = ((sums[at + length] - sums[at]) % prime * down[at] % prime for sums, down, prime in self.parts)
        return high << np.uint64(32) | low


class RollingHash:
    """Polynomial hashes modulo 2^64 of any span of bytes, from one running sum."""

    def __init__(self, body: np.ndarray):
        n = len(body)
        if len(_powers[0]) <= n:
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(n + n // 4 + 1, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
        up, self.down = _powers
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[body] * up[:n], out=self.sums[1:])

    def spans(self, at: np.ndarray, length) -> np.ndarray:
        return mix64((self.sums[at + length] - self.sums[at]) * self.down[at] + np.asarray(length).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
