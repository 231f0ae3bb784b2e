"""Vector operators on array columns. Floats are cast to double before any arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.text import let

DIMENSION = 64


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if a norm is zero."""
    a, b = doubles(a), doubles(b)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _differences(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": lambda a, b: 1 - cosine_similarity(a, b),
    "L1": lambda a, b: _sum(_differences(a, b)),
    "L2": lambda a, b: F.sqrt(_sum(F.transform(_differences(a, b), lambda x: x * x))),
    "Linf": lambda a, b: F.array_max(_differences(a, b)),
}


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise ValueError(f"unsupported metric {metric}; one of {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def normalise(vector: Column) -> Column:
    return let(doubles(vector), lambda v: let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.try_divide(x, norm))))


def distances(df: DataFrame, query: DataFrame, vector: str, query_vector: str, metric: str = "cosine") -> DataFrame:
    """All rows with `distance` to one query row (a frame of one row, columns distinct from df's)."""
    return df.crossJoin(F.broadcast(query.limit(1))).withColumn("distance", distance(F.col(vector), F.col(query_vector), metric))


def nearest(df: DataFrame, key: str, partition: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Adds `rank` by ascending (or descending) distance, ties by key.

    Over all rows the ranks come from a range partitioning and the ranges' sizes, not from one sorted task.
    """
    by = F.desc("distance") if descending else F.asc("distance")
    if partition:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(by, key)))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, by, key).sortWithinPartitions(by, key).withColumn("id__", F.monotonically_increasing_id())
    # an id is the number of its range and, in the low 33 bits, the place in it
    sizes = placed.groupBy(F.shiftright("id__", 33).alias("range__")).agg(F.count("*").alias("n__"))  # a row a range
    before = F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    sizes = F.broadcast(sizes.select("range__", F.coalesce(before, F.lit(0)).alias("before__")))
    ranked = placed.join(sizes, F.shiftright("id__", 33) == F.col("range__"))
    rank = F.col("before__") + F.col("id__").bitwiseAND((1 << 33) - 1) + 1
    return ranked.withColumn("rank", rank).drop("id__", "range__", "before__")


def top(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k nearest without a global sort."""
    return df.orderBy("distance", key).limit(k)


def mean_pool(df: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """Mean of the masked rows' vectors by key; the count is at least 1e-9."""
    flat = df.select(key, mask.cast("double").alias("m"), F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    means = flat.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("pooled"))


def centres(df: DataFrame, key: str, vector: str) -> DataFrame:
    """By key: `centre_mean`, the mean of all numbers, and `centre`, the mean vector."""
    flat = df.select(key, F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("i", "s", "n"))), lambda p: p.s / p.n)
    return flat.groupBy(key).agg((F.sum("s") / F.sum("n")).alias("centre_mean"), row.alias("centre"))


def pick(embeddings: Column, model: str) -> Column:
    return F.try_element_at(embeddings, F.lit(model))


def hashed_embedder(dimension: int = DIMENSION) -> Callable[[Column], Column]:
    """The default provider: hashed bags of tokens, one L2-normalised vector a line of the text."""
    import re

    import zlib

    token = re.compile(r"\w+|[^\w\s]")

    @F.pandas_udf("array<array<double>>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def vectors(text: str | None):
            if text is None:
                return None
            out = np.zeros((text.count("\n") + 1, dimension))
            for row, line in zip(out, text.split("\n")):
                for t in token.findall(line.lower()):
                    h = zlib.crc32(t.encode())
                    row[h % dimension] += 1 if h >> 16 & 1 else -1
            norm = np.sqrt((out**2).sum(1, keepdims=True))
            return (out / np.where(norm > 0, norm, 1)).tolist()

        for batch in texts:
            yield batch.map(vectors)

    return embed
