"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two groupings and two joins by node; nothing is gathered. Nodes with a thousandth of all
edges or more, HUBS at most, are joined by broadcast, so no task gets a hub's rows. Every round's
edges are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import Staging

#: One in so many rows of a key makes it hot; rows that no key is hot under.
HUBS, LEAST = 1000, 64


def with_group(df: DataFrame, key: str, total: int | None = None, **figures: Column) -> DataFrame:
    """All rows of a stored table (of `total` rows at most) with their key's aggregates. Rows of hot keys meet
    theirs by a broadcast of HUBS rows at most, all others by a join on the key; one aggregation serves both."""
    total = df.count() if total is None else total
    hot_from = max(LEAST, -(-total // HUBS))
    sums = df.groupBy(F.col(key).alias("key__")).agg(F.count("*").alias("rows__"), *(c.alias(n) for n, c in figures.items()))
    hot, rest = F.broadcast(sums.where(F.col("rows__") >= hot_from)), sums.where(F.col("rows__") < hot_from)
    same = F.col(key) == F.col("key__")
    out = df.join(hot, same).unionByName(df.join(hot.select("key__"), same, "left_anti").join(rest, same))
    return out.drop("key__", "rows__")


def components(edges: DataFrame, staging: Staging, name: str) -> DataFrame:
    """(node, component) of every node with an edge in (a, b); a component is named by its least node."""
    tidy = lambda e: e.where("a <> b").distinct()
    edges, before, turn = staging.write(tidy(edges), f"{name}-0"), None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first()
        if state == before:
            break
        before, turn = state, turn + 1
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        large = with_group(both, "u", 2 * state[0], m=F.min("v"))
        large = large.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        stars = staging.write(tidy(large), f"{name}-stars-{turn}")
        down = stars.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = with_group(down, "u", 2 * state[0], m=F.min("v"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staging.write(tidy(small), f"{name}-{turn}")
        staging.drop(f"{name}-stars-{turn}", f"{name}-{turn - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
