"""Nodes of dialogues, and trees as adjacency rows (tree_id, node_id, layer, children, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.text import split_literal
from colloquy.operators.clean import drop_returns, flatten_lines
from colloquy.operators.parse import apply_exceptions
from colloquy.sources.tables import require_columns


def nodes(df: DataFrame, dialogue_column: str, exceptions=None, embed=None) -> DataFrame:
    """A row a line of the dialogue, blank ones too: node_index, text and, with a provider, embedding."""
    require_columns(df, dialogue_column)
    others = [c for c in df.columns if c != dialogue_column]
    text = apply_exceptions(drop_returns(F.col(dialogue_column)), exceptions)
    out = df.select(*others, F.posexplode(split_literal(text, "\n")).alias("node_index", "text"))
    return out.withColumn("embedding", embed(F.col("text"))[0]) if embed else out


def node_layers(layers: DataFrame) -> DataFrame:
    """(layer, nodes array) rows to node and layer; of several layers the last wins."""
    return layers.select("layer", F.explode("nodes").alias("node")).groupBy("node").agg(F.max("layer").alias("layer"))


def node_list(df: DataFrame, key: str = "node_id") -> DataFrame:
    return df.orderBy(key)


def children(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node_id and its distinct children, of all nodes or of those in `of`."""
    rows = df.join(of.select("node_id"), "node_id", "left_semi") if of is not None else df
    return rows.select("node_id", F.array_distinct("children").alias("children"))


def joined_text(order: Column, text: Column) -> Column:
    """Aggregate: texts in order, each on one line and followed by a blank one."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), flatten_lines(text).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(r.t, F.lit("\n\n"))), "")
