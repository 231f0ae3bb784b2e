"""Assignment of nodes to note sections by similarity, and extractive summaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.fixed import SECTION_THRESHOLD, SUMMARY_MAX, SUMMARY_MIN
from colloquy.operators.vectors import cosine_similarity

#: Columns of a note form that are broadcast at most.
MOST_SECTIONS = 10_000


def similarities(nodes: DataFrame, sections: DataFrame, node: str, vector: str) -> DataFrame:
    """node, section_pos and similarity. Sections (section_pos, section_vector) are the columns of a note
    form: a few dozen rows, embedded once and broadcast to the nodes; over MOST_SECTIONS raises."""
    few = sections.select("section_pos", "section_vector").limit(MOST_SECTIONS + 1)
    size = F.broadcast(few.agg(F.count("*").alias("n__")))
    checked = F.when(F.col("n__") <= MOST_SECTIONS, F.col("section_vector")).otherwise(F.raise_error(F.lit("too many sections for a form")))
    few = few.join(size).select("section_pos", checked.alias("section_vector"))
    pairs = nodes.select(node, F.col(vector).alias("v__")).join(F.broadcast(few))
    return pairs.select(node, "section_pos", cosine_similarity(F.col("v__"), F.col("section_vector")).alias("similarity"))


def assign(nodes: DataFrame, sections: DataFrame, node: str, vector: str, threshold: float = SECTION_THRESHOLD, compat: str | None = None) -> DataFrame:
    """(section_pos, node) rows: the nodes at least as similar as the threshold. With compat `ordinal`
    a node with m matches goes to the first m sections instead. `gathered` makes arrays of them."""
    hits = similarities(nodes, sections, node, vector).where(F.col("similarity") >= threshold)
    if compat == "ordinal":
        hits = hits.groupBy(node).agg(F.count("*").alias("m")).select(node, F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("section_pos"))
    elif compat is not None:
        raise ValueError("compat is ordinal or None")
    return hits.select("section_pos", node)


def gathered(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
    """One row a group, with its nodes in order as an array; for groups known to be small."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def extractive(embed_lines: Callable[[list[str]], np.ndarray], least: int, most: int) -> Callable[[str | None], str | None]:
    """Sentences nearest to the text's centre, in the text's order, from `least` to `most` words."""
    import re

    def summary(text: str | None) -> str | None:
        if text is None:
            return None
        parts = [s for s in re.split(r"(?<=[.?!])\s+|\n", text) if s.strip()]
        if not parts:
            return ""
        v = embed_lines(parts)
        order, kept, words = np.argsort(-(v @ v.mean(0)), kind="stable"), [], 0
        for i in order.tolist():
            n = len(parts[i].split())
            if words + n <= most or not kept:
                kept.append(i)
                words += n
            if words >= least and words + 5 > most:
                break
        return " ".join(" ".join(parts[i] for i in sorted(kept)).split()[:most])

    return summary


def _bags(lines: list[str], dimension: int = 64) -> np.ndarray:
    import zlib

    out = np.zeros((len(lines), dimension))
    for row, line in zip(out, lines):
        for w in line.lower().split():
            row[zlib.crc32(w.encode()) % dimension] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def summarise(text: Column, model=None, tokenizer=None, min_length: int = SUMMARY_MIN, max_length: int = SUMMARY_MAX) -> Column:
    """A summary by `model` (a function from text to text), or the extractive default. A model that isn't
    a plain function of texts (it has a `generate`) needs its tokenizer."""
    if model is not None and hasattr(model, "generate") and tokenizer is None:
        raise ValueError("a model object needs its tokenizer")
    one = model if model is not None else extractive(_bags, min_length, max_length)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)
