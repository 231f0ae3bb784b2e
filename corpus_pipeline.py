"""The corpus pipeline: documents through five stages to token ids.

Each stage takes (spark, docs, sf_dir) and returns a lazy DataFrame that reads tables in the shared
folder. They stay as long as the returned frame is held, and go when a later stage is called or the driver ends.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import op5_units, op7_jaccard, op8_quality, op9_phrases, op10_bpe
from colloquy.llm.common import Staging, read_table, tune

#: Where the numbers of documents without an id begin, over the usual ids.
NAMELESS = 1 << 62
#: The frames that stages have returned, and the folders that they read.
_read: list[tuple[weakref.ref, Staging]] = []
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(call: Callable[[SparkSession, DataFrame, str, Staging], DataFrame]) -> Stage:
    """The stage with a folder of its own; folders whose frames nobody holds any more go first."""
    @functools.wraps(call)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for held, folder in _read[:]:
            if held() is None:
                folder.drop()
                _read.remove((held, folder))
        tune(spark)
        staging = Staging(spark, f"stage-{call.__name__}")
        out = call(spark, docs, sf_dir, staging)
        _read.append((weakref.ref(out), staging))
        return out

    return run


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject; those without a word go."""
    model = op8_quality.fit(docs, staging)
    return op8_quality.classify(docs, model).where("keep").select(*docs.columns)


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging) -> DataFrame:
    """One document, of the least id, of each class of documents whose sets of five-word shingles
    link at a Jaccard similarity of 0.8 or more. Documents without an id go by a hash of the text, from
    NAMELESS on, in place of one; those of them without words stay, as nothing links them."""
    given = F.lit(NAMELESS) + F.xxhash64("text").bitwiseAND(F.lit(NAMELESS - 1))
    named = docs.withColumn("id__", F.coalesce("doc_id", given))
    found = op7_jaccard.classes(named.select(F.col("id__").alias("doc_id"), "text"), staging, 5, 4, 5)
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id__")).agg(F.max("n_shingles").alias("n__"))
    kept = named.join(first, "id__")
    alone = F.col("doc_id").isNull() & (F.col("n__") == 0)
    return kept.where(~alone).dropDuplicates(["id__", "text"]).unionByName(kept.where(alone)).select(*docs.columns)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging) -> DataFrame:
    """Each repeated passage stays in its earliest place only (op5_units); a document of which nothing is left goes."""
    out = op5_units.dedup(docs, staging)
    out = out.where("n_removed = 0 OR trim(kept) <> ''").withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging) -> DataFrame:
    """Documents that neither hold a benchmark window of 13 words nor are hit in a twentieth of their words."""
    found = op9_phrases.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), staging)
    hit = staging.write(found.where(f"contaminated OR n_hit >= {op9_phrases.WINDOW}").select("marks").distinct(), "hit")
    staging.drop("postings", "cut", "starts")
    few = F.broadcast(hit) if hit.count() <= op9_phrases.SMALL else hit
    marks = F.array(*op9_phrases.marks_of(F.col("doc_id"), F.col("text")))
    return docs.withColumn("marks__", marks).join(few.withColumnRenamed("marks", "marks__"), "marks__", "left_anti").select(*docs.columns)


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging) -> DataFrame:
    """doc_id, n_tokens, digests and the ids of each text."""
    return op10_bpe.digests(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: The classifier's fit can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    staging = Staging(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = staging.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            staging.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
