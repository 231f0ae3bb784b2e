"""CSV of dialogues: quoted cells keep line ends and outer spaces both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colloquy.operators import parse
from colloquy.sources.tables import require_columns

_BOTH = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_dataframe(spark: SparkSession, path: str, dialogue_column: str, index_column: str | None = None, schema: T.StructType | None = None, **options) -> DataFrame:
    """Reads a CSV and checks its columns. Cells stay strings unless a schema is given; empty cells are null."""
    reader = spark.read.options(multiLine=True, **_BOTH, **options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return require_columns(df, dialogue_column, *([index_column] if index_column else []))


def read_dataset(spark: SparkSession, path: str, dialogue_column: str, task: str = "C", exceptions=None, **options) -> DataFrame:
    """As read_dataframe, with the parsed utterances in `utterances`."""
    df = read_dataframe(spark, path, dialogue_column, **options)
    return df.withColumn("utterances", parse.utterances(F.col(dialogue_column), task, exceptions))


def save(df: DataFrame, path: str, mode: str = "overwrite", **options) -> bool:
    df.write.mode(mode).options(**_BOTH, emptyValue="", **options).csv(path)
    return True


def section_names(df: DataFrame, skip: tuple[str, ...] = ("id", "text")) -> list[str]:
    """Section names among a frame's columns: lowered, without `skip` and names all in capitals."""
    return [c.lower() for c in df.columns if c not in skip and not c.isupper()]
