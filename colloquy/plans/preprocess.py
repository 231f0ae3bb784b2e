"""The preprocessing chain: clean, restore punctuation, correct roles. One scan, no shuffle, no Python."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from colloquy.functions.fixed import PATIENT_FORMS, SPOKEN_FORMS
from colloquy.operators import clean, punctuation, roles
from colloquy.sources import csv
from colloquy.sources.tables import require_columns


def preprocess(df: DataFrame, dialogue_column: str, table=SPOKEN_FORMS, patterns=PATIENT_FORMS, enforce: bool = True, provider=punctuation.keep, exceptions=None, mark: str = "?", scope: str = "dialogue", shared: bool = True) -> DataFrame:
    """Adds clean_dialogue, restore_punctuation_dialogue and fixed_role_dialogue."""
    require_columns(df, dialogue_column)
    df = clean.clean_spoken(df, dialogue_column, table, patterns, scope, shared=shared)
    df = punctuation.restore_punctuation(df, "clean_dialogue", enforce, provider)
    return roles.fix_role(df, "restore_punctuation_dialogue", exceptions, mark)


def main() -> None:
    """Reads a CSV of dialogues and writes it with the added columns."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--column", default="dialogue")
    p.add_argument("--restore", choices=("plain", "keep"), default="keep")
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    df = csv.read_dataframe(spark, a.source, a.column)
    csv.save(preprocess(df, a.column, provider=getattr(punctuation, a.restore)), a.target)


if __name__ == "__main__":
    main()
