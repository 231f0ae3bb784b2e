"""Dialogue texts to utterances: array<struct<pos, role, text>> as one Column, no shuffle."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.text import split_literal

UTTERANCES = "array<struct<pos:int,role:string,text:string>>"
_TAG = r"(?d)\[.*?\] "
_NAME = r"(?d)^[A-Z].*?:"


def apply_exceptions(text: Column, exceptions: Sequence[tuple[str, str]] | None) -> Column:
    return functools.reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), exceptions or (), text)


def _numbered(found: Column) -> Column:
    return F.transform(found, lambda u, i: F.struct(i.cast("int").alias("pos"), u.role.alias("role"), u.text.alias("text")))


def _tagged(text: Column, on_invalid: str) -> Column:
    tags = lambda line: F.regexp_extract_all(line, F.lit(_TAG), F.lit(0))
    lines = F.filter(split_literal(text, "\n"), lambda line: (line != "") & (F.size(tags(line)) > 0))
    if on_invalid == "drop":
        lines = F.filter(lines, lambda line: F.size(tags(line)) == 1)

    def utterance(line: Column) -> Column:
        role = F.rtrim(F.get(tags(line), F.lit(0)))
        at = F.instr(line, role)
        rest = F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + F.length(role), F.lit(2**31 - 1)))
        if on_invalid == "raise":
            role = F.when(F.size(tags(line)) > 1, F.raise_error(F.concat(F.lit("several roles in one line: "), line)).cast("string")).otherwise(role)
        return F.struct(role.alias("role"), rest.alias("text"))

    return _numbered(F.transform(lines, utterance))


def _named(text: Column) -> Column:
    name = lambda line: F.regexp_extract(line, _NAME, 0)
    lines = F.filter(split_literal(text, "\r\n"), lambda line: name(line) != "")
    return _numbered(F.transform(lines, lambda line: F.struct(F.replace(name(line), F.lit(":"), F.lit("")).alias("role"), F.substring(line, F.length(name(line)) + 1, F.lit(2**31 - 1)).alias("text"))))


def utterances(text: Column, task: str = "C", exceptions: Sequence[tuple[str, str]] | None = None, on_invalid: str = "raise") -> Column:
    """Task C: lines with a `[role] ` tag. Tasks A and B: CRLF lines that begin `Role:`. Others: none.

    A line of several tags raises; with on_invalid `drop` it goes, with `keep` its first tag counts.
    """
    if on_invalid not in ("raise", "drop", "keep"):
        raise ValueError("on_invalid is raise, drop or keep")
    text = apply_exceptions(text, exceptions)
    if task == "C":
        return _tagged(text, on_invalid)
    if task in ("A", "B"):
        return _named(text)
    return F.array().cast(UTTERANCES)


def invalid_lines(text: Column) -> Column:
    """How many lines have several tags."""
    return F.size(F.filter(split_literal(text, "\n"), lambda line: F.size(F.regexp_extract_all(line, F.lit(_TAG), F.lit(0))) > 1))


def rows(df: DataFrame, dialogue_column: str, task: str = "C", exceptions=None, on_invalid: str = "raise") -> DataFrame:
    """A row an utterance: the frame's other columns, pos, role and text."""
    others = [c for c in df.columns if c != dialogue_column]
    return df.select(*others, F.explode(utterances(F.col(dialogue_column), task, exceptions, on_invalid)).alias("u")).select(*others, "u.pos", "u.role", "u.text")


def token_lists(texts: list[str]) -> list[list[str]]:
    """The default language provider: words and single marks of each text."""
    return [re.findall(r"\w+|[^\w\s]", t) for t in texts]


def annotated(df: DataFrame, dialogue_column: str, annotate: Callable[[list[str]], list], kind: str = "array<string>", task: str = "C", exceptions=None) -> DataFrame:
    """Utterance rows with `annotation`, what a language model says of their texts: a batch of texts, over
    utterances and dialogues, goes to `annotate` at once."""
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(annotate(texts.tolist()), index=texts.index)

    return rows(df, dialogue_column, task, exceptions).withColumn("annotation", run("text"))


def join(said: Column, task: str = "C", spaced: bool = False) -> Column:
    """Utterances as a dialogue text; `spaced` puts the task's separator between role and text."""
    between = (" " if task == "C" else ": ") if spaced else ""
    return F.array_join(F.transform(said, lambda u: F.concat(u.role, F.lit(between), u.text)), "\n")
