"""Cleaning of spoken text, as Column expressions; null stays null."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.fixed import PATIENT, PATIENT_FORMS, SPOKEN_FORMS
from colloquy.functions.text import GAP, LINE_ENDS, WORD, java, replace_apart, split_literal, strip
from colloquy.sources.tables import require_columns

Pairs = Sequence[tuple[str, str]]


def replace_all(text: Column, table: Pairs = SPOKEN_FORMS) -> Column:
    """Plain substrings, one pair after another; later pairs see what earlier ones wrote."""
    return functools.reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table, text)


def collapse_repeats(text: Column, scope: str = "dialogue") -> Column:
    """A word that repeats at once, whatever stands between, stays once. With scope `line_body`
    a line's repeats are judged apart from its tag and from other lines."""
    pattern = rf"(?<!{WORD})({WORD}+)(?:{GAP}+\1(?!{WORD}))+"
    if scope == "dialogue":
        return F.regexp_replace(text, pattern, "$1")
    if scope != "line_body":
        raise ValueError("scope is dialogue or line_body")
    tag = r"^(\[[^\]]*\] )?"
    body = lambda line: F.concat(F.regexp_extract(line, tag, 0), F.regexp_replace(F.regexp_replace(line, tag, ""), pattern, "$1"))
    return F.array_join(F.transform(split_literal(text, "\n"), body), "\n")


def rewrite_patient(text: Column, patterns: Pairs = PATIENT_FORMS, splitter: Callable[[Column], Column] | None = None, shared: bool = True) -> Column:
    """Lines that begin with the patient's tag, lowered and in the third person. With a splitter (text to
    array) the patterns see one sentence at a time, and a space joins the sentences. Matches of a pattern may
    share the character between them; without `shared` it belongs to the first, and the second stays."""
    def person(said: Column) -> Column:
        one = (lambda c, kv: F.regexp_replace(c, java(kv[0]), kv[1])) if shared else (lambda c, kv: replace_apart(c, *kv))
        return functools.reduce(one, patterns, F.lower(said))

    def line(said: Column) -> Column:
        body = strip(F.substring(said, len(PATIENT) + 1, 2**31 - 1))
        body = F.array_join(F.transform(splitter(body), person), " ") if splitter else person(body)
        return F.when(said.startswith(PATIENT), F.concat(F.lit(PATIENT + " "), body)).otherwise(said)

    return F.array_join(F.transform(split_literal(text, "\n"), line), "\n")


def only_dots(text: Column) -> Column:
    return ~text.rlike("[,;!?]") & text.contains(" . ")


def spoken_point(text: Column) -> Column:
    """A lone dot in a text without other marks was said: it is the word point."""
    return F.when(only_dots(text), F.replace(text, F.lit(" . "), F.lit(" point "))).otherwise(text)


def clean_text(text: Column, table: Pairs = SPOKEN_FORMS, patterns: Pairs = PATIENT_FORMS, scope: str = "dialogue", splitter: Callable[[Column], Column] | None = None, shared: bool = True) -> Column:
    return rewrite_patient(collapse_repeats(replace_all(text, table), scope), patterns, splitter, shared)


def clean_spoken(df: DataFrame, dialogue_column: str, table: Pairs = SPOKEN_FORMS, patterns: Pairs = PATIENT_FORMS, scope: str = "dialogue", splitter: Callable[[Column], Column] | None = None, shared: bool = True) -> DataFrame:
    """Adds `clean_dialogue`."""
    require_columns(df, dialogue_column)
    return df.withColumn("clean_dialogue", clean_text(spoken_point(F.col(dialogue_column)), table, patterns, scope, splitter, shared))


def drop_returns(text: Column) -> Column:
    return F.replace(text, F.lit("\r"), F.lit(""))


def flatten_lines(text: Column) -> Column:
    """Lines joined by a space; an end of line at the end opens no line."""
    lines = F.split(text, LINE_ENDS, -1)
    return F.array_join(F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines), " ")


def cut_leading_mark(text: Column) -> Column:
    """Without a leading dot or comma and the character after it."""
    return F.when(text.rlike(r"^[.,]"), F.substring(text, 3, 2**31 - 1)).otherwise(text)
