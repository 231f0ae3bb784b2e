"""Sentence and token operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.fixed import BOUNDARY
from colloquy.functions.text import split_words
from colloquy.operators import parse
from colloquy.operators.clean import cut_leading_mark

TOKEN = r"[\p{L}\p{N}_]+|[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}_]"


def meaningful(sentence: Column) -> Column:
    """Three words or more, apart from those that open or close a bracket."""
    return F.size(F.filter(split_words(sentence), lambda w: ~(w.startswith("[") | w.endswith("]")))) >= 3


def split_sentences(text: Column, marker: str | None = None, mark_noisy: bool = False, splitter: Callable[[Column], Column] | None = None) -> Column:
    """Sentences as an array; with mark_noisy those that aren't meaningful get the marker in front.
    A splitter (text to array) takes the place of the pattern."""
    if mark_noisy and marker is None:
        raise ValueError("mark_noisy needs a marker")
    found = splitter(text) if splitter else F.split(text, BOUNDARY, -1)
    if not mark_noisy:
        return found
    return F.transform(found, lambda s: F.when(meaningful(s), s).otherwise(F.concat(F.lit(marker), s)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentence_rows(utterances: DataFrame, splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Utterance rows to sentence rows: pos becomes utt_pos, with sent_pos, role kept."""
    others = [c for c in utterances.columns if c not in ("pos", "text")]
    return utterances.select(*others, F.col("pos").alias("utt_pos"), F.posexplode(split_sentences(cut_leading_mark(F.col("text")), splitter=splitter)).alias("sent_pos", "text"))


def dialogue_sentences(df: DataFrame, dialogue_column: str, task: str = "C", exceptions=None, splitter=None) -> DataFrame:
    return sentence_rows(parse.rows(df, dialogue_column, task, exceptions), splitter)
