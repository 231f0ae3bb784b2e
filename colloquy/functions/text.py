"""Regular-expression classes that mean the same in Java, Python and RE2, and small text Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WORD, GAP = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: What Python's str.strip and str.split take for white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often and inside whatever loop the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def split_words(text: Column) -> Column:
    """Words between runs of white space; none in a blank text."""
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def java(pattern: str) -> str:
    r"""A pattern with word edges (\b) that know all letters and digits."""
    return pattern.replace(r"\b", EDGE)


def replace_apart(text: Column, pattern: str, value: str) -> Column:
    r"""Replaces a pattern between word edges (\b) as SQL without look-around does: a match takes the characters
    beside it, so of two matches with a single character between them the second stays."""
    core = pattern.replace(r"\b", "")
    if core == pattern:
        return F.regexp_replace(text, pattern, value)
    return F.regexp_replace(text, rf"(^|{GAP}){core}({GAP}|\z)", rf"$1{value}$2")


def split_literal(text: Column, separator: str) -> Column:
    return F.split(text, rf"\Q{separator}\E", -1)
