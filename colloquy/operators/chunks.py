"""Greedy packing of sentences into chunks of bounded token counts, as one fold per text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from colloquy.functions.text import strip
from colloquy.operators.sentences import tokens

STATE = "struct<chunks:array<string>,held:array<string>,counts:array<int>,length:int>"


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, n: a + n)


def _start() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(none.alias("chunks"), none.alias("held"), F.array().cast("array<int>").alias("counts"), F.lit(0).alias("length")).cast(STATE)


def _state(chunks: Column, held: Column, counts: Column, length: Column) -> Column:
    return F.struct(chunks.alias("chunks"), held.alias("held"), counts.alias("counts"), length.alias("length")).cast(STATE)


def _tail(items: Column, n: int, kind: str) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n) if n else F.array().cast(f"array<{kind}>")


def _flush(state: Column) -> Column:
    return F.when(F.size(state.held) > 0, F.array_append(state.chunks, F.array_join(state.held, " "))).otherwise(state.chunks)


def pack(text: Column, max_tokens: int, overlap: int = 0, count: Callable[[Column], Column] = token_count, compat: bool = False, cut: bool = True) -> Column:
    """Chunks of a text. A sentence over the limit is cut at commas, colons and semicolons and packed by
    itself at once, while the open chunk stays open, so chunks can stand out of the text's order.
    `overlap` pieces carry over; `compat` sums their length from the front of all counts. Without `cut` a sentence over
    the limit stays whole and in its place: it closes the open chunk and begins the next."""
    counted = lambda s: F.struct(s.alias("s"), count(F.concat(F.lit(" "), s)).alias("n"))
    every = F.transform(F.split(text, "[.!?\n]", -1), counted)

    def step(all_counts: Column, sub: bool) -> Callable[[Column, Column], Column]:
        def merge(state: Column, piece: Column) -> Column:
            full = state.length + piece.n > max_tokens
            full = full & (F.size(state.held) > 0) if sub else full
            carried, kept = _tail(state.held, overlap, "string"), _tail(state.counts, overlap, "int")
            length = _total(F.slice(all_counts, 1, F.size(carried))) if compat else _total(kept)
            opened = _state(F.array_append(state.chunks, F.array_join(state.held, " ")), F.array_append(carried, piece.s), F.array_append(kept, piece.n), length + piece.n)
            added = _state(state.chunks, F.array_append(state.held, piece.s), F.array_append(state.counts, piece.n), state.length + piece.n)
            return F.when(full, opened).otherwise(added)

        return merge

    def parts(sentence: Column) -> Column:
        subs = F.filter(F.transform(F.split(sentence, "[,;:]", -1), strip), lambda s: s != "")
        subs = F.transform(subs, counted)
        return F.aggregate(subs, _start(), step(F.transform(subs, lambda x: x.n), True), _flush)

    def sentence(state: Column, piece: Column) -> Column:
        if not cut:
            return step(F.transform(every, lambda x: x.n), True)(state, piece)
        long = _state(F.concat(state.chunks, parts(piece.s)), state.held, state.counts, state.length)
        return F.when(piece.n > max_tokens, long).otherwise(step(F.transform(every, lambda x: x.n), False)(state, piece))

    return F.aggregate(F.filter(every, lambda x: strip(x.s) != ""), _start(), sentence, _flush)
