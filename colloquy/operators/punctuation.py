"""Punctuation restoration around a replaceable word-labelling model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colloquy.functions.fixed import CHUNK_OVERLAP, CHUNK_WORDS
from colloquy.functions.text import let, split_words
from colloquy.operators import parse
from colloquy.sources.tables import require_columns

#: The label of a word that no mark follows, and the marks that are labels.
NONE, MARKS = "0", ".,?-:"
#: Rows whose restored texts a Python worker holds at once.
ROWS = 256


def has_marks(text: Column) -> Column:
    return text.rlike("[?,;!]")


def bare_words(text: Column) -> Column:
    """Words without marks, but for those beside a digit."""
    return split_words(F.regexp_replace(text, r"(?<!\p{Nd})[.,;:!?](?!\p{Nd})", ""))


def chunks(words: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping runs of words as a model sees them: one if they fit, and no last one that is all overlap."""
    def cut(own: Column) -> Column:
        step = F.when(F.size(own) > size, size - overlap).otherwise(size)
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1, step)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(own, i + 1, size))

    def tidy(runs: Column) -> Column:
        return F.when((F.size(runs) > 1) & (F.size(F.element_at(runs, -1)) <= overlap), F.slice(runs, 1, F.size(runs) - 1)).otherwise(runs)

    return let(let(words, cut), tidy)


def contributed(runs: Column, overlap: int = CHUNK_OVERLAP) -> Column:
    """What each run gives to the result: all but its last `overlap` words, the last run all."""
    def given(own: Column, last: Column) -> Column:
        return F.transform(own, lambda run, i: F.when(i < last, F.slice(run, F.lit(1), F.size(run) - overlap)).otherwise(run))

    return let(runs, lambda own: let(F.size(own) - 1, lambda last: given(own, last)))


def render(words: Column, labels: Column) -> Column:
    """Words with the marks that their labels name; anything else names none."""
    said = F.zip_with(words, labels, lambda w, m: F.concat(w, F.when((m != NONE) & (m != "") & F.lit(MARKS).contains(m), m).otherwise(""), F.lit(" ")))
    return F.trim(F.array_join(said, ""))


Labeller = Callable[[list[list[str]]], list[list[str]]]


def plain(text: Column) -> Column:
    """The default without a model: no word gets a mark."""
    return F.array_join(bare_words(text), " ")


def keep(text: Column) -> Column:
    """The text as it is."""
    return text


def model(labeller_factory: Callable[[], Labeller]) -> Callable[[Column], Column]:
    """A provider from a function that labels the words of each run; made once a Python worker.

    Spark takes no Python inside higher-order functions, so restore_punctuation hands such a provider
    all utterances of a row at once.
    """
    held: list[Labeller] = []

    def rendered(runs) -> str:
        if not held:
            held.append(labeller_factory())
        runs = [list(w) for w in runs]
        out = []
        for i, (words, labels) in enumerate(zip(runs, held[0](runs))):
            n = len(words) if i == len(runs) - 1 else len(words) - CHUNK_OVERLAP
            out += [w + (m if m in tuple(MARKS) else "") for w, m in zip(words[:n], labels)]
        return " ".join(out)

    def runs_of(words: list[str]) -> list[list[str]]:
        """As chunks does: Spark takes no nested lambdas in a Python function's arguments."""
        step = CHUNK_WORDS - CHUNK_OVERLAP if len(words) > CHUNK_WORDS else CHUNK_WORDS
        runs = [words[i : i + CHUNK_WORDS] for i in range(0, len(words), step)]
        return runs[:-1] if len(runs) > 1 and len(runs[-1]) <= CHUNK_OVERLAP else runs

    @F.arrow_udf("string")
    def one(words: pa.Array) -> pa.Array:
        return pa.array([rendered(runs_of(w.as_py())) if w.is_valid else None for w in words], pa.string())

    def restore(text: Column) -> Column:
        return F.when(text.isNotNull(), one(bare_words(text)))

    restore.rendered = rendered
    return restore


def restore_dialogue(text: Column, task: str = "C", enforce: bool = True, provider: Callable[[Column], Column] = plain, exceptions=None) -> Column:
    said = parse.utterances(text, task, exceptions)
    if hasattr(provider, "rendered"):
        raise ValueError("a Python provider restores dialogues on frames only: restore_punctuation")
    restored = parse.join(F.transform(said, lambda u: F.struct(u.role.alias("role"), provider(u.text).alias("text"))), task, spaced=True)
    return restored if enforce else F.when(has_marks(text), text).otherwise(restored)


def restore_punctuation(df: DataFrame, dialogue_column: str, enforce: bool = True, provider: Callable[[Column], Column] = plain) -> DataFrame:
    """Adds `restore_punctuation_dialogue`."""
    require_columns(df, dialogue_column)
    text, name = F.col(dialogue_column), "restore_punctuation_dialogue"
    if not hasattr(provider, "rendered"):
        return df.withColumn(name, restore_dialogue(text, "C", enforce, provider))
    said, rendered = parse.utterances(text), provider.rendered
    parts = {"roles__": F.transform(said, lambda u: u.role), "runs__": F.transform(said, lambda u: chunks(bare_words(u.text))), "kept__": F.when(has_marks(text) & F.lit(not enforce), text)}

    added = list(parts)

    def restored(roles: pa.Scalar, runs: pa.Scalar, kept: pa.Scalar) -> str | None:
        if kept.is_valid or not roles.is_valid:
            return kept.as_py()
        return "\n".join(f"{role} {rendered(words.as_py())}" for role, words in zip(roles.as_py(), runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the words only one utterance's are Python objects at a time; texts go out a few rows at once."""
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                out = [restored(*row) for row in zip(*(part.column(c) for c in added))]
                whole = part.select([c for c in part.schema.names if c not in added])
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(out, pa.string())], [*whole.schema.names, name])

    return df.withColumns(parts).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
