"""Role correction: who asks more is the doctor. On arrays without a shuffle, and on utterance rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.fixed import DOCTOR
from colloquy.functions.text import let
from colloquy.operators import parse
from colloquy.sources.tables import require_columns


def count_mark(text: Column, mark: str = "?") -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def other_role(said: Column) -> Column:
    """The role of the last utterance that isn't the doctor's; null without one."""
    return F.try_element_at(F.filter(said, lambda u: u.role != DOCTOR), F.lit(-1)).role


def asked(said: Column, doctor: bool, mark: str = "?") -> Column:
    own = F.filter(said, lambda u: (u.role == DOCTOR) if doctor else (u.role != DOCTOR))
    return F.aggregate(own, F.lit(0), lambda a, u: a + count_mark(u.text, mark))


def fix_roles(said: Column, mark: str = "?") -> Column:
    """If the others ask more than the doctor, the doctor becomes the other and all others the doctor."""
    def swapped(own: Column, other: Column) -> Column:
        return F.transform(own, lambda u: F.struct(u.pos.alias("pos"), F.when(u.role == DOCTOR, other).otherwise(DOCTOR).alias("role"), u.text.alias("text")))

    def fixed(own: Column) -> Column:
        return F.when(asked(own, True, mark) < asked(own, False, mark), let(other_role(own), lambda other: swapped(own, other))).otherwise(own)

    return let(said, fixed)


def fix_role(df: DataFrame, dialogue_column: str, exceptions=None, mark: str = "?") -> DataFrame:
    """Adds `fixed_role_dialogue`."""
    require_columns(df, dialogue_column)
    return df.withColumn("fixed_role_dialogue", parse.join(fix_roles(parse.utterances(F.col(dialogue_column), "C", exceptions), mark)))


def fix_role_rows(rows: DataFrame, key: str, order: str, mark: str = "?") -> DataFrame:
    """Utterance rows with `fixed_role`: one partial aggregation by dialogue, joined back."""
    doctor, n = F.col("role") == DOCTOR, count_mark(F.col("text"), mark)
    sums = rows.groupBy(key).agg(
        F.sum(F.when(doctor, n).otherwise(0)).alias("by_doctor"),
        F.sum(F.when(doctor, 0).otherwise(n)).alias("by_others"),
        F.max_by(F.when(~doctor, F.col("role")), F.when(~doctor, F.col(order))).alias("other"),
    )
    fixed = F.when(F.col("by_doctor") >= F.col("by_others"), F.col("role")).when(doctor, F.col("other")).otherwise(DOCTOR)
    return rows.join(sums, key).withColumn("fixed_role", fixed).drop("by_doctor", "by_others", "other")
