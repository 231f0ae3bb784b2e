"""Tables of a directory of Parquet files, and the guards on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions.fixed import DOCTOR, PATIENT

TAGS = {"assistant": DOCTOR, "user": PATIENT, "system": "[patient_guest]"}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself; raises while the plan is built if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out over the cores if the input has fewer partitions; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tagged_turns(turns: DataFrame, flatten: bool = True) -> DataFrame:
    """conv_id, turn and `line`: the tag of the turn's role, a space, and its text (on one line)."""
    tag = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])[F.col("role")]
    text = F.replace("text", F.lit("\n"), F.lit(" ")) if flatten else F.col("text")
    return turns.select("conv_id", "turn", F.concat(tag, F.lit(" "), text).alias("line"))


def dialogues(turns: DataFrame, flatten: bool = True) -> DataFrame:
    """conv_id and `dialogue`, one text a conversation, a line a turn."""
    lines = tagged_turns(turns, flatten).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    return lines.select("conv_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("dialogue"))
