"""The row-level operators on a stream of dialogues: they keep no state, so the batch plan runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from colloquy.plans.preprocess import preprocess


def read_dialogues(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def preprocess_stream(stream: DataFrame, dialogue_column: str, target: str, checkpoint: str, **options):
    """Starts the chain over what is there and ends; run again, it takes up only new files."""
    out = preprocess(stream, dialogue_column, **options)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
