"""A text of `Division:`, `Title:`, `Point:` and `Point*:` lines as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """seq, division, title, point, starred and synonyms (a point's parts between slashes), a row an entry."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))
    kind, value = F.regexp_extract("line", r"^(Division|Title|Point\*?):", 1), F.trim(F.regexp_replace("line", r"^[^:]*:\s*", ""))
    rows = lines.select("seq", kind.alias("kind"), value.alias("value")).where("kind <> ''")
    so_far = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # a template of some dozen lines
    carried = lambda k: F.last(F.when(F.col("kind") == k, F.col("value")), ignorenulls=True).over(so_far)
    point = F.when(F.col("kind").startswith("Point"), F.col("value"))
    named = rows.select("seq", "kind", carried("Division").alias("division"), F.when(F.col("kind") != "Division", carried("Title")).alias("title"), point.alias("point"), (F.col("kind") == "Point*").alias("starred"))
    parts = F.filter(F.transform(F.split("point", "/"), lambda p: F.trim(F.regexp_replace(p, ":$", ""))), lambda p: p != "")
    return named.select("seq", "division", "title", "point", "starred", F.coalesce(parts, F.array().cast("array<string>")).alias("synonyms"))
