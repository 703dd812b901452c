"""Writing and reading a repository's dump (survey K9, K11, S17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("compact", "medium", "full")


def write(symbols: DataFrame, edges: DataFrame, texts: dict[str, DataFrame], folder: str, level: str = "compact") -> list[str]:
    """Compact: index and summary texts; medium: also edges; full: also symbols by file."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    symbols.groupBy("file_path").agg(F.count("*").alias("symbols"), F.array_sort(F.collect_set("symbol_type")).alias("types")).write.mode("overwrite").json(f"{folder}/index")
    written = ["index"]
    for name, text in texts.items():
        text.select("text").write.mode("overwrite").text(f"{folder}/{name}")
        written.append(name)
    if level != "compact":
        edges.write.mode("overwrite").json(f"{folder}/edges")
        written.append("edges")
    if level == "full":
        symbols.withColumn("file", F.regexp_replace("file_path", "[^A-Za-z0-9_.-]", "_")).write.mode("overwrite").partitionBy("file").json(f"{folder}/symbols")
        written.append("symbols")
    return written


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file_path string, symbols long, types array<string>").json(f"{folder}/index")


def as_maps(dependencies: DataFrame) -> DataFrame:
    """Rows as maps."""
    columns = dependencies.columns
    return dependencies.select(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns])).alias("row"))
