"""Keyed tables as DataFrames: upserts, deletes, sets and summaries (survey K1-K8, A1-A25, J15-J20, U1-U7).

A row's identity is a hash of its natural key, so it survives an upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_id(*columns: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(*keys, "_row.*").select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """K1, K2, K4, K5: rows of `new` replace those of the same key; within `new` the last one by
    `order` counts."""
    fresh = last_of(new, keys, order) if order else new.dropDuplicates(keys)
    return old.join(fresh.select(keys), keys, "left_anti").unionByName(fresh.select(old.columns))


def delete(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """K7: what is left, and one row with how many went."""
    gone = F.coalesce(condition, F.lit(False))
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("deleted"))


def add_edges(nodes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """K6: edges whose ends exist; one edge for each pair, the newest."""
    known = nodes.select("id")
    kept = new.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return upsert(old, kept.select(old.columns), ["source", "target"])


def delete_library(tables: dict[str, DataFrame], library: str) -> dict[str, DataFrame]:
    """K8: every table without one library's rows; edges go with their nodes."""
    left = {n: t.where(F.col("library_id") != library) if "library_id" in t.columns else t for n, t in tables.items()}
    if "nodes" in left and "edges" in left:
        gone = tables["nodes"].join(left["nodes"], "id", "left_anti").select("id")
        left["edges"] = left["edges"].join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return left


def statistics(symbols: DataFrame) -> DataFrame:
    """A2: counts by type, visibility and language in one pass."""
    sets = symbols.groupingSets([["symbol_type"], ["visibility"], ["language"]], "symbol_type", "visibility", "language").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    dimension = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "visibility").otherwise("language")
    return sets.select(dimension.alias("dimension"), F.coalesce("symbol_type", "visibility", "language", F.lit("unknown")).alias("value"), "n")


def per_file(symbols: DataFrame) -> DataFrame:
    """Counts by kind, and the language or `mixed`."""
    kinds = [F.count_if(F.col("symbol_type") == k).alias(f"n_{k}") for k in ("class", "interface", "enum", "function", "method")]
    language = F.when(F.count_distinct("language") == 1, F.min("language")).otherwise("mixed")
    return symbols.groupBy("file_path").agg(*kinds, F.count("*").alias("total"), language.alias("language"))


def per_package(symbols: DataFrame, package: Column) -> DataFrame:
    """A10."""
    kind = F.col("symbol_type")
    return symbols.groupBy(package.alias("package")).agg(
        F.count_distinct("file_path").alias("files"), F.count("*").alias("symbols"), F.count_if(kind == "class").alias("classes"), F.count_if(kind == "interface").alias("interfaces"),
        F.count_if(kind.isin("function", "method")).alias("functions"), F.array_sort(F.collect_set("language")).alias("languages"))


def targets_of(edges: DataFrame) -> DataFrame:
    """Distinct targets of each source and relation."""
    return edges.groupBy("source", "relation").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], values: list[str]) -> DataFrame:
    """For each left row the first right row by `order`."""
    first = right.groupBy(*on).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return left.join(first, on, "left").select(left.columns + [f"_first.{v}" for v in values])


def distinct_edges(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first edge of each key."""
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def overridden(rows: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Values from another table where they aren't empty."""
    b = other.select(key, F.col(column).alias("_new"))
    return rows.join(b, key, "left").withColumn(column, F.coalesce(F.nullif("_new", F.lit("")), column)).drop("_new")
