"""Registered queries, and the stand-ins that driver tables are for the library's own tables.

Every stand-in exists twice: as a DataFrame and as a common table expression in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.runtime import ship, shuffle_width, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL that gives its rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of floats depend on their order; compared values don't need the last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def libraries(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("id"), F.lower("r_name").alias("group_name"), F.lower("n_name").alias("project_name"),
        F.concat(F.lower("n_name"), F.lit(" of "), F.lower("r_name")).alias("description"), F.lit("main").alias("default_version"), F.lit("github").alias("provider"),
    )


LIB = "lib AS (SELECT n_nationkey::BIGINT AS id, lower(r_name) AS group_name, lower(n_name) AS project_name, lower(n_name) || ' of ' || lower(r_name) AS description, 'main' AS default_version, 'github' AS provider FROM nation JOIN region ON n_regionkey = r_regionkey)"


def versions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("library_id"), F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("version_tag"))


VER = "ver AS (SELECT s_suppkey AS id, s_nationkey::BIGINT AS library_id, 'v' || s_suppkey AS version_tag FROM supplier)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    folder = F.element_at(F.array(F.lit("docs/"), F.lit("src/api/"), F.lit(""), F.lit("lib/docs/")), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.element_at(F.array(F.lit("readme"), F.lit("install"), F.lit("doc_"), F.lit("index"), F.lit("changelog")), (F.col("doc_id") % 5 + 1).cast("int"))
    ext = F.element_at(F.array(F.lit(".md"), F.lit(".rst"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    number = F.when(F.col("doc_id") % 5 == 2, F.col("doc_id").cast("string")).otherwise("")
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("library"), "lang", F.concat(folder, name, number, ext).alias("path"), F.col("text").alias("content"))


DOC = "doc AS (SELECT doc_id AS id, source AS library, lang, (['docs/', 'src/api/', '', 'lib/docs/'])[(doc_id % 4 + 1)::INT] || (['readme', 'install', 'doc_', 'index', 'changelog'])[(doc_id % 5 + 1)::INT] || CASE WHEN doc_id % 5 = 2 THEN doc_id::VARCHAR ELSE '' END || (['.md', '.rst', '.txt'])[(doc_id % 3 + 1)::INT] AS path, text AS content FROM documents)"

KINDS = {"ECONOMY": "class", "STANDARD": "function", "SMALL": "method", "MEDIUM": "interface", "LARGE": "variable", "PROMO": "enum"}


def symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = None
    for k, v in KINDS.items():
        kind = F.when(F.col("p_type") == k, v) if kind is None else kind.when(F.col("p_type") == k, v)
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    language = F.element_at(F.array(F.lit("python"), F.lit("java"), F.lit("go")), (F.col("p_partkey") % 3 + 1).cast("int"))
    folder = F.concat(F.lit("src/m"), (F.col("p_partkey") % 7).cast("string"), F.lit("/"))
    return p.select(
        F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 25).alias("library_id"), name.alias("name"), F.concat(brand, F.lit("."), name).alias("qualified_name"), kind.alias("symbol_type"), F.concat(folder, brand, F.lit(".py")).alias("file_path"),
        F.col("p_size").alias("line_start"), (F.col("p_size") + F.col("p_partkey") % 50).cast("int").alias("line_end"), F.when(F.col("p_size") % 4 == 0, "private").otherwise("public").alias("visibility"), language.alias("language"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Makes a "), F.col("p_name"))).alias("documentation"), (F.col("p_size") % 4 != 0).alias("is_exported"), F.when(kind == "method", brand).alias("parent_class"), (F.col("p_partkey") % 11 == 0).alias("is_abstract"),
    )


SYM = (
    "sym AS (SELECT p_partkey AS ord, p_partkey % 25 AS library_id, replace(p_name, ' ', '_') AS name, replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS qualified_name, CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())
    + " END AS symbol_type, 'src/m' || (p_partkey % 7) || '/' || replace(p_brand, '#', '') || '.py' AS file_path, p_size AS line_start, (p_size + p_partkey % 50)::INT AS line_end, CASE WHEN p_size % 4 = 0 THEN 'private' ELSE 'public' END AS visibility,"
    " (['python', 'java', 'go'])[(p_partkey % 3 + 1)::INT] AS language, CASE WHEN p_partkey % 3 = 0 THEN 'Makes a ' || p_name END AS documentation, p_size % 4 <> 0 AS is_exported, CASE WHEN p_type = 'SMALL' THEN replace(p_brand, '#', '') END AS parent_class, p_partkey % 11 = 0 AS is_abstract FROM part)"
)


def edges(spark: SparkSession, d: str, least: int = 0) -> DataFrame:
    """source, target and relation: neighbouring lines of an order. `least` shapes the graph: over
    all lines it is one component, and walks have no end but the whole."""
    items = table(spark, d, "lineitem")
    a = items.where(F.col("l_quantity") >= least).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("source"))
    b = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target"))
    e = a.join(b, ["l_orderkey", "l_linenumber"]).select("source", "target").distinct()
    relation = F.element_at(F.array(F.lit("imports"), F.lit("calls"), F.lit("inherits"), F.lit("uses")), ((F.col("source") + F.col("target")) % 4 + 1).cast("int"))
    return e.withColumn("relation", relation)


def weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target and most, the largest l_quantity that a line of the edge has: the edges of
    any `least` come from one join."""
    items = table(spark, d, "lineitem")
    a = items.where("l_quantity >= 0").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("source"), "l_quantity")
    b = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).repartition(shuffle_width(spark), "source").groupBy("source", "target").agg(F.max("l_quantity").alias("most"))


def edge_sql(least: int = 0) -> str:
    return f"edge AS (SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target, (['imports', 'calls', 'inherits', 'uses'])[((a.l_partkey + b.l_partkey) % 4 + 1)::INT] AS relation FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= {least})"


EDGE = edge_sql()
#: Lines of a sparse graph with many components, for queries on cycles and layers.
SPARSE = 47


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("source").alias("id")).union(e.select(F.col("target").alias("id"))).distinct()


NODE = "node AS (SELECT source AS id FROM edge UNION SELECT target FROM edge)"
