"""Search over libraries, documents and symbols (survey F1-F10, Q1-Q12, L1-L10, U2, W4)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.functions.fuzzy import fuzzy_tier


def exact_libraries(libraries: DataFrame, versions: DataFrame, query: str) -> DataFrame:
    """LIKE on group, project or description; versions in order; scores 3
    for the project's name, 2 for a name that contains the query, else 1."""
    like = f"%{query}%"
    hit = F.col("group_name").ilike(like) | F.col("project_name").ilike(like) | F.col("description").ilike(like)
    tags = versions.groupBy(F.col("library_id").alias("id")).agg(F.array_sort(F.collect_list("version_tag")).alias("versions"))
    name = F.lower("project_name")
    score = F.when(name == query.lower(), 3.0).when(name.contains(query.lower()), 2.0).otherwise(1.0)
    return libraries.where(hit).join(tags, "id", "left").select("id", "group_name", "project_name", F.coalesce("versions", F.array().cast("array<string>")).alias("versions"), score.alias("score"))


def fuzzy_libraries(libraries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Best tier of each library, top k."""
    hit = libraries.withColumn("hit", fuzzy_tier(query, F.col("project_name"), F.col("group_name"), F.col("description"))).where("hit is not null")
    return hit.select("id", "group_name", "project_name", "hit.score", "hit.match_type", "hit.matched_field").orderBy(F.desc("score"), "id").limit(limit)


def page(rows: DataFrame, order: list[Column | str], number: int = 1, size: int = 10) -> DataFrame:
    """One page; a size of 999 or more means all."""
    rows = rows.orderBy(*order)
    return rows if size >= 999 else rows.offset((number - 1) * size).limit(size)


def topic(documents: DataFrame, word: str) -> DataFrame:
    """F3."""
    return documents.where(F.col("path").ilike(f"%{word}%") | F.col("content").ilike(f"%{word}%"))


def symbols(rows: DataFrame, library: int | None = None, query: str | None = None, kind: str | None = None, language: str | None = None, limit: int | None = None) -> DataFrame:
    """Whatever conditions are given, all of them."""
    conditions = []
    if library is not None:
        conditions.append(F.col("library_id") == library)
    if query:
        conditions.append(T.any_of([F.col(c).ilike(f"%{query}%") for c in ("name", "qualified_name", "documentation")]))
    if kind:
        conditions.append(F.col("symbol_type") == kind)
    if language:
        conditions.append(F.col("language") == language)
    found = rows.where(functools.reduce(operator.and_, conditions)) if conditions else rows
    return found.orderBy("name", "ord").limit(limit) if limit else found


def bm25(rows: DataFrame, key: str, text: Column, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Key and score of rows that hold every query word. Document frequencies and
    lengths are one aggregate over the words asked for; the index isn't materialised."""
    words = sorted(set(query.lower().split()))
    tokens = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")
    times = lambda word: F.size(F.filter("tokens", lambda x: x == word))
    counted = rows.select(key, tokens.alias("tokens")).select(key, F.size("tokens").alias("n"), *[times(w).alias(f"tf{i}") for i, w in enumerate(words)])
    stats = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    joined = counted.where(functools.reduce(operator.and_, [F.col(f"tf{i}") > 0 for i in range(len(words))])).crossJoin(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("docs") - df + 0.5) / (df + 0.5) + 1)
        parts.append(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean"))))
    return joined.select(key, functools.reduce(operator.add, parts).alias("score"))


def content_arm(documents: DataFrame, symbol_rows: DataFrame, query: str, limit: int) -> DataFrame:
    """Q9."""
    c = F.col("content")
    a = documents.where(F.lower(c).contains(query.lower())).select(F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("id"), T.content_score(F.lower(c), query.lower()).alias("score"))
    b = symbol_rows.where(F.lower("name").contains(query.lower())).select(F.concat(F.lit("sym:"), F.col("ord").cast("string")).alias("id"), F.lit(0.8).alias("score"))
    return a.union(b).orderBy(F.desc("score"), "id").limit(limit).withColumn("source", F.lit("content"))


def graph_arm(symbol_rows: DataFrame, query: str, limit: int) -> DataFrame:
    """Q11."""
    name = F.lower("name")
    score = F.when(name == query.lower(), 0.9).otherwise(0.7)
    rows = symbol_rows.where(name.contains(query.lower())).select(F.concat(F.lit("sym:"), F.col("ord").cast("string")).alias("id"), score.alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(limit).withColumn("source", F.lit("graph"))


def merge(hits: DataFrame) -> DataFrame:
    """One row for each id whatever its case; the best score and its source, all
    sources. hits: id, score, source and ord (the order in which arms came)."""
    best = F.max_by(F.struct("id", "score", "source"), F.struct("score", (-F.col("ord")).alias("o")))
    return hits.groupBy(F.lower("id").alias("key")).agg(best.alias("best"), F.array_sort(F.collect_set("source")).alias("sources")).select("best.id", "best.score", "best.source", "sources")


#: What each arm's scores count.
BOOSTS = {"content": 2.0, "vector": 1.5, "graph": 1.2}


def hybrid(content: DataFrame, vector: DataFrame, graph: DataFrame, limit: int) -> DataFrame:
    """The arms' hits, boosted, merged, ranked."""
    arms = []
    for i, (name, rows) in enumerate((("content", content), ("vector", vector), ("graph", graph))):
        arms.append(rows.select("id", (F.col("score") * BOOSTS[name]).alias("score"), F.lit(name).alias("source"), F.lit(i).alias("ord")))
    return merge(functools.reduce(DataFrame.union, arms)).orderBy(F.desc("score"), "id").limit(limit)


def by_rank(rows: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
