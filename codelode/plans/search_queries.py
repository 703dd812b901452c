"""Queries of search, vectors and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import search as S
from codelode.operators import tables as K
from codelode.operators import vectors as V
from codelode.plans.base import DOC, EDGE, LIB, SYM, VER, docs, edges, libraries, query, rounded, symbols, versions
from codelode.runtime import table


@query(f"WITH {LIB}, {VER}, t AS (SELECT library_id, list(version_tag ORDER BY version_tag) AS versions FROM ver GROUP BY 1) SELECT lib.id, group_name, project_name, coalesce(versions, []) AS versions, CASE WHEN project_name = 'nation_1' THEN 3.0 WHEN contains(project_name, 'nation_1') THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM lib LEFT JOIN t ON t.library_id = lib.id WHERE group_name ILIKE '%nation_1%' OR project_name ILIKE '%nation_1%' OR description ILIKE '%nation_1%'")
def q1_exact_search(spark: SparkSession, d: str) -> DataFrame:
    """Q1, F1, J1, A1, L7."""
    return S.exact_libraries(libraries(spark, d), versions(spark, d), "nation_1")


FUZZY = "SELECT id, group_name, project_name, CASE WHEN n = q THEN 1.0 WHEN starts_with(n, q) THEN 0.9 WHEN contains(n, q) THEN 0.8 WHEN contains(dd, q) THEN 0.6 WHEN contains(g, q) THEN 0.5 WHEN levenshtein(n, q) <= 3 AND length(n) > 0 THEN greatest(0.4, 1 - levenshtein(n, q) / length(n)) END::DOUBLE AS score, CASE WHEN n = q THEN 'exact' WHEN starts_with(n, q) THEN 'starts_with' WHEN contains(n, q) OR contains(dd, q) OR contains(g, q) THEN 'contains' ELSE 'fuzzy' END AS match_type, CASE WHEN contains(n, q) THEN 'name' WHEN contains(dd, q) THEN 'description' WHEN contains(g, q) THEN 'group' ELSE 'name' END AS matched_field"


@query(f"WITH {LIB}, x AS (SELECT *, lower(project_name) AS n, lower(group_name) AS g, lower(description) AS dd, 'nation_1' AS q FROM lib), s AS ({FUZZY} FROM x) SELECT * FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 20")
def q2_fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    """Q2, X1, X2, L6."""
    return S.fuzzy_libraries(libraries(spark, d), "nation_1", 20)


@query(f"WITH x AS (SELECT c_custkey AS id, c_mktsegment AS group_name, c_name AS project_name, lower(c_name) AS n, lower(c_mktsegment) AS g, '' AS dd, 'customer#000000012' AS q FROM customer), s AS ({FUZZY} FROM x) SELECT * FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 50")
def x2_fuzzy_customers(spark: SparkSession, d: str) -> DataFrame:
    """X1, X2 over a larger table."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("group_name"), F.col("c_name").alias("project_name"), F.lit(None).cast("string").alias("description"))
    return S.fuzzy_libraries(c, "customer#000000012", 50)


@query(f"WITH {LIB} SELECT id, group_name, project_name, provider FROM lib WHERE group_name = 'asia' AND provider = 'github'")
def f2_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """F2, F12."""
    return libraries(spark, d).where((F.col("group_name") == "asia") & (F.col("provider") == "github")).select("id", "group_name", "project_name", "provider")


@query(f"WITH {DOC} SELECT id, path FROM doc WHERE path ILIKE '%api%' OR content ILIKE '%thereti%'")
def f3_topic(spark: SparkSession, d: str) -> DataFrame:
    return S.topic(docs(spark, d), "api").select("id", "path").union(S.topic(docs(spark, d), "thereti").select("id", "path")).distinct()


@query(f"WITH {DOC} SELECT id, path FROM doc ORDER BY path, id LIMIT 20 OFFSET 40")
def l2_page(spark: SparkSession, d: str) -> DataFrame:
    """L2, L3, L14."""
    return S.page(docs(spark, d).select("id", "path"), ["path", "id"], 3, 20)


@query(f"WITH {SYM} SELECT ord, name, qualified_name FROM sym WHERE library_id = 3 AND (name ILIKE '%red%' OR qualified_name ILIKE '%red%' OR documentation ILIKE '%red%') AND symbol_type = 'class' ORDER BY name, ord LIMIT 15")
def f4_symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """F4, F7, F8, Q4, Q5, L4."""
    return S.symbols(symbols(spark, d), 3, "red", "class", limit=15).select("ord", "name", "qualified_name")


@query(f"WITH {SYM} SELECT ord, name FROM sym WHERE symbol_type = 'method' AND parent_class = 'Brand2'")
def f9_class_methods(spark: SparkSession, d: str) -> DataFrame:
    """F5, F9, F20."""
    return symbols(spark, d).where("symbol_type = 'method' and parent_class = 'Brand2'").select("ord", "name")


@query(f"WITH {SYM} SELECT ord, (line_start % 4 <> 0) AS is_valid, regexp_matches(name, '^[A-Za-z]\\w*$') AND length(name) BETWEEN 2 AND 100 AS identifier FROM sym WHERE visibility <> 'private'")
def f18_symbol_filters(spark: SparkSession, d: str) -> DataFrame:
    """F15-F19."""
    s = symbols(spark, d).where("visibility <> 'private'")
    return s.where(T.valid_symbol(F.col("name"), F.col("file_path"), F.col("line_start"))).select("ord", F.col("is_exported").alias("is_valid"), T.identifier(F.col("name")).alias("identifier"))


TOK = "t AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM doc), c AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'of')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)"


@query(f"WITH {DOC}, {TOK} SELECT id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, s WHERE a > 0 AND b > 0")
def q6_full_text(spark: SparkSession, d: str) -> DataFrame:
    """Q6, F6, J2."""
    return rounded(S.bm25(docs(spark, d), "id", F.col("content"), "the of"), "score")


QV = [0.1 * ((i * 7) % 11 - 5) for i in range(64)]
QS = "[" + ", ".join(f"{x:.1f}" for x in QV) + "]::DOUBLE[]"


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {QS}) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, id LIMIT 10)")
def v1_cosine_search(spark: SparkSession, d: str) -> DataFrame:
    """V1, L10, Q7."""
    return rounded(V.search(table(spark, d, "embeddings"), [round(x, 1) for x in QV], "vec_id", "embedding", filters={"label": 3}), "score")


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT vec_id AS id, list_inner_product(embedding::DOUBLE[], {QS}) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10)")
def v2_dot_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.search(table(spark, d, "embeddings"), [round(x, 1) for x in QV], "vec_id", "embedding", "dot"), "score")


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], {QS}) AS score FROM embeddings ORDER BY score, id LIMIT 10)")
def v2_euclid_search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.search(table(spark, d, "embeddings"), [round(x, 1) for x in QV], "vec_id", "embedding", "euclid"), "score")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def a20_vector_counts(spark: SparkSession, d: str) -> DataFrame:
    """A20, V3."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


HASHED = "s AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS t FROM part), ch AS (SELECT id, t, unnest(string_split(lower(t), '')) AS c, unnest(range(length(t))) AS i FROM s), k AS (SELECT id, (ord(c) * (i + 1)) % 32 AS p, count(*)::DOUBLE AS n FROM ch GROUP BY 1, 2), v AS (SELECT s.id, list_transform(range(32), lambda x: CASE x WHEN 0 THEN 0.01 WHEN 1 THEN length(t) / 1000 WHEN 2 THEN 1 / length(t) ELSE coalesce(m[x][1], 0.0) END::DOUBLE) AS raw FROM s JOIN (SELECT id, map(list(p), list([n])) AS m FROM k GROUP BY 1) q ON q.id = s.id)"


@query(f"WITH {HASHED} SELECT id, list_transform(raw, lambda x: round(x / sqrt(list_inner_product(raw, raw)), 9)) AS vector FROM v")
def v5_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """V5, V6."""
    p = V.dealt(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"))).select("id", V.hash_embedding(F.col("name"), 32).alias("vector"))
    return p.select("id", F.transform("vector", lambda x: F.when(x == 0, 0.0).otherwise(F.round(x, 9))).alias("vector"))


ARMS = f"""WITH {DOC}, {SYM}, ca AS (SELECT 'doc:' || id AS id, least(1.0, 0.5 + 0.1 * ((length(content) - length(replace(lower(content), 'red', ''))) / 3)) AS score FROM doc WHERE contains(lower(content), 'red') UNION ALL SELECT 'sym:' || ord, 0.8 FROM sym WHERE contains(lower(name), 'red')), c AS (SELECT * FROM ca ORDER BY score DESC, id LIMIT 200),
g AS (SELECT 'sym:' || ord AS id, CASE WHEN lower(name) = 'red' THEN 0.9 ELSE 0.7 END AS score FROM sym WHERE contains(lower(name), 'red') ORDER BY score DESC, id LIMIT 200),
v AS (SELECT 'SYM:' || vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {QS}) AS score, vec_id FROM embeddings ORDER BY score DESC, vec_id LIMIT 200),
h AS (SELECT id, score * 2.0 AS score, 'content' AS source, 0 AS o FROM c UNION ALL SELECT id, score * 1.5, 'vector', 1 FROM v UNION ALL SELECT id, score * 1.2, 'graph', 2 FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY lower(id) ORDER BY score DESC, o) AS r, list(source) OVER (PARTITION BY lower(id)) AS l FROM h)"""


@query(f"{ARMS} SELECT id, round(score, 6)::DOUBLE AS score, source, list_sort(list_distinct(l)) AS sources FROM (SELECT * FROM m WHERE r = 1 ORDER BY score DESC, id LIMIT 300)")
def q8_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Q8-Q12, W4, L9, U2."""
    v = V.search(table(spark, d, "embeddings"), [round(x, 1) for x in QV], "vec_id", "embedding", limit=200).select(F.concat(F.lit("SYM:"), F.col("id").cast("string")).alias("id"), "score")
    s = symbols(spark, d)
    return rounded(S.hybrid(S.content_arm(docs(spark, d), s, "red", 200), v, S.graph_arm(s, "red", 200), 300), "score")


@query(f"WITH {SYM} SELECT 'type' AS dimension, symbol_type AS value, count(*) AS n FROM sym GROUP BY 2 UNION ALL SELECT 'visibility', visibility, count(*) FROM sym GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM sym GROUP BY 2")
def a2_symbol_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A2, A3."""
    return K.statistics(symbols(spark, d))


@query(f"WITH {SYM} SELECT file_path, count(*) FILTER (symbol_type = 'class') AS n_class, count(*) FILTER (symbol_type = 'interface') AS n_interface, count(*) FILTER (symbol_type = 'enum') AS n_enum, count(*) FILTER (symbol_type = 'function') AS n_function, count(*) FILTER (symbol_type = 'method') AS n_method, count(*) AS total, CASE WHEN count(DISTINCT language) = 1 THEN min(language) ELSE 'mixed' END AS language FROM sym GROUP BY 1")
def a6_file_structure(spark: SparkSession, d: str) -> DataFrame:
    """A4, A5, A6, A8."""
    return K.per_file(symbols(spark, d))


@query(f"WITH {SYM} SELECT count(*) AS symbols, count(DISTINCT file_path) AS files, count(*) / greatest(count(DISTINCT file_path), 1) AS per_file FROM sym")
def a4_symbols_per_file(spark: SparkSession, d: str) -> DataFrame:
    n, f = F.count("*"), F.count_distinct("file_path")
    return symbols(spark, d).agg(n.alias("symbols"), f.alias("files"), (n / F.greatest(f, F.lit(1))).alias("per_file"))


@query(f"WITH {SYM} SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS package, count(DISTINCT file_path) AS files, count(*) AS symbols, count(*) FILTER (symbol_type = 'class') AS classes, count(*) FILTER (symbol_type = 'interface') AS interfaces, count(*) FILTER (symbol_type IN ('function', 'method')) AS functions, list(DISTINCT language ORDER BY language) AS languages FROM sym GROUP BY 1")
def a10_packages(spark: SparkSession, d: str) -> DataFrame:
    """A9, A10."""
    return K.per_package(symbols(spark, d), T.package_of(F.col("file_path")))


@query(f"WITH {EDGE} SELECT source, relation, list(DISTINCT target ORDER BY target) AS targets FROM edge GROUP BY 1, 2")
def a7_targets(spark: SparkSession, d: str) -> DataFrame:
    return K.targets_of(edges(spark, d))


@query(f"WITH {DOC} SELECT library, sum(length(content) // 4)::BIGINT AS tokens, count(*) AS documents FROM doc GROUP BY 1")
def a18_total_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A18, A22."""
    return docs(spark, d).groupBy("library").agg(F.sum(T.count_tokens(F.col("content"))).alias("tokens"), F.count("*").alias("documents"))


@query(f"WITH {SYM}, r AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(file_path, '^[^/]*/[^/]*'), symbol_type ORDER BY name, ord) AS k FROM sym WHERE symbol_type IN ('class', 'function')) SELECT regexp_extract(file_path, '^[^/]*/[^/]*') AS module, list(name ORDER BY name, ord) FILTER (symbol_type = 'class' AND k <= 5) AS classes, list(name ORDER BY name, ord) FILTER (symbol_type = 'function' AND k <= 5) AS functions FROM r GROUP BY 1")
def a24_modules(spark: SparkSession, d: str) -> DataFrame:
    """First classes and functions of each module (a top-k report)."""
    module = F.regexp_extract("file_path", r"^([^/]*/[^/]*)", 1)
    s = symbols(spark, d).where(F.col("symbol_type").isin("class", "function")).withColumn("module", module)
    top = S.by_rank(s, ["module", "symbol_type"], ["name", "ord"], 5)
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("symbol_type") == kind, F.struct("name", "ord")))), lambda x: x["name"])
    return top.groupBy("module").agg(pick("class").alias("classes"), pick("function").alias("functions"))


@query(f"WITH {LIB}, n AS (SELECT c_nationkey % 5 AS r, c_custkey, c_name FROM customer), f AS (SELECT c_custkey % 30 AS id, arg_max(c_name, c_custkey) AS project_name FROM customer GROUP BY 1) SELECT id, project_name FROM lib WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id, project_name FROM f")
def k1_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K1, K2, K4, K5: the last row of a key wins."""
    new = table(spark, d, "customer").select((F.col("c_custkey") % 30).alias("id"), F.col("c_name").alias("project_name"), "c_custkey")
    fresh = K.last_of(new, ["id"], "c_custkey").select("id", "project_name")
    return K.upsert(libraries(spark, d).select("id", "project_name"), fresh, ["id"])


@query(f"WITH {SYM} SELECT ord, name FROM sym WHERE library_id <> 7")
def k7_delete(spark: SparkSession, d: str) -> DataFrame:
    """K7, K8."""
    return K.delete(symbols(spark, d), F.col("library_id") == 7)[0].select("ord", "name")


@query(f"WITH {SYM}, {EDGE} SELECT source, target, relation FROM edge WHERE source IN (SELECT ord FROM sym WHERE symbol_type <> 'enum') AND target IN (SELECT ord FROM sym WHERE symbol_type <> 'enum')")
def k6_add_edges(spark: SparkSession, d: str) -> DataFrame:
    """K6, J12, U7."""
    n = symbols(spark, d).where("symbol_type <> 'enum'").select(F.col("ord").alias("id"))
    e = edges(spark, d)
    return K.add_edges(n, e.limit(0), e).select("source", "target", "relation")


@query(f"WITH {SYM}, f AS (SELECT file_path, arg_min(name, ord) AS first_name FROM sym GROUP BY 1) SELECT s.ord, f.first_name FROM sym s LEFT JOIN f ON f.file_path = s.file_path")
def w3_first_match(spark: SparkSession, d: str) -> DataFrame:
    """W3, J3-J11's first match."""
    s = symbols(spark, d)
    first = s.select("file_path", "ord", F.col("name").alias("first_name"))
    return K.first_match(s.select("file_path", F.col("ord").alias("row")), first, ["file_path"], ["ord"], ["first_name"]).select(F.col("row").alias("ord"), "first_name")


@query("SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(turn) OVER w AS next_turn, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """W6, W7."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("turn").over(w).alias("next_turn"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
