"""Queries of the scalar functions over documents (survey X, F13-F14, W1-W2, Q13-Q15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import retrieval
from codelode.plans.base import DOC, LIB, SYM, docs, libraries, query, symbols

W = f"WITH {DOC}"
LINE = "'(?m)^'"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


FILE = "regexp_extract(path, '[^/]*$')"
STEM = f"regexp_replace({FILE}, '\\.(md|markdown|rst|txt)$', '')"
H1, H2 = r"trim(regexp_extract(content, '(?m)^#\s+(.+)$', 1))", r"trim(regexp_extract(content, '(?m)^##\s+(.+)$', 1))"
TITLE = f"coalesce(nullif({H1}, ''), nullif({H2}, ''), {STEM})"
TOKENS = r"(len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) + length(regexp_replace(content, '[^\{\}\[\]().,;:!?@#$%^&*+\-=<>/\\|`~]', '', 'g')) // 2)"
PRIORITY = "CASE WHEN " + " OR ".join(f"{FILE.replace('path', 'lower(path)')} = '{p}' OR starts_with({FILE.replace('path', 'lower(path)')}, '{p.replace('.md', '')}')" for p in T.HIGH_PRIORITY) + " THEN 'high' WHEN " + _any(FILE.replace("path", "lower(path)"), T.LOW_PRIORITY) + " THEN 'low' ELSE 'normal' END"
_T, _R, _G = (_hits("lower(content)", w) for w in (T.TUTORIAL, T.REFERENCE, T.GUIDE))
CLASSIFY = f"CASE WHEN {FILE.replace('path', 'lower(path)')} IN ('readme.md', 'readme.rst', 'readme.txt', 'index.md', 'index.rst', 'overview.md') THEN 'overview' WHEN greatest({_T}, {_R}, {_G}) = 0 THEN 'guide' WHEN {_T} >= {_R} AND {_T} >= {_G} THEN 'tutorial' WHEN {_R} >= {_G} THEN 'reference' ELSE 'guide' END"
# no fences or headings in these documents, and every one has a first paragraph
QUALITY = f"""greatest(0.0, least(100.0, CASE WHEN {FILE.replace('path', 'lower(path)')} IN ('readme.md', 'index.md', 'readme.rst') THEN 30 WHEN contains(lower(path), '/docs/') OR contains(lower(path), '/doc/') THEN 25 WHEN NOT contains(path, '/') THEN 20 ELSE 15 END
  + CASE WHEN regexp_matches(content, '(?s)```(\\w+)?\n(.*?)```') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(content, '(?m)^#{{1,3}}\\s+') THEN 10 ELSE 0 END
  + CASE WHEN length(content) BETWEEN 500 AND 3000 THEN 5 WHEN length(content) < 200 THEN -10 WHEN length(content) > 10000 THEN -5 ELSE 0 END + CASE WHEN {TITLE} NOT IN ('', 'Documentation') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(content, '[^\\s.!?]') THEN 5 ELSE 0 END
  + CASE WHEN ends_with(path, '.md') THEN 20 WHEN ends_with(path, '.rst') THEN 15 WHEN ends_with(path, '.txt') THEN 10 ELSE 0 END))::DOUBLE"""
ASKED = "the thereti readme docs ing"
WORDS = ["the", "thereti", "readme", "docs", "ing"]
RELEVANCE = f"(least(40, 20 * {_hits(f'lower({TITLE})', WORDS)}) + least(20, 10 * {_hits('lower(path)', WORDS)}) + least(20, 5 * {_hits('lower(content)', WORDS)}))::DOUBLE"


@query(f"{W} SELECT id, length(content) // 4 AS tokens, {TOKENS}::BIGINT AS estimated, substr(sha256(path || ':' || '1' || ':' || substr(content, 1, 100)), 1, 16) AS chunk_id, substr(sha256(content), 1, 16) AS content_hash, substr(sha256(path || ':' || substr(content, 1, 100)), 1, 16) AS doc_key FROM doc")
def x3_tokens_and_keys(spark: SparkSession, d: str) -> DataFrame:
    """X3-X7."""
    c, p = F.col("content"), F.col("path")
    return docs(spark, d).select("id", T.count_tokens(c).alias("tokens"), T.estimate_tokens(c).alias("estimated"), T.chunk_id(c, p, F.lit(1)).alias("chunk_id"), T.content_hash(c).alias("content_hash"), T.document_key(c, p).alias("doc_key"))


@query(f"{W} SELECT id, {TITLE} AS title FROM doc")
def x9_title(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", T.title(F.col("content"), F.col("path")).alias("title"))


@query(f"{W} SELECT id, {QUALITY} AS quality_score FROM doc")
def x14_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", T.quality_score(F.col("content"), F.col("path")).alias("quality_score"))


@query(f"{W} SELECT id, {RELEVANCE} AS relevance FROM doc")
def x15_relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", T.relevance_score(F.col("content"), F.col("path"), ASKED).alias("relevance"))


@query(f"{W} SELECT id, {CLASSIFY} AS document_type, {PRIORITY} AS priority FROM doc")
def x16_classify(spark: SparkSession, d: str) -> DataFrame:
    """X16, X17."""
    return docs(spark, d).select("id", T.classify(F.col("content"), F.col("path")).alias("document_type"), T.priority(F.col("path")).alias("priority"))


@query(f"{W}, w AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS n FROM doc) SELECT id, {QUALITY} AS quality_score, {CLASSIFY} AS document_type, greatest(1, round_even(n / 200, 0))::INT AS reading_time, 0 AS snippet_count, n::INT AS word_count FROM w")
def x18_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = docs(spark, d).select("id", T.metadata(F.col("content"), F.col("path")).alias("m"))
    return m.select("id", "m.quality_score", "m.document_type", "m.reading_time", "m.snippet_count", "m.word_count")


@query(f"{W} SELECT id, path FROM doc WHERE NOT {_any('lower(path)', T.CHANGELOGS)} AND NOT {_any('lower(path)', T.LOCK_FILES)} AND (starts_with(path, 'docs/') OR contains(path, '/docs/'))")
def f13_indexable_files(spark: SparkSession, d: str) -> DataFrame:
    """F13, S14."""
    return docs(spark, d).where(~T.excluded(F.col("path")) & T.indexable(F.col("path"), folders=["docs"])).select("id", "path")


@query(f"{W} SELECT id, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') AS package, regexp_replace(replace(path, '/', '.'), '\\.(py|js|ts)$', '') AS module, CASE WHEN ends_with(path, '.md') THEN 'markdown' WHEN ends_with(path, '.rst') THEN 'restructuredtext' ELSE 'text' END AS content_type FROM doc")
def x21_path_parts(spark: SparkSession, d: str) -> DataFrame:
    """X21, X22, X33."""
    p = F.col("path")
    return docs(spark, d).select("id", T.package_of(p).alias("package"), T.module_of(p).alias("module"), T.content_type(p).alias("content_type"))


@query(f"{W} SELECT id, least(1.0, 0.5 + 0.1 * ((length(content) - length(replace(content, 'the', ''))) / 3))::DOUBLE AS score, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview FROM doc WHERE contains(content, 'the')")
def x34_content_match(spark: SparkSession, d: str) -> DataFrame:
    """X34, X35."""
    c = F.col("content")
    return docs(spark, d).where(c.contains("the")).select("id", T.content_score(c, "the").alias("score"), T.preview(c, dots=True).alias("preview"))


@query(f"WITH {SYM} SELECT ord, split_part(qualified_name, '.', 1) AS class_name, 'python' AS lang_by_ext, CASE WHEN name LIKE '%enum%' THEN 'x' ELSE 'class' END AS kind, line_end - line_start + 1 AS n_lines, file_path ILIKE '%/test/%' AS is_test, regexp_replace(qualified_name, '[^A-Za-z0-9_]', '_', 'g') AS diagram_id FROM sym")
def x23_symbol_names(spark: SparkSession, d: str) -> DataFrame:
    """X23, X27, X28, X36, F15, C7."""
    s, n = symbols(spark, d), F.col("name")
    return s.select("ord", T.class_of(F.col("qualified_name")).alias("class_name"), T.language_of(F.col("file_path")).alias("lang_by_ext"), T.type_kind(n, F.col("language")).alias("kind"), (F.col("line_end") - F.col("line_start") + 1).alias("n_lines"), T.test_symbol(n, F.col("symbol_type"), F.col("file_path")).alias("is_test"), T.diagram_id(F.col("qualified_name")).alias("diagram_id"))


@query(f"WITH {LIB} SELECT id, 'github' AS provider, group_name AS parsed_group, project_name AS parsed_project FROM lib")
def x31_repository_ids(spark: SparkSession, d: str) -> DataFrame:
    """X31, X32, F11."""
    rows = libraries(spark, d).withColumn("repo", F.concat_ws("/", "group_name", "project_name"))
    return rows.select("id", T.provider_of(F.col("repo")).alias("provider"), T.repository_parts(F.concat(F.lit("/"), F.col("repo")))["group_name"].alias("parsed_group"), T.repository_parts(F.concat(F.lit("/"), F.col("repo")))["project_name"].alias("parsed_project"))


@query(
    f"""WITH RECURSIVE {DOC}, s AS (SELECT id, library, length(content) // 4 AS tokens, row_number() OVER (PARTITION BY library ORDER BY {QUALITY} DESC, id) AS r FROM doc),
g AS (SELECT library, 0::BIGINT AS r, 0::BIGINT AS total, false AS keep FROM (SELECT DISTINCT library FROM s) UNION ALL
SELECT g.library, s.r, g.total + CASE WHEN g.total + s.tokens <= 4000 THEN s.tokens ELSE 0 END, g.total + s.tokens <= 4000 FROM g JOIN s ON g.library = s.library AND s.r = g.r + 1)
SELECT s.id, s.library, s.tokens, g.total AS total_tokens FROM g JOIN s ON g.library = s.library AND g.r = s.r WHERE keep"""
)
def w1_budget(spark: SparkSession, d: str) -> DataFrame:
    """Documents by quality until the token budget is full; what doesn't fit is skipped."""
    c, p = F.col("content"), F.col("path")
    rows = docs(spark, d).select("id", "library", T.count_tokens(c).alias("tokens"), T.quality_score(c, p).alias("score"))
    return retrieval.budget_skip(rows, ["library"], 4000, "tokens", [-F.col("score"), F.col("id")]).select("id", "library", "tokens", "total_tokens")


@query(
    f"""{W}, s AS (SELECT id, library, length(content) // 4 AS tokens FROM doc), r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY library ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s),
b AS (SELECT *, min(CASE WHEN before + tokens > 2000 THEN id END) OVER (PARTITION BY library) AS stop FROM r)
SELECT id, library, CASE WHEN before + tokens <= 2000 THEN tokens ELSE 2000 - before END AS used, before + tokens > 2000 AS truncated FROM b WHERE id < coalesce(stop, id + 1) OR (id = stop AND 2000 - before > 100)"""
)
def w2_budget_stop(spark: SparkSession, d: str) -> DataFrame:
    """Running total, stop at the first overflow, cut its document."""
    rows = docs(spark, d).select("id", "library", T.count_tokens(F.col("content")).alias("tokens"))
    return retrieval.budget_stop(rows, ["library"], 2000, "tokens", [F.col("id")]).select("id", "library", "used", "truncated")


@query(
    f"""WITH RECURSIVE {DOC}, s AS (SELECT id, path, library, length(content) // 4 AS tokens, 0.5 * {QUALITY} + 0.5 * {RELEVANCE} AS score FROM doc WHERE library = 'src1'), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, id) AS r FROM s),
g AS (SELECT 0::BIGINT AS r, 0::BIGINT AS total, false AS keep UNION ALL SELECT n.r, g.total + CASE WHEN g.total + n.tokens <= 8000 THEN n.tokens ELSE 0 END, g.total + n.tokens <= 8000 FROM g JOIN n ON n.r = g.r + 1)
SELECT n.id, n.path, n.score, n.tokens FROM g JOIN n ON g.r = n.r WHERE keep"""
)
def q13_documentation(spark: SparkSession, d: str) -> DataFrame:
    """Q13: token-budgeted retrieval for one library."""
    return retrieval.documentation(docs(spark, d), "src1", ASKED, 8000).select("id", "path", "score", "tokens")


@query(
    f"""{W}, s AS (SELECT id, library, path, {TITLE} AS title, {QUALITY} AS q, row_number() OVER (PARTITION BY library ORDER BY {QUALITY} DESC, path, id) AS r FROM doc)
SELECT library, string_agg('- ' || title || ' (' || path || ')', chr(10) ORDER BY r) AS summary FROM s WHERE r <= 10 GROUP BY library"""
)
def q14_summary_format(spark: SparkSession, d: str) -> DataFrame:
    """Q14: a library's ten best documents as a list."""
    return retrieval.summary_format(docs(spark, d), 10)
