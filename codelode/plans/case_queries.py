"""Small literal tables that reach the branches which the driver's tables don't: the expected
values are written out by the rules, not computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.plans.base import query


def _values(rows: list[tuple], names: str) -> str:
    def one(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names})"


SYMBOLS = [  # name, path, line, kind; valid, mapper artifact, test, identifier
    ("run", "src/a.py", 3, "function", True, False, False, True), ("<init>", "src/a.py", 3, "function", False, True, False, False), ("myMetaInfo", "src/a.py", 1, "class", True, True, False, True),
    ("x", "N/A", 0, "function", False, False, False, False), ("x2", "unknown", 5, "function", True, False, False, True), ("TestThing", "lib/a.py", 1, "class", True, False, True, True),
    ("go", "pkg/tests/a.py", 1, "function", True, False, True, True), ("test_it", "a.py", 2, "function", True, False, True, True), ("9lives", "a.py", 1, "function", True, False, False, False), ("", "a.py", 1, "function", False, True, False, False),
]


@query(_values([(r[0], r[1], *r[4:]) for r in SYMBOLS], "name, path, valid, artifact, test, identifier"))
def f15_symbol_cases(spark: SparkSession, d: str) -> DataFrame:
    """F15, F16, F18."""
    rows = spark.createDataFrame([r[:4] for r in SYMBOLS], "name string, path string, line int, kind string")
    n, p = F.col("name"), F.col("path")
    return rows.select("name", "path", T.valid_symbol(n, p, F.col("line")).alias("valid"), T.mapper_artifact(n).alias("artifact"), T.test_symbol(n, F.col("kind"), p).alias("test"), T.identifier(n).alias("identifier"))


NAMES = [
    ("__secret", "python", "private", "class"), ("_half", "python", "protected", "class"), ("__init__", "python", "public", "class"), ("#inner", "javascript", "private", "class"), ("_x", "ruby", "public", "class"),
    ("_x", "java", "private", "class"), ("IThing", "java", "public", "interface"), ("Item", "java", "public", "class"), ("ThingInterface", "kotlin", "public", "interface"), ("MyProtocol", "python", "public", "interface"), ("ColorEnum", "kotlin", "public", "enum"),
]


@query(_values(NAMES, "name, language, visibility, kind"))
def x26_name_cases(spark: SparkSession, d: str) -> DataFrame:
    """X26, X27."""
    rows = spark.createDataFrame([r[:2] for r in NAMES], "name string, language string")
    n, k = F.col("name"), F.col("language")
    return rows.select("name", "language", T.visibility(n, k).alias("visibility"), T.type_kind(n, k).alias("kind"))


REPOSITORIES = [("github://a/b", "github", "a", "b"), ("gitlab://a/b/c", "gitlab", "a/b", "c"), ("a/b", "github", "a", "b"), ("a/b/c", "gitlab", "a/b", "c"), ("/srv/code", "local", "srv", "code"), ("~/w", "local", "~", "w"), ("./here/x", "local", "./here", "x")]


@query(_values(REPOSITORIES, "repo, provider, group_name, project_name"))
def x31_repository_cases(spark: SparkSession, d: str) -> DataFrame:
    """F11, X31, X32."""
    rows, r = spark.createDataFrame([x[:1] for x in REPOSITORIES], "repo string"), F.col("repo")
    return rows.select("repo", T.provider_of(r).alias("provider"), T.repository_parts(r)["group_name"].alias("group_name"), T.repository_parts(r)["project_name"].alias("project_name"))


PATHS = [("a.py", "python"), ("lib/B.JS", "javascript"), ("x/y.ts", "typescript"), ("m.go", "go"), ("M.java", "java"), ("k.kt", "kotlin"), ("z.none", "unknown"), ("Makefile", "unknown")]


@query(_values(PATHS, "path, language"))
def x28_language_cases(spark: SparkSession, d: str) -> DataFrame:
    """X28."""
    return spark.createDataFrame([x[:1] for x in PATHS], "path string").select("path", T.language_of(F.col("path")).alias("language"))


TEXTS = [  # path, text; title, description, score, snippets, words
    ("README.md", "# Title\n\nText of it.\n\n```python\nx = 1\n```\n", "Title", "Text of it.", 85.0, 1, 5),
    ("a/b.txt", "", "b", "", 20.0, 0, 0),
    ("docs/x.rst", "```\ncode\n```", "x", "", 50.0, 1, 0),
    ("lib/doc/y.md", "Plain first.\nsecond line\n\nOther.", "y", "Plain first. second line.", 45.0, 0, 5),
    ("z.md", "## Only second\nThis guide shows how. It works! Really? Fourth one.\n", "Only second", "how. It works. Really.", 50.0, 0, 12),
]


@query(_values([(r[0], *r[2:]) for r in TEXTS], "path, title, description, score, snippets, words"))
def x14_text_cases(spark: SparkSession, d: str) -> DataFrame:
    """Headings, fences, fillers, empty texts."""
    rows = spark.createDataFrame([r[:2] for r in TEXTS], "path string, content string")
    c, p = F.col("content"), F.col("path")
    m = rows.select("path", T.title(c, p).alias("title"), T.description(c).alias("description"), T.quality_score(c, p).alias("score"), T.metadata(c, p).alias("m"))
    return m.select("path", "title", "description", "score", F.col("m.snippet_count").alias("snippets"), F.col("m.word_count").alias("words"))
