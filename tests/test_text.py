"""Scalar functions against values worked out by hand."""

import uuid

from pyspark.sql import functions as F

from codelode.functions import enrich as N
from codelode.functions import text as T
from codelode.functions.fuzzy import fuzzy_tier

README = "# Test Documentation\n\nThis is a small library for tests.\n\n## Usage\n\nCall it like this, with care for the order:\n\n```python\nimport x\nx.run()\n```\n"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], [*values]).select(column.alias("x")).first()["x"]


def test_tokens_and_keys(spark):
    assert one(spark, T.estimate_tokens(F.col("s")), s="def foo(): return {'key': value}") == 8
    assert one(spark, T.chunk_id(F.col("s"), F.lit("a.py"), F.lit(1)), s="hello") == "76876b6b31681b9f"
    for name in ("a", "library:x", "é" * 30):
        assert one(spark, T.uuid5_url(F.col("s")), s=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_edit_distance_tiers(spark):
    rows = [("fastapi", "a", None), ("fastapi-users", "a", None), ("my-fastapi", "a", None), ("web", "a", "built on FastAPI"), ("web", "fastapi-org", None), ("fastap", "a", None), ("fstpi", "a", None), ("xyz", "a", None)]
    df = spark.createDataFrame(rows, "n string, g string, d string").select(fuzzy_tier("fastapi", F.col("n"), F.col("g"), F.col("d")).alias("t"))
    got = [(round(r.t.score, 6), r.t.match_type, r.t.matched_field) if r.t else None for r in df.collect()]
    assert got == [(1.0, "exact", "name"), (0.9, "starts_with", "name"), (0.8, "contains", "name"), (0.6, "contains", "description"), (0.5, "contains", "group"), (0.833333, "fuzzy", "name"), (0.6, "fuzzy", "name"), None]


def test_markdown_document(spark):
    p = F.lit("README.md")
    c = F.col("c")
    m = one(spark, T.metadata(c, p), c=README)
    # 30 read-me, 15 + 10 code, 10 headings, -10 short, 5 title, 5 description, 20 extension
    assert (m.quality_score, m.document_type, m.reading_time, m.snippet_count, m.has_code_examples) == (85.0, "overview", 1, 1, True)
    assert one(spark, T.title(c, p), c=README) == "Test Documentation"
    assert one(spark, T.title(c, F.lit("a/b.rst")), c="no heading") == "b"
    assert one(spark, T.description(c), c=README) == "This is a small library for tests."
    assert [tuple(x) for x in one(spark, T.snippets(c), c=README)] == [("python", "import x\nx.run()")]
    assert one(spark, T.priority(p), c="") == "high"
    assert one(spark, T.priority(F.lit("docs/INSTALL.md")), c="") == "low"


def test_low_value_snippets(spark):
    for code, language, want in (("$ pip install x", "bash", True), ("x = 1", "bash", False), ("pip install x", "python", False), ("# note\ncd src", "sh", True), ("cd a\ncd b\ncd c", "sh", False)):
        assert one(spark, T.low_value(F.col("c"), F.lit(language)), c=code) is want


def test_paths_and_names(spark):
    s = F.col("s")
    for f, value, want in (
        (T.package_of, "a/b/c.py", "a/b"), (T.package_of, "c.py", "."), (T.module_of, "a/b.ts", "a.b"), (T.class_of, "Foo.bar", "Foo"), (T.class_of, "foo.bar", None), (T.parent_class, "m.Cls.run", "Cls"), (T.parent_class, "m.run", None),
        (T.return_type, "f(x) -> int", "int"), (T.return_type, "f(x): Foo", "Foo"), (T.return_type, "f", None), (T.language_of, "x/y.kt", "kotlin"), (T.normal_path, "tmpab1.js", "<transpiled>.js"), (T.normal_path, "src/a.js", "src/a.js"),
        (T.safe_int, "12", 12), (T.safe_int, "x", 0), (T.provider_of, "/home/x", "local"), (T.provider_of, "a/b", "github"), (T.provider_of, "a/b/c", "gitlab"), (T.excluded, "docs/LICENSE.md", True), (T.excluded, "a/docs/license.md", False), (T.excluded, "a/NEWS.txt", True),
        (T.xml_escape, "<a&'b'>", "&lt;a&amp;&apos;b&apos;&gt;"), (T.diagram_id, "1a.b", "n_1a_b"), (T.mapper_artifact, "aMetaB", True), (T.mapper_artifact, "meta", False), (T.identifier, "a b", False),
    ):
        assert one(spark, f(s), s=value) == want, (f.__name__, value)
    import fnmatch
    import re

    for pattern in ("*.controller.*", "a?c", "[ab]*", "[!a]x", "x[", "a.b"):
        for name in ("x.controller.y", "abc", "bx", "ax", "x[", "a.b", "axb"):
            assert bool(re.match(T.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


def test_enrichment(spark):
    code = '"""Loads things.\nMore."""\nimport json\nfrom os.path import join\nclass UserService:\n    # note\n    def get_user(self):\n        try:\n            return 1\n        except ValueError:\n            raise\n'
    c = F.col("c")
    assert one(spark, N.title(c, F.lit("a.py")), c=code) == "Loads things."
    assert one(spark, N.title(c, F.lit("x/my_mod.py")), c="x = 1") == "My Mod"
    assert one(spark, N.description(c), c="class A: pass\ndef f(): pass\ndef g(): pass") == "Contains 1 class(es); Contains 2 function(s)"
    assert "service" in one(spark, N.categories(c), c=code)
    assert one(spark, N.categories(c), c="x") == ["utility"]
    assert one(spark, N.concepts(c), c=code) == ["serialization", "error-handling"]
    assert one(spark, N.import_names(c, F.lit("python")), c=code) == ["json", "os.path"]
    assert one(spark, N.keywords(c), c=code) == ["UserService", "get_user", "json"] or "UserService" in one(spark, N.keywords(c), c=code)
    assert abs(one(spark, N.quality(c), c=code) - 0.65) < 1e-9
    n = F.col("n")
    for name, want in (("get_user_name", "Retrieves user name"), ("on_click", "Handler for click event"), ("widget", "Function widget")):
        assert one(spark, N.symbol_description(n, F.lit("function"), F.lit(None).cast("string")), n=name) == want
    assert one(spark, N.symbol_tags(n, F.lit("method")), n="__init__") == ["magic", "method", "private"]


def test_options():
    from codelode.functions import options as O

    assert O.arguments({"libraryId": "/a/b", "maxTokens": 5, "max_tokens": 7, "page": 1}) == {"repository": "/a/b", "max_tokens": 7, "page": 1}
    assert O.included("code, Tests,odd") == {"include_code": True, "include_symbols": False, "include_diagrams": False, "include_tests": True, "include_examples": False}
    assert all(O.included(["all"]).values()) and not any(O.included(None).values())
    assert O.capped(500, "page_size") == 100
