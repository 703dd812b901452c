"""Graph operators on small graphs worked out by hand, and the cluster's loops against one task's."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codelode.operators import graph as G
from codelode.operators import graph_build as B
from codelode.operators import kernels


def graph(spark, pairs, relation="imports"):
    e = spark.createDataFrame([(a, b, relation) for a, b in pairs], "source string, target string, relation string")
    return e, G.nodes_of(e)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_triangle(spark):
    e, n = graph(spark, [("A", "B"), ("B", "C"), ("C", "A")])
    c = G.cycles(e).first()
    assert (c.nodes, c.n_edges, c.impact) == (["A", "B", "C"], 3, 9.0)
    assert {r.impact for r in G.break_suggestions(e).collect()} == {0.0}
    x = G.xs_metrics(e, n).first()
    assert (x.xs_score, x.grade, x.avg_coupling) == (15.0, "A", 1.0)
    assert rows(G.hotspots(e, n), "id", "severity") == [("A", 5.0), ("B", 5.0), ("C", 5.0)]


def test_complete_graph(spark):
    e, n = graph(spark, [(a, b) for a in "ABCDE" for b in "ABCDE" if a != b])
    x = G.xs_metrics(e, n).first()
    assert (x.n_cycles, x.avg_coupling, x.xs_score, x.grade) == (1, 4.0, 25.0, "B")
    assert {r.severity for r in G.hotspots(e, n).where("reason = 'high_coupling'").collect()} == {4.0}


def test_chain(spark):
    e, n = graph(spark, [("A", "B"), ("B", "C")])
    assert G.cycles(e).count() == 0
    level = G.layers(e, n)
    assert rows(level, "id", "level") == [("A", 2), ("B", 1), ("C", 0)]
    m = G.dependency_matrix(e, level)
    assert rows(m, "source", "row", "col") == [("A", 2, 1), ("B", 1, 0)]
    assert G.is_layered(m).first().layered
    assert rows(G.coupling(e, n), "id", "ca", "ce", "instability") == [("A", 0, 1, 1.0), ("B", 1, 1, 0.5), ("C", 1, 0, 0.0)]
    assert rows(G.generations(e, n), "id", "level") == [("A", 0), ("B", 1), ("C", 2)]
    assert G.generations(*graph(spark, [("A", "B"), ("B", "A")])).count() == 0


def test_self_loop_and_empty(spark):
    e, n = graph(spark, [("A", "A")])
    assert G.cycles(e).first().impact == 3.0
    e, n = e.limit(0), n.limit(0)
    x = G.xs_metrics(e, n).first()
    assert (x.xs_score, x.grade) == (0.0, "A")
    assert G.layers(e, n).count() == 0


def test_loops_agree_with_one_task(spark):
    random.seed(5)
    pairs = [(random.randrange(30), random.randrange(30)) for _ in range(45)]
    e = spark.createDataFrame([(a, b, "x") for a, b in set(pairs)], "source long, target long, relation string")
    want = kernels.strong_components(pairs)
    assert dict(rows(G.large_strong_components(e.select("source", "target")), "id", "component")) == want
    near = dict(rows(G.layers(e, G.nodes_of(e)), "id", "level"))
    assert dict(rows(G.layers(e, G.nodes_of(e), small=0), "id", "level")) == near


def test_array_kernels():
    """Components and levels by arrays against the walk over dictionaries; a long chain; many cycles."""
    for seed in range(60):
        random.seed(seed)
        pairs = [(random.randrange(25), random.randrange(25)) for _ in range(random.randrange(1, 50))]
        ids, s, t = kernels.coded(*[pa.chunked_array([pa.array([str(x) for x in ends])]) for ends in zip(*pairs)])
        label, level = kernels.layer_codes(len(ids), s, t)
        want = kernels.strong_components([(str(a), str(b)) for a, b in pairs])
        depth = kernels.longest_depth({(want[str(a)], want[str(b)]) for a, b in pairs if want[str(a)] != want[str(b)]})
        names = ids.to_pylist()
        assert {n: names[c] for n, c in zip(names, label)} == want
        assert {n: int(v) for n, v in zip(names, level)} == {n: depth.get(want[n], 0) for n in names}
    many = np.arange(200_000)
    began = time.monotonic()
    assert kernels.peeled(20_001, many[:20_000], many[1:20_001]).tolist() == list(range(20_000, -1, -1))
    assert (kernels.component_codes(200_000, many, many ^ 1) == many // 2 * 2).all()
    assert kernels.elementary_circuits([(i, i ^ 1) for i in range(6_000)], 2, True) == ([[0, 1], [2, 3]], 3_000)
    assert time.monotonic() - began < 20


def test_loops_hand_over(spark):
    """Loops that stop at any size and hand the rest to one task."""
    random.seed(8)
    pairs = {(random.randrange(60), random.randrange(60)) for _ in range(80)}
    e = spark.createDataFrame([(a, b, "x") for a, b in pairs], "source long, target long, relation string")
    want = kernels.strong_components(pairs)
    for small in (20, 79):
        assert dict(rows(G.strong_components(e, small), "id", "component")) == want
        assert rows(G.layers(e, G.nodes_of(e), small=small), "id", "level") == rows(G.layers(e, G.nodes_of(e)), "id", "level")


def test_circuits():
    pairs = [(1, 2), (2, 3), (3, 1), (2, 1), (4, 4)]
    assert kernels.elementary_circuits(pairs, 9) == ([[1, 2], [1, 2, 3], [4]], 3)
    assert kernels.elementary_circuits(pairs, 1, True) == ([[1, 2]], 3)


def test_circuits_without_vain_ways():
    """Against plain walks; and a row of diamonds, each with a way back: many ways, few circuits."""
    for seed in range(80):
        random.seed(seed)
        pairs = sorted({(random.randrange(9), random.randrange(9)) for _ in range(random.randrange(1, 26))})
        want = []

        def walk(path):
            for a, b in pairs:
                if a == path[-1] and b == path[0]:
                    want.append(path)
                elif a == path[-1] and b > path[0] and b not in path:
                    walk([*path, b])

        for n in range(9):
            walk([n])
        assert kernels.elementary_circuits(pairs, 5, True) == (sorted(want)[:5], len(want))
    for many in (22, 200):
        row = [p for i in range(0, 3 * many, 3) for p in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3), (i + 3, i))]
        began = time.monotonic()
        assert kernels.elementary_circuits(row, 1, True) == ([[0, 1, 3]], 2 * many)
        assert time.monotonic() - began < 10


def test_circuits_are_dealt_out(spark):
    """Components are walked where they are dealt to; numbers and the total are those of the whole."""
    pairs = [(a + 10 * k, b + 10 * k) for k in range(40) for a, b in ((1, 2), (2, 3), (3, 1), (2, 1), (4, 4), (4, 1))]
    want, total = kernels.elementary_circuits(pairs, 50, True)
    e = spark.createDataFrame(pairs, "source long, target long")
    found = G.circuits(e, 50, counted=True)
    assert total == 120 and [(r["number"], r["nodes"], r["total"]) for r in found.orderBy("number").collect()] == [(i, c, total) for i, c in enumerate(want)]
    assert found.dtypes == [("number", "bigint"), ("nodes", "array<bigint>"), ("total", "bigint")]
    assert rows(G.circuits(e, 2), "number", "nodes") == [(0, [1, 2]), (1, [1, 2, 3])]
    assert G.circuits(e.where("source = 4 AND target = 1"), counted=True).count() == 0


def test_traversal_and_depth(spark):
    e, n = graph(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("X", "B")])
    start = n.where("id = 'A'")
    assert rows(G.reachable(e, start, 2), "id", "level") == [("A", 0), ("B", 1), ("C", 2)]
    assert rows(G.reachable(e, start, 2, "both"), "id") == [("A",), ("B",), ("C",), ("X",)]
    assert rows(G.limit_depth(e, n, 1)[1], "source", "target") == [("A", "B"), ("X", "B")]


def test_rules(spark):
    e, _ = graph(spark, [("ui.View", "db.Table"), ("db.Table", "ui.View"), ("ui.Ok", "db.Ok")])
    rules = {"layers": [{"name": "top", "above": "bottom", "patterns": ["ui.*"]}, {"name": "bottom", "patterns": ["db.*"]}], "forbidden": [{"from": "ui", "to": "*.Table", "reason": "no"}, {"from": "ui.*", "to": "db.Ok"}], "allowed": [{"from": "ui.Ok", "to": "db.Ok"}]}
    assert rows(G.check_rules(e, rules), "rule", "source") == [("forbidden", "ui.View"), ("layer_order", "db.Table")]
    assert G.check_rules(e, {}).count() == 0


def symbols(spark):
    schema = "library_id long, ord long, name string, qualified_name string, symbol_type string, file_path string, line_start int, language string, visibility string, bases array<string>, implements array<string>, parent_class string, is_abstract boolean"
    data = [
        (1, "ClassA", "ClassA", "class", "src/module1.py", ["BaseClass"], None), (2, "ClassB", "ClassB", "class", "src/module1.py", ["ClassA", "Foo"], None), (3, "BaseClass", "BaseClass", "class", "src/base.py", [], None),
        (4, "method_a", "ClassA.method_a", "method", "src/module1.py", [], "ClassA"), (5, "helper_func", "helper_func", "function", "src/utils.py", [], None), (6, "UserInterface", "UserInterface", "interface", "src/interfaces.ts", [], None),
    ]
    return spark.createDataFrame([(1, o, n, q, k, f, 1, "python", "public", b, [], p, False) for o, n, q, k, f, b, p in data], schema)


def dependencies(spark):
    schema = "library_id long, source string, target string, dependency_type string, file_path string, line int"
    return spark.createDataFrame([(1, "src/module1.py", "base", "import", "src/module1.py", 1), (1, "src/module1.py", "numpy", "import", "src/module1.py", 2), (1, "ClassA.method_a", "helper_func", "call", "src/module1.py", 3), (1, "ClassB.x", "BaseClass.y", "call", "src/module1.py", 4)], schema)


def test_built_graphs(spark):
    s, d = symbols(spark), dependencies(spark)
    edges = lambda kind: rows(B.build(kind, s, d).edges, "source", "target", "relation")
    assert edges("file") == [("src/module1.py", "numpy", "imports"), ("src/module1.py", "src/base.py", "imports")]
    assert edges("module") == [("src.module1", "numpy", "imports"), ("src.module1", "src.base", "imports")]
    assert edges("class") == [("src/module1.py:ClassA", "src/base.py:BaseClass", "inherits"), ("src/module1.py:ClassB", "external:Foo", "inherits"), ("src/module1.py:ClassB", "src/base.py:BaseClass", "calls"), ("src/module1.py:ClassB", "src/module1.py:ClassA", "inherits")]
    assert edges("function") == [("src/module1.py:ClassA.method_a", "src/utils.py:helper_func", "calls")]
    assert ("src/module1.py:ClassA", "src/module1.py:ClassA.method_a", "contains") in edges("symbol")
    assert B.build("class", s, d).nodes.count() == 5
    assert B.build("class", s, d).statistics().first().n_edges == 4
    assert edges("package") == []
    assert G.degrees(B.build("file", s, d).edges, B.build("file", s, d).nodes).where(F.col("id") == "src/module1.py").first().out_degree == 2
    outside = B.build("file", s, d).nodes.where("id = 'numpy'").first()
    assert (outside.label, outside.node_type) == ("numpy", "external_module")
    assert {r.label for r in B.build("module", s, d).nodes.collect()} == {"module1", "base", "utils", "interfaces", "numpy"}


def test_dump_graph(spark):
    """Targets by name, by what is below them, by path, and those that lead nowhere."""
    data = [(1, 1, "pkg.a.One", "pkg/a.py"), (1, 2, "pkg.b.Two.go", "pkg/b.py"), (1, 3, "Three", "lib/c.py"), (1, 4, "Three", "lib/d.py")]
    s = spark.createDataFrame([(*x, "python") for x in data], "library_id long, ord long, qualified_name string, file_path string, language string")
    targets = ["pkg.a", "pkg.b", "pkg.b.Two", "Three", "lib.c", "pkg", "os", "lib.x"]
    d = spark.createDataFrame([(1, "main.py", t, "import", "main.py") for t in targets], "library_id long, source string, target string, dependency_type string, file_path string")
    found = rows(B.build("dump", s, d).edges, "target")
    assert found == [("lib/c.py",), ("lib/d.py",), ("pkg/a.py",), ("pkg/b.py",)]
    one = lambda t: rows(B.build("dump", s, d.where(F.col("target") == t)).edges, "target")
    assert one("pkg.b") == one("pkg.b.Two") == [("pkg/b.py",)] and one("Three") == [("lib/d.py",)] and one("lib.c") == [("lib/c.py",)] and one("pkg") == [("pkg/a.py",)] and one("os") == []


def test_first_holder(spark):
    """The smallest path that holds a target, whatever the target's length."""
    paths = ["src/a/one.py", "src/b/one_more.py", "lib/ab.py", "x", "src/a/one.pyi"]
    wanted = ["one", "a", "ab", "src/b", "one.py", "none", "lib/ab.py", "lib/ab.pyx", "x", "xx", "/a/o", "py"]
    p = spark.createDataFrame([(k, x) for k in (1, 2) for x in paths[: 2 if k == 2 else None]], "library_id long, path string")
    w = spark.createDataFrame([(k, x) for k in (1, 2) for x in wanted], "library_id long, target string")
    want = {(k, t): min(h) for k in (1, 2) for t in wanted if (h := [x for x in paths[: 2 if k == 2 else None] if t in x])}
    assert {(r.library_id, r.target): r.found for r in B.first_holder(w, p).collect()} == want


def test_placed_pairs(spark):
    """Pairs stay where their source is: a join by it deals out only the other side."""
    e = spark.range(2000).select((F.col("id") % 90).alias("source"), (F.col("id") % 77).alias("target"))
    colour = e.select(F.col("source").alias("id")).distinct()
    plan = G._pairs(e).join(colour.hint("merge"), F.col("source") == F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source" not in plan.split("Scan ExistingRDD")[0]
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_weighted_edges(spark):
    """One join gives the edges of any least quantity."""
    from codelode.plans.base import edges, weighted_edges

    d = "/root/testdata/sf0.001"
    w = weighted_edges(spark, d)
    for least in (0, 5, 47):
        assert rows(w.where(F.col("most") >= least), "source", "target") == rows(edges(spark, d, least), "source", "target")
    e, _ = graph(spark, [("A", "B"), ("B", "B"), ("C", "C")])
    assert rows(G.coupling(e), "id", "ca", "ce") == rows(G.coupling(e, G.nodes_of(e)), "id", "ca", "ce") == [("A", 0, 1), ("B", 1, 0), ("C", 0, 0)]
