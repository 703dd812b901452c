"""Search, vectors, keyed tables, budgets."""

from pyspark.sql import functions as F

from codelode.operators import cypher, retrieval
from codelode.operators import search as S
from codelode.operators import tables as K
from codelode.operators import vectors as V


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_budgets(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([60, 50, 30, 20])], "k string, i int, n long")
    kept = retrieval.budget_skip(df, ["k"], 100, "n", [F.col("i")])
    assert sorted(rows(kept, "n", "total_tokens")) == [(30, 90), (60, 60)]
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([600, 500, 30])], "k string, i int, n long")
    cut = retrieval.budget_stop(df, ["k"], 800, "n", [F.col("i")])
    assert sorted(rows(cut, "used", "truncated")) == [(200, True), (600, False)]
    assert sorted(rows(retrieval.budget_stop(df, ["k"], 700, "n", [F.col("i")]), "used")) == [(600,)]


def test_merge_keeps_best(spark):
    hits = spark.createDataFrame([("doc1", 0.8, "content", 0), ("DOC1", 0.9, "vector", 1), ("x", 0.5, "graph", 2), ("x", 0.5, "content", 0)], "id string, score double, source string, ord int")
    assert sorted(rows(S.merge(hits), "id", "score", "source", "sources")) == [("DOC1", 0.9, "vector", ["content", "vector"]), ("x", 0.5, "content", ["content", "graph"])]


def test_vectors(spark):
    df = spark.createDataFrame([("close", [0.1, 0.2, 0.3, 0.4]), ("far", [0.9, 0.8, 0.7, 0.6])], "id string, vector array<double>")
    assert [x[0] for x in rows(V.search(df, [0.1, 0.2, 0.3, 0.4]), "id")] == ["close", "far"]
    assert [x[0] for x in rows(V.search(df, [0.1, 0.2, 0.3, 0.4], metric="euclid", limit=1), "id")] == ["close"]
    t = spark.createDataFrame([("ab",), ("  ",)], "s string").select(V.hash_embedding(F.col("s"), 4).alias("v"))
    a, b = (r.v for r in t.collect())
    assert [round(x, 6) for x in a] == [0.019996, 0.003999, 0.999792, 0.0] and b == [0.0] * 4
    wide = spark.createDataFrame([("ab",)], "s string").select(V.hash_embedding(F.col("s"), 40).alias("v")).first().v
    raw = [0.0] * 40
    for i, c in enumerate("ab"):
        raw[ord(c) * (i + 1) % 40] += 1
    raw[:3] = [0.01, 0.002, 0.5]
    size = sum(x * x for x in raw) ** 0.5
    assert [round(x, 9) for x in wide] == [round(x / size, 9) for x in raw]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, o int")
    assert sorted(rows(K.upsert(old, K.last_of(new, ["id"], "o").select("id", "v"), ["id"]), "id", "v")) == [(1, "a"), (2, "y"), (3, "z")]
    left, gone = K.delete(old, F.col("id") == 1)
    assert rows(left, "id") == [(2,)] and gone.first().deleted == 1


def test_cypher(spark):
    n = spark.createDataFrame([("node_1", ["Symbol", "Function"], {"name": "f"}), ("node_2", ["Symbol", "Class"], {"name": "C"})], "id string, labels array<string>, properties map<string,string>")
    e = spark.createDataFrame([("node_1", "node_2", "CALLS", {"line": "3"})], "source string, target string, type string, properties map<string,string>")
    run = lambda q, **p: cypher.run(q, n, e, p).collect()
    assert run("MATCH (n) RETURN count(n)")[0][0] == 2
    assert run("MATCH (n:Symbol:Class) RETURN n.id")[0][0] == "node_2"
    assert run("MATCH (n:Symbol {name: $x}) RETURN n LIMIT 5", x="f")[0]["id"] == "node_1"
    assert run("MATCH (a)-[r:CALLS]->(b) RETURN count(r)")[0][0] == 1
    assert run("MATCH ()-[r]->() RETURN r.line")[0]["line"] == "3"
    try:
        run("CREATE (n)")
        raise AssertionError
    except ValueError:
        pass


def test_budgets_in_rounds(spark):
    """Small batches, many keys, rows without tokens: as one plain loop for each key would have it."""
    import random

    rng = random.Random(4)
    data = [(k, i, rng.choice([0, 0, 1, 3, 7, 20, 60, 200])) for k in "abc" for i in range(80)] + [("d", 1, 500), ("e", 1, 0)]
    df = spark.createDataFrame(data, "k string, i int, n int")
    skip, stop = [], []
    for key in "abcde":
        total, running, over = 0, 0, False
        for k, i, n in data:
            if k != key:
                continue
            if total + n <= 150:
                total += n
                skip.append((k, i, n, total))
            if not over and running + n <= 150:
                running += n
                stop.append((k, i, n, False))
            elif not over:
                over = True
                if 150 - running > 20:
                    stop.append((k, i, 150 - running, True))
    for batch in (2, 256):
        assert sorted(map(tuple, retrieval.budget_skip(df, ["k"], 150, "n", [F.col("i")], batch).select("k", "i", "n", "total_tokens").collect())) == sorted(skip)
        assert sorted(map(tuple, retrieval.budget_stop(df, ["k"], 150, "n", [F.col("i")], 20, batch).select("k", "i", "used", "truncated").collect())) == sorted(stop)


def test_hash_embedding_counts(spark):
    """Few and many places are counted alike, and rows are dealt over all tasks."""
    from codelode.operators import vectors as V

    for dims in (8, 32, 64, 80):
        for text in ("a", "Hello hello wide World, again", "é" * 40):
            counts = [0.0] * dims
            for i, c in enumerate(text.lower()):
                counts[ord(c) * (i + 1) % dims] += 1
            w = len(text.split())
            raw = [w / 100, len(text) / 1000, w / len(text), *counts[3:]]
            size = sum(x * x for x in raw) ** 0.5
            got = spark.range(1).select(V.hash_embedding(F.lit(text), dims).alias("v")).first().v
            assert [round(x, 12) for x in got] == [round(x / size, 12) for x in raw]
    docs = spark.range(100, numPartitions=1).select("id", F.lit("some text").alias("content"))
    assert "RoundRobinPartitioning" in V.embed_documents(docs, 8)._jdf.queryExecution().executedPlan().toString()
