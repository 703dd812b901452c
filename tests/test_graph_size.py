"""A graph of more edges than jobs of loops were once started for is still one task's work."""

from pyspark.sql import functions as F

from codelode.operators import graph as G


def test_copies_of_a_graph_need_no_loops(spark, monkeypatch):
    def loops(*_):
        raise AssertionError("loops over a graph that one task holds")

    monkeypatch.setattr(G, "large_strong_components", loops)
    copies, size = 50_001, 5  # each copy: a cycle of three, a way out of it, and one into it
    at = F.col("id") * size
    steps = [(0, 1), (1, 2), (2, 0), (2, 3), (4, 0)]
    e = spark.range(copies).select(F.explode(F.array(*[F.struct((at + a).alias("source"), (at + b).alias("target")) for a, b in steps])).alias("e")).select("e.*")
    c = G.strong_components(e)
    assert c.count() == copies * size
    assert c.where(F.col("component") == F.col("id") - F.when(F.col("id") % size < 3, F.col("id") % size).otherwise(0)).count() == copies * size
    assert [r["n_nodes"] for r in G.cycles(e, c).groupBy("n_nodes", "n_edges").count().where(f"count = {copies}").collect()] == [3]
    assert {r["level"]: r["count"] for r in G.layers(e, G.nodes_of(e)).groupBy("level").count().collect()} == {0: copies, 1: 3 * copies, 2: copies}
