"""Graph analytics over edge tables (survey A12-A17, G8-G9, G14-G34, J12-J14).

Edges have source, target and relation; nodes have id. Loops run on the cluster and end every
round in the shared folder. A graph of at most `small` edges, which is counted first, is handed to
a single task instead, where a loop of jobs would cost more than the work; so is what a loop has
left once that is no more than `small`. Such a task works on arrays, about 110 bytes an edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import kernels
from codelode.runtime import cut, numbered, shuffle_width

SMALL = 16_000_000


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both known."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that nothing points to; all nodes if there are none."""
    free = nodes.select("id").join(edges.select(F.col("target").alias("id")), "id", "left_anti")
    return free if not free.isEmpty() else nodes.select("id")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """in_degree, out_degree and total of every node, all edges counted."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("target").alias("id"), F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    known = nodes.select("id").join(sums, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return known.withColumn("total", F.col("in_degree") + F.col("out_degree"))


def _kind(edges: DataFrame) -> str:
    return dict(edges.dtypes)["source"]


def _solved(pairs: DataFrame, solve: Callable[[int, np.ndarray, np.ndarray], list[np.ndarray]], schema: str, places: int) -> DataFrame:
    """Columns that one task finds for every node, after its id; the first `places` of them are
    nodes' places, for which ids are given."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            ids, source, target = kernels.coded(t["source"], t["target"])
            found = solve(len(ids), source, target)
            columns = [ids, *[ids.take(pa.array(c)) if i < places else pa.array(c) for i, c in enumerate(found)]]
            yield from pa.table(columns, names).to_batches(65_536)

    return cut(pairs.select("source", "target").repartition(1).mapInArrow(run, schema))


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct pairs in the shared folder, those of a source in one part."""
    return cut(edges.select("source", "target").repartition(shuffle_width(edges.sparkSession), "source").distinct(), placed=True)


def _components(pairs: DataFrame) -> DataFrame:
    return _solved(pairs, lambda *g: [kernels.component_codes(*g)], f"id {_kind(pairs)}, component {_kind(pairs)}", 1)


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Id and component (its smallest id) of every node."""
    pairs = _pairs(edges)
    return _components(pairs) if pairs.count() <= small else large_strong_components(pairs, small)


def large_strong_components(pairs: DataFrame, small: int = 0) -> DataFrame:
    """Colouring: the smallest id that reaches a node colours it; what the colour's namesake is
    reached from within the colour is one component. Ends that can't be on a cycle go first. Edges
    stay where their source is, and a round follows only those of nodes that have changed."""
    width = shuffle_width(pairs.sparkSession)
    nodes = cut(nodes_of(pairs))
    left, done = pairs.where("source <> target"), None
    while True:
        many = left.count()
        if many <= small:
            break
        ends = cut(left.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(left.select("target", F.lit(0), F.lit(1))).groupBy("id").agg((F.max("o") + F.max("i") == 2).alias("inner")), placed=True)
        keep = ends.where("inner").select("id")
        if not ends.where("NOT inner").isEmpty():  # nodes without a way in or out are components themselves
            left = cut(within(left, keep).repartition(width, "source"), placed=True)
            continue
        colour = keep.select("id", F.col("id").alias("colour"))
        active = colour
        while True:
            reach = left.join(active, left.source == active.id).groupBy("target").agg(F.min("colour").alias("new"))
            after = cut(colour.join(reach, colour.id == reach.target, "left").select("id", F.least("colour", F.coalesce("new", "colour")).alias("colour"), F.coalesce(F.col("new") < F.col("colour"), F.lit(False)).alias("changed")), placed=True)
            colour, active = after.select("id", "colour"), after.where("changed").select("id", "colour")
            if active.isEmpty():
                break
        s, t = colour.select(F.col("id").alias("source"), F.col("colour").alias("cs")), colour.select(F.col("id").alias("target"), F.col("colour").alias("ct"))
        inner = cut(left.join(s, "source").join(t, "target").where("cs = ct").select("source", "target", "cs").repartition(width, "target"), placed=True)
        found = cut(colour.where("id = colour"), placed=True)
        fresh = found
        while True:
            back = inner.join(fresh, inner.target == fresh.id).select(F.col("source").alias("id"), F.col("cs").alias("colour")).dropDuplicates(["id"])  # a node has one colour
            fresh = cut(back.join(found, "id", "left_anti"), placed=True)
            if fresh.isEmpty():
                break
            found = cut(found.union(fresh.select("id", "colour")).repartition(width, "id"), placed=True)
        part = found.select("id", F.col("colour").alias("component"))
        done = part if done is None else done.union(part)
        rest = colour.select("id").join(found, "id", "left_anti")
        left = cut(within(left, rest).repartition(width, "source"), placed=True)
    if many:
        part = _components(left)
        done = part if done is None else done.union(part)
    if done is None:
        return nodes.select("id", F.col("id").alias("component"))
    return cut(nodes.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def cycles(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Component, nodes, n_nodes, n_edges and impact of each cycle: components of more
    than one node, and nodes that point to themselves."""
    c = components if components is not None else strong_components(edges)
    s, t = c.select(F.col("id").alias("source"), F.col("component").alias("cs")), c.select(F.col("id").alias("target"), F.col("component").alias("ct"))
    inner = edges.join(s, "source").join(t, "target").where("cs = ct").groupBy("cs").agg(F.count("*").alias("n_edges"))
    # only components with edges inside make lists
    members = c.join(inner.select("cs"), c.component == F.col("cs"), "left_semi").groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    return members.join(inner, members.component == inner.cs).select("component", "nodes", F.size("nodes").alias("n_nodes"), "n_edges", (2.0 * F.size("nodes") + 1.0 * F.col("n_edges")).alias("impact"))


def cycle_members(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """component and id of every node of a cycle, a row each: cycles of any size without lists."""
    c = components if components is not None else strong_components(edges)
    s, t = c.select(F.col("id").alias("source"), F.col("component").alias("cs")), c.select(F.col("id").alias("target"), F.col("component").alias("ct"))
    inner = edges.join(s, "source").join(t, "target").where("cs = ct").select(F.col("cs").alias("component")).distinct()
    return c.join(inner, "component", "left_semi").select("component", "id")


def break_suggestions(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Edges inside cycles by what removing them costs."""
    c = components if components is not None else strong_components(edges)
    s, t = c.select(F.col("id").alias("source"), F.col("component").alias("cs")), c.select(F.col("id").alias("target"), F.col("component").alias("ct"))
    fan_in = edges.groupBy("target").agg(F.count("*").alias("fan_in"))
    cost = F.col("fan_in") + F.when(F.col("relation").isin("inherits", "implements"), 10).when(F.col("relation").isin("imports", "uses"), -1).otherwise(0)
    return edges.join(s, "source").join(t, "target").where("cs = ct").join(fan_in, "target").select("source", "target", "relation", cost.cast("double").alias("impact"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    s, t = components.select(F.col("id").alias("source"), F.col("component").alias("cs")), components.select(F.col("id").alias("target"), F.col("component").alias("ct"))
    return edges.join(s, "source").join(t, "target").where("cs <> ct").select(F.col("cs").alias("source"), F.col("ct").alias("target")).distinct()


def layers(edges: DataFrame, nodes: DataFrame, components: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """Id and level: 0 for what depends on nothing, else one more than the highest level
    it depends on; a cycle's nodes share a level."""
    if components is None:
        pairs = _pairs(edges)
        if pairs.count() <= small:
            named = _solved(pairs, lambda *g: [kernels.layer_codes(*g)[1]], f"id {_kind(pairs)}, level long", 0)
            return nodes.select("id").join(named, "id", "left").select("id", F.coalesce("level", F.lit(0)).cast("long").alias("level"))
        edges, components = pairs, large_strong_components(pairs, small)
    c, width = cut(components), shuffle_width(edges.sparkSession)
    dag = cut(condensed(edges, c).repartition(width, "target"), placed=True)
    if dag.count() <= small:
        depth = _solved(dag, lambda *g: [kernels.peeled(*g)], f"component {_kind(edges)}, level long", 0)
    else:
        depth = cut(nodes_of(dag).repartition(width, "id").select(F.col("id").alias("component"), F.lit(0).cast("long").alias("level")), placed=True)
        active = depth
        while True:  # only what has risen lifts what depends on it
            up = dag.join(active, dag.target == active.component).groupBy("source").agg((F.max("level") + 1).alias("new"))
            after = cut(depth.join(up, depth.component == up.source, "left").select("component", F.coalesce(F.col("new") > F.col("level"), F.lit(False)).alias("risen"), F.greatest("level", F.coalesce("new", "level")).alias("level")), placed=True)
            depth, active = after.select("component", "level"), after.where("risen").select("component", "level")
            if active.isEmpty():
                break
    named = c.join(depth, "component", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))
    return nodes.select("id").join(named, "id", "left").select("id", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def dependency_matrix(edges: DataFrame, level: DataFrame) -> DataFrame:
    """Row, col of every distinct edge, nodes numbered by level and id."""
    place = cut(numbered(level, ["level", "id"], "place").select("id", "place"))
    r, c = place.select(F.col("id").alias("source"), F.col("place").alias("row")), place.select(F.col("id").alias("target"), F.col("place").alias("col"))
    return edges.select("source", "target").distinct().join(r, "source").join(c, "target").select("source", "target", "row", "col")


def is_layered(matrix: DataFrame) -> DataFrame:
    """No cell above the diagonal."""
    return matrix.agg((F.count_if(F.col("col") > F.col("row")) == 0).alias("layered"), F.count("*").alias("cells"))


def generations(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """Id and level counted from nodes without incoming edges; no rows if there is a cycle."""
    pairs = edges.select("source", "target").distinct()
    if pairs.where("source = target").isEmpty() and strong_components(pairs, small).where("id <> component").isEmpty():
        turned = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
        return layers(turned, nodes, small=small)
    return nodes.select("id", F.lit(0).cast("long").alias("level")).limit(0)


def circuits(edges: DataFrame, most: int = 50, counted: bool = False) -> DataFrame:
    """Number and nodes of elementary circuits in the order of their nodes, `most` of them
    (that limit is the operator's own); with `counted` also the total of all, which takes as long
    as there are circuits. Only edges within cycles are dealt out, each component whole to one
    task; a task gives the first `most` of its circuits and how many it has met."""
    kind = _kind(edges)
    c = strong_components(edges)
    s, t = c.select(F.col("id").alias("source"), F.col("component").alias("cs")), c.select(F.col("id").alias("target"), F.col("component").alias("ct"))
    inner = edges.join(s, "source").join(t, "target").where("cs = ct").select("source", "target", "cs").distinct()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            found, met = kernels.elementary_circuits(zip(t["source"].to_pylist(), t["target"].to_pylist()), most, counted)
            # without circuits to show, the count still has its row
            yield pa.record_batch([pa.array(found or [None], pa.list_(t.schema.field("source").type)), pa.array([met] + [0] * (len(found) - 1), pa.int64())], ["nodes", "met"])

    parts = cut(inner.repartition(shuffle_width(edges.sparkSession), "cs").select("source", "target").mapInArrow(walk, f"nodes array<{kind}>, met long"))
    first = parts.where("nodes IS NOT NULL").orderBy("nodes").limit(most)  # then `most` rows in one window
    rows = first.select((F.row_number().over(Window.orderBy("nodes")) - 1).cast("long").alias("number"), "nodes")
    return rows.crossJoin(parts.agg(F.sum("met").alias("total"))) if counted else rows


def reachable(edges: DataFrame, start: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """Id and level of what can be reached from `start` in at most `depth` steps, by the
    shortest way."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    steps = {"outgoing": out, "incoming": back, "both": out.union(back)}[direction].distinct()
    seen = cut(start.select("id", F.lit(0).alias("level")).dropDuplicates(["id"]))
    for level in range(1, depth + 1):
        last = seen.where(F.col("level") == level - 1)
        fresh = steps.join(last, steps.a == last.id).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("level", F.lit(level))
        after = cut(seen.union(fresh))
        if after.where(F.col("level") == level).isEmpty():
            return after
        seen = after
    return seen


def limit_depth(edges: DataFrame, nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` steps of the roots and the edges among them; below 1: no limit."""
    if depth < 1:
        return nodes, edges
    kept = reachable(edges, roots(edges, nodes), depth).select("id")
    return nodes.join(kept, "id", "left_semi"), within(edges, kept)


def induced(edges: DataFrame, nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree and the edges among them (a top-k report)."""
    top = degrees(edges, nodes).orderBy(F.desc("total"), "id").limit(most)
    return top, within(edges, top)


def risk(ca: Column, ce: Column, instability: Column) -> Column:
    """X41."""
    return F.when((ca >= 10) & (ce >= 10), "critical").when((ca >= 15) | (ca >= 10) & (instability > 0.7), "high").when((ce >= 15) | (ca >= 5) | (ce >= 5), "medium").otherwise("low")


def suggestion(ca: Column, ce: Column, instability: Column) -> Column:
    """X41. The advice's wording."""
    return (
        F.when((ca >= 10) & (ce >= 10), "Split by responsibility into smaller classes").when((ca >= 10) & (instability > 0.7), "Extract interface to stabilize API, reduce dependencies")
        .when(ce >= 15, "Reduce dependencies through dependency injection or facade pattern").when(ca >= 10, "Consider extracting interface if API changes frequently").otherwise("Monitor for coupling growth")
    )


def coupling(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct neighbours on either side, instability, risk and advice; a node isn't
    its own neighbour. Without `nodes`: of the edges' own nodes."""
    edges, nodes = (edges, nodes_of(edges)) if nodes is None else (within(edges, nodes), nodes)
    pairs = edges.where("source <> target").select("source", "target").distinct()
    ce, ca = pairs.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("ce")), pairs.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("ca"))
    rows = nodes.select("id").join(ca, "id", "left").join(ce, "id", "left").na.fill(0, ["ca", "ce"])
    a, e = F.col("ca"), F.col("ce")
    rows = rows.withColumn("instability", F.when(a + e > 0, e / (a + e)).otherwise(0.0))
    return rows.withColumn("risk_level", risk(a, e, F.col("instability"))).withColumn("suggestion", suggestion(a, e, F.col("instability")))


def coupling_summary(rows: DataFrame) -> DataFrame:
    """A14."""
    a, e, i = F.col("ca"), F.col("ce"), F.col("instability")
    return rows.agg(F.avg(a).alias("avg_ca"), F.avg(e).alias("avg_ce"), F.avg(i).alias("avg_instability"), F.count_if((a >= 10) & (e >= 10)).alias("god_classes"), F.count_if((a >= 10) & (i > 0.7)).alias("unstable_cores"), F.count_if(e >= 15).alias("high_coupling"))


def refactoring_targets(rows: DataFrame, most: int = 20) -> DataFrame:
    """The riskiest nodes (a top-k report)."""
    order = F.when(F.col("risk_level") == "critical", 0).when(F.col("risk_level") == "high", 1).when(F.col("risk_level") == "medium", 2).otherwise(3)
    return rows.where("risk_level <> 'low'").orderBy(order, F.desc(F.col("ca") + F.col("ce")), "id").limit(most)


def package_coupling(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Coupling of packages, abstractness, distance and zone. symbols: id, package,
    symbol_type, is_abstract."""
    of = symbols.select("id", "package")
    s, t = of.select(F.col("id").alias("source"), F.col("package").alias("ps")), of.select(F.col("id").alias("target"), F.col("package").alias("pt"))
    between = edges.join(s, "source").join(t, "target").where("ps <> pt").select(F.col("ps").alias("source"), F.col("pt").alias("target")).distinct()
    counts = symbols.groupBy("package").agg(
        F.count_if(F.col("symbol_type") == "class").alias("class_count"), F.count_if(F.col("symbol_type") == "interface").alias("interface_count"), F.count_if((F.col("symbol_type") == "class") & F.col("is_abstract")).alias("abstract_count"))
    base = coupling(between, counts.select(F.col("package").alias("id"))).select(F.col("id").alias("package"), "ca", "ce", "instability")
    total = F.col("class_count") + F.col("interface_count")
    rows = base.join(counts, "package").withColumn("abstractness", F.when(total > 0, (F.col("abstract_count") + F.col("interface_count")) / total).otherwise(0.0))
    i, a = F.col("instability"), F.col("abstractness")
    return rows.withColumn("distance", F.abs(a + i - 1.0)).withColumn("zone", F.when((i < 0.3) & (a < 0.3), "zone_of_pain").when((i > 0.7) & (a > 0.7), "zone_of_uselessness").otherwise("normal"))


def hotspots(edges: DataFrame, nodes: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """G25."""
    hub = degrees(edges, nodes).where("total >= 5").select("id", F.lit("high_coupling").alias("reason"), F.least(F.lit(10.0), F.col("total") / 2.0).alias("severity"))
    cyclic = cycle_members(edges, components).groupBy("id").agg(F.count("*").alias("n"))
    return hub.unionByName(cyclic.select("id", F.lit("cycle_participant").alias("reason"), F.least(F.lit(10.0), F.col("n") * 2.0 + 3.0).alias("severity")))


def xs_metrics(edges: DataFrame, nodes: DataFrame, n_violations: int = 0, components: DataFrame | None = None) -> DataFrame:
    """One row with the counts, the score and its grade."""
    counts = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(cycles(edges, components).agg(F.count("*").alias("n_cycles")))  # one row each
    avg = F.when(F.col("n_nodes") > 0, F.col("n_edges") / F.col("n_nodes")).otherwise(0.0)
    score = 15.0 * F.col("n_cycles") + 2.0 * F.greatest(F.lit(0.0), avg - 3) * F.col("n_nodes") + 0.1 * F.greatest(F.lit(0), F.col("n_nodes") - 50) + 5.0 * n_violations
    return counts.withColumn("avg_coupling", avg).withColumn("xs_score", score).withColumn("grade", T.xs_grade(F.col("xs_score")))


def compare(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Differences between two snapshots."""
    a, b = before.select(*keys, *[F.col(v).alias(f"{v}_before") for v in values]), after.select(*keys, *[F.col(v).alias(f"{v}_after") for v in values])
    rows = a.join(b, keys, "full") if keys else a.crossJoin(b)  # without keys each side is one row
    return rows.select("*", *[(F.coalesce(f"{v}_after", F.lit(0)) - F.coalesce(f"{v}_before", F.lit(0))).alias(f"{v}_delta") for v in values])


def matches(value: Column, pattern: str, layer_patterns: dict[str, list[str]] | None = None, label: Column | None = None) -> Column:
    """layer name, shell pattern, or plain prefix."""
    values = [value] if label is None else [value, label]
    if layer_patterns and pattern in layer_patterns:
        return T.any_of([v.rlike(T.glob_regex(p)) for p in layer_patterns[pattern] for v in values])
    found = T.any_of([v.rlike(T.glob_regex(pattern)) for v in values])
    if "*" not in pattern and "?" not in pattern:
        found |= value.startswith(pattern + ".") | value.startswith(pattern + "/")
    return found


def check_rules(edges: DataFrame, rules: dict) -> DataFrame:
    """Rule, source, target and message of every violation. rules: layers (name,
    above, patterns), forbidden (from, to, reason), allowed (from, to), as the YAML file has them.
    Rules are few and become conditions on the edges, so edges are read once and never joined."""
    s, t = F.col("source").cast("string"), F.col("target").cast("string")
    named = {x["name"]: x.get("patterns", []) for x in rules.get("layers", [])}
    allowed = T.any_of([matches(s, r["from"], named) & matches(t, r["to"], named) for r in rules.get("allowed", [])])
    hits = []
    for r in rules.get("forbidden", []):
        reason = F.lit(r["reason"]) if r.get("reason") else F.concat(F.lit("Forbidden dependency: "), s, F.lit(" -> "), t)
        hits.append(F.when(matches(s, r["from"], named) & matches(t, r["to"], named) & ~allowed, F.struct(F.lit("forbidden").alias("rule"), reason.alias("message"))))
    for x in rules.get("layers", []):
        for lower in [x["above"]] if isinstance(x.get("above"), str) else x.get("above") or []:
            message = F.concat(F.lit(f"Layer violation: {lower} must not depend on {x['name']}: "), s, F.lit(" -> "), t)
            hits.append(F.when(matches(s, lower, named) & matches(t, x["name"], named), F.struct(F.lit("layer_order").alias("rule"), message.alias("message"))))
    if not hits:
        return edges.select(F.lit("").alias("rule"), "source", "target", F.lit("").alias("message")).limit(0)
    return edges.select("source", "target", F.explode(F.array_compact(F.array(*hits))).alias("v")).select("v.rule", "source", "target", "v.message")


def structure_report(edges: DataFrame, nodes: DataFrame, rules: dict | None = None) -> dict[str, DataFrame]:
    """Metrics, cycles, layers, hotspots and violations of one graph, components found
    once."""
    edges, nodes = cut(edges), cut(nodes)
    c = cut(strong_components(edges))
    bad = check_rules(edges, rules or {})
    return {
        "metrics": xs_metrics(edges, nodes, bad.count() if rules else 0, c), "cycles": cycles(edges, c), "layers": layers(edges, nodes, c), "violations": bad,
        "hotspots": hotspots(edges, nodes, c).orderBy(F.desc("severity"), "id").limit(10), "suggestions": break_suggestions(edges, c),
    }
