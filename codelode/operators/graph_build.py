"""Dependency graphs of six kinds from symbols and dependencies (survey G1-G7, J3-J11, A8-A10).

symbols: library_id, ord, name, qualified_name, symbol_type, file_path, line_start, language,
visibility, bases, implements, parent_class, is_abstract. dependencies: library_id, source, target,
dependency_type, file_path, line. A graph is two DataFrames: nodes (id, label, node_type, ...) and
edges (source, target, relation). Where several symbols match a target the one of smallest `ord`
(for files, the smallest path) is taken. All matching is by equi joins: on names' suffixes, on
paths' prefixes, and for substrings on the rarest short piece of what is looked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as T


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    kind: str

    def statistics(self) -> DataFrame:
        """A11."""
        n = self.nodes.agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_set("language")).alias("languages"))
        return n.crossJoin(self.edges.agg(F.count("*").alias("n_edges")))  # one row each


def _distinct(edges: DataFrame) -> DataFrame:
    """U3."""
    return edges.dropDuplicates(["library_id", "source", "target", "relation"])


def _external(edges: DataFrame, nodes: DataFrame, kind: str = "external_module", prefix: str = "") -> DataFrame:
    """Nodes for targets that aren't known, under their own names."""
    extra = edges.select("library_id", F.col("target").alias("id")).distinct().join(nodes, ["library_id", "id"], "left_anti")
    return extra.select("library_id", "id", F.regexp_replace("id", f"^{prefix}", "").alias("label"), F.lit(kind).alias("node_type"), F.lit(None).cast("string").alias("language"))


def _nodes(rows: DataFrame, node_id: Column, label: Column, kind: Column, *extra: Column) -> DataFrame:
    return rows.select("library_id", node_id.alias("id"), label.alias("label"), kind.alias("node_type"), *(extra or (F.col("language"),)))


def suffixes(name: Column, separator: str) -> Column:
    """All trailing parts of a dotted name, the whole name included."""
    parts = F.split(name, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def prefixes(name: Column) -> Column:
    """All leading parts of a name that isn't empty, character by character, the whole name included."""
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, 1, i))


def _pieces(name: Column, size: int) -> Column:
    """Distinct stretches of `size` characters; none of a shorter name."""
    whole = F.transform(F.sequence(F.lit(1), F.length(name) - (size - 1)), lambda i: F.substring(name, i, size))
    return F.when(F.length(name) >= size, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def first_holder(wanted: DataFrame, paths: DataFrame, size: int = 4) -> DataFrame:
    """library_id, target, found: the smallest path of the library that holds the target.

    wanted: library_id, target; paths: library_id, path. A target is looked for among the paths
    that have the rarest of its pieces of `size` characters (of its own length, if it is shorter)."""
    p, t = F.col("path"), F.col("target")
    held = paths.select("library_id", "path", F.explode(F.flatten(F.array(*[_pieces(p, n) for n in range(1, size + 1)]))).alias("piece"))
    counts = held.groupBy("library_id", "piece").count()
    own = F.coalesce(*[F.when(F.length(t) >= n, _pieces(t, n)) for n in range(size, 0, -1)])
    asked = wanted.select("library_id", "target", F.explode(own).alias("piece")).join(counts, ["library_id", "piece"], "left")
    rarest = asked.groupBy("library_id", "target").agg(F.min_by("piece", F.struct("count", "piece")).alias("piece"), F.count_if(F.col("count").isNull()).alias("missing"))
    near = rarest.where("missing = 0").join(held, ["library_id", "piece"]).where(p.contains(t))
    return near.groupBy("library_id", "target").agg(F.min("path").alias("found"))


def _imports(dependencies: DataFrame, source: Column) -> DataFrame:
    kept = dependencies.where(F.col("dependency_type").isin("import", "imports") & (F.col("target") != ""))
    return kept.select("library_id", source.alias("source"), "target").distinct()


def file_graph(symbols: DataFrame, dependencies: DataFrame) -> Graph:
    """Files, and what they import: the smallest path that holds the target (which those
    that end in target.py do), or else a module outside."""
    files = symbols.groupBy("library_id", "file_path").agg(F.count("*").alias("symbol_count"), F.when(F.count_distinct("language") == 1, F.min("language")).otherwise("mixed").alias("language"))
    nodes = _nodes(files, F.col("file_path"), T.file_name(F.col("file_path")), F.lit("file"), F.col("language"))
    imports = _imports(dependencies, F.col("file_path")).where("source <> ''")
    found = first_holder(imports.select("library_id", "target").distinct(), nodes.select("library_id", F.col("id").alias("path")))
    edges = imports.join(found, ["library_id", "target"], "left").select("library_id", "source", F.coalesce("found", "target").alias("target"), F.lit("imports").alias("relation"))
    edges = _distinct(edges.where("source <> target"))
    return Graph(nodes.unionByName(_external(edges, nodes)), edges, "file")


def dump_graph(symbols: DataFrame, dependencies: DataFrame) -> Graph:
    """Files, and the files that imports lead to: that of the last symbol of the target's
    name, or of a name in it; else the smallest of those with names below the target, or whose path
    holds it with slashes for dots. What leads nowhere gives no edge."""
    q = F.col("qualified_name")
    files = symbols.groupBy("library_id", "file_path").agg(F.when(F.count_distinct("language") == 1, F.min("language")).otherwise("mixed").alias("language"))
    nodes = _nodes(files, F.col("file_path"), T.file_name(F.col("file_path")), F.lit("file"), F.col("language"))
    names = F.array_distinct(F.array(q, F.regexp_replace(q, r"\.[^.]*$", "")))
    own = symbols.where(q != "").select("library_id", "ord", "file_path", F.explode(names).alias("target"))
    direct = own.groupBy("library_id", "target").agg(F.max_by("file_path", "ord").alias("direct"))
    parts = F.split("target", r"\.")
    heads = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), ".")))
    below = own.select("library_id", "file_path", F.explode(heads).alias("target")).groupBy("library_id", "target").agg(F.min("file_path").alias("below"))
    imports = _imports(dependencies, F.col("file_path"))
    ways = imports.select("library_id", "target", F.replace(F.col("target"), F.lit("."), F.lit("/")).alias("way")).distinct()
    held = first_holder(ways.select("library_id", F.col("way").alias("target")).distinct(), nodes.select("library_id", F.col("id").alias("path"))).withColumnRenamed("target", "way")
    found = ways.join(held, ["library_id", "way"]).select("library_id", "target", "found")
    edges = imports
    for part in (direct, below, found):
        edges = edges.join(part, ["library_id", "target"], "left")
    edges = edges.select("library_id", "source", F.coalesce("direct", F.least("below", "found")).alias("target"), F.lit("imports").alias("relation"))
    return Graph(nodes, _distinct(edges.where("target is not null and source <> target")), "dump")


def module_graph(symbols: DataFrame, dependencies: DataFrame) -> Graph:
    """Modules by path; a target is a module's name or a dotted suffix of it, or else a
    module outside. Only known modules import."""
    rows = symbols.withColumn("module", T.module_of(F.col("file_path")))
    per = rows.groupBy("library_id", "module").agg(F.count("*").alias("symbol_count"), F.min_by("language", "ord").alias("language"))
    nodes = _nodes(per, F.col("module"), F.element_at(F.split("module", r"\."), -1), F.lit("module"), F.col("language"))
    keys = nodes.select("library_id", "id", F.explode(suffixes(F.col("id"), r"\.")).alias("target")).groupBy("library_id", "target").agg(F.min("id").alias("found"))
    imports = _imports(dependencies, T.module_of(F.col("file_path"))).join(nodes.select("library_id", F.col("id").alias("source")), ["library_id", "source"], "left_semi")
    edges = imports.join(keys, ["library_id", "target"], "left").select("library_id", "source", F.coalesce("found", "target").alias("target"), F.lit("imports").alias("relation"))
    edges = _distinct(edges.where("source <> target"))
    return Graph(nodes.unionByName(_external(edges, nodes)), edges, "module")


def package_graph(symbols: DataFrame, dependencies: DataFrame) -> Graph:
    """Folders; a target's package is that of the file that holds it, or else the
    smallest that starts with it as a path, or that it starts with. Only known files depend."""
    p = T.package_of(F.col("file_path"))
    per = symbols.withColumn("package", p).groupBy("library_id", "package").agg(F.min_by("language", "ord").alias("language"))
    nodes = _nodes(per, F.col("package"), F.when(F.col("package") == ".", "root").otherwise(T.file_name(F.col("package"))), F.lit("package"), F.col("language"))
    files = symbols.select("library_id", "file_path").distinct()
    deps = dependencies.where(F.col("target") != "").join(files, ["library_id", "file_path"], "left_semi").select("library_id", p.alias("source"), "target", F.col("dependency_type").alias("relation")).distinct()
    wanted = deps.select("library_id", "target").distinct()
    by_file = first_holder(wanted, files.withColumnRenamed("file_path", "path")).select("library_id", "target", T.package_of(F.col("found")).alias("a"))
    as_path = wanted.withColumn("way", F.replace(F.col("target"), F.lit("."), F.lit("/")))
    packages = nodes.select("library_id", "id")
    within = as_path.select("library_id", "target", F.explode(prefixes(F.col("way"))).alias("id")).join(packages, ["library_id", "id"])
    above = as_path.join(packages.select("library_id", "id", F.explode(prefixes(F.col("id"))).alias("way")), ["library_id", "way"])
    by_prefix = within.select("library_id", "target", "id").union(above.select("library_id", "target", "id")).groupBy("library_id", "target").agg(F.min("id").alias("b"))
    edges = deps.join(by_file, ["library_id", "target"], "left").join(by_prefix, ["library_id", "target"], "left").select("library_id", "source", F.coalesce("a", "b").alias("target"), "relation").where("target is not null and source <> target")
    return Graph(nodes, _distinct(edges), "package")


def symbol_id() -> Column:
    """file:Class.name for members, file:name otherwise."""
    return F.concat("file_path", F.lit(":"), F.when(F.col("parent_class").isNotNull(), F.concat("parent_class", F.lit("."), "name")).otherwise(F.col("name")))


def class_graph(symbols: DataFrame, dependencies: DataFrame) -> Graph:
    """Classes, interfaces and enums; inherits and implements by name; calls
    between classes."""
    types = symbols.where(F.col("symbol_type").isin("class", "interface", "enum")).withColumn("id", F.concat("file_path", F.lit(":"), "name"))
    nodes = _nodes(types, F.col("id"), F.col("name"), F.col("symbol_type"))
    first = types.groupBy("library_id", "name").agg(F.min_by("id", "ord").alias("found")).withColumnRenamed("name", "base")

    def by_name(column: str, relation: str) -> DataFrame:
        wanted = types.select("library_id", F.col("id").alias("source"), F.explode(column).alias("base"))
        return wanted.join(first, ["library_id", "base"], "left").select("library_id", "source", F.coalesce("found", F.concat(F.lit("external:"), "base")).alias("target"), F.lit(relation).alias("relation"))

    names = types.select("library_id", "id", "ord", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"))
    last = names.groupBy("library_id", "key").agg(F.max_by("id", "ord").alias("node"))
    calls = dependencies.where(F.col("dependency_type").isin("call", "calls")).select("library_id", T.class_of(F.col("source")).alias("a"), T.class_of(F.col("target")).alias("b"))
    a, b = last.select("library_id", F.col("key").alias("a"), F.col("node").alias("source")), last.select("library_id", F.col("key").alias("b"), F.col("node").alias("target"))
    called = calls.join(a, ["library_id", "a"]).join(b, ["library_id", "b"]).where("source <> target").select("library_id", "source", "target", F.lit("calls").alias("relation"))
    edges = _distinct(by_name("bases", "inherits").union(by_name("implements", "implements")).union(called))
    return Graph(nodes.unionByName(_external(edges, nodes, "external", "external:")), edges, "class")


def function_graph(symbols: DataFrame, dependencies: DataFrame) -> Graph:
    """Functions and methods; a call's end is a node whose id ends in it after a
    colon or a dot; data flows join the first nodes of their files."""
    rows = symbols.where(F.col("symbol_type").isin("function", "method")).withColumn("id", symbol_id())
    nodes = _nodes(rows, F.col("id"), F.col("name"), F.col("symbol_type"))
    tail = F.element_at(F.split("id", ":"), -1)
    keyed = rows.select("library_id", "id", "ord", F.explode(suffixes(tail, r"\.")).alias("key"))
    first = keyed.groupBy("library_id", "key").agg(F.min_by("id", "ord").alias("node"))
    calls = dependencies.where(F.col("dependency_type").isin("call", "calls")).select("library_id", F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    a, b = first.select("library_id", F.col("key").alias("a"), F.col("node").alias("source")), first.select("library_id", F.col("key").alias("b"), F.col("node").alias("target"))
    called = calls.join(a, ["library_id", "a"]).join(b, ["library_id", "b"]).select("library_id", "source", "target", F.lit("calls").alias("relation"))
    per_file = rows.groupBy("library_id", "file_path").agg(F.min_by("id", "ord").alias("node"))
    flows = dependencies.where(F.col("dependency_type") == "data_flow").where((F.size(F.split("source", ":")) == 2) & (F.size(F.split("target", ":")) == 2)).select("library_id", F.split_part("source", F.lit(":"), F.lit(1)).alias("a"), F.split_part("target", F.lit(":"), F.lit(1)).alias("b"))
    fa, fb = per_file.select("library_id", F.col("file_path").alias("a"), F.col("node").alias("source")), per_file.select("library_id", F.col("file_path").alias("b"), F.col("node").alias("target"))
    flowed = flows.join(fa, ["library_id", "a"]).join(fb, ["library_id", "b"]).where("source <> target").select("library_id", "source", "target", F.lit("data_flow").alias("relation"))
    return Graph(nodes, _distinct(called.union(flowed)), "function")


def symbol_graph(symbols: DataFrame, dependencies: DataFrame) -> Graph:
    """All symbols; class and function edges, and contains edges to members."""
    rows = symbols.withColumn("id", symbol_id())
    nodes = _nodes(rows, F.col("id"), F.col("name"), F.col("symbol_type"))
    holders = symbols.where(F.col("symbol_type").isin("class", "interface", "enum")).select("library_id", "file_path", F.col("name").alias("parent_class"), F.concat("file_path", F.lit(":"), "name").alias("source")).distinct()
    members = rows.where("parent_class is not null").select("library_id", "file_path", "parent_class", F.col("id").alias("target"))
    contains = members.join(holders, ["library_id", "file_path", "parent_class"]).select("library_id", "source", "target", F.lit("contains").alias("relation"))
    c, f = class_graph(symbols, dependencies), function_graph(symbols, dependencies)
    edges = _distinct(c.edges.unionByName(f.edges).unionByName(contains))
    extra = c.nodes.where("node_type = 'external'")
    return Graph(nodes.unionByName(extra), edges, "symbol")


BUILDERS = {"file": file_graph, "dump": dump_graph, "module": module_graph, "package": package_graph, "class": class_graph, "function": function_graph, "symbol": symbol_graph}


def build(kind: str, symbols: DataFrame, dependencies: DataFrame, max_depth: int = 0) -> Graph:
    """A graph by name, cut to `max_depth` steps from its roots if that is at least 1. One
    library's graph: the ids then are unique."""
    from codelode.operators.graph import limit_depth

    if kind not in BUILDERS:
        raise ValueError(f"unknown kind of graph: {kind}")
    g = BUILDERS[kind](symbols, dependencies)
    if max_depth < 1:
        return g
    nodes, edges = limit_depth(g.edges, g.nodes, max_depth)
    return Graph(nodes, edges, kind)
