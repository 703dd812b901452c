"""Queries of chunking, enrichment, graph construction, exports, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import enrich as N
from codelode.functions import text as T
from codelode.operators import chunk as C
from codelode.operators import cypher, export
from codelode.operators import graph as G
from codelode.operators import graph_build as B
from codelode.plans.base import DOC, EDGE, NODE, SPARSE, SYM, docs, edge_sql, edges, nodes, query, symbols
from codelode.plans.graph_queries import CYC, PACKAGES, ZONED, R
from codelode.plans.text_queries import TOKENS
from codelode.runtime import cut, table
from codelode.sources import cpg, extract
from codelode.streaming import progress as P


def _chunks(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return C.chunk(docs(spark, d), strategy).select("id", "source_file", "chunk_type", "start_line", "end_line", "token_count")


def _chunk_sql(size: str, room: int, overlap: int, least: int, where: str = "true", also: str = "") -> str:
    """Ranges of lines that fill `room`, each from the last lines of the one before, up to `overlap`.
    A state is a range's first line and the last one that is in it in any case."""
    end = f"coalesce(list_min(list_filter(range(seen + 1, n), lambda j: cum[j + 2] - cum[lo + 1] > {room})), n)"
    tokens = TOKENS.replace("content", "text")
    return f"""WITH RECURSIVE {DOC}, l AS (SELECT *, string_split(content, chr(10)) AS lines FROM doc WHERE content <> '' AND {where}),
s AS (SELECT path, lines, len(lines) AS n, list_transform(lines, lambda content: {size}) AS sizes FROM l), c AS (SELECT path, lines, n, list_transform(range(n + 1), lambda i: coalesce(list_sum(sizes[1:i]), 0)) AS cum, row_number() OVER () AS doc FROM s),
state AS (SELECT doc, 0::BIGINT AS lo, 0::BIGINT AS seen FROM c UNION ALL SELECT doc, list_min(list_filter(range(lo, stop + 1), lambda a: cum[stop + 1] - cum[a + 1] <= {overlap})), stop FROM (SELECT state.*, cum, n, {end} AS stop FROM state JOIN c USING (doc)) WHERE stop < n),
r AS (SELECT path, lo, {end} AS stop, lines, cum FROM state JOIN c USING (doc)), t AS (SELECT path, lo, stop, array_to_string(lines[lo + 1:stop], chr(10)) AS text FROM r), k AS (SELECT *, {tokens}::INT AS token_count FROM t)
SELECT substr(sha256(path || ':' || (lo + 1) || ':' || substr(text, 1, 100)), 1, 16) AS id, path AS source_file, CASE WHEN ends_with(path, '.md') THEN 'documentation' ELSE 'code' END AS chunk_type, (lo + 1)::INT AS start_line, stop::INT AS end_line, token_count FROM k WHERE {least}{also}"""


@query(_chunk_sql("length(content) + 1", 1000, 100, "length(text) >= 50"))
def h1_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "fixed_size")


@query(_chunk_sql(TOKENS, 500, 50, "token_count >= 20"))
def h2_token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """H2, H6."""
    return _chunks(spark, d, "embedding")


AUTO = _chunk_sql("length(content) + 1", 1000, 100, "length(text) >= 50", "NOT ends_with(path, '.md')")
MARKDOWN = _chunk_sql("length(content) + 1", 2000, 100, "length(text) >= 50", "ends_with(path, '.md')")


@query(f"SELECT * FROM ({AUTO}) UNION ALL SELECT * FROM ({MARKDOWN})")
def h5_auto_chunks(spark: SparkSession, d: str) -> DataFrame:
    """H5, H1: no headings and no code in these documents."""
    return _chunks(spark, d, "auto")


#: Small sources, and the lines where their sections begin and end.
SOURCES = {
    "a.py": "import os\n\n@cached\ndef one(x):\n    return x\n\nclass Two:\n    @property\n    def y(self):\n        return 1\nasync def three():\n    pass",
    "b.js": "import x from 'y'\nexport class A {\n  run(a) {\n    go(a)\n  }\n}\nconst f = async (x) => {\n}\nasync function g() {\n}",
    "c.ts": "export abstract class B {\n}\nexport interface I {\n}\ntype T = string",
    "d.go": "package d\n\ntype S struct {\n}\nfunc (s *S) Run(x int) {\n}",
    "e.kt": "data class K(val a: Int)\nsuspend fun go() {\n}\nobject O {\n}",
    "f.md": "# Top\nIntro.\n\n## Part one\nText.\n### Deeper\nMore.\n## Part two\nEnd.",
    "g.java": "package g;\npublic class G {\n    public int run(int a) {\n    }\n}",
}
SECTIONS = [
    ("a.py", 1, 2, "code", "module_header"), ("a.py", 3, 3, "code", "decorator"), ("a.py", 4, 6, "function", "function"), ("a.py", 7, 10, "class", "class"), ("a.py", 11, 12, "function", "function"),
    ("b.js", 1, 1, "code", "module_header"), ("b.js", 2, 2, "class", "class"), ("b.js", 3, 3, "function", "method"), ("b.js", 4, 6, "function", "method"), ("b.js", 7, 8, "function", "arrow_function"), ("b.js", 9, 10, "function", "function"),
    ("c.ts", 1, 2, "class", "class"), ("c.ts", 3, 4, "class", "interface"), ("c.ts", 5, 5, "code", "type"),
    ("d.go", 1, 2, "code", "module_header"), ("d.go", 3, 4, "code", "struct"), ("d.go", 5, 6, "function", "function"),
    ("e.kt", 1, 1, "class", "class"), ("e.kt", 2, 3, "function", "fun"), ("e.kt", 4, 5, "code", "object"),
    ("f.md", 1, 3, "documentation", "preamble"), ("f.md", 4, 5, "documentation", "Part one"), ("f.md", 6, 7, "documentation", "Deeper"), ("f.md", 8, 9, "documentation", "Part two"),
    ("g.java", 1, 1, "code", "module_header"), ("g.java", 2, 2, "class", "class"), ("g.java", 3, 5, "function", "method"),
]


@query("SELECT * FROM (VALUES " + ", ".join(map(str, SECTIONS)) + ") AS t(source_file, start_line, end_line, chunk_type, section)")
def h3_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every boundary of the languages, on small sources."""
    files = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    return C.chunk(files, "auto").select("source_file", "start_line", "end_line", "chunk_type", "section")


CATS = ", ".join(f"CASE WHEN contains(lower(content), '{c}') THEN '{c}' END" for c in N.CATEGORIES)


@query(f"WITH {DOC}, c AS (SELECT id, list_sort(list_filter([{CATS}], lambda x: x IS NOT NULL)) AS c FROM doc) SELECT id, CASE WHEN len(c) > 0 THEN c ELSE ['utility'] END AS categories FROM c")
def x53_categories(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", N.categories(F.col("content")).alias("categories"))


TAGS = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{t}' END" for t, words in N.TAGS.items())
CONS = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{t}' END" for t, words in N.CONCEPTS.items())


@query(f"WITH {DOC} SELECT id, list_sort(list_distinct(list_filter([lang, {TAGS}], lambda x: x IS NOT NULL))) AS tags, list_filter([{CONS}], lambda x: x IS NOT NULL) AS concepts FROM doc")
def x52_tags_and_concepts(spark: SparkSession, d: str) -> DataFrame:
    """X52, X54."""
    return docs(spark, d).select("id", N.tags(F.col("content"), F.col("lang")).alias("tags"), N.concepts(F.col("content")).alias("concepts"))


@query(f"WITH {DOC} SELECT id, (0.5 - CASE WHEN len(string_split(content, chr(10))) > 200 THEN 0.1 ELSE 0.0 END - CASE WHEN len(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x), '#'))) < len(string_split(content, chr(10))) * 0.05 THEN 0.05 ELSE 0.0 END + CASE WHEN contains(content, '->') OR contains(content, ': str') OR contains(content, ': int') THEN 0.1 ELSE 0.0 END + CASE WHEN contains(content, 'logging') OR contains(content, 'logger') THEN 0.05 ELSE 0.0 END)::DOUBLE AS quality FROM doc")
def x56_code_quality(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", N.quality(F.col("content")).alias("quality"))


@query(f"WITH {SYM} SELECT ord, CASE WHEN length(documentation) > 10 THEN documentation ELSE upper(symbol_type[1]) || symbol_type[2:] || ' ' || replace(name, '_', ' ') END AS description, [symbol_type] AS tags, CASE symbol_type WHEN 'function' THEN ['Call: ' || name || '()'] WHEN 'method' THEN ['Call: instance.' || name || '()'] WHEN 'class' THEN ['Instantiate: ' || name || '()', 'Inherit: class MyClass(' || name || '):'] ELSE [] END AS hints FROM sym")
def x59_symbol_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """X59, X60."""
    n, k = F.col("name"), F.col("symbol_type")
    return symbols(spark, d).select("ord", N.symbol_description(n, k, F.col("documentation")).alias("description"), N.symbol_tags(n, k).alias("tags"), N.usage_hints(n, k, F.lit(None).cast("string")).alias("hints"))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Symbols of one library, and calls and imports between them, from the driver's tables."""
    s = symbols(spark, d).withColumns({"library_id": F.lit(0).cast("long"), "bases": F.when(F.col("ord") % 5 == 0, F.array(F.replace(F.col("name"), F.lit("red"), F.lit("blue")))).otherwise(F.array().cast("array<string>")), "implements": F.array().cast("array<string>")})
    e = edges(spark, d)
    a = s.select(F.col("ord").alias("source"), F.col("qualified_name").alias("sn"), F.col("file_path"))
    b = s.select(F.col("ord").alias("target"), F.col("qualified_name").alias("tn"), F.col("file_path").alias("tf"))
    j = e.join(a, "source").join(b, "target")
    kind = F.when(F.col("relation") == "imports", "import").otherwise("call")
    dotted = F.regexp_replace(F.replace("tf", F.lit("/"), F.lit(".")), r"\.py$", "")
    # whole dotted names, their last parts, and parts of paths
    way = (F.col("source") + 2 * F.col("target")) % 3
    imported = F.when(way == 0, dotted).when(way == 1, F.regexp_replace(dotted, r"^src\.", "")).otherwise(F.regexp_replace("tf", r"^src/|\.py$", ""))
    target = F.when(F.col("relation") == "imports", imported).otherwise(F.col("tn"))
    return s, j.select(F.lit(0).cast("long").alias("library_id"), F.col("sn").alias("source"), target.alias("target"), kind.alias("dependency_type"), "file_path", F.lit(1).alias("line"))


DOTTED = "regexp_replace(replace(b.file_path, '/', '.'), '\\.py$', '')"
IMPORTED = f"CASE (source + 2 * target) % 3 WHEN 0 THEN {DOTTED} WHEN 1 THEN regexp_replace({DOTTED}, '^src\\.', '') ELSE regexp_replace(b.file_path, '^src/|\\.py$', '', 'g') END"
PARTS = f"{SYM}, {EDGE}, dep AS (SELECT a.qualified_name AS source, CASE WHEN relation = 'imports' THEN {IMPORTED} ELSE b.qualified_name END AS target, CASE WHEN relation = 'imports' THEN 'import' ELSE 'call' END AS kind, a.file_path FROM edge JOIN sym a ON a.ord = source JOIN sym b ON b.ord = target)"
FILES = "f AS (SELECT DISTINCT file_path AS p FROM sym), t AS (SELECT DISTINCT target FROM dep WHERE kind = 'import'), h AS (SELECT target, min(p) AS found FROM t JOIN f ON contains(p, target) OR ends_with(p, target || '.py') GROUP BY 1)"


@query(f"WITH {PARTS}, {FILES} SELECT DISTINCT file_path AS source, coalesce(found, target) AS target, 'imports' AS relation FROM dep LEFT JOIN h USING (target) WHERE kind = 'import' AND file_path <> coalesce(found, target)")
def g1_file_graph(spark: SparkSession, d: str) -> DataFrame:
    """G1, J3, J7, U3."""
    return B.build("file", *_parts(spark, d)).edges.select("source", "target", "relation")


@query(
    f"""WITH {PARTS}, {FILES}, e AS (SELECT DISTINCT file_path AS source, coalesce(found, target) AS target FROM dep LEFT JOIN h USING (target) WHERE kind = 'import')
SELECT p AS id, regexp_extract(p, '[^/]*$') AS label, 'file' AS node_type FROM f UNION ALL SELECT DISTINCT target, target, 'external_module' FROM e WHERE source <> target AND target NOT IN (SELECT p FROM f)"""
)
def g1_file_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files, and the modules outside that they import."""
    return B.build("file", *_parts(spark, d)).nodes.select("id", "label", "node_type")


@query(
    f"""WITH {PARTS}, f AS (SELECT DISTINCT file_path AS p FROM sym), t AS (SELECT DISTINCT target FROM dep WHERE kind = 'import'), own AS (SELECT ord, file_path AS p, unnest([qualified_name, regexp_replace(qualified_name, '\\.[^.]*$', '')]) AS k FROM sym),
a AS (SELECT k AS target, arg_max(p, ord) AS a FROM own GROUP BY 1), b AS (SELECT target, min(p) AS b FROM (SELECT target, p FROM t JOIN f ON contains(p, replace(target, '.', '/')) UNION ALL SELECT target, p FROM t JOIN own ON starts_with(k, target || '.')) GROUP BY 1)
SELECT DISTINCT file_path AS source, coalesce(a, b) AS target, 'imports' AS relation FROM dep LEFT JOIN a USING (target) LEFT JOIN b USING (target) WHERE kind = 'import' AND coalesce(a, b) IS NOT NULL AND file_path <> coalesce(a, b)"""
)
def g30_dump_graph(spark: SparkSession, d: str) -> DataFrame:
    """G30, J17."""
    return B.build("dump", *_parts(spark, d)).edges.select("source", "target", "relation")


MODULE = "regexp_replace(replace(file_path, '/', '.'), '\\.py$', '')"


@query(
    f"""WITH {PARTS}, m AS (SELECT DISTINCT {MODULE} AS id FROM sym), i AS (SELECT DISTINCT {MODULE} AS source, target FROM dep WHERE kind = 'import'),
h AS (SELECT target, min(id) AS found FROM (SELECT DISTINCT target FROM i) JOIN m ON id = target OR ends_with(id, '.' || target) GROUP BY 1)
SELECT DISTINCT source, coalesce(found, target) AS target, 'imports' AS relation FROM i LEFT JOIN h USING (target) WHERE source <> coalesce(found, target)"""
)
def g2_module_graph(spark: SparkSession, d: str) -> DataFrame:
    """G2, J4, J7."""
    return B.build("module", *_parts(spark, d)).edges.select("source", "target", "relation")


@query(
    f"""WITH {PARTS}, pk AS (SELECT DISTINCT regexp_extract(file_path, '^(.*)/', 1) AS id FROM sym), i AS (SELECT DISTINCT regexp_extract(file_path, '^(.*)/', 1) AS source, target, kind FROM dep),
f AS (SELECT DISTINCT file_path AS p FROM sym), t AS (SELECT DISTINCT target FROM i), h AS (SELECT target, regexp_extract(min(p), '^(.*)/', 1) AS a FROM t JOIN f ON contains(p, target) OR ends_with(p, target || '.py') GROUP BY 1),
w AS (SELECT target, min(id) AS b FROM t JOIN pk ON starts_with(replace(target, '.', '/'), id) OR starts_with(id, replace(target, '.', '/')) GROUP BY 1)
SELECT DISTINCT source, coalesce(a, b) AS target, kind AS relation FROM i LEFT JOIN h USING (target) LEFT JOIN w USING (target) WHERE coalesce(a, b) IS NOT NULL AND source <> coalesce(a, b)"""
)
def g3_package_graph(spark: SparkSession, d: str) -> DataFrame:
    """G3, J5."""
    return B.build("package", *_parts(spark, d)).edges.select("source", "target", "relation")


CLS = "ty AS (SELECT *, file_path || ':' || name AS id FROM sym WHERE symbol_type IN ('class', 'interface', 'enum')), fst AS (SELECT name, arg_min(id, ord) AS found FROM ty GROUP BY 1), base AS (SELECT id AS source, replace(name, 'red', 'blue') AS b FROM ty WHERE ord % 5 = 0)"


@query(f"WITH {SYM}, {CLS} SELECT DISTINCT source, coalesce(found, 'external:' || b) AS target, 'inherits' AS relation FROM base LEFT JOIN fst ON fst.name = b")
def g4_class_graph(spark: SparkSession, d: str) -> DataFrame:
    """`Brand.name` calls start in upper case but name no class here."""
    return B.build("class", *_parts(spark, d)).edges.select("source", "target", "relation")


FUN = "fn AS (SELECT *, file_path || ':' || coalesce(parent_class || '.', '') || name AS id FROM sym WHERE symbol_type IN ('function', 'method')), k AS (SELECT id, ord, name AS key FROM fn UNION ALL SELECT id, ord, parent_class || '.' || name FROM fn WHERE parent_class IS NOT NULL), f1 AS (SELECT key, arg_min(id, ord) AS node FROM k GROUP BY 1)"


@query(f"WITH {PARTS}, {FUN} SELECT DISTINCT a.node AS source, b.node AS target, 'calls' AS relation FROM dep JOIN f1 a ON a.key = source JOIN f1 b ON b.key = target WHERE kind = 'call'")
def g5_function_graph(spark: SparkSession, d: str) -> DataFrame:
    """G5, J10."""
    return B.build("function", *_parts(spark, d)).edges.select("source", "target", "relation")


@query(f"WITH {PARTS}, {CLS}, {FUN} SELECT DISTINCT source, coalesce(found, 'external:' || b) AS target, 'inherits' AS relation FROM base LEFT JOIN fst ON fst.name = b UNION SELECT a.node, b.node, 'calls' FROM dep JOIN f1 a ON a.key = source JOIN f1 b ON b.key = target WHERE kind = 'call'")
def g6_symbol_graph(spark: SparkSession, d: str) -> DataFrame:
    """G6, U8, J8."""
    return B.build("symbol", *_parts(spark, d)).edges.select("source", "target", "relation")


@query(f"WITH {EDGE}, {NODE} SELECT 'digraph dependencies {{' || chr(10) || (SELECT string_agg('  \"n' || id || '\" [label=\"n' || id || '\"];', chr(10) ORDER BY 'n' || id) FROM node) || chr(10) || (SELECT string_agg('  \"n' || source || '\" -> \"n' || target || '\" [label=\"' || relation || '\"];', chr(10) ORDER BY 'n' || source, 'n' || target) FROM edge) || chr(10) || '}}' AS text")
def export_dot(spark: SparkSession, d: str) -> DataFrame:
    e = cut(edges(spark, d).select(*[F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) for c in ("source", "target")], "relation"))
    return export.dot(nodes(e).withColumn("label", F.col("id")), e)


GRAPHML = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '  <key id="label" for="node" attr.name="label" attr.type="string"/>' || chr(10) || '  <key id="relation" for="edge" attr.name="relation" attr.type="string"/>' || chr(10) || '  <graph edgedefault="directed">' || chr(10)"""


@query(
    f"""WITH {EDGE}, {NODE} SELECT {GRAPHML} || (SELECT string_agg('    <node id="n' || id || '"><data key="label">n' || id || '</data></node>', chr(10) ORDER BY 'n' || id) FROM node) || chr(10)
|| (SELECT string_agg('    <edge source="n' || source || '" target="n' || target || '"><data key="relation">' || relation || '</data></edge>', chr(10) ORDER BY 'n' || source, 'n' || target) FROM edge) || chr(10) || '  </graph>' || chr(10) || '</graphml>' AS text"""
)
def export_graphml(spark: SparkSession, d: str) -> DataFrame:
    e = cut(edges(spark, d).select(*[F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) for c in ("source", "target")], "relation"))
    return export.graphml(nodes(e).withColumn("label", F.col("id")), e)


@query(f"WITH {EDGE} SELECT 'flowchart LR' || chr(10) || string_agg('    n_' || source || ' -->|' || relation || '| n_' || target, chr(10) ORDER BY source::VARCHAR, target::VARCHAR) AS text FROM edge")
def export_mermaid(spark: SparkSession, d: str) -> DataFrame:
    e = cut(edges(spark, d).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "relation"))
    return export.mermaid(e)


@query(
    f"""WITH {EDGE}, {NODE} SELECT '{{"graph":{{"label":"graph","directed":true,"nodes":{{' || (SELECT string_agg('"' || id || '":{{"label":"' || id || '","node_type":"part"}}', ',' ORDER BY id::VARCHAR) FROM node)
|| '}},"edges":[' || (SELECT string_agg('{{"source":' || source || ',"target":' || target || ',"relation":"' || relation || '"}}', ',' ORDER BY source, target) FROM edge) || ']}}}}' AS text"""
)
def export_json_graph(spark: SparkSession, d: str) -> DataFrame:
    e = cut(edges(spark, d))
    n = nodes(e).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("label"), F.lit("part").alias("node_type"))
    return export.json_graph(n, e)


@query(
    f"""{R}, {CYC}, cn AS (SELECT DISTINCT unnest(nodes) AS id FROM cyc), g AS (SELECT n.id, coalesce(i.n, 0) AS a, coalesce(o.n, 0) AS b FROM node n LEFT JOIN (SELECT target, count(*) AS n FROM edge GROUP BY 1) i ON i.target = n.id LEFT JOIN (SELECT source, count(*) AS n FROM edge GROUP BY 1) o ON o.source = n.id)
SELECT id, '{{"id":' || id || ',"label":"' || id || '","in_degree":' || a || ',"out_degree":' || b || ',"total":' || (a + b) || ',"in_cycle":' || (id IN (SELECT id FROM cn)) || '}}' AS payload FROM g"""
)
def g34_interactive(spark: SparkSession, d: str) -> DataFrame:
    e = cut(edges(spark, d, SPARSE))
    return export.interactive(G.degrees(e, nodes(e)), G.cycle_members(e).select("id"))


@query(
    f"""WITH {SYM}, x AS (SELECT 0 AS part, symbol_type AS a, 0 AS o, '- ' || symbol_type || ': ' || count(*) AS line FROM sym GROUP BY symbol_type UNION ALL
SELECT 1, symbol_type || ':' || qualified_name, ord, '- `' || qualified_name || '` (' || symbol_type || ')' FROM sym WHERE symbol_type IN ('class', 'function') QUALIFY row_number() OVER (PARTITION BY symbol_type ORDER BY qualified_name, ord) <= 10)
SELECT '# Summary' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY part, a, o) AS text FROM x"""
)
def g35_summary(spark: SparkSession, d: str) -> DataFrame:
    """G35, G37."""
    return export.summary(symbols(spark, d))


@query(
    f"""{R}, {CYC}, s AS (SELECT (SELECT count(*) FROM node) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges, (SELECT count(*) FROM cyc) AS n_cycles), u AS (SELECT *, (15.0 * n_cycles + 2.0 * greatest(0.0, n_edges / n_nodes - 3) * n_nodes + 0.1 * greatest(0, n_nodes - 50))::DOUBLE AS xs FROM s),
top AS (SELECT * FROM cyc ORDER BY 2.0 * n_nodes + n_edges DESC, component LIMIT 10), {SYM}, {PACKAGES},
x AS (SELECT 0 AS part, '' AS a, 'Score ' || round(xs, 2) || ', grade ' || CASE WHEN xs < 20 THEN 'A' WHEN xs < 40 THEN 'B' WHEN xs < 60 THEN 'C' WHEN xs < 80 THEN 'D' ELSE 'F' END || ', nodes ' || n_nodes || ', edges ' || n_edges AS line FROM u
UNION ALL SELECT 1, lpad(component::VARCHAR, 20, '0'), '- cycle of ' || n_nodes || ' nodes and ' || n_edges || ' edges' FROM top UNION ALL SELECT 2, zone, '- ' || zone || ': ' || count(*) FROM ({ZONED}) GROUP BY zone)
SELECT '# Architecture' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY part, a) AS text FROM x"""
)
def g36_architecture(spark: SparkSession, d: str) -> DataFrame:
    """G33, G36."""
    e = cut(edges(spark, d, SPARSE))
    c = cut(G.strong_components(e))
    s = symbols(spark, d).select(F.col("ord").alias("id"), T.package_of(F.col("file_path")).alias("package"), "symbol_type", "is_abstract")
    return export.architecture(G.xs_metrics(e, nodes(e), 0, c), G.cycles(e, c), G.package_coupling(e, s))


@query(
    f"""WITH RECURSIVE {edge_sql(48)}, pairs AS (SELECT DISTINCT source, target FROM edge), walk AS (SELECT source AS start, [source] AS nodes, target AS nxt FROM pairs WHERE target >= source
UNION ALL SELECT w.start, list_append(w.nodes, w.nxt), p.target FROM walk w JOIN pairs p ON p.source = w.nxt WHERE w.nxt <> w.start AND p.target >= w.start AND (p.target = w.start OR NOT list_contains(w.nodes, p.target)) AND p.target <> w.nxt),
c AS (SELECT nodes, row_number() OVER (ORDER BY nodes) - 1 AS number, count(*) OVER () AS total FROM walk WHERE nxt = start) SELECT number, nodes, total FROM c WHERE number < 50"""
)
def g31_circuits(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 circuits, as its reports have them, and how many there are; of a graph so
    sparse that all can be counted."""
    return G.circuits(cut(edges(spark, d, 48)), 50, counted=True)


@query(f"WITH {SYM} SELECT count(*) AS count FROM sym WHERE symbol_type = 'class' AND is_exported AND visibility = 'public' AND language = 'go'")
def g13_cypher_count(spark: SparkSession, d: str) -> DataFrame:
    """G13, K10, Q16."""
    return cypher.run("MATCH (n:Class:PublicAPI {language: $lang}) RETURN count(n)", cypher.from_symbols(symbols(spark, d)), spark.createDataFrame([], "source string, target string, type string, properties map<string,string>"), {"lang": "go"})


@query(f"WITH {SYM}, {EDGE} SELECT a.ord || '' AS source, b.ord || '' AS target FROM edge JOIN sym a ON a.ord = source JOIN sym b ON b.ord = target WHERE relation = 'calls' AND a.symbol_type = 'class'")
def g13_cypher_edges(spark: SparkSession, d: str) -> DataFrame:
    n = cypher.from_symbols(symbols(spark, d)).withColumn("id", F.col("ord").cast("string"))
    e = edges(spark, d).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), cypher.relation_type().alias("type"), F.create_map().cast("map<string,string>").alias("properties"))
    return cypher.run("MATCH (a:Class)-[r:CALLS]->(b:Symbol) RETURN r", n, e).select("source", "target")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    m = s.where("symbol_type = 'method'").select(F.concat_ws("|", F.lit("METHOD"), "name", "qualified_name", "file_path", F.col("line_start").cast("string"), F.col("line_end").cast("string"), F.concat("name", F.lit("(x: int) -> str")), F.lit("x:int;y:map:str")).alias("line"))
    t = s.where("symbol_type = 'class'").select(F.concat_ws("|", F.lit("TYPE"), "name", "qualified_name", "file_path", F.col("line_start").cast("string"), F.lit("Base; Other")).alias("line"))
    return m.union(t)


@query(f"WITH {SYM} SELECT name, qualified_name AS full_name, file_path AS filename, line_start, line_end, name || '(x: int) -> str' AS signature, 2 AS n_parameters, 'map:str' AS last_type FROM sym WHERE symbol_type = 'method'")
def c1_cpg_methods(spark: SparkSession, d: str) -> DataFrame:
    """C1-C3."""
    m = cpg.methods(_lines(spark, d))
    return m.select("name", "full_name", "filename", "line_start", "line_end", "signature", F.size("parameters").alias("n_parameters"), F.element_at("parameters", -1)["type"].alias("last_type"))


@query(f"WITH {SYM} SELECT name, qualified_name, CASE WHEN symbol_type = 'class' THEN 'class' ELSE 'method' END AS symbol_type, 'python' AS language, CASE WHEN symbol_type = 'method' THEN 'str' END AS return_type FROM sym WHERE symbol_type IN ('class', 'method')")
def c5_cpg_symbols(spark: SparkSession, d: str) -> DataFrame:
    """C4, C5, F16, J15, X24-X27."""
    return cpg.to_symbols(_lines(spark, d)).select("name", "qualified_name", "symbol_type", "language", "return_type")


@query(f"WITH {SYM} SELECT qualified_name, line_end - line_start + 1 AS n_lines, line_end - line_start + 1 > 40 AS large FROM sym WHERE symbol_type IN ('function', 'method')")
def c7_size_metrics(spark: SparkSession, d: str) -> DataFrame:
    return cpg.size_metrics(symbols(spark, d), 40)


@query(
    f"""WITH {SYM}, f AS (SELECT name, ord % 3 AS kind, 'src/f' || ord || (['.py', '.java', '.go'])[(ord % 3 + 1)::INT] AS p FROM sym)
SELECT 'symbol' AS row_kind, p AS file_path, name, 'class' AS symbol_type, NULL AS parent_class, CASE kind WHEN 2 THEN 'private' ELSE 'public' END AS visibility, NULL AS source, NULL AS target, NULL AS dependency_type FROM f
UNION ALL SELECT 'symbol', p, CASE kind WHEN 2 THEN 'Run' ELSE 'run' END, 'method', name, 'public', NULL, NULL, NULL FROM f
UNION ALL SELECT 'dependency', p, NULL, NULL, NULL, NULL, p, (['os', 'java.util.List', 'fmt'])[(kind + 1)::INT], 'import' FROM f
UNION ALL SELECT 'dependency', p, NULL, NULL, NULL, NULL, name || '.run', 'helper', 'call' FROM f WHERE kind = 0"""
)
def e1_extract(spark: SparkSession, d: str) -> DataFrame:
    """E1-E7 over code made from the parts' names, in three languages."""
    s = symbols(spark, d)
    n = F.col("name")
    py = F.concat(F.lit("import os\n\nclass "), n, F.lit("(Base):\n    def run(self, x: int) -> str:\n        return helper(x)\n"))
    java = F.concat(F.lit("import java.util.List;\npublic class "), n, F.lit(" extends Base implements Runnable {\n    public void run() { go(); }\n}\n"))
    go = F.concat(F.lit('package main\nimport "fmt"\ntype '), n, F.lit(" struct { a int }\nfunc (t *"), n, F.lit(") Run(x int) { fmt.Println(x) }\n"))
    files = s.select(F.concat(F.lit("src/f"), F.col("ord").cast("string"), F.element_at(F.array(F.lit(".py"), F.lit(".java"), F.lit(".go")), (F.col("ord") % 3 + 1).cast("int"))).alias("path"), F.when(F.col("ord") % 3 == 0, py).when(F.col("ord") % 3 == 1, java).otherwise(go).alias("content"))
    return extract.extract(files).select("row_kind", "file_path", "name", "symbol_type", "parent_class", "visibility", "source", "target", "dependency_type")


EV = "(SELECT event_id, ts, user_id, event_type, value FROM events)"


@query("SELECT time_bucket(INTERVAL 6 hours, ts) AS start, time_bucket(INTERVAL 6 hours, ts) + INTERVAL 6 hours AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3")
def r3_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = P.windows(table(spark, d, "events"), "6 hours")
    return e.withColumn("total", F.round("total", 6))


@query("SELECT w AS start, w + INTERVAL 2 hours AS \"end\", event_type, count(*) AS n FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS w) GROUP BY 1, 2, 3")
def r3_sliding(spark: SparkSession, d: str) -> DataFrame:
    return P.windows(table(spark, d, "events"), "2 hours", "1 hour").drop("total")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 hours THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 hours AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def r3_sessions(spark: SparkSession, d: str) -> DataFrame:
    return P.sessions(table(spark, d, "events"), "2 hours")


@query("SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)")
def w10_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """W10, R5."""
    return P.within_limit(table(spark, d, "events"), 3, 86400).select("event_id", "recent", "allowed")


@query("SELECT user_id::VARCHAR AS task_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS phase, max(ts) AS ts, least(100.0, 100.0 * arg_max(value, {'a': ts, 'b': event_id}) / 50)::DOUBLE AS percent FROM events GROUP BY 1")
def r1_latest_progress(spark: SparkSession, d: str) -> DataFrame:
    """R1, R3, Y6."""
    e = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("task_id")).agg(F.max_by(F.struct("event_type", "ts", "value"), F.struct("ts", "event_id")).alias("e"))
    return e.select("task_id", F.col("e.event_type").alias("phase"), "e.ts", P.percent(F.col("e.value"), F.lit(50)).alias("percent"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(url, '/en/') AS english FROM pages")
def s8_url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and paths."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.col("url").rlike("/en/").alias("english"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def y1_json(spark: SparkSession, d: str) -> DataFrame:
    """Typed values from JSON metadata."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
