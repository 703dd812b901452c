"""One object over a corpus's tables (survey 2.18): each tool's answer is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import enrich
from codelode.functions import text as T
from codelode.operators import chunk, cypher, export, graph, graph_build, retrieval, search, summary, tables, vectors
from codelode.runtime import cut, ship
from codelode.sources import dump, extract, files


@dataclass
class Corpus:
    """libraries, versions, documents (id, library, path, content), symbols and dependencies;
    embeddings may be missing, and what needs them then raises."""

    spark: SparkSession
    libraries: DataFrame
    versions: DataFrame
    documents: DataFrame
    symbols: DataFrame
    dependencies: DataFrame
    embeddings: DataFrame | None = None

    @classmethod
    def index(cls, spark: SparkSession, folder: str, name: str = "local", provider: str = "local") -> Corpus:
        """Read a folder: its documents, and symbols of its code."""
        ship(spark)
        tree = files.provider(provider).files(spark, folder)
        code = files.walk(tree)
        symbols, dependencies = extract.tables(code)
        library = spark.createDataFrame([(0, "local", name, folder, "main", provider)], "id long, group_name string, project_name string, description string, default_version string, provider string")
        version = spark.createDataFrame([(0, 0, "main")], "id long, library_id long, version_tag string")
        docs = files.documents(tree).select(F.xxhash64("path").alias("id"), F.lit(name).alias("library"), "path", "content")
        return cls(spark, library, version, docs, cut(symbols), cut(dependencies))

    def health(self) -> dict[str, str]:
        parts = {"content": "healthy", "vector": "healthy" if self.embeddings is not None else "missing", "graph": "healthy"}
        return parts | {"status": "healthy" if "missing" not in parts.values() else "degraded"}

    def list(self, provider: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
        rows = self.libraries.where(F.col("provider") == provider) if provider else self.libraries
        return search.page(rows, ["group_name", "project_name", "id"], number, size)

    def search(self, query: str, exact: bool = False, limit: int = 10) -> DataFrame:
        return search.exact_libraries(self.libraries, self.versions, query).orderBy(F.desc("score"), "id").limit(limit) if exact else search.fuzzy_libraries(self.libraries, query, limit)

    def docs(self, library: str, query: str | None = None, topic: str | None = None, max_tokens: int | None = None, mode: str = "standard") -> DataFrame:
        rows = retrieval.documentation(self.documents, library, query, max_tokens, topic)
        return {"standard": retrieval.standard_format, "summary": retrieval.summary_format, "full": retrieval.full_format}[mode](rows)

    def find_documents(self, query: str, limit: int = 20) -> DataFrame:
        """Q3, filtering before the page is cut."""
        c = F.col("content")
        hit = self.documents.where(F.lower(c).contains(query.lower()) | F.lower("path").contains(query.lower()))
        return hit.select("id", "library", "path", T.content_score(F.lower(c), query.lower()).alias("score"), T.preview(c, dots=True).alias("preview")).orderBy(F.desc("score"), "id").limit(limit)

    def analyze(self) -> DataFrame:
        return tables.statistics(self.symbols)

    def structure(self) -> DataFrame:
        return tables.per_file(self.symbols)

    def symbol(self, name: str) -> DataFrame:
        return self.symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))

    def find_symbols(self, query: str | None = None, kind: str | None = None, language: str | None = None, limit: int | None = 100) -> DataFrame:
        return search.symbols(self.symbols, None, query, kind, language, limit)

    def full_text(self, query: str, limit: int = 20) -> DataFrame:
        text = F.concat_ws(" ", "name", "qualified_name", "documentation")
        return search.bm25(self.symbols.withColumn("key", F.to_json("ord") if dict(self.symbols.dtypes)["ord"].startswith("struct") else F.col("ord")), "key", text, query).orderBy(F.desc("score"), "key").limit(limit)

    def semantic(self, vector: list[float], filters: dict | None = None, limit: int = 10) -> DataFrame:
        if self.embeddings is None:
            raise ValueError("this corpus has no embeddings")
        return vectors.search(self.embeddings, vector, filters=filters, limit=limit)

    def graph(self, kind: str = "class", max_depth: int = 0) -> graph_build.Graph:
        g = graph_build.build(kind, self.symbols, self.dependencies, max_depth)
        return graph_build.Graph(cut(g.nodes), cut(g.edges), kind)

    def call_graph(self, start: str, depth: int = 3, direction: str = "outgoing") -> DataFrame:
        g = self.graph("function")
        first = g.nodes.where((F.col("id") == start) | (F.col("label") == start)).orderBy("id").limit(1)
        return graph.reachable(g.edges, first, depth, direction)

    def query(self, text: str, **parameters) -> DataFrame:
        g = self.graph("symbol")
        properties = F.map_from_arrays(F.array(F.lit("name"), F.lit("type")), F.array("label", "node_type"))
        nodes = g.nodes.select("id", F.array(F.lit("Symbol"), F.initcap("node_type")).alias("labels"), properties.alias("properties"))
        edges = g.edges.select("source", "target", cypher.relation_type().alias("type"), F.create_map().cast("map<string,string>").alias("properties"))
        return cypher.run(text, nodes, edges, parameters)

    def export(self, kind: str = "class", form: str = "dot") -> DataFrame:
        g = self.graph(kind)
        return {"dot": export.dot, "json": export.json_graph, "graphml": export.graphml}[form](g.nodes, g.edges) if form != "mermaid" else export.mermaid(g.edges)

    def dsm(self, kind: str = "class") -> DataFrame:
        g = self.graph(kind)
        return graph.dependency_matrix(g.edges, graph.layers(g.edges, g.nodes))

    def cycles(self, kind: str = "class") -> DataFrame:
        return graph.cycles(self.graph(kind).edges).orderBy(F.desc("impact"), "component")

    def layers(self, kind: str = "class") -> DataFrame:
        g = self.graph(kind)
        return graph.layers(g.edges, g.nodes)

    def architecture(self, kind: str = "class", rules: dict | None = None) -> dict[str, DataFrame]:
        g = self.graph(kind)
        return graph.structure_report(g.edges, g.nodes, rules)

    def metrics(self, kind: str = "class") -> DataFrame:
        g = self.graph(kind)
        return graph.xs_metrics(g.edges, g.nodes)

    def coupling(self, kind: str = "class") -> DataFrame:
        g = self.graph(kind)
        return graph.coupling(g.edges, g.nodes)

    def llmstxt(self, library: str) -> DataFrame:
        return summary.llms_text(self.documents.where(F.col("library") == library), self.symbols)

    def chunks(self, strategy: str = "auto") -> DataFrame:
        return chunk.chunk(self.documents, strategy)

    def enriched(self) -> DataFrame:
        return enrich.enrich_code(self.documents.withColumn("language", T.language_of(F.col("path"))))

    def dump(self, folder: str, level: str = "compact") -> list[str]:
        s = self.symbols.withColumn("ord", F.monotonically_increasing_id()) if dict(self.symbols.dtypes)["ord"].startswith("struct") else self.symbols
        return dump.write(s, self.graph("class").edges, {"summary": export.summary(s)}, folder, level)


def main(arguments: list[str]) -> int:
    """python -m codelode COMMAND FOLDER [ARGUMENT]: prints rows as JSON."""
    import json

    plain = {"analyze", "structure", "dsm", "cycles", "layers", "metrics", "coupling", "chunks"}
    asked = {"symbol", "find_symbols", "find_documents", "full_text", "query", "export", "docs", "call_graph", "llmstxt"}
    if len(arguments) < 2 or arguments[0] not in plain | asked or arguments[0] in asked and len(arguments) < 3:
        print(f"usage: python -m codelode COMMAND FOLDER [ARGUMENT]; commands: {', '.join(sorted(plain | asked))}")
        return 2
    spark = SparkSession.builder.appName("codelode").getOrCreate()
    corpus = Corpus.index(spark, arguments[1])
    rows = getattr(corpus, arguments[0])(*arguments[2:3])
    for line in rows.toJSON().toLocalIterator():
        print(json.dumps(json.loads(line)))
    return 0
