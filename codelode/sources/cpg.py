"""Code property graph text: pipe-delimited lines of an external tool (survey C1-C7, J15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as T


def unwrapped(text: DataFrame, column: str = "value") -> DataFrame:
    """List(...) and JSON arrays as lines; other text as it is."""
    c = F.col(column)
    items = (
        F.when(c.rlike(r"(?s)List\(.*\)"), F.regexp_extract_all(c, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)))
        .when(F.trim(c).startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.split(c, "\n"))).otherwise(F.split(c, "\n"))
    )
    return text.select(F.explode(items).alias("line")).select(F.trim("line").alias("line")).where("line <> ''")


def _fields(lines: DataFrame, tag: str, least: int) -> DataFrame:
    parts = F.split("line", r"\|")
    return lines.select(parts.alias("p")).where((F.upper(F.col("p")[0]) == tag) & (F.size("p") >= least))


def _at(i: int) -> Column:
    return F.get("p", F.lit(i))


def parameters(text: Column) -> Column:
    """C3."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x.contains(":"))
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.regexp_replace(x, r"^[^:]*:", "").alias("type")))


def methods(lines: DataFrame) -> DataFrame:
    """C1."""
    return _fields(lines, "METHOD", 7).select(_at(1).alias("name"), _at(2).alias("full_name"), _at(3).alias("filename"), T.safe_int(_at(4)).alias("line_start"), T.safe_int(_at(5)).alias("line_end"), _at(6).alias("signature"), parameters(_at(7)).alias("parameters"))


def types(lines: DataFrame) -> DataFrame:
    bases = F.filter(F.transform(F.split(F.coalesce(_at(5), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return _fields(lines, "TYPE", 5).select(_at(1).alias("name"), _at(2).alias("full_name"), _at(3).alias("filename"), T.safe_int(_at(4)).alias("line_start"), bases.alias("inherits_from"))


def members(lines: DataFrame) -> DataFrame:
    return _fields(lines, "MEMBER", 4).select(_at(1).alias("name"), _at(2).alias("type_name"), _at(3).alias("parent_type"))


def calls(lines: DataFrame) -> DataFrame:
    return _fields(lines, "CALL", 4).select(_at(1).alias("caller"), _at(2).alias("callee"), T.safe_int(_at(3)).alias("line"))


def comments(lines: DataFrame) -> DataFrame:
    """C4: file|line|text, where the text may hold bars."""
    p = F.split("line", r"\|")
    return lines.select(p.alias("p")).where("size(p) >= 3").select(_at(0).alias("file_path"), T.safe_int(_at(1)).alias("line_number"), F.array_join(F.slice("p", 3, F.size("p")), "|").alias("code"))


def data_flows(lines: DataFrame) -> DataFrame:
    """C4."""
    p = F.split("line", r"\|")
    return lines.select(p.alias("p")).where("size(p) >= 6").select(_at(0).alias("source_file"), T.safe_int(_at(1)).alias("source_line"), _at(2).alias("source_code"), _at(3).alias("sink_file"), T.safe_int(_at(4)).alias("sink_line"), _at(5).alias("sink_code"))


def to_symbols(lines: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Types, methods and members as symbols; the comment on the line before is the
    documentation; made-up names go."""
    lang = T.language_of(F.col("filename"))
    t = types(lines).select("name", F.col("full_name").alias("qualified_name"), T.type_kind(F.col("name"), lang).alias("symbol_type"), "filename", "line_start", F.lit(None).cast("int").alias("line_end"), F.lit(None).cast("string").alias("signature"), F.col("inherits_from").alias("bases"), F.lit(None).cast("string").alias("parent_class"))
    parent = T.parent_class(F.col("full_name"))
    m = methods(lines).select("name", F.col("full_name").alias("qualified_name"), F.when(parent.isNotNull(), "method").otherwise("function").alias("symbol_type"), "filename", "line_start", "line_end", "signature", F.array().cast("array<string>").alias("bases"), parent.alias("parent_class"))
    v = members(lines).select("name", F.concat_ws(".", "parent_type", "name").alias("qualified_name"), F.lit("variable").alias("symbol_type"), F.lit("").alias("filename"), F.lit(0).alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.col("type_name").alias("signature"), F.array().cast("array<string>").alias("bases"), F.col("parent_type").alias("parent_class"))
    rows = t.unionByName(m).unionByName(v).where(~T.mapper_artifact(F.col("name"))).withColumn("language", lang).withColumn("file_path", T.normal_path(F.col("filename"))).drop("filename")
    rows = rows.withColumn("visibility", T.visibility(F.col("name"), F.col("language"))).withColumn("return_type", T.return_type(F.col("signature")))
    if notes is None:
        return rows.withColumn("documentation", F.lit(None).cast("string"))
    n = notes.select("file_path", (F.col("line_number") + 1).alias("line_start"), F.col("code").alias("documentation")).dropDuplicates(["file_path", "line_start"])
    return rows.join(n, ["file_path", "line_start"], "left")


def to_dependencies(lines: DataFrame) -> DataFrame:
    """Calls and inheritance as dependencies."""
    c = calls(lines).where(~T.mapper_artifact(F.col("callee"))).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("call").alias("dependency_type"), "line")
    i = types(lines).select(F.col("full_name").alias("source"), F.explode("inherits_from").alias("target"), F.lit("inherits").alias("dependency_type"), F.col("line_start").alias("line"))
    return c.union(i)


def size_metrics(symbols: DataFrame, large: int = 50) -> DataFrame:
    """Lines of functions and methods, and which are large."""
    n = F.col("line_end") - F.col("line_start") + 1
    return symbols.where(F.col("symbol_type").isin("function", "method")).select("qualified_name", n.alias("n_lines"), (n > large).alias("large"))


def report(symbols: DataFrame) -> DataFrame:
    """A Markdown list for each file."""
    line = F.concat(F.lit("- `"), "qualified_name", F.lit("` ("), "symbol_type", F.lit(", line "), F.col("line_start").cast("string"), F.lit(")"))
    return symbols.groupBy("file_path").agg(F.concat(F.lit("## "), F.first("file_path"), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "qualified_name", line.alias("x")))), lambda s: s["x"]), "\n")).alias("markdown"))
