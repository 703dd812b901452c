"""A small subset of Cypher over node and edge tables (survey G12, G13, Q16).

nodes: id, labels, properties. edges: source, target, type, properties. Any other text raises.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = r"\(\s*(\w+)\s*((?::\s*\w+\s*)*)(?:\{([^}]*)\})?\s*\)"


def _properties(text: str | None, parameters: dict) -> dict[str, str]:
    out = {}
    for part in filter(None, (x.strip() for x in (text or "").split(","))):
        name, _, value = part.partition(":")
        value = value.strip()
        out[name.strip()] = str(parameters[value[1:]]) if value.startswith("$") else value.strip("'\"")
    return out


def match(nodes: DataFrame, labels: list[str] | None = None, properties: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Nodes with all labels and equal properties."""
    for label in labels or []:
        nodes = nodes.where(F.array_contains("labels", label))
    for name, value in (properties or {}).items():
        nodes = nodes.where(F.element_at("properties", name) == value)
    return nodes.orderBy("id").limit(limit) if limit else nodes


def run(text: str, nodes: DataFrame, edges: DataFrame, parameters: dict | None = None) -> DataFrame:
    parameters = parameters or {}
    query = " ".join(text.split())
    limit = re.search(r" LIMIT (\d+)$", query, re.I)
    most = int(limit[1]) if limit else None
    query = query[: limit.start()] if limit else query
    labels_of = lambda s: re.findall(r"\w+", s or "")
    if m := re.fullmatch(rf"MATCH {NODE} RETURN (.+)", query, re.I):
        name, labels, props, wanted = m.groups()
        rows = match(nodes, labels_of(labels), _properties(props, parameters))
        if re.fullmatch(rf"count\(\s*(\*|{name})\s*\)( AS \w+)?", wanted, re.I):
            return rows.agg(F.count("*").alias("count"))
        if re.fullmatch(rf"{name}\.id( AS \w+)?", wanted, re.I):
            out = rows.select("id")
        elif re.fullmatch(rf"labels\({name}\)( AS \w+)?", wanted, re.I):
            out = rows.select("labels")
        elif wanted == name:
            out = rows.select("id", "labels", "properties")
        elif p := re.fullmatch(rf"{name}\.(\w+)( AS \w+)?", wanted):
            out = rows.select("id", F.element_at("properties", p[1]).alias(p[1]))
        else:
            raise ValueError(f"not supported: {text}")
        return out.orderBy(out.columns[0]).limit(most) if most else out
    if m := re.fullmatch(rf"MATCH (?:{NODE}|\(\))-\[\s*(\w+)?\s*(?::\s*(\w+))?\s*\]->(?:{NODE}|\(\)) RETURN (.+)", query, re.I):
        _, la, pa, rel, kind, _, lb, pb, wanted = m.groups()
        rows = edges.where(F.upper("type") == kind.upper()) if kind else edges
        for column, labels, props in (("source", la, pa), ("target", lb, pb)):
            if labels or props:
                rows = rows.join(match(nodes, labels_of(labels), _properties(props, parameters)).select(F.col("id").alias(column)), column, "left_semi")
        if re.fullmatch(rf"count\(\s*(\*|{rel})\s*\)( AS \w+)?", wanted, re.I):
            return rows.agg(F.count("*").alias("count"))
        if p := re.fullmatch(rf"{rel}\.(\w+)( AS \w+)?", wanted):
            return rows.select("source", "target", F.element_at("properties", p[1]).alias(p[1]))
        out = rows.select("source", "target", "type", "properties")
        return out.orderBy("source", "target").limit(most) if most else out
    raise ValueError(f"not supported: {text}")


def from_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols as nodes, with their type and PublicAPI as labels."""
    labels = F.array_compact(F.array(F.lit("Symbol"), F.initcap("symbol_type"), F.when(F.col("is_exported") & (F.col("visibility") == "public"), "PublicAPI")))
    names = ["name", "qualified_name", "file_path", "language", "visibility"]
    return symbols.select(F.concat(F.col("library_id").cast("string"), F.lit(":"), "qualified_name", F.lit("#"), F.col("ord").cast("string")).alias("id"), "library_id", "ord", labels.alias("labels"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names)).alias("properties"))


def relation_type(relation: str = "relation"):
    """Upper case with underscores."""
    return F.upper(F.replace(F.col(relation), F.lit("-"), F.lit("_")))
