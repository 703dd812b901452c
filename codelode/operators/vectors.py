"""Vector collections: similarity search and the offline hash embedding (survey V1-V8, Q7, Q10, Q17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.runtime import shuffle_width

#: Dimensions of known embedding models.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "voyage-code-2": 1536, "voyage-2": 1024, "cohere-embed-english-v3.0": 1024, "cohere-embed-multilingual-v3.0": 1024}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """V2. Euclid is a distance: smaller is nearer."""
    if metric == "dot":
        return dot(a, b)
    if metric == "euclid":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    return dot(a, b) / (norm(a) * norm(b))


def search(rows: DataFrame, query: list[float], key: str = "id", vector: str = "vector", metric: str = "cosine", filters: dict | None = None, limit: int = 10) -> DataFrame:
    """Rows that equal the filters, nearest first."""
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name) == value)
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(key).alias("id"), similarity(F.col(vector), literal, metric).alias("score"))
    return scored.orderBy(F.asc("score") if metric == "euclid" else F.desc("score"), "id").limit(limit)


def hash_embedding(text: Column, dims: int) -> Column:
    """V5, V7: characters counted at places that their code and position give, three statistics
    in the first slots, unit length; blank text gives zeros. One array per row, no Python."""
    low = F.lower(text)
    letters = F.transform(F.filter(F.split(low, ""), lambda x: x != ""), lambda x, i: (F.ascii(x).cast("long") * (i + 1)) % dims)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("double")
    chars = F.length(text).cast("double")
    # few places are counted one by one; for many, sort once and fold runs into a dense array
    slots = F.lit(list(range(dims))).cast("array<long>")
    counts = _once(letters, lambda at: F.transform(slots, lambda i: F.size(F.filter(at, lambda p: p == i)).cast("double"))) if dims <= 64 else _dense(letters, dims)
    stats = F.array(words / 100, chars / 1000, F.when(chars > 0, words / chars).otherwise(0.0))
    raw = F.concat(F.slice(stats, 1, min(3, dims)), F.slice(counts, 4, max(dims - 3, 1))) if dims > 3 else F.slice(stats, 1, dims)
    length = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, v: s + v * v))
    unit = _once(raw, lambda r: _once(length(r), lambda z: F.transform(r, lambda v: F.when(z > 0, v / z).otherwise(0.0))))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array_repeat(F.lit(0.0), dims)).otherwise(unit)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all tasks: vectors cost more than their rows' bytes tell, by which files are split."""
    return rows.repartition(shuffle_width(rows.sparkSession))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: what a lambda only refers to is computed anew for
    each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _dense(places: Column, dims: int) -> Column:
    ordered = F.array_sort(places)
    # (last place, its count, dense prefix): each step appends the zeros between two places
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("n"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        gap = F.array_repeat(F.lit(0.0), (p - a["at"] - 1).cast("int"))
        done = F.when(a["at"] >= 0, F.concat(a["out"], F.array(a["n"]), gap)).otherwise(gap)
        return F.when(p == a["at"], F.struct(a["at"].alias("at"), (a["n"] + 1).alias("n"), a["out"].alias("out"))).otherwise(F.struct(p.alias("at"), F.lit(1.0).alias("n"), done.alias("out")))

    def close(a: Column) -> Column:
        full = F.when(a["at"] >= 0, F.concat(a["out"], F.array(a["n"]))).otherwise(a["out"])
        return F.concat(full, F.array_repeat(F.lit(0.0), (F.lit(dims) - F.size(full)).cast("int")))

    return F.aggregate(ordered, start, step, close)


def embed_documents(docs: DataFrame, dims: int, most: int = 8000) -> DataFrame:
    """V6: id and vector of the first `most` characters."""
    return dealt(docs.select("id", "content")).select("id", hash_embedding(F.substring("content", 1, most), dims).alias("vector"))


def embed_symbols(symbols: DataFrame, dims: int) -> DataFrame:
    """V6: name, qualified name and documentation together."""
    text = F.concat_ws(" ", "name", "qualified_name", "documentation")
    return dealt(symbols.select("ord", text.alias("text"))).select(F.col("ord").alias("id"), hash_embedding(F.col("text"), dims).alias("vector"))


def enrich(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with what is known of their nodes."""
    return hits.join(nodes, "id", "left")
