"""Short texts about a library: read-me summary, llms.txt, snippets with context (survey W7, X12, X19, X20, Y7)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as T

#: Headings that end a read-me's summary, and names of key files.
STOPS = ["install", "setup", "getting started", "requirements", "contributing", "license"]
KEY_FILES = ["main.py", "app.py", "__init__.py", "index.js", "index.ts", "setup.py", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "pom.xml"]


def readme_summary(content: Column, most: int = 2000) -> Column:
    """Text without fences up to the first heading about installation, cut to a size."""
    lines = F.split(F.regexp_replace(content, T.FENCE, ""), "\n")
    stop = "|".join(STOPS)
    at = F.aggregate(lines, F.struct(F.lit(False).alias("end"), F.lit("").alias("text")), lambda a, x: F.when(a["end"] | F.lower(x).rlike(rf"^#+\s.*({stop})"), F.struct(F.lit(True).alias("end"), a["text"].alias("text"))).otherwise(F.struct(F.lit(False).alias("end"), F.concat(a["text"], x, F.lit("\n")).alias("text"))))
    return F.substring(F.trim(at["text"]), 1, most)


def snippets_with_context(docs: DataFrame, back: int = 4) -> DataFrame:
    """Each fenced block with up to four lines before it that aren't blank. A closing
    fence doesn't open another block."""
    lines = docs.select("id", F.split("content", "\n").alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.when(F.ltrim(x).startswith("```"), i)), lambda i: i.isNotNull())
    pairs = lines.withColumn("marks", marks).withColumn("k", F.explode(F.when(F.size("marks") > 1, F.sequence(F.lit(0), F.floor(F.size("marks") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))))
    a, b = F.element_at("marks", F.col("k") * 2 + 1), F.element_at("marks", F.col("k") * 2 + 2)
    before = F.filter(F.slice("lines", F.greatest(a - back, F.lit(0)) + 1, F.least(a, F.lit(back))), lambda x: F.trim(x) != "")
    language = F.coalesce(F.nullif(F.regexp_extract(F.element_at("lines", a + 1), r"```(\w+)", 1), F.lit("")), F.lit("text"))
    return pairs.select("id", "k", language.alias("language"), F.array_join(F.slice("lines", a + 2, b - a - 1), "\n").alias("code"), F.array_join(before, "\n").alias("context"))


def llms_text(docs: DataFrame, symbols: DataFrame, budget: int = 2000) -> DataFrame:
    """One text for a library: title and description from its read-me, documents by quality,
    public classes and functions; cut to a budget of four characters a token."""
    c, p = F.col("content"), F.col("path")
    name = T.file_name(F.lower(p))
    rank = F.struct(F.when(name == "readme.md", 0).when(name.startswith("readme"), 1).otherwise(2).alias("o"), F.length("path").alias("n"), F.col("path").alias("q"))
    first = docs.agg(F.min_by(F.struct("path", "content"), rank).alias("r"))
    head = first.select(F.concat(F.lit("# "), T.title(F.col("r.content"), F.col("r.path")), F.lit("\n\n> "), F.substring(T.description(F.col("r.content")), 1, 200)).alias("head"))
    best = docs.select("path", T.title(c, p).alias("title"), T.quality_score(c, p).alias("q")).orderBy(F.desc("q"), "path").limit(8)
    links = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("o"), "path", "title"))), lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["path"], F.lit(")"))), "\n").alias("links"))
    public = symbols.where(F.col("is_exported") & F.col("symbol_type").isin("class", "function")).select("qualified_name", "symbol_type").distinct().orderBy("symbol_type", "qualified_name").limit(8)
    api = public.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_type", "qualified_name"))), lambda x: F.concat(F.lit("- `"), x["qualified_name"], F.lit("` ("), x["symbol_type"], F.lit(")"))), "\n").alias("api"))
    text = F.concat(F.col("head"), F.lit("\n\n## Documentation\n\n"), F.col("links"), F.lit("\n\n## API\n\n"), F.col("api"), F.lit("\n"))
    return head.crossJoin(links).crossJoin(api).select(F.substring(text, 1, budget * 4).alias("text"))  # one row each


def repaired_json(text: str) -> dict | list | None:
    """What a model meant as JSON: fences and talk around it, trailing commas, open brackets."""
    body = re.sub(r"```(?:json)?", "", text)
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    end = max(body.rfind("}"), body.rfind("]"))
    for candidate in (body[: end + 1], body):
        fixed = re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], candidate).rstrip().rstrip(",")
        stack, quoted, escaped = [], False, False
        for ch in fixed:
            if quoted:
                quoted, escaped = escaped or ch != '"', not escaped and ch == "\\"
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif ch in "}]" and stack:
                stack.pop()
        try:
            return json.loads(fixed + '"' * quoted + "".join(reversed(stack)))
        except ValueError:
            continue
    return None
