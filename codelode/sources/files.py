"""Repository trees as DataFrames (survey S1-S15, S17-S19)."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as T

# Folders that walks leave out, and names of a repository's own settings.
SKIPPED = [".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", "target", ".idea", ".vscode", ".tox", ".mypy_cache", ".pytest_cache", "vendor"]
TESTS = ["test", "tests", "__tests__", "spec"]
SETTINGS = ["git_context.json", ".git_context.json", "repo_context.json"]


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Path (from the root), length, modified and content of every file that isn't binary.
    Spark's reader leaves out names that start with a dot or an underscore."""
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(re.sub(r"^\w+:/*", "/", base)), "")
    return rows.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), F.col("content").alias("bytes")).where(~binary(F.col("bytes")))


def binary(content: Column, most: int = 8192) -> Column:
    """S3: a zero byte near the start."""
    return F.hex(F.substring(content, 1, most)).rlike("^(?:..)*?00")


def decoded(rows: DataFrame) -> DataFrame:
    """Text, with replacement characters where bytes aren't UTF-8."""
    return rows.withColumn("content", F.coalesce(F.try_validate_utf8(F.col("bytes").cast("string")), F.make_valid_utf8(F.col("bytes").cast("string")))).drop("bytes")


def walk(rows: DataFrame, tests: bool = False, hidden: bool = False, skipped: list[str] | None = None, globs: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Files of known languages outside of left-out folders; shell patterns may narrow."""
    parts = F.split("path", "/")
    keep = ~F.arrays_overlap(parts, F.array(*map(F.lit, skipped if skipped is not None else SKIPPED))) & (T.language_of(F.col("path")) != "unknown")
    if not tests:
        keep &= ~F.arrays_overlap(parts, F.array(*map(F.lit, TESTS))) & ~T.file_name(F.col("path")).rlike(r"^test_|_test\.\w+$|\.(test|spec)\.\w+$")
    if not hidden:
        keep &= ~F.exists(parts, lambda x: x.startswith("."))
    if globs:
        keep &= T.any_of([F.col("path").rlike(T.glob_regex(g)) | T.file_name(F.col("path")).rlike(T.glob_regex(g)) for g in globs])
    if excludes:
        keep &= ~T.any_of([F.col("path").rlike(T.glob_regex(g)) for g in excludes])
    return rows.where(keep)


def documents(rows: DataFrame, most: int = 100 * 1024) -> DataFrame:
    """Read-me files and Markdown under documentation folders, up to a size."""
    low = F.lower("path")
    return rows.where((F.col("length") <= most) & (T.file_name(low).startswith("readme") | (low.rlike(r"(^|/)docs?/") & low.endswith(".md"))))


def tags(rows: DataFrame, most: int = 5) -> DataFrame:
    """The newest tags by date (a top-k report)."""
    return rows.orderBy(F.desc("date"), "name").limit(most)


def settings(rows: DataFrame, names: list[str] | None = None, schema: str = "projectTitle string, description string, folders array<string>, excludeFolders array<string>, excludeFiles array<string>") -> DataFrame:
    """The first of the known settings files, parsed; a tool's own file name may come first in
    `names`."""
    names = names or SETTINGS
    order = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    first = rows.where(F.col("path").isin(names)).agg(F.min_by("content", order).alias("content"))
    return first.select(F.from_json("content", schema).alias("s")).select("s.*")


def changed(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content's hash isn't in the cache yet."""
    hashed = rows.withColumn("file_hash", F.sha2("content", 256))
    return hashed.join(cache.select("path", "file_hash"), ["path", "file_hash"], "left_anti")


def simple_yaml(text: str) -> dict:
    """The YAML that rule files use: nested lists of mappings, inline lists, scalars."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml:
        return yaml.safe_load(text) or {}
    out: dict = {}
    section, item, key = None, None, None
    scalar = lambda s: [x.strip().strip("'\"") for x in s[1:-1].split(",") if x.strip()] if s.startswith("[") else s.strip("'\"")
    for raw in text.split("\n"):
        line = re.sub(r"\s+#.*$|^#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if indent == 0 and body.endswith(":"):
            section = out.setdefault(body[:-1], [])
        elif body.startswith("- ") and ":" in body and not re.match(r"- ['\"]", body):
            item = {}
            section.append(item)
            k, _, v = body[2:].partition(":")
            key, item[k.strip()] = k.strip(), scalar(v.strip()) if v.strip() else []
        elif body.startswith("- "):
            item[key].append(scalar(body[2:].strip()))
        else:
            k, _, v = body.partition(":")
            if item is not None and section is not None and indent > 0:
                key, item[k.strip()] = k.strip(), scalar(v.strip()) if v.strip() else []
            else:
                out[k.strip()] = scalar(v.strip())
    return out


def config(path: str | None = None, environment: dict[str, str] | None = None) -> dict:
    """Settings with ${NAME} taken from the environment."""
    import os

    env = os.environ if environment is None else environment
    text = Path(path).read_text() if path else ""
    text = re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), text)
    return json.loads(text) if text.lstrip().startswith("{") else simple_yaml(text)


class Provider:
    """What a source of repositories has to give; S6 and S7 need a network and would be
    subclasses that read an API."""

    name = "base"

    def files(self, spark: SparkSession, repository: str, ref: str | None = None) -> DataFrame:
        raise NotImplementedError

    def versions(self, spark: SparkSession, repository: str) -> DataFrame:
        raise NotImplementedError


class LocalProvider(Provider):
    name = "local"

    def files(self, spark: SparkSession, repository: str, ref: str | None = None) -> DataFrame:
        return decoded(tree(spark, repository))


PROVIDERS: dict[str, type[Provider]] = {"local": LocalProvider}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]()
