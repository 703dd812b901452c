"""Heuristic enrichment of code and symbols, without a model (survey X50-X63).

Lists come sorted where results would otherwise have no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import contains_any

# Names and the words that stand for them.
TAGS = {
    "async": ["async ", "await ", "asyncio"], "api": ["api", "endpoint", "@route", "@app"], "database": ["sql", "query", "orm", "model"], "testing": ["test_", "pytest", "unittest", "mock"],
    "web": ["http", "request", "response", "flask", "fastapi", "django"], "cli": ["argparse", "click", "typer"], "data": ["pandas", "numpy", "dataframe"], "ml": ["sklearn", "tensorflow", "pytorch", "model"],
}
CONCEPTS = {
    "asynchronous": ["async ", "await ", "asyncio"], "concurrency": ["thread", "multiprocessing", "concurrent"], "caching": ["cache", "lru_cache", "memoize"], "validation": ["validate", "validator", "schema"],
    "serialization": ["json", "serialize", "marshal"], "authentication": ["auth", "login", "token", "jwt"], "error-handling": ["try:", "except", "raise "], "logging": ["logging", "logger", "log."],
    "testing": ["test_", "assert", "mock"], "dependency-injection": ["inject", "container", "provider"], "orm": ["sqlalchemy", "django.db", "orm"], "api": ["api", "endpoint", "rest"],
}
CATEGORIES = ["controller", "service", "repository", "model", "utility", "configuration", "test", "middleware", "handler", "validator", "parser", "serializer", "factory", "observer", "strategy", "adapter", "decorator", "singleton", "api_endpoint", "data_access", "business_logic", "presentation", "infrastructure"]
CATEGORY_RULES = {"service": r"class\s+\w+Service", "repository": r"class\s+\w+Repository", "controller": r"class\s+\w+Controller", "api_endpoint": r"@app\.route|@router\.\w+"}
PATTERNS = ["singleton", "factory", "builder", "prototype", "adapter", "decorator", "facade", "proxy", "observer", "strategy", "command", "iterator", "state", "template-method", "visitor", "mediator", "memento", "chain-of-responsibility", "repository", "unit-of-work", "specification"]
TOPICS = ["asynchronous", "concurrency", "threading", "caching", "validation", "serialization", "authentication", "authorization", "logging", "error-handling", "testing", "mocking", "dependency-injection", "orm", "database", "api", "rest", "graphql", "websocket", "streaming", "pagination", "filtering", "sorting", "encryption", "hashing", "compression", "file-handling", "networking", "parsing", "templating", "configuration"]
VERBS = {
    "get": "Retrieves {}", "set": "Sets {}", "is": "Checks if {}", "has": "Checks if has {}", "can": "Checks if can {}", "create": "Creates {}", "delete": "Deletes {}", "remove": "Removes {}", "update": "Updates {}", "find": "Finds {}",
    "search": "Searches for {}", "validate": "Validates {}", "parse": "Parses {}", "process": "Processes {}", "handle": "Handles {}", "on": "Handler for {} event", "to": "Converts to {}", "from": "Creates from {}", "load": "Loads {}", "save": "Saves {}",
}
DOCSTRING = r'(?s)^"""(.+?)"""'


def _names(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def title(code: Column, path: Column) -> Column:
    """X50."""
    doc = F.substring(F.split_part(F.trim(F.regexp_replace(F.regexp_extract(code, DOCSTRING, 1), r"^\s+", "")), F.lit("\n"), F.lit(1)), 1, 60)
    stem = F.initcap(F.replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.\w+$", ""), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.nullif(doc, F.lit("")), F.nullif(F.regexp_extract(code, r"class\s+(\w+)", 1), F.lit("")), F.nullif(stem, F.lit("")), F.lit("Code Module"))


def description(code: Column) -> Column:
    """X51."""
    doc = F.regexp_replace(F.regexp_extract(code, DOCSTRING, 1), r"^\s+|\s+$", "")
    c, f = F.regexp_count(code, F.lit(r"\bclass\s+\w+")), F.regexp_count(code, F.lit(r"\bdef\s+\w+"))
    counts = F.concat_ws("; ", F.when(c > 0, F.concat(F.lit("Contains "), c.cast("string"), F.lit(" class(es)"))), F.when(f > 0, F.concat(F.lit("Contains "), f.cast("string"), F.lit(" function(s)"))))
    return F.coalesce(F.nullif(doc, F.lit("")), F.nullif(counts, F.lit("")), F.lit("Code module"))


def tags(code: Column, language: Column) -> Column:
    """X52."""
    low = F.lower(code)
    return F.array_sort(F.array_distinct(F.concat(F.array(language), _names([(contains_any(low, w), t) for t, w in TAGS.items()]))))


def categories(code: Column) -> Column:
    """X53."""
    low = F.lower(code)
    found = _names([(low.contains(c), c) for c in CATEGORIES] + [(code.rlike(r), c) for c, r in CATEGORY_RULES.items()])
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array(F.lit("utility")))


def concepts(code: Column) -> Column:
    """X54."""
    low = F.lower(code)
    return _names([(contains_any(low, w), c) for c, w in CONCEPTS.items()])


def import_names(code: Column, language: Column) -> Column:
    """X61."""
    rules = {"python": r"(?m)^\s*(?:from|import)\s+([\w.]+)", "javascript": r"(?:from|require\()\s*['\"]([^'\"]+)['\"]", "typescript": r"(?:from|require\()\s*['\"]([^'\"]+)['\"]", "go": r"(?m)^\s*(?:import\s+)?\"([^\"]+)\""}
    out = F.array().cast("array<string>")
    for name, rule in rules.items():
        out = F.when(language == name, F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(rule), F.lit(1))))).otherwise(out)
    return out


def keywords(code: Column, most: int = 20) -> Column:
    """Sorted, then cut."""
    found = F.concat(*[F.regexp_extract_all(code, F.lit(r), F.lit(1)) for r in (r"class\s+(\w+)", r"def\s+(\w+)")], F.transform(F.regexp_extract_all(code, F.lit(r"(?:from|import)\s+(\S+)"), F.lit(1)), lambda x: F.split_part(x, F.lit("."), F.lit(1))))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin("self", "cls")))), 1, most)


def quality(code: Column) -> Column:
    """0 to 1."""
    lines = F.split(code, "\n")
    comments = F.size(F.filter(lines, lambda x: F.trim(x).startswith("#")))
    points = lambda c, p: F.when(c, p).otherwise(0.0)
    score = (
        0.5 + points(contains_any(code, ['"""', "'''"]), 0.1) + points(contains_any(code, ["->", ": str", ": int"]), 0.1) + points(code.contains("try:") & code.contains("except"), 0.05)
        + points(contains_any(code, ["logging", "logger"]), 0.05) - points(F.size(lines) > 200, 0.1) - points(comments < F.size(lines) * 0.05, 0.05)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def related(code: Column, most: int = 10) -> Column:
    """X58."""
    low = F.lower(code)
    pairs = [(contains_any(low, [n.replace("-", "_"), n]), f"{kind}:{n}") for kind, names in (("pattern", PATTERNS), ("concept", TOPICS)) for n in names]
    return F.slice(_names(pairs), 1, most)


def search_text(*parts: Column) -> Column:
    """X57, X60."""
    return F.concat_ws(" ", *parts)


def symbol_description(name: Column, kind: Column, documentation: Column) -> Column:
    """The documentation's first line, else what the name's verb says."""
    first = F.split_part(F.trim(documentation), F.lit("\n"), F.lit(1))
    out = F.when(F.length(first) > 10, first)
    for verb, words in VERBS.items():
        rest = F.replace(F.regexp_extract(name, f"(?i)^{verb}_?(.+)", 1), F.lit("_"), F.lit(" "))
        before, after = words.split("{}")
        out = out.when(name.rlike(f"(?i)^{verb}_?.+"), F.concat(F.lit(before), rest, F.lit(after)))
    return out.otherwise(F.concat(F.initcap(kind), F.lit(" "), F.replace(name, F.lit("_"), F.lit(" "))))


def symbol_tags(name: Column, kind: Column, code: Column | None = None) -> Column:
    """X60."""
    pairs = [(name.startswith("_"), "private"), (name.startswith("__") & name.endswith("__"), "magic"), (name.startswith("test_"), "test")]
    if code is not None:
        pairs += [(code.contains(w), t) for w, t in (("async ", "async"), ("@property", "property"), ("@staticmethod", "static"), ("@classmethod", "classmethod"))]
    return F.array_sort(F.array_distinct(F.concat(F.array(kind), _names(pairs))))


def usage_hints(name: Column, kind: Column, signature: Column) -> Column:
    """X60."""
    call = F.coalesce(signature, F.concat(name, F.lit("()")))
    return (
        F.when(kind == "function", F.array(F.concat(F.lit("Call: "), call))).when(kind == "method", F.array(F.concat(F.lit("Call: instance."), call)))
        .when(kind == "class", F.array(F.concat(F.lit("Instantiate: "), name, F.lit("()")), F.concat(F.lit("Inherit: class MyClass("), name, F.lit("):"))))
        .otherwise(F.array().cast("array<string>"))
    )


def confidence(n_matches: Column) -> Column:
    """Of a keyword classification."""
    return F.least(F.lit(0.8), 0.3 + 0.1 * n_matches)


def summarize(code: Column, language: Column) -> Column:
    """A summary without a model."""
    n = F.size(F.split(code, "\n"))
    return F.concat(language, F.lit(" code with "), n.cast("string"), F.lit(" lines. "), description(code))


def enrich_code(files: DataFrame) -> DataFrame:
    """All of the above over a table of path, content and language."""
    c, p, l = F.col("content"), F.col("path"), F.col("language")
    return files.select(
        "*", title(c, p).alias("title"), description(c).alias("description"), tags(c, l).alias("tags"), categories(c).alias("categories"), concepts(c).alias("concepts"),
        keywords(c).alias("keywords"), quality(c).alias("quality"), related(c).alias("related"), import_names(c, l).alias("imports"),
    )
