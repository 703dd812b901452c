"""Chunking: one document becomes many rows (survey H1-H6, W5).

A chunk is a range of lines; all strategies first decide on ranges and then cut. Runs in
mapInArrow, one document at a time, so a partition's memory is a batch of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "id string, content string, chunk_type string, source_file string, start_line int, end_line int, token_count int, section string"
Range = tuple[int, int, str, str]  # first line, one past the last, type, section

# What starts a section of code, by language.
BOUNDARIES = {
    "python": {"class": r"class\s+\w+", "function": r"(?:async\s+)?def\s+\w+", "decorator": r"@\w+"},
    "javascript": {"class": r"(?:export\s+)?class\s+\w+", "function": r"(?:export\s+)?(?:async\s+)?function\s+\w+", "arrow_function": r"(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\(", "method": r"\s+(?:async\s+)?\w+\s*\("},
    "typescript": {"class": r"(?:export\s+)?(?:abstract\s+)?class\s+\w+", "interface": r"(?:export\s+)?interface\s+\w+", "function": r"(?:export\s+)?(?:async\s+)?function\s+\w+", "type": r"(?:export\s+)?type\s+\w+\s*="},
    "java": {"class": r"(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+\w+", "interface": r"(?:public)?\s*interface\s+\w+", "method": r"\s+(?:public|private|protected)?\s*(?:static)?\s*\w+\s+\w+\s*\("},
    "kotlin": {"class": r"(?:open|data|sealed|abstract)?\s*class\s+\w+", "object": r"object\s+\w+", "fun": r"(?:suspend\s+)?fun\s+\w+", "interface": r"interface\s+\w+"},
    "go": {"struct": r"type\s+\w+\s+struct", "interface": r"type\s+\w+\s+interface", "function": r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?\w+\s*\("},
}
# Languages of extensions, and the chunk types of sections.
CODE = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin", ".go": "go"}
TYPES = {"class": "class", "interface": "class", "function": "function", "fun": "function", "method": "function", "arrow_function": "function"}
_SPECIAL = re.compile(r"[{}\[\]().,;:!?@#$%^&*+\-=<>/\\|`~]")


def estimate_tokens(text: str) -> int:
    return len(text.split()) + len(_SPECIAL.findall(text)) // 2


def fill(sizes: list[int], room: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of as many lines as fit; each repeats the last lines of the one before, up to
    `overlap`. A line that is too large stands alone."""
    first, total, n = 0, 0, len(sizes)
    for i, size in enumerate(sizes):
        if i > first and total + size > room:
            yield first, i
            again, total = i, 0
            while again > first and total + sizes[again - 1] <= overlap:
                again -= 1
                total += sizes[again]
            first = again
        total += size
    if first < n:
        yield first, n


def by_size(lines: list[str], room: int = 1000, overlap: int = 100, least: int = 50) -> list[Range]:
    """H1."""
    found = fill([len(x) + 1 for x in lines], room, overlap)
    return [(a, b, "", "") for a, b in found if sum(len(x) + 1 for x in lines[a:b]) - 1 >= least]


def by_tokens(lines: list[str], room: int = 2000, overlap: int = 100, least: int = 50) -> list[Range]:
    """H2."""
    found = fill([estimate_tokens(x) for x in lines], room, overlap)
    return [(a, b, "", "") for a, b in found if estimate_tokens("\n".join(lines[a:b])) >= least]


def by_meaning(lines: list[str], path: str, room: int = 2000) -> list[Range]:
    """H3: sections of code; the last line always belongs to the last section."""
    language = next((v for k, v in CODE.items() if path.endswith(k)), "python")
    rules = [(kind, re.compile(rule)) for kind, rule in BOUNDARIES[language].items()]
    starts = [(i, kind) for i, x in enumerate(lines) for kind in [next((k for k, r in rules if r.match(x)), None)] if kind]
    if not starts:
        return by_size(lines, room)
    if starts[0][0] > 0:
        starts.insert(0, (0, "module_header"))
    out: list[Range] = []
    for (a, kind), (b, _) in zip(starts, [*starts[1:], (len(lines), "")]):
        if not "".join(lines[a:b]).strip():
            continue
        if sum(len(x) + 1 for x in lines[a:b]) - 1 > room:
            out += [(a + x, a + y, "code", kind) for x, y in fill([len(x) + 1 for x in lines[a:b]], room, 0)]
        else:
            out.append((a, b, TYPES.get(kind, ""), kind))
    return out


def by_heading(lines: list[str], room: int = 2000, level: int = 2) -> list[Range]:
    """H4: Markdown sections from level 2 on; what comes before the first is the preamble."""
    heads = [(i, m[2].strip()) for i, x in enumerate(lines) for m in [re.match(r"(#{1,6})\s+(.+)$", x)] if m and len(m[1]) >= level]
    if not heads:
        return by_size(lines, room)
    out: list[Range] = [(0, heads[0][0], "documentation", "preamble")] if "".join(lines[: heads[0][0]]).strip() else []
    for (a, name), (b, _) in zip(heads, [*heads[1:], (len(lines), "")]):
        if sum(len(x) + 1 for x in lines[a:b]) - 1 > room:
            out += [(a + x, a + y, "documentation", name) for x, y, _, _ in by_size(lines[a:b], room, 50)]
        else:
            out.append((a, b, "documentation", name))
    return out


def by_extension(lines: list[str], path: str) -> list[Range]:
    """H5."""
    if path.endswith(".md"):
        return by_heading(lines)
    return by_meaning(lines, path) if any(path.endswith(e) for e in (".py", ".js", ".ts", ".java", ".kt", ".go")) else by_size(lines)


STRATEGIES: dict[str, Callable[[list[str], str], list[Range]]] = {
    "fixed_size": lambda x, p: by_size(x), "token_based": lambda x, p: by_tokens(x), "semantic": by_meaning, "markdown": lambda x, p: by_heading(x), "auto": by_extension,
    "embedding": lambda x, p: by_tokens(x, 500, 50, 20), "context": lambda x, p: by_tokens(x, 2000, 100, 100),  # H6
}


def cut_text(content: str, path: str, strategy: str) -> list[tuple]:
    if not content:
        return []
    lines = content.split("\n")
    plain = "documentation" if path.endswith(".md") else "code"
    rows = []
    for a, b, kind, section in STRATEGIES[strategy](lines, path):
        text = "\n".join(lines[a:b])
        key = hashlib.sha256(f"{path}:{a + 1}:{text[:100]}".encode()).hexdigest()[:16]
        rows.append((key, text, kind or plain, path, a + 1, b, estimate_tokens(text), section))
    return rows


def chunk(docs: DataFrame, strategy: str = "auto", path: str = "path", content: str = "content") -> DataFrame:
    """Chunks of all documents."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                rows = [r for p, c in zip(part.column(path).to_pylist(), part.column(content).to_pylist()) for r in cut_text(c or "", p or "", strategy)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return docs.select(path, content).mapInArrow(run, SCHEMA)


def register(spark) -> None:
    """The strategies as a table function for SQL: SELECT * FROM docs, LATERAL chunk(path, content, 'auto')."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=SCHEMA)
    class Chunk:
        def eval(self, path: str, content: str, strategy: str):
            yield from cut_text(content or "", path or "", strategy)

    spark.udtf.register("chunk", Chunk)
