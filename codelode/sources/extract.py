"""Symbols and dependencies from source files (survey E1-E8).

Python is parsed with the standard library's syntax tree. The other languages are read with
patterns over text whose comments and strings are blanked out and whose braces tell what is inside
what; that finds declarations, not every expression, and emits no calls. All languages give one
schema, with `bases` and `implements` filled alike.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import LANGUAGES

SYMBOL = {"name": "string", "qualified_name": "string", "symbol_type": "string", "file_path": "string", "line_start": "int", "line_end": "int", "signature": "string", "visibility": "string", "language": "string", "documentation": "string", "is_exported": "boolean", "bases": "array<string>", "implements": "array<string>", "parent_class": "string", "is_abstract": "boolean", "is_async": "boolean"}
DEPENDENCY = {"source": "string", "target": "string", "dependency_type": "string", "line": "int", "is_external": "boolean"}
SCHEMA = "row_kind string, " + ", ".join(f"{k} {v}" for k, v in (SYMBOL | DEPENDENCY).items())
ROW = dict.fromkeys(["row_kind", *SYMBOL, *DEPENDENCY])


def symbol(name: str, kind: str, path: str, language: str, start: int, end: int, **more) -> dict:
    parent = more.get("parent_class")
    row = ROW | {"row_kind": "symbol", "name": name, "symbol_type": kind, "file_path": path, "language": language, "line_start": start, "line_end": end, "qualified_name": f"{parent}.{name}" if parent else name, "visibility": "public", "is_abstract": False, "is_async": False, "bases": [], "implements": []} | more
    row["is_exported"] = row["visibility"] == "public"
    return row


def dependency(source: str, target: str, kind: str, path: str, line: int) -> dict:
    return ROW | {"row_kind": "dependency", "source": source, "target": target, "dependency_type": kind, "file_path": path, "line": line, "is_external": not target.startswith(".")}


# ---- Python


class PythonReader(ast.NodeVisitor):
    """Functions, methods, classes, imports and calls."""

    def __init__(self, path: str):
        self.path, self.rows, self.scope, self.kinds = path, [], [], []

    def _declare(self, node, kind: str, **more) -> None:
        holder = ".".join(self.scope) if self.kinds and self.kinds[-1] == "class" else None
        self.rows.append(symbol(node.name, kind, self.path, "python", node.lineno, node.end_lineno, documentation=ast.get_docstring(node), visibility="private" if node.name.startswith("_") else "public", parent_class=holder, qualified_name=".".join([*self.scope, node.name]), **more))

    def _inside(self, node, kind: str) -> None:
        self.scope.append(node.name)
        self.kinds.append(kind)
        self.generic_visit(node)
        self.scope.pop()
        self.kinds.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [ast.unparse(b) for b in node.bases]
        abstract = any(b.split(".")[-1] in ("ABC", "Protocol") for b in bases) or any("ABCMeta" in ast.unparse(k.value) for k in node.keywords)
        self._declare(node, "enum" if any(b.split(".")[-1] in ("Enum", "IntEnum", "StrEnum", "Flag") for b in bases) else "class", bases=bases, is_abstract=abstract, signature=f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}")
        self._inside(node, "class")

    def _function(self, node, asynchronous: bool) -> None:
        back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        marks = [ast.unparse(d) for d in node.decorator_list]
        self._declare(node, "method" if self.kinds and self.kinds[-1] == "class" else "function", signature=f"{node.name}({ast.unparse(node.args)}){back}", is_async=asynchronous, is_abstract=any(m.endswith("abstractmethod") for m in marks))
        self._inside(node, "function")

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._function(node, False)

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._function(node, True)

    def visit_Import(self, node: ast.Import) -> None:
        self.rows += [dependency(self.path, a.name, "import", self.path, node.lineno) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.rows.append(dependency(self.path, "." * node.level + (node.module or ""), "import", self.path, node.lineno))

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            target = ast.unparse(node.func)
            if target.startswith("self.") and self.kinds.count("class"):
                target = ".".join(self.scope[: len(self.kinds) - 1 - self.kinds[::-1].index("class") + 1]) + target[4:]
            if "(" not in target:
                self.rows.append(dependency(".".join(self.scope) or self.path, target, "call", self.path, node.lineno))
        self.generic_visit(node)


def read_python(text: str, path: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    reader = PythonReader(path)
    reader.visit(tree)
    return reader.rows


# ---- languages with braces

STRINGS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
HASHES = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)


def blank(text: str, rule: re.Pattern) -> str:
    """Comments and strings as spaces; line ends stay."""
    return rule.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def block_end(code: str, start: int) -> int:
    """The place after the block that opens next, or of the declaration's end."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif not depth:
            return m.end()
    return len(code)


VISIBLE = r"(?P<visible>public|private|protected|internal|fileprivate|open)?[ \t]*"
# Declarations by language: (kind, pattern). Names in the groups are name, visible, bases, implements, mods.
RULES: dict[str, list[tuple[str, str]]] = {
    "javascript": [
        ("class", r"(?P<mods>(?:export\s+|default\s+|abstract\s+)*)class\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s+extends\s+(?P<bases>[\w.]+)(?:<[^>{]*>)?)?(?:\s+implements\s+(?P<implements>[\w., <>]+?))?\s*\{"),
        ("interface", r"(?:export\s+)?interface\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s+extends\s+(?P<bases>[\w., <>]+?))?\s*\{"),
        ("enum", r"(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)"),
        ("variable", r"(?:export\s+)?type\s+(?P<name>\w+)(?:<[^>=]*>)?\s*="),
        ("function", r"(?P<mods>(?:export\s+|default\s+|async\s+)*)function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>(]*>)?\("),
        ("function", r"(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)(?:\s*:[^=\n]+)?\s*=\s*(?P<mods>async\s+)?(?:\([^()]*\)|\w+)(?:\s*:[^=\n{]+)?\s*=>"),
        ("method", r"(?m)^[ \t]+(?P<mods>(?:(?:public|private|protected|static|async|get|set|readonly|abstract|override)\s+)*)(?P<name>#?\w+)\s*(?:<[^>(]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\s*:\s*[^{;\n]+)?\s*\{"),
    ],
    "java": [
        ("class", VISIBLE + r"(?P<mods>(?:(?:static|final|abstract|sealed|strictfp)\s+)*)(?:class|record)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+(?P<implements>[\w., <>]+?))?\s*\{"),
        ("interface", VISIBLE + r"(?P<mods>(?:static\s+|sealed\s+)*)@?interface\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<bases>[\w., <>]+?))?\s*\{"),
        ("enum", VISIBLE + r"(?P<mods>(?:static\s+)?)enum\s+(?P<name>\w+)(?:\s+implements\s+(?P<implements>[\w., <>]+?))?\s*\{"),
        ("method", r"(?m)^[ \t]+" + VISIBLE + r"(?P<mods>(?:(?:static|final|abstract|synchronized|default|native)\s+)*)(?:<[^>]+>\s*)?(?:[\w.<>\[\],? ]+\s+)?(?P<name>\w+)\s*\([^()]*\)\s*(?:throws\s+[\w., ]+)?\s*[{;]"),
    ],
    "kotlin": [
        ("interface", VISIBLE + r"(?P<mods>(?:sealed\s+|fun\s+)*)interface\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*:\s*(?P<bases>[\w., <>()]+?))?\s*(?:\{|\n)"),
        ("enum", VISIBLE + r"enum\s+class\s+(?P<name>\w+)"),
        ("class", VISIBLE + r"(?P<mods>(?:(?:data|sealed|open|abstract|inner|value|annotation)\s+)*)class\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*(?:private\s+constructor)?\([^)]*\))?(?:\s*:\s*(?P<bases>[\w., <>()]+?))?\s*(?:\{|\n)"),
        ("class", VISIBLE + r"(?P<mods>(?:companion\s+|data\s+)*)object\s+(?P<name>\w+)"),
        ("function", VISIBLE + r"(?P<mods>(?:(?:suspend|inline|override|open|abstract|operator|infix|tailrec)\s+)*)fun\s+(?:<[^>]+>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*\("),
        ("method", r"(?m)^[ \t]+" + VISIBLE + r"(?P<name>constructor)\s*\("),
    ],
    "go": [("class", r"(?m)^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"(?m)^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("function", r"(?m)^func\s+(?:\(\s*\w*\s*\*?(?P<holder>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(")],
    "rust": [
        ("class", r"(?P<visible>pub)?(?:\([^)]*\))?\s*struct\s+(?P<name>\w+)"), ("enum", r"(?P<visible>pub)?(?:\([^)]*\))?\s*enum\s+(?P<name>\w+)"), ("interface", r"(?P<visible>pub)?(?:\([^)]*\))?\s*trait\s+(?P<name>\w+)"),
        ("scope", r"impl(?:<[^>{]*>)?\s+(?:(?P<implements>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<name>\w+)"), ("function", r"(?P<visible>pub)?(?:\([^)]*\))?\s*(?P<mods>(?:async\s+|const\s+|unsafe\s+)*)fn\s+(?P<name>\w+)"),
    ],
    "c": [("class", r"(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"), ("enum", r"(?:typedef\s+)?enum\s+(?P<name>\w+)\s*\{"), ("function", r"(?m)^(?P<mods>(?:(?:static|inline|extern|const|unsigned|signed|struct)\s+)*)[A-Za-z_][\w\s*]*?[\s*](?P<name>[A-Za-z_]\w*)\s*\([^;{}()]*\)\s*\{")],
    "cpp": [
        ("class", r"(?:class|struct)\s+(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?P<bases>[\w:, <>]+?))?\s*\{"), ("enum", r"enum\s+(?:class\s+|struct\s+)?(?P<name>\w+)"),
        ("function", r"(?m)^[ \t]*(?P<mods>(?:(?:static|inline|virtual|constexpr|explicit|const)\s+)*)(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])?(?:(?P<holder>\w+)::)?(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:const|override|noexcept|final|\s)*(?::[^{;]*)?\{"),
    ],
    "csharp": [
        ("class", VISIBLE + r"(?P<mods>(?:(?:static|sealed|abstract|partial)\s+)*)(?:class|struct|record)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[\w., <>]+?))?\s*\{"), ("interface", VISIBLE + r"(?P<mods>(?:partial\s+)?)interface\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*:\s*(?P<bases>[\w., <>]+?))?\s*\{"), ("enum", VISIBLE + r"enum\s+(?P<name>\w+)"),
        ("method", r"(?m)^[ \t]+" + VISIBLE + r"(?P<mods>(?:(?:static|virtual|override|abstract|async|sealed|extern|new|partial)\s+)*)[\w.<>\[\],?]+\s+(?P<name>\w+)\s*(?:<[^>(]*>)?\([^()]*\)\s*(?:where[^{;]*)?(?:\{|=>|;)"),
    ],
    "php": [
        ("class", r"(?P<mods>(?:abstract\s+|final\s+)*)class\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w\\]+))?(?:\s+implements\s+(?P<implements>[\w\\, ]+?))?\s*\{"), ("interface", r"interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w\\, ]+?))?\s*\{"), ("class", r"(?m)^\s*trait\s+(?P<name>\w+)"), ("enum", r"(?m)^\s*enum\s+(?P<name>\w+)"),
        ("function", VISIBLE + r"(?P<mods>(?:static\s+|abstract\s+|final\s+)*)function\s+&?(?P<name>\w+)\s*\("),
    ],
    "swift": [("class", VISIBLE + r"(?P<mods>(?:final\s+)?)(?:class|struct|actor)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*:\s*(?P<bases>[\w., <>]+?))?\s*\{"), ("interface", VISIBLE + r"protocol\s+(?P<name>\w+)"), ("enum", VISIBLE + r"enum\s+(?P<name>\w+)"), ("function", VISIBLE + r"(?P<mods>(?:(?:static|override|mutating|class)\s+)*)func\s+(?P<name>\w+)")],
}
RULES["typescript"] = RULES["javascript"]
WORDS = {"if", "for", "while", "switch", "catch", "return", "else", "throw", "do", "try", "function", "sizeof", "await", "foreach", "lock", "using", "when"}
IMPORTS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("import", r"(?m)^\s*(?:import|export)\s[^'\"\n;]*?from\s*['\"]([^'\"]+)['\"]"), ("import", r"(?m)^\s*import\s*['\"]([^'\"]+)['\"]"), ("require", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)")],
    "java": [("static_import", r"(?m)^\s*import\s+static\s+([\w.]+(?:\.\*)?)\s*;"), ("import", r"(?m)^\s*import\s+(?!static\b)([\w.]+(?:\.\*)?)\s*;")],
    "kotlin": [("import", r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)")],
    "go": [("import", r"(?m)^import\s+(?:\w+\s+)?\"([^\"]+)\""), ("import", r"(?m)^\s+(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$")],
    "rust": [("import", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"), ("import", r"(?m)^\s*extern\s+crate\s+(\w+)")],
    "c": [("include", r"(?m)^\s*#\s*include\s*\"([^\"]+)\"")],
    "cpp": [("include", r"(?m)^\s*#\s*include\s*\"([^\"]+)\"")],
    "csharp": [("import", r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;")],
    "php": [("import", r"(?m)^\s*use\s+([\w\\]+)"), ("include", r"(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]")],
    "ruby": [("import", r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]")],
    "swift": [("import", r"(?m)^\s*import\s+(?:\w+\s+)?(\w+)\s*$")],
}
IMPORTS["typescript"] = IMPORTS["javascript"]
DEFAULT_VISIBILITY = {"java": "package", "rust": "private"}


def names_in(text: str | None) -> list[str]:
    return [re.sub(r"<.*|\(.*|\b(?:public|private|protected|virtual)\b", "", x, flags=re.S).strip() for x in re.split(r",(?![^<(]*[>)])", text or "") if x.strip()]


def visibility(language: str, name: str, word: str | None, mods: str) -> str:
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if word else "private"
    found = word or next((w for w in ("public", "private", "protected", "internal") if re.search(rf"\b{w}\b", mods)), None)
    if found in ("public", "private", "protected", "internal"):
        return found
    if language in ("javascript", "typescript"):
        return "private" if name[0] in "#_" else "public"
    return DEFAULT_VISIBILITY.get(language, "public")


def doc_before(text: str, start: int) -> str | None:
    m = re.search(r"/\*\*(.*?)\*/\s*(?:@\w+(?:\([^)]*\))?\s*)*$", text[max(0, start - 3000) : start], re.S)
    return re.sub(r"(?m)^\s*\*\s?", "", m[1]).strip() if m and "*/" not in m[1] else None


def read_braces(text: str, path: str, language: str) -> list[dict]:
    """Classes hold what stands inside their braces."""
    code = blank(text, STRINGS)
    line = lambda at: text.count("\n", 0, at) + 1
    found = []
    for order, (kind, rule) in enumerate(RULES[language]):
        for m in re.finditer(rule, code):
            name = m["name"]
            if name not in WORDS:
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                opening = m.end() - 1 if m[0].rstrip().endswith(("{", ";")) else m.end()
                found.append((at, order, kind, m, block_end(code, opening)))
    found.sort(key=lambda x: (x[0], x[1]))
    rows, holders, seen = [], [], set()
    for at, _, kind, m, end in found:
        holders = [h for h in holders if h[1] > at]
        groups = m.groupdict()
        holder = groups.get("holder") or (holders[-1][0] if holders else None)
        name, mods = m["name"], groups.get("mods") or ""
        if kind == "scope":
            holders.append((name, end))
            continue
        if kind == "method" and not holder or (line(at), name) in seen:
            continue
        seen.add((line(at), name))
        bases, implements = names_in(groups.get("bases")), names_in(groups.get("implements"))
        if language in ("csharp", "swift") and kind == "class":
            implements += [b for b in bases if re.match(r"I[A-Z]", b)]
            bases = [b for b in bases if not re.match(r"I[A-Z]", b)]
        inner = kind in ("function", "method") and holder
        rows.append(symbol(name, "method" if inner else kind, path, language, line(at), line(max(at, end - 1)), parent_class=holder if inner or groups.get("holder") else None, visibility=visibility(language, name, groups.get("visible"), mods), signature=" ".join(text[at : m.end()].rstrip(" {;\n").split()), documentation=doc_before(text, at), bases=bases, implements=implements, is_abstract="abstract" in mods, is_async="async" in mods or "suspend" in mods))
        if kind in ("class", "interface", "enum"):
            holders.append((name, end))
    for kind, rule in IMPORTS.get(language, []):
        rows += [dependency(path, m[1], kind, path, line(m.start(1))) for m in re.finditer(rule, text)]
    return rows


def read_indented(text: str, path: str, language: str) -> list[dict]:
    """E5: Ruby and shell."""
    rows, holders = [], []
    for number, raw in enumerate(blank(text, HASHES).split("\n"), 1):
        indent = len(raw) - len(raw.lstrip())
        if raw.strip():
            holders = [h for h in holders if h[1] < indent]
        if language == "bash":
            if m := re.match(r"\s*(?:function\s+(?P<a>[\w-]+)\s*(?:\(\))?|(?P<b>[\w-]+)\s*\(\))\s*\{?", raw):
                rows.append(symbol(m["a"] or m["b"], "function", path, language, number, number))
        elif m := re.match(r"\s*(class|module)\s+(?:\w+::)*(\w+)(?:\s*<\s*([\w:]+))?", raw):
            rows.append(symbol(m[2], "class", path, language, number, number, bases=[m[3]] if m[3] else []))
            holders.append((m[2], indent))
        elif m := re.match(r"\s*def\s+(?:self\.)?([\w?!=]+)", raw):
            holder = holders[-1][0] if holders else None
            rows.append(symbol(m[1], "method" if holder else "function", path, language, number, number, parent_class=holder))
    for kind, rule in IMPORTS.get(language, []):
        rows += [dependency(path, m[1], kind, path, text.count("\n", 0, m.start(1)) + 1) for m in re.finditer(rule, text)]
    return rows


# ---- Smalltalk file-outs

SUBCLASS = re.compile(r"^\s*(?P<base>[\w.]+)\s+(?P<how>(?:weak|variable\w*)?[sS]ubclass):\s*#'?(?P<name>[\w.]+)'?(?P<rest>.*)", re.S)
DEFINE = re.compile(r"^\s*(?P<space>[\w.]+)\s+defineClass:\s*#(?P<name>\w+)\s+superclass:\s*#\{(?P<base>[\w.]+)\}(?P<rest>.*)", re.S)
METHODS = re.compile(r"^\s*!?\s*(?P<name>[\w.]+)(?P<side>\s+class)?\s+methodsFor:\s*'(?P<category>[^']*)'")


def dialect(text: str) -> str:
    """Which of the two families a file-out comes from."""
    return "cincom" if re.search(r"defineClass:|^'From VisualWorks|Smalltalk defineNameSpace", text, re.M) else "standard"


def message_sends(body: str) -> list[str]:
    """Selectors sent in a method's body: keywords of one statement part joined, and unary ones."""
    code = re.sub(r"\"[^\"]*\"|'(?:[^']|'')*'", " ", body)
    out = []
    for part in re.split(r"[.\[\]();|]", code):
        words = re.findall(r"\b([A-Za-z]\w*:)(?!=)", part)
        if words:
            out.append("".join(words))
        out += [w for w in re.findall(r"(?<=[\w)])\s+([a-z]\w*)(?![\w:])", part) if w not in ("self", "super", "true", "false", "nil", "thisContext")]
    return list(dict.fromkeys(out))


def read_smalltalk(text: str, path: str) -> list[dict]:
    """`!` chunks; a doubled mark is one mark within a chunk."""
    rows, at, current = [], 0, None
    for m in re.finditer(r"(?:[^!]|!!)*!?", text):
        if not m[0]:
            continue
        chunk, line = m[0].rstrip("!").replace("!!", "!"), text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
        at = line + chunk.strip().count("\n")
        if current and not chunk.strip():
            current = None
        elif k := METHODS.match(chunk):
            current = (k["name"], bool(k["side"]), k["category"])
        elif current:
            body = chunk.strip()
            head = body.split("\n")[0].strip()
            words = re.findall(r"\w+:", head) if re.match(r"\w+:\s*\w+", head) else []
            name = "".join(words) or (re.match(r"[-+*/\\~<>=@%|&?,]+", head) or re.match(r"\w+", head) or [head])[0]
            holder = current[0] + (" class" if current[1] else "")
            rows.append(symbol(name, "method", path, "smalltalk", line, at, parent_class=holder, visibility="private" if "private" in current[2].lower() else "public", signature=head, documentation=next(iter(re.findall(r"\"([^\"]*)\"", body)), None)))
            rows += [dependency(f"{holder}.{name}", s, "call", path, line) for s in message_sends("\n".join(body.split("\n")[1:]))]
        elif k := SUBCLASS.match(chunk) or DEFINE.match(chunk):
            rows.append(symbol(k["name"], "class", path, "smalltalk", line, at, bases=[] if k["base"] == "nil" else [k["base"].split(".")[-1]], signature=" ".join(chunk.split())[:200]))
    return rows


def read_file(text: str, path: str) -> list[dict]:
    """The reader that a file's extension asks for."""
    language = LANGUAGES.get(path.rpartition(".")[2].lower(), "unknown")
    if language == "python":
        return read_python(text, path)
    if language == "smalltalk":
        return read_smalltalk(text, path)
    if language in RULES:
        return read_braces(text, path, language)
    return read_indented(text, path, language) if language in ("ruby", "bash") else []


def extract(files: DataFrame) -> DataFrame:
    """Symbol and dependency rows of a table of path and content; no shuffle."""
    arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = {k: arrow[v] for k, v in ({"row_kind": "string"} | SYMBOL | DEPENDENCY).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                rows = [r for p, c in zip(part.column("path").to_pylist(), part.column("content").to_pylist()) for r in read_file(c or "", p or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and dependencies, each with its order in the corpus by path and place."""
    rows = extract(files)
    symbols = rows.where("row_kind = 'symbol'").select(F.lit(0).cast("long").alias("library_id"), F.struct("file_path", "line_start", "name").alias("ord"), *SYMBOL)
    dependencies = rows.where("row_kind = 'dependency'").select(F.lit(0).cast("long").alias("library_id"), *DEPENDENCY, "file_path")
    return symbols, dependencies


def resolve_includes(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """An include is looked for beside its file, then at the root, among the known files."""
    beside = F.regexp_replace(F.concat(F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1), "target"), r"[^/]+/\.\./", "")
    known = files.select(F.col("path").alias("found")).distinct()
    rows = dependencies.withColumn("near", beside)
    a, b = known.select(F.col("found").alias("near"), F.col("found").alias("a")), known.select(F.col("found").alias("target"), F.col("found").alias("b"))
    return rows.join(a, "near", "left").join(b, "target", "left").withColumn("resolved", F.coalesce("a", "b")).drop("near", "a", "b")
