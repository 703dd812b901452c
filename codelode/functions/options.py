"""Names and options that callers may give in older forms (survey X38, X39, L16)."""

from __future__ import annotations

import re

#: Older names that aren't the present name in another case.
OLD_NAMES = {"libraryId": "repository", "library_id": "repository", "repoId": "repository", "repo_id": "repository", "lang": "language", "type": "symbol_type"}
#: What a report may include.
PARTS = ("code", "symbols", "diagrams", "tests", "examples")
#: The largest pages and limits of each kind of request.
CAPS = {"page_size": 100, "search": 200, "semantic": 50, "symbols": 100, "repositories": 1000}


def present_name(name: str) -> str:
    return OLD_NAMES.get(name) or re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), name)


def arguments(given: dict) -> dict:
    """Values under present names; one given under its present name wins."""
    old = {present_name(k): v for k, v in given.items() if present_name(k) != k}
    return old | {k: v for k, v in given.items() if present_name(k) == k}


def included(wanted: str | list[str] | None) -> dict[str, bool]:
    """Flags from a list or a comma-separated text; `all` sets every one, unknown words none."""
    words = wanted.split(",") if isinstance(wanted, str) else wanted or []
    chosen = {w.strip().lower() for w in words}
    return {f"include_{p}": p in chosen or "all" in chosen for p in PARTS}


def capped(value: int, kind: str) -> int:
    """L16."""
    if value < 1:
        raise ValueError(f"{kind} must be at least 1")
    return min(value, CAPS[kind])
