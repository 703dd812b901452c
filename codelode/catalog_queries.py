"""All registered queries of the library."""

from __future__ import annotations

from codelode.plans import case_queries, code_queries, graph_queries, search_queries, text_queries  # noqa: F401
from codelode.plans.base import ORACLES, QUERIES

FLAGSHIP = "w1_budget"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
