"""Fuzzy matching of names (survey X1, X2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fuzzy_tier(query: str, name: Column, group: Column, description: Column) -> Column:
    """score, match_type and matched_field of the first tier that fits; null if none does."""
    q = query.lower()
    n, g, d = F.lower(name), F.lower(group), F.lower(F.coalesce(description, F.lit("")))
    far = F.levenshtein(n, F.lit(q))
    tier = lambda score, kind, field: F.struct(F.lit(score).cast("double").alias("score") if not isinstance(score, Column) else score.alias("score"), F.lit(kind).alias("match_type"), F.lit(field).alias("matched_field"))
    near = (far <= 3) & (F.length(name) > 0)
    return (
        F.when(n == q, tier(1.0, "exact", "name")).when(n.startswith(q), tier(0.9, "starts_with", "name")).when(n.contains(q), tier(0.8, "contains", "name"))
        .when(d.contains(q), tier(0.6, "contains", "description")).when(g.contains(q), tier(0.5, "contains", "group"))
        .when(near, tier(F.greatest(F.lit(0.4), 1 - far / F.length(name)), "fuzzy", "name"))
    )
