"""Token-budgeted document retrieval (survey W1, W2, Q13-Q15, X20)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.runtime import cut


def _spend(rows: DataFrame, keys: list[str], budget: int, stop: bool, batch: int) -> DataFrame:
    """_row, _place, before and over of the rows of _n > 0 tokens that a budget for each key takes.

    A round gives every key its next `batch` rows, which Spark picks before it deals them out, and
    folds their sizes. What can't fit any more, or comes after the stop, is gone before the next
    round; a key takes `budget` rows at most."""
    left = rows.select(*keys, "_row", "_place", "_n").where(F.col("_n") > 0)
    left = left if stop else left.where(F.col("_n") <= budget)
    place, kept, total = left.schema["_place"].dataType.simpleString(), [], None
    entry = f"struct<_row:bigint,_place:{place},before:bigint,over:boolean>"
    while True:
        w = Window.partitionBy(*keys).orderBy("_place")
        head = left.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= batch)
        sizes = head.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", "_row", "_n"))).alias("all"))
        if total is not None:
            sizes = sizes.join(total.select(*keys, F.col("total").alias("_given")), keys)
        given = F.lit(0).cast("long") if total is None else F.col("_given")

        def take(a, x):
            fits = a["total"] + x["_n"] <= budget
            one = F.struct(x["_row"].alias("_row"), x["_place"].alias("_place"), a["total"].alias("before"), (~fits).alias("over"))
            more = F.struct((a["total"] + F.when(fits, x["_n"]).otherwise(0)).alias("total"), (~fits).alias("done"), F.array_append(a["keep"], one).alias("keep"))
            return F.when(a["done"], a).otherwise(more) if stop else F.when(fits, F.struct(more["total"].alias("total"), F.lit(False).alias("done"), more["keep"].alias("keep"))).otherwise(a)

        start = F.struct(given.alias("total"), F.lit(False).alias("done"), F.array().cast(f"array<{entry}>").alias("keep"))
        state = cut(sizes.select(*keys, F.aggregate("all", start, take).alias("s"), F.element_at("all", -1)["_place"].alias("last")))
        kept.append(state.select(*keys, F.inline("s.keep")))
        total = state.where(~F.col("s.done")).select(*keys, F.col("s.total").alias("total"), "last")
        room = F.lit(True) if stop else F.col("_n") <= budget - F.col("total")
        left = cut(left.join(total, keys).where((F.col("_place") > F.col("last")) & room).select(*keys, "_row", "_place", "_n"))
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, kept)


def _placed(rows: DataFrame, tokens: str, order: list[Column]) -> DataFrame:
    """Rows, written once, with _n tokens and a _place of their own in the order."""
    own = cut(rows.withColumn("_n", F.col(tokens).cast("long")).withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])))
    return own.withColumn("_row", F.monotonically_increasing_id()).withColumn("_place", F.struct("_order", "_row")).drop("_order")


def budget_skip(rows: DataFrame, keys: list[str], budget: int, tokens: str, order: list[Column], batch: int = 256) -> DataFrame:
    """Greedy budget: a row that doesn't fit is skipped, smaller ones after it may still fit. The
    order is ascending in the columns given. Rows without tokens always fit."""
    placed = _placed(rows, tokens, order)
    chosen = cut(_spend(placed, keys, budget, False, batch))
    sized = placed.join(chosen.select("_row", "before"), "_row").withColumn("total_tokens", F.col("before") + F.col("_n")).drop("before")
    spent = chosen.join(placed.select("_row", "_n"), "_row").groupBy(*keys).agg(F.collect_list(F.struct("_place", (F.col("before") + F.col("_n")).alias("total"))).alias("_spent"))
    free = placed.where(F.col("_n") <= 0).join(spent, keys, "left")
    free = free.withColumn("total_tokens", F.coalesce(F.array_max(F.transform(F.filter("_spent", lambda x: x["_place"] < F.col("_place")), lambda x: x["total"])), F.lit(0).cast("long"))).drop("_spent")
    return sized.unionByName(free).drop("_row", "_place", "_n")


def budget_stop(rows: DataFrame, keys: list[str], budget: int, tokens: str, order: list[Column], least: int = 100, batch: int = 256) -> DataFrame:
    """Running total up to the first overflow; its row is cut if more than `least` tokens remain."""
    placed = _placed(rows, tokens, order)
    chosen = cut(_spend(placed, keys, budget, True, batch))
    ends = chosen.where("over").select(*keys, F.col("_place").alias("_end"))
    sized = placed.join(chosen.where(~F.col("over") | (budget - F.col("before") > least)).select("_row", "before", "over"), "_row")
    sized = sized.withColumn("used", F.when(F.col("over"), budget - F.col("before")).otherwise(F.col("_n"))).withColumnRenamed("over", "truncated").drop("before")
    free = placed.where(F.col("_n") <= 0).join(ends, keys, "left").where("_end is null or _place < _end").drop("_end")
    return sized.unionByName(free.withColumn("used", F.lit(0).cast("long")).withColumn("truncated", F.lit(False))).drop("_row", "_place", "_n")


def documentation(docs: DataFrame, library: str, query: str | None = None, max_tokens: int | None = None, topic: str | None = None) -> DataFrame:
    """Documents of a library: filtered by topic, scored, sorted, cut to a budget."""
    c, p = F.col("content"), F.col("path")
    rows = docs.where(F.col("library") == library)
    if topic:
        rows = rows.where(p.ilike(f"%{topic}%") | c.ilike(f"%{topic}%"))
    quality = T.quality_score(c, p)
    score = 0.5 * quality + 0.5 * T.relevance_score(c, p, query) if query else quality
    rows = rows.select("*", T.count_tokens(c).alias("tokens"), score.alias("score"))
    if max_tokens is None:
        return rows
    # only sizes and scores are sorted; texts join what is kept
    kept = budget_skip(rows.select("id", "library", "path", "tokens", "score"), ["library"], max_tokens, "tokens", [-F.col("score"), F.col("path"), F.col("id")])
    return docs.join(kept.drop("library", "path"), "id")


def summary_format(docs: DataFrame, most: int = 10) -> DataFrame:
    """One line for each of a library's best documents."""
    c, p = F.col("content"), F.col("path")
    rank = F.row_number().over(Window.partitionBy("library").orderBy(F.desc("q"), "path", "id"))
    rows = docs.select("id", "library", "path", T.title(c, p).alias("title"), T.quality_score(c, p).alias("q")).withColumn("r", rank).where(F.col("r") <= most)
    line = F.concat(F.lit("- "), "title", F.lit(" ("), "path", F.lit(")"))
    return rows.groupBy("library").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n").alias("summary"))


def full_format(docs: DataFrame) -> DataFrame:
    """A library's documents as one Markdown text, each under its path, badges left out."""
    part = F.concat(F.lit("## "), "path", F.lit("\n\n"), T.without_badges(F.col("content")))
    return docs.groupBy("library").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "id", part.alias("part")))), lambda x: x["part"]), "\n\n---\n\n").alias("markdown"))


def standard_format(docs: DataFrame) -> DataFrame:
    """path, title, description and snippets worth showing."""
    c, p = F.col("content"), F.col("path")
    return docs.select("id", "library", "path", T.title(c, p).alias("title"), T.description(c).alias("description"), F.filter(T.snippets(c), lambda s: ~T.low_value(s["code"], s["language"])).alias("snippets"))
