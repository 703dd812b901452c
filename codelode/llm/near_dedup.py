"""Near duplicates by bottom-k sketches.

A document's set holds 64-bit hashes of its distinct word shingles. One hash gives all sets one
order; values that many documents have come last in it (`frequent`; any choice of them gives the
same links, it only decides how much work finds them). Of `n` values a document retains the
smallest k = n - ceil(0.8 n) + 1: two sets that share four fifths of their union share one of
their retained values, so inverted lists of retained values lose no link. What two documents
retain up to the smaller of their largest retained values is known of both: the bottom of the
union. The differences seen there are no more than all differences, so pairs with too many go, and
never a similar one. Exact Jaccard on full sets, from whole texts, links the rest.

Documents of equal sets are one class from the start. Lists never give all pairs of their members.
First each class meets its lists' smallest one; the links found contract to components. Members of
different components then meet: in lists of at most `common` members by a join, in longer ones
within blocks, on full sets in memory. As frequent values come last, a class is only in long lists
if nearly all of its set is frequent.

Results: a null or empty text, or one without words, has no shingles and is its own component;
rows with equal sets share a component, equal rows too; rows that share a doc_id and differ are
documents of their own, and either links others; a row without doc_id is kept, has no component
and links nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.bitmaps import BITS, bitmap, within
from codelode.llm.components import components
from codelode.llm.flat import Rolling, groups, mix, sliced, spread_runs
from codelode.runtime import cut

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `width` words."""
    out: list[np.ndarray] = []
    for a, b in groups(map(len, texts), 1_000_000):
        data = _LOWER[np.frombuffer(b" ".join(texts[a:b]) + b" ", np.uint8)]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a))
        gap = _BREAK[data]
        starts, stops = np.flatnonzero(~gap & np.r_[True, gap[:-1]]), np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
        words = Rolling(data).of(starts, stops)
        bounds = np.searchsorted(starts, np.r_[0, ends])
        n = max(0, len(words) - width + 1)
        runs = np.zeros(n, np.uint64)
        for j in range(width):
            runs = mix(runs + words[j : j + n] * _FACTORS[j % len(_FACTORS)])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= width:
                out.append(np.unique(runs[lo : hi - width + 1]))
            elif hi > lo:  # fewer words: the whole sequence is one shingle
                one = np.full(1, hi - lo, np.uint64)
                for j in range(lo, hi):
                    one = mix(one + words[j : j + 1] * _FACTORS[(j - lo) % len(_FACTORS)])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sampled(docs: DataFrame, width: int, rate: int) -> DataFrame:
    """One in `rate` of all (document, value) pairs, chosen by their hash: value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = [np.zeros(0, np.uint64)]
            for s in shingle_sets(texts, width):
                found.append(s[mix(s ^ mix(s.sum(dtype=np.uint64, keepdims=True))) < np.uint64((1 << 64) // rate)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["value"])

    return docs.select("text").mapInArrow(run, "value long")


def frequent(docs: DataFrame, width: int, rate: int = 8, least: int = 3) -> np.ndarray:
    """A bitmap of values that about rate * least documents or more have. The threshold doubles
    until at most one bit in 16 is set, whatever the input."""
    counts = cut(_sampled(docs, width, rate).groupBy("value").count().where(F.col("count") >= least))
    levels = counts.groupBy(F.floor(F.log2("count")).alias("level")).count().collect()  # 64 rows at most
    level = next(x for x in range(65) if sum(r["count"] for r in levels if r["level"] >= x) <= 1 << BITS - 4)
    return bitmap(counts.where(F.floor(F.log2("count")) >= level), "value")


def retained(values: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """The values that a set retains, in the common order: frequent ones have the highest bit."""
    often = within(values, bits)
    values = values >> np.uint64(1)
    n = len(values)
    return np.concatenate([values[~often], values[often] | np.uint64(1 << 63)])[: n + (-percent * n) // 100 + 1]


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, h1 and h2 (of the set), sketch (retained 64-bit values, ascending)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))  # four megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sets = shingle_sets(texts, width)
            h = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ _FACTORS[1]).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            sketch = pa.array([retained(s, sent.value, percent).tobytes() if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), sketch],
                ["doc_id", "text_hash", "n", "h1", "h2", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, h1 long, h2 long, sketch binary")


def differences(x: np.ndarray, y: np.ndarray) -> int:
    """How many values the bottom of the union of two sketches shows in one set only."""
    top = min(x[-1], y[-1])
    seen = np.searchsorted(x, top, side="right") + np.searchsorted(y, top, side="right")
    return int(seen) - 2 * len(np.intersect1d(x, y, assume_unique=True))


def _sized(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _hopeful(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches leave room for the similarity."""
    a = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist()
            sketches = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), size)
            keep = pa.array([(100 + percent) * differences(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= (100 - percent) * n for x, y, n in sketches], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))


def _texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of classes: that of the row of the smallest doc_id."""
    wanted = ids.distinct().join(classes.select("id", "doc_id", "text_hash"), "id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", "text")


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs that exact Jaccard on full sets confirms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                left, right = batch.column("ta").cast(pa.binary()).to_pylist(), batch.column("tb").cast(pa.binary()).to_pylist()
                texts = list(dict.fromkeys([*left, *right]))
                sets = dict(zip(texts, shingle_sets(texts, width)))
                keep = []
                for x, y in zip(left, right):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of lists (value, id, label) as top, id, label, n: lists whose largest component is
    the same are one group."""
    per = rows.groupBy("value", "label").count()
    top = per.groupBy("value").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
    return cut(rows.join(top, "value").select("top", "id", "label").distinct().join(classes.select("id", "n"), "id"))


def _within_long_lists(members: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 600_000) -> DataFrame:
    """Links between components of lists that are too long for a join: of each group of members
    those outside the largest component meet all, exactly, on full sets in memory. Both sides are dealt out in blocks of about `block` shingles, so that
    no task holds a whole list. Of the links found in a block only those that join components are
    given: fewer than it has members."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], ["id", "shingles"])

    def run(table: pa.Table) -> pa.Table:
        outside = table.column("outside").to_numpy(zero_copy_only=False)
        ids, label = (table.column(c).to_numpy() for c in ("id", "label"))
        full = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in full])
        inner = np.flatnonzero(~outside)
        values = np.concatenate([full[i] for i in inner]) if len(inner) else np.zeros(0, np.uint64)
        owner = np.repeat(inner, n[inner])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        for i in np.flatnonzero(outside):
            lo, hi = np.searchsorted(values, full[i], side="left"), np.searchsorted(values, full[i], side="right")
            both = np.bincount(owner[spread_runs(lo, hi - lo)], minlength=len(ids))
            for j in np.flatnonzero(~outside & (100 * both >= percent * (n + n[i] - both))).tolist():
                x, y = find(label[i]), find(label[j])
                if x != y:
                    root[x] = y
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    weight = lambda of: F.ceil(F.sum(F.when(of, F.greatest("n", F.lit(300)))) / block)
    sizes = members.groupBy("top").agg(weight(F.lit(True)).alias("inner_blocks"), weight(F.col("label") != F.col("top")).alias("outer_blocks"))
    dealt = members.join(sizes, "top")
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    inside = dealt.select("top", "id", "label", F.lit(False).alias("outside"), of("inner_blocks").alias("x"), each("outer_blocks").alias("y"))
    outer = dealt.where("label <> top").select("top", "id", "label", F.lit(True).alias("outside"), each("inner_blocks").alias("x"), of("outer_blocks").alias("y"))
    full = texts.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(sets, "id long, shingles binary")
    return inside.union(outer).join(full, "id").groupBy("top", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, common: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; text_hash (xxhash64) and chosen: the
    one text of its component that stays, where doc_ids alone don't tell."""
    sigs = cut(signatures(docs, width, percent))
    same = sigs.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("sketch").alias("sketch"))
    classes = cut(same.select(F.monotonically_increasing_id().alias("id"), "row.doc_id", "row.text_hash", "h1", "h2", "n", "sketch"))
    sketches = classes.select("id", "n", "sketch")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "sketch"):
            parts = [np.frombuffer(s, np.int64) for s in batch.column("sketch").to_pylist()]
            sizes = [len(p) for p in parts]
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), *(pa.array(np.repeat(batch.column(c).to_numpy(), sizes), pa.int64()) for c in ("id", "n"))], ["value", "id", "n"])

    rows = classes.select("id", "n", "sketch").mapInArrow(values, "value long, id long, n long")
    sizes = rows.groupBy("value").agg(F.min("id").alias("first"), F.min_by("n", "id").alias("first_n"), F.count("*").alias("size")).where("size > 1")
    shared = cut(rows.join(sizes, "value"))
    star = cut(shared.where("id <> first").where(_sized("first_n", "n", percent)).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    near = cut(_hopeful(star, sketches, percent))
    links = cut(_links(near, _texts(_ends(near), classes, docs), width, percent))
    labels = components(links)
    labelled = shared.join(labels, shared.id == labels.node, "left").select("value", "id", "n", "size", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("value")
    open_ = cut(labelled.join(mixed, "value", "left_semi"))
    short = open_.where(F.col("size") <= common)
    x, y = (short.select("value", F.col("id").alias(i), F.col("n").alias("n" + i), F.col("label").alias("l" + i)) for i in "ab")
    # at most `common` partners a row
    meet = x.join(y, "value").where(_sized("na", "nb", percent)).where("a < b and la <> lb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    near = cut(_hopeful(meet, sketches, percent))
    members = _members(open_.where(F.col("size") > common).select("value", "id", "label"), classes)
    texts = cut(_texts(_ends(near).union(members.select("id")), classes, docs))
    more = cut(_links(near, texts, width, percent)).union(cut(_within_long_lists(members, texts, width, percent)))
    final = components(links.union(more)) if not more.isEmpty() else labels
    named = cut(classes.join(final, classes.id == final.node, "left").select("doc_id", "text_hash", "h1", "h2", "n", F.coalesce("label", "id").alias("label")))
    least = named.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    own = named.join(least, "label").select("h1", "h2", "n", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("least"))
    nameless, alone = F.col("doc_id").isNull(), F.col("component_id").isNull()
    component = F.when(~nameless, F.coalesce("component_id", "doc_id"))
    return sigs.select("doc_id", "text_hash", "h1", "h2", "n").join(own, ["h1", "h2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (nameless | alone | (F.col("doc_id") == F.col("component_id"))).alias("kept"),
        "text_hash", (nameless | alone | ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("least")))).alias("chosen"),
    )


def distinct(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of near duplicates,
    that of the smallest doc_id. Equal rows are one document; rows without doc_id all stay."""
    found = cut(near_duplicates(docs, width, percent).where("chosen and doc_id is not null").select("doc_id", "text_hash"))
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any of the input's names
    named = found.select(F.col("doc_id").alias(own + "doc"), F.col("text_hash").alias(own + "hash"))
    left = docs.join(named, (F.col("doc_id").cast("long") == F.col(own + "doc")) & (F.xxhash64("text") == F.col(own + "hash")), "left_semi")
    if not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "text"])
    return left.unionByName(docs.where("doc_id is null"))


#: The same rows in SQL, for small tables.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), lowest AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN lowest ON a = d.doc_id
"""
