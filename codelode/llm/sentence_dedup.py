"""Substring dedup over sliding spans of sentences.

A sentence ends after . ! or ? before white space, and at a line's end. Every run of three
consecutive sentences of at least `few` words together is hashed, and so is every run of two that
has `pair` words and every one that has `many`; a document of fewer than three sentences is a run
itself if it has `few` words. With all three at 0 every run counts, down to lines of one word. Runs
whose hash occurs more than once are found by counting hashes, which combines before the shuffle;
only their occurrences are joined, and every sentence within an occurrence that isn't the first one
(by doc_id, then place) goes. Hashes are 64 bits to find candidates and 128 to decide.

Results: a null text stays null and has no sentences; removed sentences take the white space that
follows them along; rows that share a doc_id count as one document and keep each other's
sentences; rows without doc_id keep all; an empty table gives no rows; extra columns pass through,
but for those of the names of the columns that are added, which `prefix` can change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.flat import Rolling, groups, mix, sliced
from codelode.runtime import cut

RUN = 3
_WHITE = np.isin(np.arange(256), [9, 10, 12, 13, 32])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def sentences(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the sentences of a flat array of texts, and the text of each. White
    space follows a sentence and isn't part of it."""
    n = len(data)
    white = _WHITE[data]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(white, -1, place))  # the last character that isn't white space
    lines = np.cumsum(data == 10)
    opening = ~white & np.r_[True, white[:-1] | first[1:-1]]
    at = np.flatnonzero(opening)
    text = np.searchsorted(ends, at, side="right")
    before = np.where(at > 0, last[np.maximum(at - 1, 0)], -1)
    begin = np.r_[0, ends][text]
    fresh = before < begin  # nothing but white space before it in its text
    known = np.where(fresh, 0, before)
    starts = at[fresh | _STOP[data[known]] | (lines[at] > lines[known])]
    text = np.searchsorted(ends, starts, side="right")
    limit = np.minimum(np.r_[starts[1:], n], ends[text])
    return starts, last[limit - 1] + 1 if len(limit) else limit, text


def runs(texts: list[bytes], few: int, pair: int, many: int) -> dict[str, np.ndarray]:
    """text, pos, size, h1, h2 of every run of sentences."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    none = {k: np.zeros(0, np.int64) for k in ("text", "pos", "size", "h1", "h2")}
    if not len(data):
        return none
    starts, stops, text = sentences(data, ends)
    if not len(starts):
        return none
    white = _WHITE[data]
    edge = np.r_[0, ends[:-1]]
    opens = ~white & np.r_[True, white[:-1]]
    opens[edge[edge < len(data)]] |= ~white[edge[edge < len(data)]]
    upto = np.r_[0, np.cumsum(opens)]
    words = upto[stops] - upto[starts]
    total = np.r_[0, np.cumsum(words)]
    heads = np.r_[True, text[1:] != text[:-1]]
    number = np.arange(len(starts))
    pos = number - np.maximum.accumulate(np.where(heads, number, 0))
    count = np.bincount(text, minlength=len(texts))[text]
    key = Rolling(data).of(starts, stops)
    out: dict[str, list[np.ndarray]] = {k: [] for k in none}
    for size in range(1, RUN + 1):
        fits = number[pos + size <= count]
        w = total[fits + size] - total[fits]
        whole = (count[fits] == size) & (size < RUN)
        take = fits[(w >= (many, pair, few)[size - 1]) | whole & (w >= few)]
        h1 = np.full(len(take), size, np.uint64)
        h2 = np.full(len(take), size + 64, np.uint64)
        for j in range(size):
            h1 = mix(h1 * np.uint64(0x9E3779B97F4A7C15) + key[take + j])
            h2 = mix(h2 * np.uint64(0xC2B2AE3D27D4EB4F) ^ mix(key[take + j] + np.uint64(j + 1)))
        for k, v in (("text", text[take]), ("pos", pos[take]), ("size", np.full(len(take), size)), ("h1", h1.view(np.int64)), ("h2", h2.view(np.int64))):
            out[k].append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def _span_rows(docs: DataFrame, few: int, pair: int, many: int, names: tuple[str, ...]) -> DataFrame:
    kinds = {"h1": "long", "h2": "long", "doc_id": "long", "pos": "int", "size": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = batch.column("doc_id").to_numpy()
            for a, b in groups(map(len, texts), 1_000_000):
                found = runs(texts[a:b], few, pair, many)
                found["doc_id"] = ids[a:b][found.pop("text")]
                yield pa.RecordBatch.from_arrays([pa.array(found[k], pa.int64() if kinds[k] == "long" else pa.int32()) for k in names], list(names))

    return docs.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in names))


def dedup(docs: DataFrame, few: int = 12, pair: int = 20, many: int = 40, prefix: str = "") -> DataFrame:
    """All columns of docs with the text that is left, and n_sentences and n_removed, named after
    the prefix."""
    added = [prefix + "n_sentences", prefix + "n_removed"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    again = _span_rows(texts, few, pair, many, ("h1",)).groupBy("h1").count().where("count > 1").select("h1")
    spans = _span_rows(texts, few, pair, many, ("h1", "h2", "doc_id", "pos", "size"))
    hits = cut(spans.join(again, "h1", "left_semi"))
    # written, so that the join reads two plain tables and Spark can split a hot hash's part
    first = cut(hits.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"))
    later = hits.join(first, ["h1", "h2"]).where(F.struct("doc_id", "pos") != F.col("first"))
    # runs of one document: as many as it has sentences, a few times over
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any of the input's names
    marks = later.groupBy(F.col("doc_id").alias(own + "doc")).agg(F.collect_set(F.struct("pos", "size")).alias(own + "spans"))
    names = [c for c in docs.columns if c not in added]
    kept = docs.select(names).join(marks, F.col("doc_id").cast("long") == F.col(own + "doc"), "left").drop(own + "doc")
    at = names.index("text")
    schema = docs.select(names).schema.add(added[0], "long").add(added[1], "long")

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            spans = batch.column(len(names)).to_pylist()
            columns = list(batch.columns)[:-1]
            left: list[bytes | None] = list(texts)
            counts, removed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, b in groups((len(t or b"") for t in texts), 1_000_000):
                data = np.frombuffer(b"".join(t or b"" for t in texts[a:b]), np.uint8)
                if not len(data):
                    continue
                ends = np.cumsum([len(t or b"") for t in texts[a:b]])
                starts, _, text = sentences(data, ends)
                counts[a:b] = np.bincount(text, minlength=b - a)
                offset = np.cumsum(counts[a:b]) - counts[a:b]
                for i in range(a, b):
                    if spans[i] and texts[i]:
                        gone = np.zeros(int(counts[i]), bool)
                        for s in spans[i]:
                            gone[s["pos"] : s["pos"] + s["size"]] = True
                        removed[i] = gone.sum()
                        own = starts[offset[i - a] : offset[i - a] + counts[i]] - (ends[i - a] - len(texts[i]))
                        cuts = [0, *own[1:].tolist(), len(texts[i])]
                        left[i] = b"".join(texts[i][cuts[j] : cuts[j + 1]] for j in np.flatnonzero(~gone).tolist())
            columns[at] = pa.array(left, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(removed)], schema.fieldNames())

    return kept.mapInArrow(strike, schema)


#: The same rows in SQL; {docs} is the table.
SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?][ \t\n\r\f]+|[ \t\r\f]*\n[ \t\n\r\f]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents
), sentence AS (
  SELECT doc_id, s, unnest(range(len(s))) AS pos FROM cut
), word AS (
  SELECT doc_id, pos, regexp_replace(s[pos + 1], '[ \t\n\r\f]+$', '') AS t, s[pos + 1] AS piece, len(s) AS n FROM sentence
), counted AS (
  SELECT *, len(regexp_extract_all(t, '[^ \t\n\r\f]+')) AS w FROM word
), run AS (
  SELECT doc_id, pos, 1 AS size, w, n, [t] AS k FROM counted
  UNION ALL SELECT a.doc_id, a.pos, 2, a.w + b.w, a.n, [a.t, b.t] FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
  UNION ALL SELECT a.doc_id, a.pos, 3, a.w + b.w + c.w, a.n, [a.t, b.t, c.t] FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN counted c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2
), chosen AS (
  SELECT * FROM run WHERE w >= CASE size WHEN 3 THEN 12 WHEN 2 THEN 20 ELSE 40 END OR (n = size AND w >= 12)
), later AS (
  SELECT doc_id, pos, size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM chosen) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + unnest(range(size)) AS pos FROM later
)
SELECT w.doc_id, max(w.n)::BIGINT AS n_sentences, count(g.pos)::BIGINT AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN w.piece END, '' ORDER BY w.pos), '') AS text
FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id
"""
