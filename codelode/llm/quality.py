"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's features are hashed words, word shapes, neighbouring shapes and repetitions. On a sample
of labelled rows (at most `sample` of them, the ones of the smallest hashes) weights by inverse
document frequency and a truncated singular value decomposition are fitted. The sample's latent
vectors and labels, of a size that `sample` and `rank` fix, go to every executor; every document's
cosine with every one of them is computed in blocks, and its `k` nearest vote with weights that
grow with similarity. Rows with crc32(doc_id) mod 5 = 0 never teach.

Results: a null or empty text, or one of white space alone, scores 0; equal texts score alike;
without labels every text that isn't empty scores 0.5; extra columns pass through, but for those
of the names of the columns that are added, which `prefix` can change; repeated label rows of a
document count once, by their largest quality; of rows that share a labelled doc_id one text
teaches, that of the smallest hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.bpe import BLANK, LETTER, NUMBER, SPACE, classes, flat_points
from codelode.llm.flat import Rolling, groups, sliced, texts_of

WORDS, SHAPES = 1024, 24
FEATURES = WORDS + SHAPES + SHAPES * SHAPES + 2
_UPPER: list[np.ndarray] = []


def _upper() -> np.ndarray:
    if not _UPPER:
        points = np.zeros(0x110000, bool)
        points[[i for i in range(0x3000) if chr(i).isupper()]] = True
        _UPPER.append(points)
    return _UPPER[0]


def features(texts: list[str]) -> np.ndarray:
    """Counts, a row for each text."""
    n = len(texts)
    text, points, ends = flat_points([t + "\n" for t in texts])
    kind = classes()[points]
    blank = (kind == SPACE) | (kind == BLANK)
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(starts):
        return np.zeros((n, FEATURES), np.float32)
    stops = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    owner = np.searchsorted(ends, starts, side="right")

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags)]
        return sums[stops] - sums[starts]

    letters, numbers, capitals = within(kind == LETTER), within(kind == NUMBER), within(_upper()[points])
    size = stops - starts
    signs = size - letters - numbers
    # shape: sort of word, times sort of signs in it
    sort = np.select([letters == 0, (capitals == letters) & (letters > 1), numbers > 0, _upper()[points[starts]]], [0, 1, 2, 3], 4) + (letters == 0) * (numbers > 0) * 5
    marks = np.minimum(signs, 3)
    shape = sort * 4 + marks  # 6 sorts of word, 4 numbers of signs
    key = Rolling(points).of(starts, stops)
    same_text = np.r_[False, owner[1:] == owner[:-1]]
    again = same_text & np.r_[False, key[1:] == key[:-1]]
    pair = np.where(same_text, np.r_[0, shape[:-1]] * SHAPES + shape, -1)
    row = owner * FEATURES
    out = np.bincount(row + (key % np.uint64(WORDS)).astype(np.int64), minlength=n * FEATURES)
    out += np.bincount(row + WORDS + shape, minlength=n * FEATURES)
    out += np.bincount((row + WORDS + SHAPES + pair)[pair >= 0], minlength=n * FEATURES)
    out += np.bincount(row + FEATURES - 2 + again, minlength=n * FEATURES)
    return out.reshape(n, FEATURES).astype(np.float32)


def weigh(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Roots of relative counts, each family of features of the same length, times the weights."""
    out = np.sqrt(counts)
    for lo, hi in ((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, FEATURES - 2), (FEATURES - 2, FEATURES)):
        norm = np.sqrt(np.einsum("ij,ij->i", out[:, lo:hi], out[:, lo:hi]))
        out[:, lo:hi] /= np.maximum(norm, 1e-9)[:, None]
    return out * weight


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


class Model:
    """Weights, projection, and the labelled vectors, from rows of counts that come in blocks: a
    function of (low, high). Only a block of them is held at a time."""

    def __init__(self, rows: Callable[[int, int], np.ndarray], labels: np.ndarray, rank: int = 64, k: int = 25, power: float = 8.0, block: int = 500):
        n = len(labels)
        self.k, self.power = min(k, n), power
        self.labels = labels.astype(np.float32)
        if not n:
            return
        parts = [(a, min(n, a + block)) for a in range(0, n, block)]
        seen = sum((rows(a, b) > 0).sum(axis=0) for a, b in parts)
        self.weight = np.log((1 + n) / (1 + seen)).astype(np.float32) * 0.5 + 0.5
        gram = np.zeros((FEATURES, FEATURES))
        for a, b in parts:
            x = weigh(rows(a, b), self.weight)
            gram += x.T @ x
        _, vectors = np.linalg.eigh(gram)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
        self.known = np.concatenate([unit(weigh(rows(a, b), self.weight) @ self.basis) for a, b in parts])

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        empty = counts.sum(axis=1) == 0
        if not len(self.labels):
            return np.where(empty, 0.0, 0.5)
        own = unit(weigh(counts, self.weight) @ self.basis)
        out = np.empty(len(own))
        for a in range(0, len(own), block):
            near = own[a : a + block] @ self.known.T
            at = np.argpartition(near, -self.k, axis=1)[:, -self.k :] if self.k < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
            weight = np.maximum(np.take_along_axis(near, at, axis=1).astype(np.float64), 1e-6) ** self.power
            out[a : a + block] = (weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1)
        out[empty] = 0.0
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, rank: int = 64, k: int = 25) -> Model:
    """Fit on at most `sample` labelled rows."""
    taught = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch)
            for a, b in groups(map(len, texts), 1_000_000):
                counts = features(texts[a:b])  # float32, as scored rows have them
                at = [np.flatnonzero(row).astype(np.uint16) for row in counts]
                columns = [pa.array([i.tobytes() for i in at], pa.binary()), pa.array([row[i].tobytes() for row, i in zip(counts, at)], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("quality")[a:b], *columns], ["doc_id", "quality", "at", "count"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taught), "doc_id")
    # one text for each label: combined before the shuffle, however often a doc_id repeats
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"), F.first("quality").alias("quality")).select("doc_id", "quality", "least.text")
    # `sample` rows at most, and of each no more than its features that aren't zero
    rows = found.mapInArrow(run, "doc_id long, quality int, at binary, count binary").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))

    def block(low: int, high: int) -> np.ndarray:
        part = rows.slice(low, high - low)
        out = np.zeros((high - low, FEATURES), np.float32)
        for i, (at, count) in enumerate(zip(part.column("at").to_pylist(), part.column("count").to_pylist())):
            out[i, np.frombuffer(at, np.uint16)] = np.frombuffer(count, np.float32)
        return out

    return Model(block, rows.column("quality").to_numpy(), rank, k)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, prefix: str = "") -> DataFrame:
    """All columns of docs, and quality_score and quality_kept, named after the prefix; no shuffle."""
    added = [prefix + "quality_score", prefix + "quality_kept"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a size that `sample` and `rank` fix
    names = [c for c in docs.columns if c not in added]
    schema = docs.select(names).schema.add(added[0], "double").add(added[1], "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, scores = texts_of(batch), []
            for a, b in groups((2000 + len(t) for t in texts), 1_000_000):
                scores.append(sent.value.score(features(texts[a:b])))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score >= threshold)], [*names, *added])

    return docs.select(names).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = classify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), threshold)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_kept").cast("int").alias("predicted"))
