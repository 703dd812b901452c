"""Nearest neighbours by inner product, with score-aware quantisation.

Vectors are cut into subspaces of two dimensions with 16 codewords each. Codebooks and codes
minimise |r|^2 + (eta - 1) <r, x/|x|>^2: the residual's part parallel to the vector costs eta times
the rest, as it is what moves large inner products. The codebooks are fitted on at most `sample`
rows; every row is encoded, two four-bit codes to a byte. A query sums table entries over the
codes of a block of rows, the best of the block are scored again exactly in double precision, and
the best of all blocks are kept.

Results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; a query meets every row but those of its own vec_id, and rows that repeat
are met as often; of several rows of one vec_id one asks, that of the vector of the smallest hash;
ties go to the smaller vec_id; with fewer candidates than `k` all are returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.runtime import cut, shuffle_width

WORDS = 16


class Codebook:
    def __init__(self, x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 7):
        n, self.dims = x.shape
        self.parts = -(-self.dims // 2)
        eta = (self.dims - 1) * threshold**2 / (1 - threshold**2)
        self.extra = max(0.0, eta - 1.0)
        s = self.split(x)
        rng = np.random.default_rng(seed)
        self.words = s[rng.permutation(n)[np.arange(WORDS) % n]].transpose(1, 0, 2).copy()  # part, word, 2
        for step in range(4 + rounds):
            score_aware = step >= 4
            codes = self.encode(x, 1 if score_aware else 0)
            u, away = self.direction(x), None
            if score_aware:
                away = np.einsum("npd,npd->n", s - self.of(codes), u)
            for p in range(self.parts):
                own = codes[:, p]
                c = self.words[p][own]
                if score_aware:
                    rest = away - np.einsum("nd,nd->n", s[:, p] - c, u[:, p])
                    a = np.zeros((WORDS, 2, 2))
                    b = np.zeros((WORDS, 2))
                    pull = self.extra * (rest + np.einsum("nd,nd->n", s[:, p], u[:, p]))
                    for i in range(2):
                        b[:, i] = np.bincount(own, s[:, p, i] + pull * u[:, p, i], WORDS)
                        for j in range(2):
                            a[:, i, j] = np.bincount(own, (i == j) + self.extra * u[:, p, i] * u[:, p, j], WORDS)
                    full = np.bincount(own, minlength=WORDS) > 0
                    self.words[p][full] = np.linalg.solve(a[full] + 1e-9 * np.eye(2), b[full][:, :, None])[:, :, 0]
                    away = rest + np.einsum("nd,nd->n", s[:, p] - self.words[p][own], u[:, p])
                else:
                    count = np.bincount(own, minlength=WORDS)
                    for i in range(2):
                        total = np.bincount(own, s[:, p, i], WORDS)
                        self.words[p][count > 0, i] = total[count > 0] / count[count > 0]

    def split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * 2))
        padded[:, : self.dims] = x
        return padded.reshape(len(x), self.parts, 2)

    def direction(self, x: np.ndarray) -> np.ndarray:
        return self.split(x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None])

    def of(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(self.parts), codes]

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Nearest codewords, then sweeps over the parts that lower the score-aware loss."""
        s, u = self.split(x), self.direction(x)
        near = ((s[:, :, None, :] - self.words[None]) ** 2).sum(axis=3)
        codes = near.argmin(axis=2)
        if not sweeps:
            return codes
        away = np.einsum("npd,npd->n", s - self.of(codes), u)
        for _ in range(sweeps):
            for p in range(self.parts):
                along = u[:, p] @ self.words[p].T  # <c, u> for every word
                own = np.einsum("nd,nd->n", s[:, p], u[:, p])
                rest = away - own + along[np.arange(len(x)), codes[:, p]]
                total = (rest + own)[:, None] - along
                codes[:, p] = (near[:, p] + self.extra * total**2).argmin(axis=1)
                away = rest + own - along[np.arange(len(x)), codes[:, p]]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        if codes.shape[1] % 2:
            codes = np.c_[codes, np.zeros(len(codes), codes.dtype)]
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each byte of a code, what every value of it adds to a query's score."""
        parts = np.einsum("qpd,pwd->qpw", self.split(queries), self.words)
        if self.parts % 2:
            parts = np.concatenate([parts, np.zeros((len(queries), 1, WORDS))], axis=1)
        low, high = parts[:, 0::2], parts[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), -1, WORDS * WORDS).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows that take part, as vec_id and vector, and their number of dimensions."""
    v = F.col("vector")
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    dims = common[0]["n"] if common else 0
    return rows.where(F.size(v) == dims), dims


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the k largest scores, ties to the smaller id; missing ones score -inf."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, sample: int = 16384, again: int = 128, block: int = 8192, query_block: int = 8192, row_block: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`. Every block of
    rows meets every block of queries, each pair in a task of its own; a pair gives each query's
    best, of which Spark keeps `k` before and after it deals them out by query."""
    spark = rows.sparkSession
    rows, dims = usable(rows, key, vector)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    train = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow().column(0), dims)
    sent = spark.sparkContext.broadcast(Codebook(train))  # 32 bytes a dimension and codeword

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = sent.value.pack(sent.value.encode(_matrix(batch.column("vector"), dims))) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "vector", "code"])

    index = cut(rows.mapInArrow(encode, "vec_id long, vector array<double>, code binary"))
    asked = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("vector"), "vector")).alias("least")).select("vec_id", "least.vector")
    n, q = index.count(), asked.count()
    # as many blocks of rows as bound a task's memory, or as there are tasks to fill
    row_blocks = max(1, -(-n // row_block), min(shuffle_width(spark), n // 2048))
    query_blocks = max(1, -(-q // query_block))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # dealt by place, not by id, as ids may repeat
    left = index.withColumn("x", F.pmod(F.monotonically_increasing_id(), F.lit(row_blocks)).cast("int")).withColumn("y", each(query_blocks))
    right = asked.withColumn("y", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("x", each(row_blocks))

    def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
        queries, query_ids = _matrix(asked.column("vector"), dims), asked.column("vec_id").to_numpy()
        score = np.full((len(queries), k), -np.inf)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        for a in range(0, len(rows) if len(queries) else 0, block):
            part = rows.slice(a, block)
            own, data = part.column("vec_id").to_numpy(), _matrix(part.column("vector"), dims)
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(part), -1)
            columns = [np.ascontiguousarray(codes[:, j]) for j in range(codes.shape[1])]
            most = min(again, len(part))
            for b in range(0, len(queries), 64):
                tables = sent.value.tables(queries[b : b + 64])
                rough = np.zeros((len(tables), len(part)), np.float32)
                for j, column in enumerate(columns):
                    rough += tables[:, j].take(column, axis=1)
                rough[query_ids[b : b + 64, None] == own[None]] = -np.inf
                at = np.argpartition(rough, len(part) - most, axis=1)[:, len(part) - most :]
                exact = np.einsum("qd,qrd->qr", queries[b : b + 64], data[at])
                near = own[at]
                exact[near == query_ids[b : b + 64, None]] = -np.inf
                score[b : b + 64], ids[b : b + 64] = _best(np.c_[score[b : b + 64], exact], np.c_[ids[b : b + 64], near], k)
        full = np.isfinite(score)
        return pa.table({"query_id": pa.array(np.repeat(query_ids, full.sum(axis=1)), pa.int64()), "vec_id": pa.array(ids[full], pa.int64()), "score": pa.array(score[full], pa.float64())})

    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
