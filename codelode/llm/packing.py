"""Best-fit packing of tokenized documents, in bulk-synchronous rounds.

Documents are tokenized once and cut into pieces of at most `room` tokens. Lengths and gaps are
integers up to `room`, so a range-sorted list of documents or gaps is a list of at most `room`
runs of equal values, whatever the input's size; rounds work on runs. A round takes the longest
documents left, sweeps the sorted gaps for each run's successor (the smallest gap that holds it),
gives a gap that several runs want to the longer one and then to lower ranks, opens sequences for
what found none, and updates the gaps. The plan says which ranks of a length go where; each piece
finds its rank through counts by (slice, length), so no key, however common, meets in one task.

Results: an empty or null text is a piece of one token (the end mark); the longest pieces may fill
a sequence alone; equal rows are separate pieces; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.bpe import encode_texts, words_alone
from codelode.llm.flat import sliced, texts_of
from codelode.runtime import cut, shuffle_width

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def prepare(text: str) -> str:
    """Normalised as the vocabulary's file says: composed, lower case letter by letter."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces_of(docs: DataFrame, path: str, room: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(path, texts_of(batch), words_alone, prepare)):
                data = np.r_[ids, end_id].astype("<u4")
                for k, start in enumerate(range(0, len(data), room)):
                    part = data[start : start + room]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan_rounds(counts: dict[int, int], room: int, band: float = 0.9) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, one past the last, first sequence, offset, pieces a sequence):
    rank r goes to sequence first + (r - first rank) // pieces a sequence."""
    todo = sorted((n, c) for n, c in counts.items() if c > 0)  # range-sorted documents
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences
    order: list[int] = []  # the gaps, range-sorted
    plan, opened = [], 0
    while todo:
        least = todo[-1][0] * band
        fresh: dict[int, list[tuple[int, int]]] = defaultdict(list)

        def put(length: int, rank: int, take: int, first: int, gap: int) -> int:
            """Fill sequences from `first` on that have `gap` left; returns how many it used."""
            each = gap // length
            full, rest = divmod(take, each)
            plan.append((length, rank, rank + take, first, room - gap, each))
            if full and gap - each * length:
                fresh[gap - each * length].append((first, full))
            if rest:
                fresh[gap - rest * length].append((first + full, 1))
            return full + bool(rest)

        while todo and todo[-1][0] >= least:
            length, left = todo.pop()
            rank, at = 0, bisect.bisect_left(order, length)  # the successor of this length
            while left and at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                take = min(left, n * (gap // length))
                used = put(length, rank, take, first, gap)
                rank, left = rank + take, left - take
                if used < n:
                    gaps[gap].append((first + used, n - used))
                if not gaps[gap]:
                    del gaps[gap], order[at]
            if left:
                opened += put(length, rank, left, opened, room)
        for gap, ranges in fresh.items():
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap] += ranges
    return plan


def best_fit(docs: DataFrame, path: str, room: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    slices = 4 * shuffle_width(spark)
    pieces = cut(pieces_of(docs, path, room, end_id)).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    counts = pieces.groupBy("slice", "length").count()
    # at most `room` lengths, and for each at most one row a slice
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `room` rows
    rows = np.array(plan_rounds(totals, room), np.int64).reshape(-1, 6)
    # from arrays: a list of rows would start further Python workers, that stay
    plan = spark.createDataFrame(pa.table(list(rows.T), ["length", "low", "high", "first", "gap_at", "each"]))
    own = Window.partitionBy("slice", "length").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("n", F.row_number().over(own) - 1).join(bases, ["slice", "length"]).withColumn("rank", F.col("base") + F.col("n"))
    p = F.broadcast(plan.withColumnRenamed("length", "of"))  # bounded by `room`, not by the input
    there = F.col("rank") - F.col("low")
    return ranked.join(p, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(there / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("gap_at") + (there % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
