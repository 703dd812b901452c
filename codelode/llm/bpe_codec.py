"""Byte-level BPE, encoding and decoding.

Each batch's distinct words become byte arrays, ranked merges are folded over them with the rank
table of a vocabulary file, and the ids are dealt back to the words' places; decoding concatenates
the ids' binary pieces. `encode_native` does the same fold with Spark's higher-order functions and
a literal rank map (see README for its figures); `byte_bpe` is the path for large corpora.

Results: a null or empty text has no tokens and decodes to no bytes; special strings are ordinary
text; extra columns are ignored; repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.bpe import encode_texts, vocabulary, words_spaced
from codelode.llm.flat import spread_runs, texts_of


class Pieces:
    """The bytes of every id, one after the other."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[spread_runs(self.start[ids], self.length[ids])].tobytes()


def byte_bpe(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids as little-endian 32-bit words and of the decoded
    bytes, and with keep_ids the ids themselves; no shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary(path).pieces)
        for batch in batches:
            ids = encode_texts(path, texts_of(batch), words_spaced)
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(pieces.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


BUCKETS = 8192


def rank_map(path: str) -> Column:
    """The literal rank map: an array of small maps from a piece in hexadecimal to its rank, the
    array's index being the piece's CRC-32 modulo BUCKETS."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    with open(path, "rb") as f:
        for a, b in map(bytes.split, f):
            piece = base64.b64decode(a).hex().upper()
            buckets[zlib.crc32(piece.encode()) % BUCKETS][piece] = int(b)
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def encode_native(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The same fold inside Spark: distinct words of the corpus, `aggregate` over as many merges
    as a word can take, the rank looked up in a literal map. Gives word, ids."""
    ranks = rank_map(path)

    def rank(piece: Column) -> Column:
        return F.coalesce(F.element_at(F.element_at(ranks, (F.crc32(piece.cast("binary")) % BUCKETS + 1).cast("int")), piece), F.lit(2**31 - 1))

    words = docs.select(F.explode(F.expr(f"regexp_extract_all(text, r\"(?U){pattern}\", 0)")).alias("word")).distinct()
    units = F.transform(F.sequence(F.lit(1), F.octet_length("word")), lambda i: F.hex(F.col("word").cast("binary").substr(i, F.lit(1))))

    def merge(pieces: Column, _: Column) -> Column:
        last = F.size(pieces)
        # rank and place in one number, so that the least is the leftmost of the lowest rank
        pairs = F.transform(F.slice(pieces, 1, F.greatest(last - 1, F.lit(0))), lambda x, i: rank(F.concat(x, F.element_at(pieces, i + 2))).cast("long") * (1 << 20) + i)
        at = (F.coalesce(F.array_min(pairs), F.lit((2**31 - 1) << 20)) % (1 << 20)).cast("int")
        stop = F.coalesce(F.array_min(pairs), F.lit((2**31 - 1) << 20)) >= ((2**31 - 1) << 20)
        joined = F.concat(F.slice(pieces, F.lit(1), at), F.array(F.concat(F.element_at(pieces, at + 1), F.element_at(pieces, F.least(at + 2, last)))), F.slice(pieces, at + 3, F.greatest(last - at - 2, F.lit(0))))
        return F.when(stop, pieces).otherwise(joined)

    whole = F.hex(F.col("word").cast("binary"))
    folded = F.when(rank(whole) < 2**31 - 1, F.array(whole)).otherwise(F.aggregate(F.sequence(F.lit(1), F.octet_length("word")), units, merge))
    return words.select("word", F.transform(folded, rank).alias("ids"))


def decode_native(ids: Column, path: str) -> Column:
    """Binary pieces of the ids, concatenated, from a literal array by id."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a).hex() for a, b in map(bytes.split, f)}
    pieces = F.from_json(F.lit(json.dumps([ranks.get(i, "") for i in range(max(ranks) + 1)])), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))
