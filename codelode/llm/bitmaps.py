"""Sets of 64-bit values as bitmaps over their low bits: of a size that doesn't depend on the input.

A bitmap says yes for every value of its set, and now and then for another one; users must give
the same results either way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 25  # four megabytes


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Little-endian bits, 2**BITS of them; the driver reads 1024 rows at most."""
    bit = F.col(column).bitwiseAND((1 << BITS) - 1) + 1
    parts = values.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in parts.collect():
        out[(r["part"] - 1) * 4096 :][:4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def within(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = (values.view(np.uint64) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)
