"""Media columns: texts' bytes in progressive JPEG files, read back as RGB tensors.

Results: a null text counts as empty; an empty text is one payload unit of filler; equal texts
give equal values; long texts make tall images; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import jpeg
from codelode.llm.flat import groups, texts_of

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str, unit: int = 576, filler: bytes = b"\xff") -> bytes:
    data = text.encode("utf-8")
    return data + filler * (max(1, -(-len(data) // unit)) * unit - len(data))


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, spread of the whole and a checksum of the tensor."""
    mean = rgb.reshape(-1, 3).mean(axis=0, dtype=np.float64)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(f"{m:.4f}" for m in mean) + f";{rgb.std(dtype=np.float64):.4f};{zlib.crc32(rgb):08x}"


def store_and_read(docs: DataFrame, tensors: bool = False, batch_bytes: int = 2_000_000) -> DataFrame:
    """Store each text in a file, read the file back and describe it. With tensors, also `media`
    (the file), `height`, `width` and `rgb` (the tensor's bytes, row by row)."""
    extra = ", media binary, height int, width int, rgb binary" if tensors else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in groups((len(t) for t in texts), batch_bytes):
                parts = [payload(t) for t in texts[a:b]]
                files: list[bytes] = []
                for c, d in groups(map(len, parts), 500_000):
                    files += jpeg.encode_payloads(parts[c:d])
                rows = []
                for i, text, file, image, coefs in zip(ids[a:b], texts[a:b], files, *jpeg.decode_files(files)):
                    back, rgb = jpeg.payload_of(image, coefs), jpeg.pixels(image, coefs)
                    row = (i, len(text.encode("utf-8")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(rgb))
                    rows.append((*row, file, *rgb.shape[:2], rgb.tobytes()) if tensors else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                names = [x.split()[0] for x in (SCHEMA + extra).split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + extra)
