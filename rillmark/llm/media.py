"""Media columns: texts stored as lossless WebP images, read back as pixel arrays, and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm import webp
from rillmark.llm._base import as_bytes, flat, pieces, small_batches


#: Bytes of texts and of media that a task writes and reads together, of several Arrow batches.
TEXTS, MEDIA = 15 << 17, 7 << 18


def _gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of some batches as one, as soon as a column of theirs has `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text's UTF-8 bytes, filled with zeros to a positive multiple of
    64, as grey lossless WebP images of 64 samples a row (several in a row for long texts).

    Null and empty texts are one row of zeros. Repeated rows and equal texts have equal media. An
    empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), as_bytes(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 1, TEXTS):
            data, offsets = flat(batch.column("_text"))
            for i, j in pieces(offsets, TEXTS):
                payloads = []
                for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True):
                    padded = np.zeros(max(webp.ROW, -(-(b - a) // webp.ROW) * webp.ROW), np.uint8)
                    padded[: b - a] = data[a:b]
                    payloads.append(padded)
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(webp.encode_rows(payloads), pa.binary())], names=["_id", "n_bytes", "media"])

    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


def describe(stored: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Decodes `media` and gives id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 64
    samples), media_bytes, media_sha256 and feature (rows, mean, deviation and mean step of the samples)."""
    small_batches(stored.sparkSession)
    schema = T.StructType(
        [T.StructField(id_col, stored.schema[id_col].dataType)]
        + [T.StructField(c, T.StringType() if c in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 2, MEDIA):
            all_media = batch.column(2).to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in all_media])])
            for i, j in pieces(offsets, MEDIA):
                media = all_media[i:j]
                out = [[] for _ in range(6)]
                for m, x in zip(media, webp.decode_rows(media), strict=True):
                    raw = x.tobytes()
                    step = np.abs(np.diff(x.astype(np.int16))).mean()
                    feature = f"rows={len(x) // webp.ROW};mean={x.mean():.4f};std={x.std():.4f};step={step:.4f}"
                    for column, value in zip(out, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(x) for x in out)], names=schema.names)

    return stored.select(id_col, "n_bytes", "media").mapInArrow(work, schema)
