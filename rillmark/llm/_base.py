"""What the operators of this subpackage share: the checkpoint folder and Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, so that a worker holds a few MB of usual texts at once.
BATCH_ROWS = "500"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name inside spark.checkpoint.dir.

    In local mode, where that setting may be missing, a folder under /tmp is used; on a cluster a
    missing setting is an error, because executors share no local folder.
    """
    return f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints/rillmark"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts are long, and a worker's memory is bounded by a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def as_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_key(text_col: str) -> list:
    """Two longs that name a text: `_k1`, `_k2`. Equal texts share them, and null has its own."""
    return [F.xxhash64(text_col, F.lit(5)).alias("_k1"), F.xxhash64(F.lit(3), text_col).alias("_k2")]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array one after another, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes come to about `limit`; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j
