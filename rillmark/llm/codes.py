"""Product codes of vectors, with annular norm pruning of the search for the nearest entry.

Components become integers, so every sum and distance is exact and no result depends on partitions.
Vectors are cut into equal parts and each part position has a codebook. A round assigns every part to
its codebook's nearest entry and moves each entry to the floor of its parts' mean.

The nearest entry is found without looking at all of them. Entries are sorted by norm. The entry
whose norm is nearest to the part's gives a first distance d; by the triangle inequality no entry is
nearer whose norm differs from the part's by more than d. Two binary searches find that annulus, its
ends included, and only its entries are compared exactly.

A round reads the integer vectors once. Each task keeps one sum and count per entry, so what is
shuffled and what the driver gathers are codebooks, whose size the data do not change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components must be smaller, so that distances with an entry's index stay below 2**63.
LIMIT = 1 << 26


def annulus(norms: np.ndarray, radius: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the sorted norms from radius - reach to radius + reach, both included, and
    whatever rounding of square roots could have moved out."""
    slack = 1e-9 + 1e-12 * (radius + reach)
    return np.searchsorted(norms, radius - reach - slack, "left"), np.searchsorted(norms, radius + reach + slack, "right")


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of parts the index of the nearest entry (ties: the lowest), its squared distance,
    and how many distances were computed in all."""
    n, entries = len(parts), len(book)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    length = (book * book).sum(axis=1)
    order = np.argsort(length, kind="stable")
    norms = np.sqrt(length[order].astype(float))
    radius = np.sqrt((parts * parts).sum(axis=1).astype(float))
    at = np.searchsorted(norms, radius)
    below, above = np.maximum(at - 1, 0), np.minimum(at, entries - 1)
    guess = order[np.where(np.abs(radius - norms[below]) <= np.abs(norms[above] - radius), below, above)]
    best = ((parts - book[guess]) ** 2).sum(axis=1)
    lo, hi = annulus(norms, radius, np.sqrt(best.astype(float)))
    many = hi - lo
    start = np.cumsum(many) - many
    row = np.repeat(np.arange(n), many)
    entry = order[np.arange(len(row)) - np.repeat(start - lo, many)]
    distance = ((parts[row] - book[entry]) ** 2).sum(axis=1)
    found = np.minimum.reduceat(distance * entries + entry, start)  # the first guess lies in its annulus, so none is empty
    return found % entries, found // entries, n + len(row)


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part of integer vectors (rows), and the rows' summed squared distances."""
    n, (parts, _, wide) = len(vectors), books.shape
    cut_up = vectors.reshape(n, parts, wide)
    index, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
    for p in range(parts):
        index[:, p], distance, _ = nearest(cut_up[:, p], books[p])
        error += distance
    return index, error


def moved(books: np.ndarray, rows: list) -> np.ndarray:
    """Entries at the floor of their parts' mean, from rows (part, entry, place, total, n); unused ones stay."""
    out = books.copy()
    for part, entry, place, total, n in rows:
        out[part, entry, place] = total // n
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), wide)


def _totals(df: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, total, n) of each task's parts."""
    parts, entries, wide = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("_v"), parts * wide)
            index, _ = assign(vectors, books)
            for p in range(parts):
                np.add.at(total[p], index[:, p], vectors[:, p * wide : (p + 1) * wide])
                n[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        columns = [np.repeat(part, wide), np.repeat(entry, wide), np.tile(np.arange(wide), len(part)), total[part, entry].ravel(), np.repeat(n[part, entry], wide)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["part", "entry", "place", "total", "n"])

    return df.select("_v").mapInArrow(work, "part long, entry long, place long, total long, n long")


def encode(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: its id, code (two hex digits a part), error (squared distances summed
    over parts), label_error (error summed over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null, or holds a null or a component that is not finite, are dropped. Each
    component x is floor(scale * x). Codebooks start as the parts of the `entries` smallest ids (null
    ids last, equal ids in the order of their vectors), fewer if fewer rows are kept. Repeated rows
    count each. An empty table gives no rows; other columns are ignored. Vectors of another
    length than the first one's, of a length that `parts` does not divide, or with components beyond
    LIMIT / scale raise an error.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries, and at least one part")
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector_col, lambda x: F.when(F.abs(x.cast("double")) * scale < LIMIT, F.floor(x.cast("double") * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large"))))
    rows = cut(vectors.where(good).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), scaled.alias("_v")))
    first = [r[0] for r in rows.orderBy(F.asc_nulls_last("_id"), "_v").select("_v").limit(entries).collect()]
    kind, label = rows.schema["_id"].dataType, rows.schema["_label"].dataType
    if not first:
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    length = len(first[0])
    if length % parts or any(len(x) != length for x in first):
        raise ValueError("vectors must have one length, which the parts divide")
    wide = length // parts
    same = F.when(F.size("_v") == length, F.col("_v")).otherwise(F.raise_error(F.lit("vectors differ in length")))
    rows = rows.withColumn("_v", same)
    books = np.array(first, np.int64).reshape(len(first), parts, wide).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = _totals(rows, books).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = moved(books, sums.collect())  # parts * entries * wide rows at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, error = assign(_matrix(batch.column("_v"), length), books)
            text = index.astype(np.uint8).tobytes().hex()
            code = [text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(len(index))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(code, pa.string()), pa.array(error)], names=["_id", "_label", "code", "error"])

    schema = T.StructType([T.StructField("_id", kind), T.StructField("_label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = cut(rows.mapInArrow(work, schema))
    sums = coded.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error"))
    # a frequent label is one row on the right, so a skewed join can be split; few labels are broadcast by their size
    out = coded.join(sums, F.col("_label").eqNullSafe(F.col("_l")))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
