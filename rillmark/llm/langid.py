"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A trigram's vector binds
(multiplies) its letters' vectors after rotating the first twice and the second once; a text's vector
bundles (adds) those of its trigrams, where a run of other characters is one blank. A language's
prototype bundles its texts' unit vectors. A text goes to the language whose prototype has the
largest cosine with it, both taken relative to the mean of all prototypes.

A batch of texts is one matrix product: counts of trigrams by text times the vectors of the trigrams
that occur.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import as_bytes, flat, pieces, small_batches

DIMENSIONS = 1024
SEED = 20240607
#: Trigrams whose vectors are held at once.
SLICE = 8192
#: Steepness of the score, a softmax of the cosines.
STEEP = 12.0
#: Languages whose prototypes the driver gathers at most; more raise an error.
MAX_LANGUAGES = 2000


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for other characters."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


@functools.lru_cache(100_000)
def _vector(cp: int, dimensions: int) -> np.ndarray:
    bits = np.random.default_rng((SEED, cp)).integers(0, 2, dimensions, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def text_vectors(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of UTF-8 texts, and whether each has a letter (if not, the vector is 0)."""
    docs = len(offsets) - 1
    out = np.zeros((docs, dimensions), np.float32)
    heads = (data & 0xC0) != 0x80
    ends = np.concatenate([[0], np.cumsum(heads)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letter = _letters()[np.minimum(points, 0x10FFFF)]
    doc = np.repeat(np.arange(docs), np.diff(ends))
    # blanks: one between words, one before and after each text
    first = np.zeros(len(points), bool)
    first[ends[:-1][np.diff(ends) > 0]] = True
    real = letter > 0
    start = real & (first | ~np.concatenate([[False], real[:-1]]))
    kept = np.flatnonzero(real)
    if not len(kept):
        return out, np.zeros(docs, bool)
    symbols, inverse = np.unique(letter[kept], return_inverse=True)
    a = len(symbols) + 1
    # each kept letter's place when a blank stands before every word and after the last of a text
    text_start = np.zeros(len(kept), bool)
    text_start[np.flatnonzero(np.diff(doc[kept], prepend=-1))] = True
    place = np.arange(len(kept)) + np.cumsum(start[kept]) + np.cumsum(text_start) - 1
    stream = np.zeros(place[-1] + 2, np.int64)
    stream[place] = inverse + 1
    owner = np.zeros(len(stream), np.int64)
    owner[place] = doc[kept]
    middle = place  # one trigram around each letter, and one around each blank between words
    blank = place[start[kept] & ~text_start] - 1
    middle = np.concatenate([middle, blank])
    own = np.concatenate([doc[kept], owner[np.minimum(blank + 1, len(owner) - 1)]])
    key = (stream[middle - 1] * a + stream[middle]) * a + stream[middle + 1]
    grams, column = np.unique(key, return_inverse=True)
    vectors = np.vstack([np.ones((1, dimensions), np.int8), *(_vector(int(s), dimensions)[None] for s in symbols)])
    turned = [np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), vectors]
    for lo in range(0, len(grams), SLICE):
        g = grams[lo : lo + SLICE]
        v = (turned[0][g // (a * a)] * turned[1][g // a % a] * turned[2][g % a]).astype(np.float32)
        some = slice(None) if len(grams) <= SLICE else (column >= lo) & (column < lo + SLICE)
        counts = np.bincount(own[some] * len(g) + column[some] - lo, minlength=docs * len(g))
        out += counts.reshape(docs, len(g)).astype(np.float32) @ v
    has = np.bincount(doc[kept], minlength=docs) > 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9), has


def prototypes(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names and their prototypes (rows), learned from rows with a language."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), as_bytes(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            data, offsets = flat(batch.column("_text"))
            for i, j in pieces(offsets):
                vectors, _ = text_vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], dimensions)
                for lang in set(langs[i:j]):
                    sums[lang] = sums.get(lang, 0) + vectors[langs[i:j] == lang].sum(axis=0, dtype=np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.mapInArrow(work, "lang string, v array<double>").select("lang", F.posexplode("v"))
    sums = parts.groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    got = sorted(sums.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.array([[p["x"] for p in r["v"]] for r in got]).reshape(len(got), dimensions)
    return [r["lang"] for r in got], (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def identify(docs: DataFrame, names: list[str], table: np.ndarray, *, keep: list[Column] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` (all, if not given), then lang_pred and score for every row.

    Texts without a letter, null texts, and all texts when no language was learned are `und` with
    score 0. Ties go to the first name in order. Columns of these two names are replaced.
    """
    small_batches(docs.sparkSession)
    columns = keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*columns).alias("_rest"), as_bytes(text_col).alias("_text"))
    mean = table.mean(axis=0) if len(names) > 1 else np.zeros(table.shape[1], np.float32)
    centred = table - mean
    centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    dimensions = table.shape[1]
    schema = T.StructType([T.StructField("_rest", rows.schema["_rest"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("_text"))
            for i, j in pieces(offsets):
                langs, scores = ["und"] * (j - i), np.zeros(j - i)
                if names:
                    vectors, has = text_vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], dimensions)
                    vectors = vectors - mean
                    cosine = (vectors @ centred.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                    best = cosine.argmax(axis=1)
                    odds = np.exp(STEEP * (cosine - cosine.max(axis=1, keepdims=True)))
                    scores = np.where(has, 1 / odds.sum(axis=1, dtype=np.float64), 0.0)
                    langs = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("_rest").slice(i, j - i), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["_rest", "lang_pred", "score"])

    return rows.mapInArrow(work, schema).select("_rest.*", "lang_pred", "score")


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
