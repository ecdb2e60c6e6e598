"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the passages that set toxic texts apart from ordinary
ones, one on ordinary text; each is put behind the same common dictionary, so that they differ only
in what is special to them. A text is cut into short windows at blanks; each window is compressed
with either dictionary, and the difference of the two lengths is how much closer the window is to
toxic text. Shares of windows beyond fixed differences are the features of a logistic calibration.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import as_bytes, small_batches

WINDOW = 64
#: Labelled rows of each label that a model is fitted on at most, chosen by a hash of their texts.
SAMPLE_ROWS = 1500
#: Characters of such a row at most; longer rows are left out of the sample, never cut.
SAMPLE_CHARS = 20_000
#: Bounds of what the dictionaries are trained on, all of it from that sample: telling runs and how
#: often one counts, and windows of ordinary text in the common and in the ordinary dictionary.
RUNS, REPEATS, COMMON_WINDOWS, ORDINARY_WINDOWS = 400, 40, 200_000, 16_000
GRAM = 7


def windows(text: bytes, width: int = WINDOW) -> list[bytes]:
    """The lower-cased text (A-Z) in windows of at most `width` bytes, cut at a blank where the second half has one."""
    text = text.lower()
    out, i, n = [], 0, len(text)
    while i < n:
        j = min(n, i + width)
        if j < n:
            k = text.rfind(b" ", i + width // 2, j)
            j = k if k > i else j
        out.append(text[i:j])
        i = j
    return out


def _passages(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """Runs of telling grams in words of toxic texts, with the number of texts. Telling is one in three
    times as many toxic as ordinary texts, by more than four standard deviations, and after at
    least five different beginnings, which copies of one text do not give it."""
    grams = lambda t: {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}
    own: Counter = Counter()
    for t in toxic:
        own.update(grams(t))
    own = Counter({g: n for g, n in own.items() if n >= 5})
    longer: set[bytes] = set()
    for t in toxic:
        longer.update(t[i - 4 : i + GRAM] for i in range(4, len(t) - GRAM + 1) if t[i : i + GRAM] in own)
    variety = Counter(x[4:] for x in longer)
    own = Counter({g: n for g, n in own.items() if variety[g] >= 5})
    other: Counter = Counter()
    for t in ordinary:
        other.update(grams(t) & own.keys())
    n1, n0 = len(toxic), max(len(ordinary), 1)
    telling = set()
    for g, a in own.items():
        b = other[g]
        p = (a + b) / (n1 + n0)
        if a / n1 > 3 * b / n0 and (a / n1 - b / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9) > 4:
            telling.add(g)
    runs: Counter = Counter()
    for t in toxic:
        found = set()
        for w in t.split():
            w = b" " + w + b" "
            at = [i for i in range(len(w) - GRAM + 1) if w[i : i + GRAM] in telling]
            if at:
                found.add(w[at[0] : at[-1] + GRAM])
        runs.update(found)
    return runs


def _originals(texts: list[bytes]) -> list[bytes]:
    """Without texts that share over a fifth of their runs of three words with those before them:
    near copies would make all words of one text look telling."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.split()
        own = {hash((a, b, c)) for a, b, c in zip(w, w[1:], w[2:], strict=False)}
        if 5 * len(own & seen) <= len(own):
            out.append(t)
        seen |= own
    return out


def _dictionary(samples: list[bytes], size: int, segment: int = 16) -> bytes:
    """Trained content without its header of entropy tables; plain samples where there are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()[-size * 3 // 4 :]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size * 3 // 4 :]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def compressors(self) -> tuple:
        make = lambda d: zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False)
        return make(self.toxic), make(self.ordinary)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(text: bytes, toxic, ordinary) -> list[float]:
    d = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(b" " + text + b" ")], float)
    top = np.sort(d)[-3:]
    return [d.max(), top.mean(), d.mean(), *((d >= k).mean() for k in (2, 3, 4, 5)), math.log1p((d >= 4).sum()), math.log(len(d))]


def fit(rows: list[tuple[bytes, int]], prior: float, *, most_runs: int = RUNS, repeats: int = REPEATS, common_windows: int = COMMON_WINDOWS, ordinary_windows: int = ORDINARY_WINDOWS) -> Model:
    """A model from texts and labels; `prior` is the share of toxic rows that the scores assume. The
    dictionaries take at most `most_runs` telling runs, each `repeats` times, and so many windows."""
    r = random.Random(11)
    toxic, plain = (_originals([b" " + t.lower() + b" " for t, y in rows if y == k]) for k in (1, 0))
    runs = _passages(toxic, plain) if toxic else Counter()
    common = [(t, n) for t, n in sorted(runs.items(), key=lambda x: (-x[1], x[0]))[:most_runs] if n >= 3]
    # a run repeated to the length of a dictionary's segment, as often as it counts
    samples = [t * (1 + 24 // len(t)) for t, n in common for _ in range(min(n, repeats))]
    special = _dictionary(samples * max(1, 4000 // max(1, len(samples))), 4096, 12) if samples else b""
    parts = [w for t in plain for w in windows(t)]
    r.shuffle(parts)
    base = _dictionary(parts[:common_windows], 2048)
    usual = _dictionary(parts[-ordinary_windows:], 4096, 12)[-len(special) :] if special else b""
    n = len(features(b"", *Model(base, base, *[np.zeros(0)] * 3).compressors()))
    model = Model(base + special, base + usual, np.zeros(n), np.ones(n), np.zeros(n + 1))
    if not toxic or not plain:
        model.weights[-1] = -4.0 if not toxic else 4.0
        return model
    pair = model.compressors()
    x = np.array([features(t, *pair) for t, _ in rows])
    y = np.array([k for _, k in rows], float)
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - model.centre) / model.scale, np.ones(len(x))]
    # the sample holds the labels in other shares than all labelled rows do
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ model.weights, -500, 500)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(n + 1)
        model.weights = model.weights + np.linalg.solve(h, a.T @ (weight * (y - p)) - model.weights)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, **bounds: int) -> Model:
    """A model from at most `sample_rows` rows of each label. Twice as many labels are drawn first,
    by a hash of their ids, and only their texts are read; null texts and labels are left out. `bounds`
    are those of `fit`."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_labelled"), F.col(label_col).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = []
    for y in (0, 1):
        drawn = known.where(F.col("_y") == y).orderBy(F.xxhash64("_labelled", F.lit(3)), "_labelled").limit(2 * sample_rows)
        texts = docs.where(F.length(text_col) <= sample_chars).join(F.broadcast(drawn), F.col(id_col) == F.col("_labelled")).select(F.col(text_col).alias("t"))
        got += [(r["t"].encode(), y) for r in texts.orderBy(F.xxhash64("t"), "t").limit(sample_rows).collect()]
    total = sum(counts.values())
    return fit(got, counts.get(1, 0) / total if total else 0.0, **bounds)


def score_texts(docs: DataFrame, model: Model, *, keep: list[Column] | None = None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns `keep` (all, if not given), then score (0 to 1) and predicted (score >= threshold).

    Null texts are scored as empty ones. Columns of these two names are replaced.
    """
    small_batches(docs.sparkSession)
    columns = keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(*columns).alias("_rest"), as_bytes(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_rest", rows.schema["_rest"].dataType), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in batches:
            x = np.array([features(t, *pair) for t in batch.column("_text").to_pylist()]).reshape(batch.num_rows, len(model.centre))
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(model.score(x), pa.float64())], names=["_rest", "score"])

    return rows.mapInArrow(work, schema).select("_rest.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
