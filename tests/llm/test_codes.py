import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    wide = len(kept[0][1]) // parts
    part = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[list(part(v, p)) for _, v, _ in kept[:entries]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, p: min(range(len(books[p])), key=lambda e: (d(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            own = [(pick(v, p), part(v, p)) for _, v, _ in kept]
            for e in range(len(books[p])):
                some = [v for k, v in own if k == e]
                if some:
                    new[p][e] = [sum(x) // len(some) for x in zip(*some, strict=True)]
        books = new
    out = []
    for i, v, g in kept:
        at = [pick(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e in at), sum(d(part(v, p), books[p][e]) for p, e in enumerate(at)), g))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sum(x for *_, x, k in out if k == g), sha) for i, c, e, g in out), key=str)


def vectors(n, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=16) * (1 + i % 3)], None if i % 7 == 0 else i % 3) for i in range(n)]
    rows += [(rows[3][0], rows[3][1], 1), (n, None, 0), (n + 1, [None] + [0.0] * 15, 0), (n + 2, [float("nan")] * 16, 1), (n + 3, [float("inf")] + [1.0] * 15, 1), (None, [0.5] * 16, 2), (None, [0.5] * 16, None)]
    return rows


@pytest.mark.parametrize("n", [5, 120])
def test_equals_brute_force(spark, n):
    rows = vectors(n)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("code"), F.lit("x").alias("_v"), F.lit(3).alias("error"))
    for parts in (1, 5):
        got = codes.encode(df.repartition(parts))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table_hot_label_and_faults(spark):
    assert codes.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.encode(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    hot = spark.createDataFrame([(i, [1.0] * 8, 1) for i in range(300)] + [(300, [2.0] * 8, 2)], SCHEMA)
    out = codes.encode(hot).collect()
    assert len(out) == 301 and {r.error for r in out} == {r.label_error for r in out} and len({r.code for r in out}) >= 1
    for bad in ([0.0] * 9, [1e9] * 8):
        with pytest.raises(Exception, match="length|large"):
            codes.encode(spark.createDataFrame([(0, [0.0] * 8, 1), (1, bad, 1)], SCHEMA)).collect()


def test_annulus_finds_the_nearest_and_leaves_most_out():
    r = np.random.default_rng(4)
    book = r.integers(-2000, 2000, (256, 4)) * r.integers(1, 40, (256, 1))
    book[7], book[200] = book[3], -book[3]
    parts = np.concatenate([book[:50] + r.integers(-3, 4, (50, 4)), np.zeros((2, 4), np.int64), r.integers(-(1 << 25), 1 << 25, (40, 4))])
    index, distance, looked = codes.nearest(parts, book)
    every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert looked < parts.shape[0] * 256 / 3
