import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.functions import counters
from rillmark.operators import inference, ingest, raster
from rillmark.sources import npy


def scenes(spark, shapes, seed=1):
    r = np.random.default_rng(seed)
    data = [r.normal(size=(2, h, w)) for h, w in shapes]
    rows = [(s, a, b, float(x[0, a, b]), float(x[1, a, b])) for s, x in enumerate(data) for a in range(x.shape[1]) for b in range(x.shape[2])]
    return data, spark.createDataFrame(rows, "scene long, r long, c long, u double, v double").repartition(5)


@pytest.mark.parametrize("many", [1, 2, 5])
def test_tiles_with_margins_equal_the_whole_raster(spark, many):
    data, px = scenes(spark, [(13, 9), (8, 16), (1, 1), (5, 3)])
    r = np.random.default_rng(2)
    weights = [r.normal(size=3 * 2 * 9 + 3) for _ in range(many)]
    members = spark.createDataFrame([(k, w.tolist()) for k, w in enumerate(weights)], "member long, weights array<double>")
    for turns in (False, True):
        want = {}
        for s, x in enumerate(data):
            p = np.stack([inference.predict(inference.convolution, w, x, turns) for w in weights[:3]])
            e = np.clip(p[:, 2].mean(axis=0), 1e-6, 1 - 1e-6)
            f = p[:, 2].mean(axis=0)
            unsure = p[:, 2].var(axis=0) if many > 1 else -(e * np.log2(e) + (1 - e) * np.log2(1 - e))
            want |= {(s, a, b): (f[a, b], unsure[a, b], p[:, 1].mean(axis=0)[a, b]) for a in range(x.shape[1]) for b in range(x.shape[2])}
        for side, margin in ((4, 1), (5, 2), (128, 2)):
            got = {(x.scene, x.r, x.c): (x.flood, x.uncertainty, x.water) for x in inference.infer(px, ["u", "v"], members, turns=turns, side=side, margin=margin).collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_convolution_and_other_models(spark):
    x, w = np.random.default_rng(3).normal(size=(2, 6, 5)), np.random.default_rng(4).normal(size=57)
    kernels, wide = w[:54].reshape(3, 2, 3, 3), np.pad(x, ((0, 0), (1, 1), (1, 1)))
    naive = [[[(kernels[k] * wide[:, a : a + 3, b : b + 3]).sum() + w[54 + k] for b in range(5)] for a in range(6)] for k in range(3)]
    assert np.allclose(inference.convolution(w, x), naive)
    _, px = scenes(spark, [(4, 4)])
    members = spark.createDataFrame([(0, [0.0])], "member long, weights array<double>")
    flat = inference.infer(px, ["u", "v"], members, model=lambda _, x: np.zeros((3, *x.shape[1:])), side=2, margin=0)
    assert {round(x.flood, 9) for x in flat.collect()} == {round(1 / 3, 9)}
    with pytest.raises(ValueError, match="member"):
        inference.infer(px, ["u"], members.limit(0))
    assert inference.infer(px.limit(0), ["u", "v"], members).count() == 0


def labelled(spark, n=3000):
    r = np.random.default_rng(7)
    x = r.normal(size=(n, 4))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=n) > 0.6, 2, np.where(x[:, 1] > 0.9, 1, 0))
    region = r.integers(0, 3, n)
    rows = [(*map(float, a), int(b), int(g)) for a, b, g in zip(x, y, region, strict=True)]
    return x, y, region, spark.createDataFrame([*rows, (None, 0.0, 0.0, 0.0, 1, 0), (0.0, 0.0, 0.0, 0.0, None, 0)], "a double, b double, c double, d double, y int, region int").repartition(6)


def whole_loss(w, x, y):
    """Focal and Dice loss of all pixels at once, straight from their definition."""
    p = inference.softmax(w @ np.c_[x, np.ones(len(x))].T).T
    hot = np.eye(3)[y]
    pt = (p * hot).sum(axis=1)
    score = (2 * (p * hot).sum(axis=0) + 1e-5) / ((p + hot).sum(axis=0) + 1e-5)
    return (-((1 - pt) ** 2) * np.log(np.maximum(pt, 1e-7))).mean() + 1 - score.mean()


def test_training_equals_a_run_on_the_driver(spark):
    x, y, region, px = labelled(spark)
    best, history = inference.train(px, list("abcd"), "y", F.col("region") == 2, rounds=5)
    fit, held = region != 2, region == 2
    w, rule, kept, top = np.zeros((3, 5)), inference.AdamW(0.1), None, 0.0
    for k, loss, iou, better in history:
        assert loss == pytest.approx(whole_loss(w, x[fit], y[fit]), abs=1e-9)
        slope = np.zeros_like(w)  # by differences
        for at in np.ndindex(*w.shape):
            step = np.zeros_like(w)
            step[at] = 1e-5
            slope[at] = (whole_loss(w + step, x[fit], y[fit]) - whole_loss(w - step, x[fit], y[fit])) / 2e-5
        w = rule.step(w, slope)
        guess = (w @ np.c_[x[held], np.ones(held.sum())].T).argmax(axis=0)
        want = ((guess == 2) & (y[held] == 2)).sum() / ((guess == 2) | (y[held] == 2)).sum()
        assert iou == pytest.approx(want, abs=0.01) and better == (iou >= top)
        kept, top = (w, iou) if better else (kept, top)
    assert np.allclose(best, kept, atol=1e-4)
    losses = [h[1] for h in history]
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False)) and history[-1][2] > 0.5


def test_training_without_held_out_pixels(spark):
    *_, px = labelled(spark, 60)
    _, history = inference.train(px, list("abcd"), "y", F.lit(False), rounds=1)
    assert history[0][2:] == (1.0, True)


def test_numbers_by_counter(spark):
    df = spark.range(20_000).select("id", counters.uniform(5, F.col("id")).alias("u"), counters.normal(5, F.col("id"), F.lit("x")).alias("z"))
    same = df.repartition(7).orderBy("id").select("u", "z").limit(50).collect()
    assert same == df.orderBy("id").select("u", "z").limit(50).collect()
    one = df.where("id = 3").first()
    assert one.u == (int(hashlib.md5(b"5:3").hexdigest()[:13], 16) + 0.5) / 2**52
    m = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z"), F.corr("u", "z")).first()
    assert abs(m[0] - 0.5) < 0.01 and 0 < m[1] and m[2] < 1 and abs(m[3]) < 0.03 and abs(m[4] - 1) < 0.02 and abs(m[5]) < 0.03
    null = spark.range(1).select(counters.uniform(5, F.lit(None).cast("long")).alias("u")).first()
    assert null.u == (int(hashlib.md5(b"5:null").hexdigest()[:13], 16) + 0.5) / 2**52


def test_augmentation_moves_every_pixel_once_and_does_not_depend_on_partitions(spark):
    data, px = scenes(spark, [(4, 7)] * 24)
    out = raster.augment(px, ["u"], 3)
    rows = {(x.scene, x.r, x.c): (x.u, x.v) for x in out.collect()}
    assert len(rows) == 24 * 28 and rows == {(x.scene, x.r, x.c): (x.u, x.v) for x in raster.augment(px.repartition(2), ["u"], 3).collect()}
    kinds, noisy = set(), 0
    for s, x in enumerate(data):
        h, w = (4, 7) if (s, 3, 6) in rows else (7, 4)
        v = np.array([[rows[s, a, b][1] for b in range(w)] for a in range(h)])
        u = np.array([[rows[s, a, b][0] for b in range(w)] for a in range(h)])
        fit = [(a, b, k) for a in (0, 1) for b in (0, 1) for k in range(4) if np.array_equal(np.rot90(x[1][:: -1 if a else 1, :: -1 if b else 1], k), v)]
        assert fit
        kinds.add(fit[0])
        a, b, k = fit[0]
        noisy += not np.array_equal(np.rot90(x[0][:: -1 if a else 1, :: -1 if b else 1], k), u)
    assert len(kinds) > 4 and 4 < noisy < 20


def test_npy_files(spark, tmp_path):
    npy.register(spark)
    r = np.random.default_rng(5)
    arrays = {"a": r.normal(size=(3, 4, 5)), "b": r.integers(0, 9, (7, 2)).astype(np.int16), "c": np.asfortranarray(r.normal(size=(4, 6, 3)).astype(np.float32)), "d": np.array([1.5, 2.5]), "e": np.zeros((0, 3)), "f": np.array(7.0), "g": np.array([[True, False]])}
    for name, x in arrays.items():
        np.save(tmp_path / f"{name}.npy", x)
    for rows in (2, 65_536):
        got = spark.read.format("npy").option("rows", rows).load(str(tmp_path)).collect()
        for name, x in arrays.items():
            own = {tuple(g.place): g.values for g in got if g.file.endswith(f"/{name}.npy")}
            x = np.atleast_1d(x)
            assert own == {at: list(map(float, x[at])) for at in np.ndindex(*x.shape[:-1])} if x.size else own == {}
    assert len(spark.read.format("npy").load(f"file://{tmp_path}/a.npy").collect()) == 12
    out = spark.createDataFrame([("x", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("y", [1], [0.1])], "name string, shape array<int>, values array<double>")
    out.write.format("npy").option("dtype", "<f8").mode("append").save(str(tmp_path / "out"))
    assert np.load(tmp_path / "out/x.npy").tolist() == [[1, 2, 3], [4, 5, 6]] and sorted(os.listdir(tmp_path / "out")) == ["x.npy", "y.npy"]
    np.save(tmp_path / "out/z.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="plain numbers"):
        spark.read.format("npy").load(str(tmp_path / "out")).collect()


def test_hashes_of_files_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "CHUNK", 1000)
    files = {"a b.bin": os.urandom(1_000_001), "c.bin": b"", "d/é.bin": b"x" * 1000, "e.txt": b"left out"}
    (tmp_path / "d").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate((2 << 30) + 5)  # a file of holes, beyond what one row can hold
    out = {x.path.rsplit("/", 1)[1]: (x.length, x.sha256) for x in ingest.file_hashes(spark, str(tmp_path), "*.bin").collect()}
    big = hashlib.sha256()
    for _ in range(2048):
        big.update(bytes(1 << 20))
    big.update(bytes(5))
    assert out == {n.rsplit("/", 1)[-1]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items() if n.endswith("bin")} | {"big.bin": ((2 << 30) + 5, big.hexdigest())}
