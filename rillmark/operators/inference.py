"""Model inference over tiles with margins, by an ensemble, and training of a pixel model.

A raster is cut into tiles that carry a margin of their neighbours' pixels, so that a model whose
reach is at most the margin gives on each tile what it gives on the whole raster: results are cropped to
the tile and seams do not show. Beyond the raster's edge there is 0, as a padded convolution has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of an ensemble that are used, by their number; more are left out, as the method has it.
MEMBERS = 3
CLASSES = 3
#: The sides of a tile and its margin, in pixels.
SIDE, MARGIN = 128, 2

#: A model: parameters and channels (channel, row, column) to class scores (class, row, column).
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def convolution(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One layer of 3 x 3 kernels, padded with zeros: weights run over class, channel, row and column, then
    a bias for each class."""
    channels, h, w = x.shape
    kernels = weights[: CLASSES * channels * 9].reshape(CLASSES, channels, 3, 3)
    wide = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    out = np.zeros((CLASSES, h, w))
    for a in range(3):
        for b in range(3):
            out += np.tensordot(kernels[:, :, a, b], wide[:, a : a + h, b : b + w], axes=1)
    return out + weights[CLASSES * channels * 9 :][:, None, None]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=0))
    return e / e.sum(axis=0)


def predict(model: Model, weights: np.ndarray, x: np.ndarray, turns: bool) -> np.ndarray:
    """Class probabilities; with `turns` the mean of those of the channels as they are and mirrored along
    each axis, turned back."""
    out = softmax(model(weights, x))
    if turns:
        for axis in (2, 1):
            out = out + np.flip(softmax(model(weights, np.flip(x, axis))), axis)
        out = out / 3
    return out


def tiles(px: DataFrame, channels: Sequence[str], side: int = SIDE, margin: int = MARGIN) -> DataFrame:
    """(scene, tr, tc, r, c, values): the pixels of each tile and its margin, as lists; a pixel goes to
    its own tile and to those whose margin it lies in. Tiles of a margin alone are left out."""
    if not 0 <= margin <= side:
        raise ValueError("the margin must not be wider than a tile")
    near = lambda x: F.sequence(F.expr(f"({x} - {margin}) div {side}"), F.expr(f"({x} + {margin}) div {side}"))
    size = px.groupBy("scene").agg((F.expr(f"max(r) div {side}")).alias("_tr"), F.expr(f"max(c) div {side}").alias("_tc"))
    placed = px.select("scene", "r", "c", F.array(*[F.col(x).cast("double") for x in channels]).alias("v")).withColumn("tr", F.explode(near("r"))).withColumn("tc", F.explode(near("c")))
    inside = placed.join(size, "scene").where("tr between 0 and _tr and tc between 0 and _tc")
    return inside.groupBy("scene", "tr", "tc").agg(F.collect_list("r").alias("r"), F.collect_list("c").alias("c"), F.flatten(F.collect_list("v")).alias("values"))


def infer(px: DataFrame, channels: Sequence[str], members: DataFrame, *, model: Model = convolution, turns: bool = True, side: int = SIDE, margin: int = MARGIN, most: int = MEMBERS) -> DataFrame:
    """(scene, r, c, flood, uncertainty, water) for each pixel: the mean probabilities of flood (class 2) and
    permanent water (class 1) over the members, and the variance of the first. A single member's uncertainty
    is the entropy of its flood probability, held off 0 and 1 by 1e-6.

    `members` (member, weights) are the ensemble; the first `most` by number are used, which is what the
    driver reads of them. `model` is any function that reaches no farther than the margin."""
    weights = [np.array(r.weights, float) for r in members.orderBy("member").limit(most).collect()]
    if not weights:
        raise ValueError("an ensemble needs a member")
    many = len(channels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                tr, tc = batch.column("tr")[k].as_py(), batch.column("tc")[k].as_py()
                r, c = (np.asarray(batch.column(x)[k].values, np.int64) for x in ("r", "c"))
                top, left = tr * side - margin, tc * side - margin
                x = np.zeros((many, side + 2 * margin, side + 2 * margin))
                x[:, r - top, c - left] = np.asarray(batch.column("values")[k].values, float).reshape(-1, many).T
                # a mirrored model pads where the raster ends, not where the tile does
                h, w = min(side + 2 * margin, int(r.max()) - top + 1), min(side + 2 * margin, int(c.max()) - left + 1)
                all_p = np.stack([predict(model, one, x[:, :h, :w], turns) for one in weights])
                flood = all_p[:, 2].mean(axis=0)
                if len(weights) > 1:
                    unsure = all_p[:, 2].var(axis=0)
                else:
                    p = np.clip(flood, 1e-6, 1 - 1e-6)
                    unsure = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
                water = all_p[:, 1].mean(axis=0)
                own = (r // side == tr) & (c // side == tc)
                r, c = r[own], c[own]
                at = (r - top, c - left)
                columns = [np.full(len(r), batch.column("scene")[k].as_py()), r, c]
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in columns), *(pa.array(v[at]) for v in (flood, unsure, water))], names=["scene", "r", "c", "flood", "uncertainty", "water"])

    return tiles(px, channels, side, margin).mapInArrow(work, "scene long, r long, c long, flood double, uncertainty double, water double")


def _passed(px: DataFrame, features: Sequence[str], label: str, weights: np.ndarray, focus: float) -> dict[bool, dict[str, np.ndarray]]:
    """Sums over the pixels of the fitting (False) and held-out (True) regions at these weights: focal loss,
    its gradient, and for each class what the Dice loss and its gradient follow from. Each task adds up its
    own pixels; what is shuffled and what the driver reads has the size of the model."""
    many, sizes = len(features) + 1, {"n": (1,), "focal": (1,), "focal_g": (CLASSES, len(features) + 1), "both": (CLASSES,), "all": (CLASSES,), "both_g": (CLASSES, CLASSES, len(features) + 1), "all_g": (CLASSES, CLASSES, len(features) + 1), "hit": (1,), "either": (1,)}

    def add(sums: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
        p = softmax(weights @ x.T).T
        hot = np.eye(CLASSES)[y]
        pt = (p * hot).sum(axis=1)
        held = np.maximum(pt, 1e-7)
        rest = 1 - pt
        sums["n"] += len(y)
        sums["focal"] += (-(rest**focus) * np.log(held)).sum()
        # of the focal term by pt, then of pt by the scores: p_y (1[k = y] - p_k)
        slope = focus * rest ** (focus - 1) * np.log(held) - np.where(pt > 1e-7, rest**focus / held, 0)
        sums["focal_g"] += ((slope * pt)[:, None] * (hot - p)).T @ x
        sums["both"] += (p * hot).sum(axis=0)
        sums["all"] += (p + hot).sum(axis=0)
        for c in range(CLASSES):
            dp = p[:, c : c + 1] * ((np.arange(CLASSES) == c) - p)
            sums["both_g"][c] += (dp * hot[:, c : c + 1]).T @ x
            sums["all_g"][c] += dp.T @ x
        top = p.argmax(axis=1)
        sums["hit"] += ((top == 2) & (y == 2)).sum()
        sums["either"] += ((top == 2) | (y == 2)).sum()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {out: {k: np.zeros(v) for k, v in sizes.items()} for out in (False, True)}
        for batch in batches:
            x = np.stack([*(batch.column(f).to_numpy(zero_copy_only=False) for f in features), np.ones(len(batch))], axis=1)
            y, out = batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_out").to_numpy(zero_copy_only=False).astype(bool)
            for part in (False, True):
                if (out == part).any():
                    add(sums[part], x[out == part], y[out == part])
        rows = [(part, name, i, v) for part, own in sums.items() for name, values in own.items() for i, v in enumerate(values.ravel().tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names=["out", "name", "i", "v"])

    assert many == weights.shape[1]
    got = px.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("long").alias("_y"), F.col("_out")).mapInArrow(work, "out boolean, name string, i long, v double")
    result = {part: {k: np.zeros(int(np.prod(v))) for k, v in sizes.items()} for part in (False, True)}
    for r in got.groupBy("out", "name", "i").agg(F.sum("v").alias("v")).collect():
        result[r.out][r.name][r.i] = r.v
    return {part: {k: v.reshape(sizes[k]) for k, v in own.items()} for part, own in result.items()}


def loss_and_gradient(s: dict[str, np.ndarray], smooth: float = 1e-5) -> tuple[float, np.ndarray]:
    """Mean focal loss plus one less the mean Dice score of the classes, and the gradient by the weights."""
    n = max(float(s["n"][0]), 1.0)
    top, bottom = 2 * s["both"] + smooth, s["all"] + smooth
    by_both, by_all = -2 / (CLASSES * bottom), top / (CLASSES * bottom**2)
    gradient = s["focal_g"] / n + np.tensordot(by_both, s["both_g"], axes=1) + np.tensordot(by_all, s["all_g"], axes=1)
    return float(s["focal"][0] / n + 1 - (top / bottom).mean()), gradient


class AdamW:
    """The optimiser's rule; its state has the size of the model."""

    def __init__(self, rate: float = 1e-3, decay: float = 1e-4, first: float = 0.9, second: float = 0.999, least: float = 1e-8):
        self.rate, self.decay, self.first, self.second, self.least, self.t, self.m, self.v = rate, decay, first, second, least, 0, 0.0, 0.0

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = self.first * self.m + (1 - self.first) * gradient
        self.v = self.second * self.v + (1 - self.second) * gradient**2
        m, v = self.m / (1 - self.first**self.t), self.v / (1 - self.second**self.t)
        return weights * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + self.least)


def train(px: DataFrame, features: Sequence[str], label: str, held_out: Column, *, rounds: int = 3, rate: float = 0.1, focus: float = 2.0) -> tuple[np.ndarray, list[tuple[int, float, float, bool]]]:
    """Fits a softmax of pixel features by rounds over all fitting pixels, and returns the weights (class,
    feature and bias) that did best on the held-out regions, with what each round came to: its number, the
    loss before its step, the flood IoU on the held-out pixels after it (1 without any), and whether its
    weights are the best so far. Ties go to the later round. Pixels with a null label or feature take no part."""
    whole = px.withColumn("_out", held_out).where(" and ".join(f"{c} is not null" for c in (*features, label, "_out")))
    weights, rule = np.zeros((CLASSES, len(features) + 1)), AdamW(rate)
    best, most, history = weights, 0.0, []
    sums = _passed(whole, features, label, weights, focus)
    for k in range(rounds):
        loss, gradient = loss_and_gradient(sums[False])
        weights = rule.step(weights, gradient)
        sums = _passed(whole, features, label, weights, focus)  # held-out pixels now, fitting pixels for the next round
        iou = float(sums[True]["hit"][0] / sums[True]["either"][0]) if sums[True]["either"][0] else 1.0
        better = iou >= most
        if better:
            best, most = weights, iou
        history.append((k, loss, iou, better))
    return best, history
