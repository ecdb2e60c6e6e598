"""Neighbourhood operators over pixel rows (scene, r, c, ...). Scenes may differ in size.

Operators that look along rows and columns come in two halves, so that several of them share one
shuffle by row and one by column: all `_rows` halves first, then all `_columns` halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions import counters


def _along(axis: str) -> WindowSpec:
    """A pixel's row in the order of its columns (axis c), or its column in the order of its rows."""
    return Window.partitionBy("scene", "r" if axis == "c" else "c").orderBy(axis)


def _gradient(elevation: str, axis: str, cell: float) -> Column:
    w = _along(axis)
    before, after, here = F.lag(elevation).over(w), F.lead(elevation).over(w), F.col(elevation)
    width = F.when(before.isNull() | after.isNull(), 1).otherwise(2) * cell
    return (F.coalesce(after, here) - F.coalesce(before, here)) / width


def slope_rows(px: DataFrame, elevation: str = "dem", cell: float = 30.0) -> DataFrame:
    return px.withColumn("_gx", _gradient(elevation, "c", cell))


def slope_columns(px: DataFrame, elevation: str = "dem", cell: float = 30.0) -> DataFrame:
    gy = _gradient(elevation, "r", cell)
    return px.withColumn("_gy", gy).withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)))).drop("_gx", "_gy")


def slope(px: DataFrame, elevation: str = "dem", cell: float = 30.0) -> DataFrame:
    """Adds slope_deg: central differences, one-sided at edges, 0 along an axis of one pixel."""
    return slope_columns(slope_rows(px, elevation, cell), elevation, cell)


def dilate_rows(px: DataFrame, mask: str, n: int, name: str) -> DataFrame:
    """Whether a set pixel lies within 0 to n columns of the same row."""
    return px.withColumns({f"_{name}{k}": F.max(F.col(mask)).over(_along("c").rangeBetween(-k, k)) for k in range(n + 1)})


def dilate_columns(px: DataFrame, mask: str, n: int, name: str) -> DataFrame:
    """A set pixel within n steps lies a rows away and within n - a columns."""
    grown = F.lit(False)
    for a in range(-n, n + 1):
        grown = grown | F.coalesce(F.max(F.col(f"_{name}{n - abs(a)}")).over(_along("r").rangeBetween(a, a)), F.lit(False))
    return px.withColumn(name, grown).drop(*[f"_{name}{k}" for k in range(n + 1)])


def dilate(px: DataFrame, mask: str, n: int, name: str) -> DataFrame:
    """Adds a mask grown by n steps in the four directions."""
    return dilate_columns(dilate_rows(px, mask, n, name), mask, n, name)


def _mirrored(px: DataFrame, axis: str, part: str, k: int) -> DataFrame:
    """With the k edge pixels of an axis repeated outside it in mirror order; `_last` is its last place."""
    px = px.withColumn("_last", F.max(axis).over(Window.partitionBy("scene", part)))
    at = F.col(axis)
    copies = F.array(at, F.when(at < k, -1 - at), F.when(at > F.col("_last") - k, 2 * F.col("_last") + 1 - at))
    return px.withColumn(axis, F.explode(F.filter(copies, lambda x: x.isNotNull())))


def lee_filter(px: DataFrame, band: str, window: int = 7) -> DataFrame:
    """Adds <band>_lee: speckle filter with local mean and variance of a window (even: one more),
    mirrored edges, and the noise level of the whole scene. Scenes are at least half a window wide.
    The pixels' other columns go through both passes with them."""
    k = window // 2
    x = px.withColumns({"_m": F.col(band), "_s": F.col(band) * F.col(band)})
    for axis, part in (("c", "r"), ("r", "c")):
        w = Window.partitionBy("scene", part).orderBy(axis).rowsBetween(-k, k)
        x = _mirrored(x, axis, part, k).withColumns({"_m": F.avg("_m").over(w), "_s": F.avg("_s").over(w)}).where((F.col(axis) >= 0) & (F.col(axis) <= F.col("_last"))).drop("_last")
    noise = px.groupBy("scene").agg((F.var_pop(band) / (F.avg(band) ** 2 + 1e-6)).alias("_noise"))
    var = F.greatest(F.col("_s") - F.col("_m") ** 2, F.lit(0.0))
    weight = F.least(F.greatest(var / (var + F.col("_noise") * F.col("_m") ** 2 + 1e-6), F.lit(0.0)), F.lit(1.0))
    return x.join(noise, "scene").withColumn(f"{band}_lee", F.col("_m") + weight * (F.col(band) - F.col("_m"))).drop("_m", "_s", "_noise")


def nearest_in_row(up: np.ndarray, down: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each column of a row, given the nearest river rows above and below (-1: none): squared
    distance, row and column of the nearest river pixel; ties go to the smallest (row, column).
    Distance -1 without one. Columns step outwards together while a nearer pixel is possible, so the
    work is the width times the farthest distance."""
    n = len(up)
    far = np.int64(1) << 60
    above, below = np.where(up >= 0, row - up, far), np.where(down >= 0, down - row, far)
    own = np.where(above <= below, up, down)  # of equal distances the row above has the smaller number
    gap = np.minimum(above, below)
    gap2 = np.where(gap < far, gap * gap, far)
    best, br, bc = gap2.copy(), own.copy(), np.arange(n)
    at = np.arange(n)
    for k in range(1, n):
        at = at[best[at] >= k * k]
        if not len(at):
            break
        for step in (-k, k):
            j = at + step
            ok = (j >= 0) & (j < n)
            c, j = at[ok], j[ok]
            d2 = np.where(gap2[j] < far, gap2[j] + k * k, far)
            less = (d2 < best[c]) | ((d2 == best[c]) & (d2 < far) & ((own[j] < br[c]) | ((own[j] == br[c]) & (j < bc[c]))))
            best[c[less]], br[c[less]], bc[c[less]] = d2[less], own[j[less]], j[less]
    return np.where(best < far, best, -1), br, bc


def river_columns(px: DataFrame) -> DataFrame:
    """The nearest river pixels above and below in the same column, with their height."""
    here = F.when(F.col("river"), F.struct("r", "dem"))
    up = F.last(here, ignorenulls=True).over(_along("r").rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(here, ignorenulls=True).over(_along("r").rowsBetween(0, Window.unboundedFollowing))
    return px.withColumn("_up", up).withColumn("_down", down)


def river_rows(px: DataFrame, low: DataFrame, cell: float = 30.0) -> DataFrame:
    """The nearest river pixel of all from those of the columns; `low` has each scene's lowest pixel."""
    row = px.groupBy("scene", "r").agg(F.sort_array(F.collect_list(F.struct("c", "_up", "_down", *[x for x in px.columns if x not in ("scene", "r", "c", "_up", "_down")]))).alias("x"))
    row = row.select("scene", "r", "x", F.col("x.c").alias("c"), *[F.expr(f"transform(x, v -> coalesce(v._{k}.r, -1L))").alias(k) for k in ("up", "down")], *[F.col(f"x._{k}.dem").alias(f"{k}_dem") for k in ("up", "down")])
    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    schema = T.StructType([row.schema["scene"], row.schema["r"], row.schema["x"], T.StructField("d2", longs), T.StructField("level", doubles)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d2s, levels = [], []
            for r, *lists in zip(batch.column("r").to_pylist(), *(batch.column(k) for k in ("c", "up", "down", "up_dem", "down_dem")), strict=True):
                c, u, d = (np.asarray(x.values, np.int64) for x in lists[:3])
                heights = [x.values.to_numpy(zero_copy_only=False).astype(float) for x in lists[3:]]
                wide = int(c[-1]) + 1
                at, dem = np.full((2, wide), -1, np.int64), np.zeros((2, wide))
                at[:, c], dem[:, c] = (u, d), heights
                d2, nr, nc = nearest_in_row(at[0], at[1], r)
                d2s.append(d2[c])
                levels.append(np.where(at[0, nc[c]] == nr[c], dem[0, nc[c]], dem[1, nc[c]]))
            yield pa.RecordBatch.from_arrays([batch.column("scene"), batch.column("r"), batch.column("x"), pa.array(d2s, pa.list_(pa.int64())), pa.array(levels, pa.list_(pa.float64()))], names=schema.names)

    out = row.mapInArrow(work, schema).select("scene", "r", F.explode(F.arrays_zip("x", "d2", "level")).alias("n"))
    kept = [f for f in schema["x"].dataType.elementType.names if f not in ("_up", "_down")]
    out = out.select("scene", "r", *[F.col(f"n.x.{f}").alias(f) for f in kept], F.col("n.d2").alias("_d2"), F.col("n.level").alias("_level")).join(low, "scene")
    far = F.col("_d2") < 0
    distance = F.when(far, 0.0).otherwise(F.sqrt("_d2") * cell)
    height = F.greatest(F.col("dem") - F.when(far, F.col("_lowest")).otherwise(F.col("_level")), F.lit(0.0))
    return out.withColumn("distance_m", distance).withColumn("hand_m", height).drop("_d2", "_level", "_lowest")


def lowest(px: DataFrame) -> DataFrame:
    return px.groupBy("scene").agg(F.min("dem").alias("_lowest"))


def nearest_river(px: DataFrame, cell: float = 30.0) -> DataFrame:
    """Adds distance_m (0 without a river) and hand_m (height above the nearest river pixel, above
    the lowest pixel without a river). Exact and separable: the nearest river rows above and below
    within each column, then one pass over each row; ties go to the smallest (row, column)."""
    return river_rows(river_columns(px), lowest(px), cell)


def steepest(px: DataFrame, cell: float = 30.0) -> DataFrame:
    """(scene, r, c, nr, nc): the steepest lower neighbour; ties go to N, S, W, E, NW, NE, SW, SE.

    A pixel takes its two neighbours along the row, then the three of the rows above and below along
    the column: one shuffle for each, and no copies of pixels. Rows of a scene are complete, but
    whole rows may be missing."""
    here = F.struct("dem", "c")
    row = px.select("scene", "r", "c", "dem", F.struct(F.lag(here).over(_along("c")).alias("west"), here.alias("own"), F.lead(here).over(_along("c")).alias("east"), F.col("r").alias("r")).alias("own"))
    wide = row.select("scene", "r", "c", "dem", "own", F.lag("own").over(_along("r")).alias("north"), F.lead("own").over(_along("r")).alias("south"))
    falls = []
    for i, (a, b) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))):
        to = F.col(("north", "own", "south")[a + 1])[("west", "own", "east")[b + 1]]
        near = (F.col(("north", "own", "south")[a + 1])["r"] == F.col("r") + a) & (to["c"] == F.col("c") + b)
        fall = (F.col("dem") - to["dem"]) / (cell if not a or not b else 1.4142 * cell)
        falls.append(F.when(near & (fall > 0), F.struct(fall.alias("fall"), F.lit(-i).alias("o"), (F.col("r") + a).alias("nr"), (F.col("c") + b).alias("nc"))))
    out = wide.select("scene", "r", "c", F.array_max(F.array(*falls)).alias("m"))
    return out.where("m is not null").select("scene", "r", "c", "m.nr", "m.nc")


def turned(px: DataFrame, k: int) -> DataFrame:
    """Each scene turned by k quarters against the clock: coordinates change, values stay."""
    size = px.groupBy("scene").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    r, c, h, w = (F.col(x) for x in ("r", "c", "_h", "_w"))
    to = {0: (r, c), 1: (w - 1 - c, r), 2: (h - 1 - r, w - 1 - c), 3: (c, h - 1 - r)}[k % 4]
    return px.join(size, "scene").withColumns({"r": to[0], "c": to[1]}).drop("_h", "_w")


def flipped(px: DataFrame, axis: str) -> DataFrame:
    """Each scene mirrored along an axis."""
    last = px.groupBy("scene").agg(F.max(axis).alias("_last"))
    return px.join(last, "scene").withColumn(axis, F.col("_last") - F.col(axis)).drop("_last")


def augment(px: DataFrame, radar: list[str], seed: int, deviation: float = 0.5) -> DataFrame:
    """Each scene mirrored along rows and along columns with even chances, turned by 0 to 3 quarters, and
    with an even chance of normal noise on its radar bands. Chances follow from seed and scene, noise from
    seed, scene, the pixel's new place and the band, whatever the partitions."""
    chance = lambda kind: counters.uniform(seed, F.col("scene"), F.lit(kind))
    size = px.groupBy("scene").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    x = px.join(size.withColumns({"_k": F.floor(chance("turns") * 4), "_fr": chance("rows") > 0.5, "_fc": chance("columns") > 0.5, "_noisy": chance("noise") > 0.5}), "scene")
    h, w, k = F.col("_h"), F.col("_w"), F.col("_k")
    x = x.withColumns({"r": F.when(F.col("_fr"), h - 1 - F.col("r")).otherwise(F.col("r")), "c": F.when(F.col("_fc"), w - 1 - F.col("c")).otherwise(F.col("c"))})
    r, c = F.col("r"), F.col("c")
    x = x.withColumns({"r": F.when(k == 0, r).when(k == 1, w - 1 - c).when(k == 2, h - 1 - r).otherwise(c), "c": F.when(k == 0, c).when(k == 1, r).when(k == 2, w - 1 - c).otherwise(h - 1 - r)})
    noise = {b: F.when(F.col("_noisy"), F.col(b) + deviation * counters.normal(seed, F.col("scene"), F.col("r"), F.col("c"), F.lit(b))).otherwise(F.col(b)) for b in radar}
    return x.withColumns(noise).drop("_h", "_w", "_k", "_fr", "_fc", "_noisy")
