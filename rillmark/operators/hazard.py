"""Flood and debris masks of scenes: terrain limits, detection, votes, optical fusion, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions import expressions as X
from rillmark.operators import graph, raster

#: The limits that the masks use unless others are given.
MAX_SLOPE, MAX_HAND, MAX_DISTANCE, SHADOW_SLOPE = 18.0, 25.0, 1500.0, 40.0
CONSERVATIVE, LIBERAL = -5.0, -3.0
CORRIDOR, CORRIDOR_SLOPE, VH_RISE, COHERENCE_LOSS, BSI_RISE = 450.0, 35.0, 2.2, 0.35, 0.15
WET, DRY, CLOUD_STEPS, RIVER_STEPS = 0.12, -0.1, 3, 2


def terrain(px: DataFrame, *, sky: bool = False) -> DataFrame:
    """Adds slope_deg, distance_m, hand_m, shadow, valid (where floods may be) and near_river; with
    `sky` also clear (no cloud within a few steps). All of them share one pass over rows and one over
    columns."""
    low = raster.lowest(px)
    grown = [("river", RIVER_STEPS, "near_river"), *([("cloud", CLOUD_STEPS, "_cloudy")] if sky else [])]
    px = raster.slope_rows(px)
    for g in grown:
        px = raster.dilate_rows(px, *g)
    px = raster.slope_columns(px)
    for g in grown:
        px = raster.dilate_columns(px, *g)
    px = raster.river_rows(raster.river_columns(px), low)
    if sky:
        px = px.withColumn("clear", ~F.col("_cloudy")).drop("_cloudy")
    shadow = F.col("slope_deg") > SHADOW_SLOPE
    below = (F.col("slope_deg") <= MAX_SLOPE) & (F.col("hand_m") <= MAX_HAND) & (F.col("distance_m") <= MAX_DISTANCE)
    return px.withColumn("shadow", shadow).withColumn("valid", below & ~shadow)


def threshold_flood(px: DataFrame) -> DataFrame:
    """The detector without a model: adds flood_cons, flood_lib, prob, uncertainty and permanent_water."""
    dvv, dvh = F.col("post_vv") - F.col("pre_vv"), F.col("post_vh") - F.col("pre_vh")
    px = px.withColumn("flood_cons", X.water(dvv, dvh, CONSERVATIVE) & F.col("valid")).withColumn("flood_lib", X.water(dvv, dvh, LIBERAL) & F.col("valid"))
    cons, lib = F.col("flood_cons").cast("double"), F.col("flood_lib").cast("double")
    return px.withColumns({"prob": lib * 0.8, "uncertainty": F.abs(lib - cons) * 0.5, "permanent_water": (F.col("pre_vv") < -18.0) & (F.col("slope_deg") < 5.0)})


def model_flood(px: DataFrame, flood: Column, water: Column, conservative: float = 0.65, liberal: float = 0.40) -> DataFrame:
    """The decision on a model's flood and permanent-water probabilities, of whatever model: water
    that was there before and pixels that cannot flood have probability 0. Adds the columns of
    `threshold_flood` but for uncertainty, which is the model's."""
    permanent = (water > 0.5) & (F.col("slope_deg") < 8.0)
    px = px.withColumn("permanent_water", permanent).withColumn("prob", F.when(F.col("permanent_water") | ~F.col("valid"), 0.0).otherwise(flood))
    return px.withColumns({"flood_cons": (F.col("prob") >= conservative) & F.col("valid"), "flood_lib": (F.col("prob") >= liberal) & F.col("valid")})


def debris(px: DataFrame, *, coherence: str | None = None, optical: bool = False, clear: str = "clear") -> DataFrame:
    """Adds corridor, signals (available), votes, debris_cons and debris_lib. Signals count inside the
    river's corridor only: the rise in VH, the loss of coherence where its column is given, and with
    `optical` the rise of the bare soil index on clear pixels. Of two or more signals, the
    conservative mask wants two votes."""
    near = (F.col("distance_m") <= CORRIDOR) & (F.col("slope_deg") <= CORRIDOR_SLOPE)
    signals = [F.col("post_vh") - F.col("pre_vh") >= VH_RISE]
    if coherence:
        signals.append(F.col(coherence) >= COHERENCE_LOSS)
    if optical:
        rise = X.bare_soil(*map(F.col, ("blue", "red", "nir", "swir"))) - X.bare_soil(*map(F.col, ("blue_pre", "red_pre", "nir_pre", "swir_pre")))
        signals.append((rise >= BSI_RISE) & F.col(clear))
    votes = F.lit(0)
    for s in signals:
        votes = votes + (s & F.col("corridor")).cast("int")
    px = px.withColumn("corridor", near).withColumn("signals", F.lit(len(signals))).withColumn("votes", votes)
    return px.withColumns({"debris_cons": (F.col("votes") >= (2 if len(signals) > 1 else 1)) & F.col("corridor"), "debris_lib": (F.col("votes") >= 1) & F.col("corridor")})


def fuse(px: DataFrame, masks: Sequence[str], *, wet_from: float = WET) -> DataFrame:
    """Adds <mask>_fused and <mask>_unsure for radar masks, given clear, green, swir and prob: pixels
    that clear optics see dry go, then pixels that they see wet come where the radar leaves it open."""
    index = X.normalized_difference(F.col("green"), F.col("swir"))
    wet = (index >= wet_from) & F.col("clear")
    out = {}
    for m in masks:
        dry = F.col(m) & F.col("clear") & (index < DRY)
        out[f"{m}_fused"] = (F.col(m) & ~dry) | (wet & (F.col("prob") >= 0.3))
        out[f"{m}_unsure"] = dry | (wet & ~F.col(m) & (F.col("prob") < 0.25))
    return px.withColumns(out)


def clean(px: DataFrame, flood: Sequence[str], rubble: Sequence[str]) -> DataFrame:
    """Adds <mask>_clean: floods must meet the river (near_river) and stay below the height limit,
    debris may lie half as high again."""
    return graph.clean_masks(px, {**dict.fromkeys(flood, MAX_HAND), **dict.fromkeys(rubble, 1.5 * MAX_HAND)}, connected=flood)


def areas(px: DataFrame) -> DataFrame:
    """Per scene: square kilometres of flood and debris at both levels and of permanent water, and
    the share of pixels that sensors disagree on."""
    sums = {"flood_km2_cons": "flood_cons", "flood_km2_lib": "flood_lib", "debris_km2_cons": "debris_cons", "debris_km2_lib": "debris_lib", "permanent_km2": "permanent_water"}
    return px.groupBy("scene").agg(*[X.km2(F.count_if(F.col(m))).alias(n) for n, m in sums.items()], F.bround(F.avg(F.col("unsure").cast("int")), 4).alias("uncertain"), F.max("signals").alias("signals"))
