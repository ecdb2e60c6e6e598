"""Queries over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import expressions as X
from rillmark.operators import graph, hazard, raster, vectors
from rillmark.plans.sql import FINAL, FLOOD, FOUR, LABEL, MASKS, PX, SLOPE, NEAR, TERRAIN, filled, km2, query
from rillmark.sources import tables

AT = ("scene", "r", "c")
FLOODS, RUBBLE = ("flood_cons_fused", "flood_lib_fused"), ("debris_cons", "debris_lib")


def _r(x, digits: int = 6):
    return F.round(x, digits)


def raw_masks(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with terrain, detection, three debris signals and optical fusion."""
    px = hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d), sky=True))
    return hazard.fuse(hazard.debris(px, coherence="coherence_loss", optical=True), ["flood_cons", "flood_lib"])


def final_masks(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with cleaned masks, and cons and lib, the unions of flood and debris."""
    px = hazard.clean(raw_masks(spark, d), FLOODS, RUBBLE)
    return px.withColumn("cons", F.expr("flood_cons_fused_clean or debris_cons_clean")).withColumn("lib", F.expr("flood_lib_fused_clean or debris_lib_clean"))


def hazard_figures(px: DataFrame) -> DataFrame:
    named = px.select(*AT, F.col("flood_cons_fused_clean").alias("flood_cons"), F.col("flood_lib_fused_clean").alias("flood_lib"), F.col("debris_cons_clean").alias("debris_cons"), F.col("debris_lib_clean").alias("debris_lib"), "permanent_water", F.col("flood_cons_unsure").alias("unsure"), "signals")
    return hazard.areas(named)


@query(f"""WITH {PX} SELECT scene, r, c, round(post_vv - pre_vv, 6) AS dvv, round(post_vh - pre_vh, 6) AS dvh,
round((pre_vh - pre_vv) / (abs(pre_vh) + abs(pre_vv) + 1e-6), 6) AS cross_pre, round((post_vh - post_vv) / (abs(post_vh) + abs(post_vv) + 1e-6), 6) AS cross_post FROM px""")
def band_diff_features(spark, d):
    px = tables.pixels(spark, d)
    return px.select(*AT, _r(F.col("post_vv") - F.col("pre_vv")).alias("dvv"), _r(F.col("post_vh") - F.col("pre_vh")).alias("dvh"), _r(X.cross_ratio(F.col("pre_vv"), F.col("pre_vh"))).alias("cross_pre"), _r(X.cross_ratio(F.col("post_vv"), F.col("post_vh"))).alias("cross_post"))


@query(f"WITH {PX} SELECT scene, r, c, round(10 * log10(greatest(green - 0.3::DOUBLE, 1e-7)), 6) AS db FROM px")
def linear_to_db(spark, d):
    return tables.pixels(spark, d).select(*AT, _r(X.to_db(F.col("green") - 0.3)).alias("db"))


@query(f"""WITH {MASKS} SELECT scene, r, c, round(w, 6) AS mndwi, round(bsi_pre, 6) AS bsi_pre, round(bsi_post, 6) AS bsi_post, round(bsi_post - bsi_pre, 6) AS bsi_change FROM z""")
def optical_indices(spark, d):
    pre, post = X.bare_soil(*map(F.col, ("blue_pre", "red_pre", "nir_pre", "swir_pre"))), X.bare_soil(*map(F.col, ("blue", "red", "nir", "swir")))
    return tables.pixels(spark, d).select(*AT, _r(X.normalized_difference(F.col("green"), F.col("swir"))).alias("mndwi"), _r(pre).alias("bsi_pre"), _r(post).alias("bsi_post"), _r(post - pre).alias("bsi_change"))


@query(f"""WITH {PX}, o AS (SELECT unnest(range(-3, 4)) AS k), ext AS (SELECT scene, max(r) AS lr, max(c) AS lc FROM px GROUP BY scene), w AS (SELECT p.scene, p.r, p.c, avg(q.pre_vv) AS m, avg(q.pre_vv * q.pre_vv) AS s FROM px p JOIN ext USING (scene) CROSS JOIN o a CROSS JOIN o b
JOIN px q ON q.scene = p.scene AND q.r = CASE WHEN p.r + a.k < 0 THEN -1 - p.r - a.k WHEN p.r + a.k > lr THEN 2 * lr + 1 - p.r - a.k ELSE p.r + a.k END
AND q.c = CASE WHEN p.c + b.k < 0 THEN -1 - p.c - b.k WHEN p.c + b.k > lc THEN 2 * lc + 1 - p.c - b.k ELSE p.c + b.k END GROUP BY ALL),
n AS (SELECT scene, var_pop(pre_vv) / (avg(pre_vv) * avg(pre_vv) + 1e-6) AS noise FROM px GROUP BY scene), v AS (SELECT w.*, pre_vv, noise, greatest(s - m * m, 0) AS var FROM w JOIN px USING (scene, r, c) JOIN n USING (scene))
SELECT scene, r, c, round(m + least(greatest(var / (var + noise * m * m + 1e-6), 0), 1) * (pre_vv - m), 6) AS pre_vv_lee FROM v""")
def lee_filter(spark, d):
    return raster.lee_filter(tables.pixels(spark, d), "pre_vv").select(*AT, _r("pre_vv_lee").alias("pre_vv_lee"))


@query(f"WITH {PX}, {SLOPE} SELECT scene, r, c, round(slope_deg, 6) AS slope_deg FROM sl")
def slope_deg(spark, d):
    return raster.slope(tables.pixels(spark, d)).select(*AT, _r("slope_deg").alias("slope_deg"))


@query(f"WITH {PX}, {NEAR} SELECT scene, r, c, round(distance_m, 6) AS distance_m FROM nd")
def river_distance(spark, d):
    return raster.nearest_river(tables.pixels(spark, d)).select(*AT, _r("distance_m").alias("distance_m"))


@query(f"WITH {PX}, {NEAR} SELECT scene, r, c, round(hand_m, 6) AS hand_m FROM nd")
def hand(spark, d):
    return raster.nearest_river(tables.pixels(spark, d)).select(*AT, _r("hand_m").alias("hand_m"))


@query(f"WITH {TERRAIN} SELECT scene, r, c, shadow, valid FROM t")
def valid_flood_mask(spark, d):
    return hazard.terrain(tables.pixels(spark, d)).select(*AT, "shadow", "valid")


@query(f"WITH {FLOOD} SELECT scene, r, c, flood_cons, flood_lib, permanent_water, CASE WHEN flood_lib THEN 0.8::DOUBLE ELSE 0 END AS prob, CASE WHEN flood_lib <> flood_cons THEN 0.5::DOUBLE ELSE 0 END AS uncertainty FROM fl")
def baseline_flood(spark, d):
    return hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d))).select(*AT, "flood_cons", "flood_lib", "permanent_water", "prob", "uncertainty")


@query(f"""WITH {TERRAIN}, p AS (SELECT *, least(greatest(0.5::DOUBLE - (post_vv - pre_vv) / 20, 0), 1) AS pf, pre_vv < -15 AND slope_deg < 8 AS permanent_water FROM t), de AS (SELECT *, CASE WHEN valid AND NOT permanent_water THEN pf ELSE 0 END AS prob FROM p)
SELECT scene, r, c, permanent_water, round(prob, 6) AS prob, prob >= 0.65::DOUBLE AND valid AS flood_cons, prob >= 0.4::DOUBLE AND valid AS flood_lib FROM de""")
def model_decision(spark, d):
    """The decision rule on probabilities that stand for a model's."""
    flood = F.least(F.greatest(F.lit(0.5) - (F.col("post_vv") - F.col("pre_vv")) / 20, F.lit(0.0)), F.lit(1.0))
    water = F.when(F.col("pre_vv") < -15, 0.9).otherwise(0.1)
    return hazard.model_flood(hazard.terrain(tables.pixels(spark, d)), flood, water).select(*AT, "permanent_water", _r("prob").alias("prob"), "flood_cons", "flood_lib")


@query(f"""WITH RECURSIVE {FINAL} SELECT scene, {km2('flood_cons_clean')} AS flood_km2_cons, {km2('flood_lib_clean')} AS flood_km2_lib, {km2('debris_cons_clean')} AS debris_km2_cons, {km2('debris_lib_clean')} AS debris_km2_lib,
{km2('permanent_water')} AS permanent_km2, round_even(avg(unsure::INT), 4) AS uncertain, 3 AS signals FROM f GROUP BY scene""")
def hazard_area(spark, d):
    return hazard_figures(final_masks(spark, d))


@query(f"WITH {MASKS} SELECT scene, r, c, corridor, votes, debris_cons, debris_lib FROM z")
def debris_votes(spark, d):
    px = hazard.terrain(tables.pixels(spark, d), sky=True)
    return hazard.debris(px, coherence="coherence_loss", optical=True).select(*AT, "corridor", "votes", "debris_cons", "debris_lib")


@query(f"WITH {TERRAIN} SELECT scene, r, c, distance_m <= 450 AND slope_deg <= 35 AND post_vh - pre_vh >= 2.2 AS debris_cons, distance_m <= 450 AND slope_deg <= 35 AND post_vh - pre_vh >= 2.2 AS debris_lib FROM t")
def debris_radar_only(spark, d):
    """With one signal, both levels want one vote."""
    return hazard.debris(hazard.terrain(tables.pixels(spark, d))).select(*AT, "debris_cons", "debris_lib")


@query(f"WITH {PX}, k AS (SELECT scene, r, c FROM px WHERE cloud) SELECT p.scene, p.r, p.c, EXISTS (SELECT 1 FROM k WHERE k.scene = p.scene AND abs(k.r - p.r) + abs(k.c - p.c) <= 3) AS cloudy FROM px p")
def cloud_dilate(spark, d):
    return raster.dilate(tables.pixels(spark, d), "cloud", 3, "cloudy").select(*AT, "cloudy")


@query(f"WITH {MASKS} SELECT scene, r, c, fused_cons, fused_lib, unsure AS unsure_cons, unsure_lib FROM z")
def sensor_fusion(spark, d):
    px = hazard.fuse(hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d), sky=True)), ["flood_cons", "flood_lib"])
    return px.select(*AT, F.col("flood_cons_fused").alias("fused_cons"), F.col("flood_lib_fused").alias("fused_lib"), F.col("flood_cons_unsure").alias("unsure_cons"), F.col("flood_lib_unsure").alias("unsure_lib"))


#: A mask with many components: bright pixels of the radar's noise.
NOISE = "pre_vv > -11.6"
_NOISE_LABELS = f"{PX}, {FOUR}, fil AS MATERIALIZED (SELECT scene, 'x' AS mask, r, c FROM px WHERE {NOISE}), {LABEL}"


@query(f"WITH RECURSIVE {_NOISE_LABELS} SELECT scene, r, c, label, count(*) OVER (PARTITION BY scene, label) AS pixels FROM lb")
def component_labels(spark, d):
    t = graph.label(tables.pixels(spark, d).where(NOISE))
    return t.join(t.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("pixels")), ["scene", "label"]).select(*AT, "label", "pixels")


@query(f"WITH RECURSIVE {_NOISE_LABELS}, k AS (SELECT * FROM lb QUALIFY count(*) OVER (PARTITION BY scene, label) >= 8) SELECT p.scene, p.r, p.c, k.r IS NOT NULL AS kept FROM px p LEFT JOIN k USING (scene, r, c)")
def small_components(spark, d):
    px = tables.pixels(spark, d).withColumn("on", F.expr(NOISE))
    return graph.keep_components(px, "on", "kept", min_size=8).select(*AT, "kept")


HOLES = "abs(post_vh - pre_vh) < 1.2"


@query(f"""WITH RECURSIVE {PX}, {filled(f"SELECT scene, 'x' AS mask, r, c, {HOLES} AS on FROM px")} SELECT p.scene, p.r, p.c, fil.r IS NOT NULL AS mask_filled FROM px p LEFT JOIN fil USING (scene, r, c)""")
def fill_holes(spark, d):
    px = tables.pixels(spark, d).withColumn("mask", F.expr(HOLES))
    return graph.fill_holes(px, "mask").select(*AT, "mask_filled")


@query(f"""WITH RECURSIVE {PX}, {FOUR}, m AS MATERIALIZED (SELECT scene, r, c FROM px WHERE {NOISE}), k AS (SELECT scene, r, c FROM m WHERE c BETWEEN 29 AND 34 UNION SELECT b.scene, b.r, b.c FROM k a CROSS JOIN o4 JOIN m b ON b.scene = a.scene AND b.r = a.r + dr AND b.c = a.c + dc)
SELECT p.scene, p.r, p.c, k.r IS NOT NULL AS kept FROM px p LEFT JOIN k USING (scene, r, c)""")
def river_connected(spark, d):
    px = raster.dilate(tables.pixels(spark, d), "river", 2, "near_river").withColumn("on", F.expr(NOISE))
    return graph.keep_components(px, "on", "kept", touching="near_river").select(*AT, "kept")


@query(f"WITH RECURSIVE {FINAL} SELECT scene, r, c, flood_cons_clean, flood_lib_clean, debris_cons_clean, debris_lib_clean FROM f")
def postprocess(spark, d):
    px = final_masks(spark, d)
    return px.select(*AT, F.col("flood_cons_fused_clean").alias("flood_cons_clean"), F.col("flood_lib_fused_clean").alias("flood_lib_clean"), "debris_cons_clean", "debris_lib_clean")


@query(f"WITH RECURSIVE {FINAL} SELECT scene, r, c, cons, lib FROM hz")
def hazard_union(spark, d):
    return final_masks(spark, d).select(*AT, "cons", "lib")


_STACK = "pre_vv, pre_vh, post_vv, post_vh, post_vv - pre_vv, post_vh - pre_vh, least(greatest(slope_deg / 60, 0), 1), least(greatest(hand_m / 100, 0), 1), least(greatest(distance_m / 3000, 0), 1)"


@query(f"WITH {TERRAIN}, s AS (SELECT scene, r, c, unnest([{_STACK}])::FLOAT AS x, unnest(range(9)) AS channel FROM t) SELECT scene, r, c, channel, round(x::DOUBLE, 4) AS value FROM s")
def feature_stack(spark, d):
    """The nine channels of a pixel in single precision, one row each."""
    t = hazard.terrain(tables.pixels(spark, d))
    stack = F.array(F.col("pre_vv"), F.col("pre_vh"), F.col("post_vv"), F.col("post_vh"), F.expr("post_vv - pre_vv"), F.expr("post_vh - pre_vh"), X.scaled(F.col("slope_deg"), 60), X.scaled(F.col("hand_m"), 100), X.scaled(F.col("distance_m"), 3000))
    return t.select(*AT, F.posexplode(stack.cast("array<float>")).alias("channel", "x")).select(*AT, F.col("channel").cast("long").alias("channel"), F.round(F.col("x").cast("double"), 4).alias("value"))


@query(f"""WITH {FLOOD}, v AS (SELECT 'baseline' AS variant, flood_cons AS pred, dem < 850 AND flood_lib AS ref FROM fl UNION ALL SELECT 'liberal', flood_lib, dem < 850 AND flood_lib FROM fl UNION ALL SELECT 'vv', post_vv - pre_vv < -3, dem < 850 AND flood_lib FROM fl UNION ALL SELECT 'none', FALSE, FALSE FROM fl),
n AS (SELECT variant, count_if(pred AND ref)::BIGINT AS tp, count_if(pred AND NOT ref)::BIGINT AS fp, count_if(NOT pred AND ref)::BIGINT AS fn, count_if(NOT pred AND NOT ref)::BIGINT AS tn FROM v GROUP BY variant)
SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE round_even(tp / (tp + fp + fn), 4) END AS iou, CASE WHEN tp + fp = 0 THEN 0 ELSE round_even(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round_even(tp / (tp + fn), 4) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round_even(2 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM n""")
def confusion_metrics(spark, d):
    """Agreement of four variants of the detector with one reference."""
    ref = F.expr("dem < 850 and flood_lib")
    kinds = [("baseline", F.col("flood_cons"), ref), ("liberal", F.col("flood_lib"), ref), ("vv", F.expr("post_vv - pre_vv < -3"), ref), ("none", F.lit(False), F.lit(False))]
    px = hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d)))
    v = px.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), p.alias("pred"), t.alias("ref")) for n, p, t in kinds])).alias("x")).select("x.*")
    return vectors.metrics(v, ["variant"])


#: A reference map of the flood: what the corridor of the event held.
REFERENCE = "c between 27 and 35 and r between 14 and 48"


@query(f"WITH {FLOOD} SELECT scene, r, c, CASE WHEN ({REFERENCE}) AND NOT flood_lib THEN 1 WHEN flood_lib AND NOT ({REFERENCE}) THEN 2 ELSE 0 END AS status FROM fl")
def disagreement(spark, d):
    px = hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d)))
    return px.select(*AT, vectors.disagreement(F.col("flood_lib"), F.expr(REFERENCE)).alias("status"))


@query(f"""WITH {FLOOD}, n AS (SELECT scene, count_if(({REFERENCE}) AND NOT flood_lib)::BIGINT AS omitted, count_if(flood_lib AND NOT ({REFERENCE}))::BIGINT AS committed, count_if(flood_lib AND ({REFERENCE})) AS tp FROM fl GROUP BY scene)
SELECT scene, omitted, committed, coalesce(round_even(tp / (tp + omitted + committed), 4), 1) AS iou, tp / (tp + omitted + committed) >= 0.6 AS iou_met FROM n""")
def evaluation_report(spark, d):
    """Per scene: omission and commission pixels, IoU, and whether the target of 0.60 is met."""
    px = hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d)))
    m = vectors.metrics(px.select("scene", F.col("flood_lib").alias("pred"), F.expr(REFERENCE).alias("ref")), ["scene"])
    return m.select("scene", F.col("fn").alias("omitted"), F.col("fp").alias("committed"), "iou", (F.col("iou") >= 0.6).alias("iou_met"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings), q AS (SELECT vec_id % 64 AS r, c, least(greatest(0.5::DOUBLE + x, 1e-6), 1 - 1e-6) AS p FROM e)
SELECT r, c, round(avg(p), 6) AS mean, round(var_pop(p), 6) AS variance, round(-avg(p) * log2(avg(p)) - (1 - avg(p)) * log2(1 - avg(p)), 6) AS entropy FROM q GROUP BY r, c""")
def ensemble_uncertainty(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 64).alias("r"), F.posexplode("embedding").alias("c", "x"))
    p = F.least(F.greatest(F.col("x").cast("double") + 0.5, F.lit(1e-6)), F.lit(1 - 1e-6))
    g = e.groupBy("r", F.col("c").cast("long").alias("c")).agg(F.avg(p).alias("m"), F.var_pop(p).alias("v"))
    return g.select("r", "c", _r("m").alias("mean"), _r("v").alias("variance"), _r(X.entropy(F.col("m"))).alias("entropy"))


@query(f"""WITH {PX}, ext AS (SELECT scene, max(r) AS lr, max(c) AS lc FROM px GROUP BY scene), a AS (SELECT scene, r, c, pre_vv AS p FROM px UNION ALL SELECT scene, r, lc - c, post_vv FROM px JOIN ext USING (scene) UNION ALL SELECT scene, lr - r, c, pre_vh FROM px JOIN ext USING (scene))
SELECT scene, r, c, round(avg(p), 6) AS mean FROM a GROUP BY ALL""")
def flip_average(spark, d):
    """Mean of three rasters, the second and third seen in a mirror and turned back."""
    px = tables.pixels(spark, d)
    parts = px.select(*AT, F.col("pre_vv").alias("p")).union(raster.flipped(px.select(*AT, "post_vv"), "c").select(*AT, "post_vv")).union(raster.flipped(px.select(*AT, "pre_vh"), "r").select(*AT, "pre_vh"))
    return parts.groupBy(*AT).agg(_r(F.avg("p")).alias("mean"))


@query(f"WITH {PX}, ext AS (SELECT scene, max(r) AS lr, max(c) AS lc FROM px GROUP BY scene) SELECT scene, 1 AS k, lc - c AS r, r AS c, round(dem, 6) AS dem FROM px JOIN ext USING (scene) UNION ALL SELECT scene, 2, lr - r, lc - c, round(dem, 6) FROM px JOIN ext USING (scene) UNION ALL SELECT scene, 3, c, lr - r, round(dem, 6) FROM px JOIN ext USING (scene)")
def turned_tiles(spark, d):
    """Each scene turned by one, two and three quarters."""
    px = tables.pixels(spark, d).select(*AT, "dem")
    out = None
    for k in (1, 2, 3):
        part = raster.turned(px, k).select("scene", F.lit(k).alias("k"), "r", "c", _r("dem").alias("dem"))
        out = part if out is None else out.union(part)
    return out


#: Three logits and the class of a pixel: other, permanent water, flood.
_LOGITS = "-(pre_vv + 12) / 4 AS l1, -(post_vv - pre_vv) / 3 AS l2"


@query(f"""WITH {FLOOD}, x AS (SELECT scene, {_LOGITS}, CASE WHEN flood_lib THEN 2 WHEN permanent_water THEN 1 ELSE 0 END AS y FROM fl), s AS (SELECT *, 1 + exp(l1) + exp(l2) AS z FROM x), p AS (SELECT scene, y, 1 / z AS p0, exp(l1) / z AS p1, exp(l2) / z AS p2 FROM s),
k AS (SELECT scene, y, [p0, p1, p2][y + 1] AS pt, p0, p1, p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS top FROM p),
lo AS (SELECT scene, avg(-(1 - pt) * (1 - pt) * ln(greatest(pt, 1e-7))) AS focal, 1 - ((2 * sum(CASE WHEN y = 0 THEN p0 ELSE 0 END) + 1e-5) / (sum(p0) + count_if(y = 0) + 1e-5) + (2 * sum(CASE WHEN y = 1 THEN p1 ELSE 0 END) + 1e-5) / (sum(p1) + count_if(y = 1) + 1e-5)
+ (2 * sum(CASE WHEN y = 2 THEN p2 ELSE 0 END) + 1e-5) / (sum(p2) + count_if(y = 2) + 1e-5)) / 3 AS dice, count_if(top = 2 AND y = 2) AS i2, count_if(top = 2 OR y = 2) AS u2 FROM k GROUP BY scene)
SELECT scene, round(focal, 6) AS focal, round(dice, 6) AS dice, round(focal + dice, 6) AS loss, CASE WHEN u2 = 0 THEN 1 ELSE round_even(i2 / u2, 4) END AS flood_iou FROM lo""")
def focal_dice_loss(spark, d):
    """Focal loss plus the class mean of the Dice loss, and the IoU of the flood class."""
    px = hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d)))
    x = px.selectExpr("scene", *_LOGITS.split(", "), "case when flood_lib then 2 when permanent_water then 1 else 0 end as y")
    e = F.array(F.lit(1.0), F.exp("l1"), F.exp("l2"))
    p = x.withColumn("e", e).withColumn("z", F.expr("e[0] + e[1] + e[2]")).select("scene", "y", F.transform("e", lambda v: v / F.col("z")).alias("p"))
    p = p.withColumn("pt", F.expr("p[y]")).withColumn("top", F.array_position("p", F.array_max("p")) - 1)
    focal = F.avg(-((1 - F.col("pt")) ** 2) * F.log(F.greatest("pt", F.lit(1e-7))))
    dice = 0.0
    for k in range(3):
        hit = F.sum(F.when(F.col("y") == k, F.col("p")[k]).otherwise(0.0))
        dice = dice + (2 * hit + 1e-5) / (F.sum(F.col("p")[k]) + F.count_if(F.col("y") == k) + 1e-5)
    g = p.groupBy("scene").agg(focal.alias("f"), (1 - dice / 3).alias("g"), F.count_if(F.expr("top = 2 and y = 2")).alias("i"), F.count_if(F.expr("top = 2 or y = 2")).alias("u"))
    return g.select("scene", _r("f").alias("focal"), _r("g").alias("dice"), _r(F.col("f") + F.col("g")).alias("loss"), F.bround(X.ratio(F.col("i"), F.col("u"), 1.0), 4).alias("flood_iou"))


@query(f"WITH {PX} SELECT scene, r, c, 800.0::DOUBLE + (64 - r) * 15 + abs(c - 32) * 25 AS plain, round(dem - (800.0::DOUBLE + (64 - r) * 15 + abs(c - 32) * 25), 6) AS difference FROM px")
def synthetic_terrain(spark, d):
    """The valley of the trial run, a plane to the south with walls beside a river, under every pixel, and
    how far the terrain lies above it."""
    plain = F.expr("800D + (64 - r) * 15 + abs(c - 32) * 25")
    return tables.pixels(spark, d).select(*AT, plain.alias("plain"), _r(F.col("dem") - plain).alias("difference"))


@query("""WITH t AS (SELECT vec_id // 64 AS tile, vec_id % 64 AS r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT 'tile_' || tile AS tile_id, 'basin_' || tile % 3 AS region, count_if(r BETWEEN 10 AND 39 AND c BETWEEN 34 AND 43)::BIGINT AS flooded, count_if(c BETWEEN 31 AND 33)::BIGINT AS river, round(avg(x) FILTER (r BETWEEN 10 AND 39 AND c BETWEEN 34 AND 43), 6) AS mean FROM t GROUP BY tile""")
def synthetic_tiles(spark, d):
    """The trial's flooded box and river laid over every tile of vectors, in three regions that are the units
    of a geographic hold-out: their pixels and the mean value in the box."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.expr("vec_id div 64").alias("tile"), (F.col("vec_id") % 64).alias("r"), F.posexplode("embedding").alias("c", "x"))
    box = F.expr("r between 10 and 39 and c between 34 and 43")
    g = e.groupBy("tile").agg(F.count_if(box).alias("flooded"), F.count_if(F.col("c").between(31, 33)).alias("river"), _r(F.avg(F.when(box, F.col("x").cast("double")))).alias("mean"))
    return g.select(F.concat(F.lit("tile_"), F.col("tile")).alias("tile_id"), F.concat(F.lit("basin_"), F.col("tile") % 3).alias("region"), "flooded", "river", "mean")


_GROUND = "CASE WHEN slope_deg IS NULL THEN 'not covered' WHEN shadow THEN 'shadow' WHEN slope_deg <= 5 AND distance_m <= 300 THEN 'valley floor' WHEN slope_deg > 18 THEN 'steep gorge' ELSE 'slope' END"


@query(f"""WITH {FLOOD}, ref AS (SELECT vec_id // 448 AS scene, vec_id % 64 + 6 AS r, c + 9 AS c, c BETWEEN 20 AND 30 AND vec_id % 64 BETWEEN 8 AND 44 AND x > -0.05 AS ref FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id // 64 % 7 = 2)),
j AS (SELECT coalesce(fl.scene, ref.scene) AS scene, {_GROUND} AS ground, flood_lib AS pred, ref FROM fl FULL JOIN ref ON ref.scene = fl.scene AND ref.r = fl.r AND ref.c = fl.c),
n AS (SELECT scene, ground, coalesce(count_if(pred AND ref), 0)::BIGINT AS tp, coalesce(count_if(pred AND NOT ref), 0)::BIGINT AS fp, coalesce(count_if(NOT pred AND ref), 0)::BIGINT AS fn, coalesce(count_if(NOT pred AND NOT ref), 0)::BIGINT AS tn, count_if(pred IS NULL)::BIGINT AS no_prediction, count_if(ref IS NULL)::BIGINT AS no_reference FROM j GROUP BY ALL)
SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE round_even(tp / (tp + fp + fn), 4) END AS iou, CASE WHEN tp + fp = 0 THEN 0 ELSE round_even(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round_even(tp / (tp + fn), 4) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round_even(2 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM n""")
def reference_comparison(spark, d):
    """The detector against a reference raster of its own extent, by kind of ground: pixels that only one
    of them covers are counted apart."""
    px = hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d)))
    return vectors.compare(px.withColumn("pred", F.col("flood_lib")), tables.reference(spark, d))
