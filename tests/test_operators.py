import re

import __spark_entry__
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.functions import expressions as X
from rillmark.operators import checkpoints, graph, hazard, ingest, raster, report, segments, vectors
from rillmark.sources import tables


GEO = "scene long, lon_min double, lat_max double, px_w double, px_h double, rows long, cols long"


def grid(spark, n, fill):
    return spark.createDataFrame([(0, r, c, *fill(r, c)) for r in range(n) for c in range(n)], "scene long, r long, c long, dem double, river boolean, mask boolean")


def test_valley_distance_and_height(spark):
    px = grid(spark, 20, lambda r, c: (1000.0 + 30 * abs(c - 10), c == 10, False))
    out = {(x.r, x.c): x for x in raster.nearest_river(px).collect()}
    assert all(abs(x.distance_m - 30 * abs(c - 10)) < 1e-9 and x.hand_m == 30 * abs(c - 10) for (_, c), x in out.items())
    none = raster.nearest_river(px.withColumn("river", F.lit(False))).collect()
    assert {x.distance_m for x in none} == {0.0} and min(x.hand_m for x in none) == 0.0


def test_nearest_in_a_row_equals_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(200):
        h, w, row = r.integers(1, 9), r.integers(1, 9), 0
        river = r.random((h, w)) < 0.2
        row = int(r.integers(0, h))
        up = np.array([max((k for k in range(row + 1) if river[k, c]), default=-1) for c in range(w)])
        down = np.array([min((k for k in range(row, h) if river[k, c]), default=-1) for c in range(w)])
        d2, nr, nc = raster.nearest_in_row(up, down, row)
        for c in range(w):
            best = min((((k - row) ** 2 + (j - c) ** 2, k, j) for k, j in zip(*np.nonzero(river), strict=True)), default=(-1, 0, 0))
            assert d2[c] == best[0] and (best[0] < 0 or (nr[c], nc[c]) == best[1:])


def test_valid_pixels_of_a_valley_of_100_columns(spark):
    px = spark.range(100 * 100).select(F.lit(0).cast("long").alias("scene"), F.expr("id div 100").alias("r"), (F.col("id") % 100).alias("c")).withColumn("dem", 1000 + 30.0 * F.abs(F.col("c") - 50)).withColumn("river", F.col("c") == 50)
    out = hazard.terrain(px).where("valid").groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("a"), F.max("c").alias("b")).first()
    assert tuple(out) == (100, 50, 50)  # beside the river the slope is too steep


def test_dilation_of_grids_of_other_sizes(spark):
    px = spark.createDataFrame([(s, r, c, (r, c) == (1, 2)) for s, n in ((0, 5), (1, 3)) for r in range(n) for c in range(n)], "scene long, r long, c long, m boolean")
    got = {(x.scene, x.r, x.c) for x in raster.dilate(px, "m", 2, "grown").where("grown").collect()}
    assert got == {(s, r, c) for s, n in ((0, 5), (1, 3)) for r in range(n) for c in range(n) if abs(r - 1) + abs(c - 2) <= 2}


def test_lee_filter_of_an_odd_size_lowers_the_variance(spark):
    r = np.random.default_rng(7)
    px = spark.createDataFrame([(0, a, b, float(x)) for (a, b), x in np.ndenumerate(10 * r.exponential(size=(20, 13)))], "scene long, r long, c long, v double")
    out = raster.lee_filter(px, "v", 5).agg(F.count(F.lit(1)), F.var_pop("v"), F.var_pop("v_lee"), F.avg("v"), F.avg("v_lee")).first()
    assert out[0] == 260 and out[2] < out[1] and abs(out[4] / out[3] - 1) < 0.2


def test_plane_flows_straight_down(spark, monkeypatch):
    px = grid(spark, 20, lambda r, c: (1000.0 - 10 * r, False, False))
    for tile in (256, 3):
        monkeypatch.setattr(vectors, "TILE", tile)
        path = vectors.trace(raster.steepest(px), px.where("r = 0 and c = 10")).collect()
        assert sorted((x.k, x.r, x.c) for x in path) == [(k, k, 10) for k in range(20)]


def test_flow_path_settlements(spark):
    px = grid(spark, 20, lambda r, c: (1000.0 - 10 * r, False, 10 <= r <= 14 and c == 10))
    path = vectors.trace(raster.steepest(px), px.where("r = 0 and c = 10"))
    assert tuple(vectors.flow_summary(path, px, "mask").first()) == (0, 0.57, 0.25)
    places = spark.createDataFrame([(0, 2, 1, 15, 10), (0, 1, 0, 5, 10), (0, 3, 2, 5, 19), (1, 4, 3, 5, 10)], "scene long, osm_id long, input_ord long, r long, c long")
    out = sorted(map(tuple, vectors.flow_settlements(path, places, px, "mask").select("place", "osm_id", "km", "in_flood", "elevation").collect()))
    assert out == [(1, 1, 0.15, False, 950.0), (2, 2, 0.45, False, 850.0)]


def ring(r, c):
    return (0.0, False, (2 <= r <= 6 and 2 <= c <= 6 and not (3 <= r <= 5 and 3 <= c <= 5)) or (r, c) == (9, 9))


def test_components_holes_and_size(spark):
    px = grid(spark, 10, ring)
    for tile in (128, 3):
        labels = {(x.r, x.c): x.label for x in graph.label(px.where("mask"), tile=tile).collect()}
        assert set(labels.values()) == {2 << 31 | 2, 9 << 31 | 9} and len(labels) == 17
    filled = graph.fill_holes(px, "mask")
    assert filled.where("mask_filled").count() == 26
    assert graph.keep_components(filled, "mask_filled", "kept", min_size=8).where("kept").count() == 25
    assert graph.keep_components(px, "mask", "kept", touching="river").where("kept").count() == 17  # no river: all stay


def test_labels_across_tiles_equal_those_of_one_tile(spark):
    r = np.random.default_rng(5)
    on = r.random((40, 40)) < 0.6
    px = spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(*np.nonzero(on), strict=True)], "scene long, r long, c long")
    pick = lambda df: sorted((x.r, x.c, x.label) for x in df.collect())
    assert pick(graph.label(px, tile=128)) == pick(graph.label(px, tile=7))


def test_masks_are_cleaned(spark):
    on = lambda r, c: (r, c) in ((5, 5), (5, 6)) or (20 <= r <= 29 and 20 <= c <= 29) or (35 <= r <= 44 and 35 <= c <= 44)
    px = grid(spark, 50, lambda r, c: (0.0, c == 25, on(r, c))).withColumn("rubble", F.col("mask")).withColumn("hand_m", F.lit(30.0))
    px = raster.dilate(px, "river", 2, "near_river")
    out = graph.clean_masks(px, {"mask": 40.0, "rubble": 29.0}, connected=["mask"], min_size=5).where("mask_clean").agg(F.count(F.lit(1)), F.max("r")).first()
    assert tuple(out) == (100, 29)
    assert graph.clean_masks(px, {"rubble": 40.0}, min_size=5).where("rubble_clean").count() == 200
    assert graph.clean_masks(px, {"rubble": 29.0}, min_size=5).where("rubble_clean").count() == 0


def test_debris_votes(spark):
    px = grid(spark, 30, lambda r, c: (0.0, False, False)).withColumns({"distance_m": F.lit(100.0), "slope_deg": F.lit(5.0), "pre_vh": F.lit(-18.0), "post_vh": F.when(F.expr("r = 15 and c = 15"), -15.0).otherwise(-18.0), "clear": F.lit(True)})
    px = px.withColumns({k: F.lit(v) for k, v in {"blue_pre": 0.3, "red_pre": 0.2, "nir_pre": 0.3, "swir_pre": 0.2, "blue": 0.1, "red": 0.4, "nir": 0.1, "swir": 0.5}.items()})
    out = hazard.debris(px, optical=True).agg(F.max("signals"), F.count_if("debris_cons"), F.count_if("debris_lib")).first()
    assert tuple(out) == (2, 1, 900)
    assert tuple(hazard.debris(px).agg(F.count_if("debris_cons"), F.count_if("debris_lib")).first()) == (1, 1)
    soil = spark.range(1).select(X.bare_soil(*map(F.lit, (0.1, 0.35, 0.15, 0.45)))).first()[0]
    assert abs(soil - 0.5238) < 1e-4


def test_fusion(spark):
    px = grid(spark, 25, lambda r, c: (0.0, False, (r, c) in ((10, 10), (5, 5)))).withColumns({
        "prob": F.expr("case when r = 10 and c = 10 then 0.75D when r = 5 and c = 5 then 0.65D else 0.1D end"), "clear": F.lit(True),
        "green": F.expr("case when r = 10 and c = 10 then 0.7D when r = 5 and c = 5 then 0.1D else 0.2D end"), "swir": F.expr("case when r = 10 and c = 10 then 0.1D when r = 5 and c = 5 then 0.9D else 0.4D end")})
    out = hazard.fuse(px, ["mask"])
    assert [(x.r, x.c) for x in out.where("mask_fused").collect()] == [(10, 10)]
    assert [(x.r, x.c) for x in out.where("mask_unsure").collect()] == [(5, 5)]
    edge = px.withColumns({"mask": F.lit(False), "green": F.lit(0.56), "swir": F.lit(0.44 - 1e-6), "prob": F.lit(0.3)})
    assert hazard.fuse(edge, ["mask"]).where("mask_fused").count() == 625  # at the limit counts as wet


def test_points_meet_the_scenes_that_cover_them(spark):
    r = np.random.default_rng(6)
    scenes = [(k, float(x), float(y), float(w), float(w), int(h), int(n)) for k, (x, y, w, h, n) in enumerate(zip(r.uniform(80, 82, 40), r.uniform(20, 22, 40), r.choice([0.01, 0.003, 0.2], 40), r.integers(1, 30, 40), r.integers(1, 30, 40), strict=True))]
    scenes.append((40, 80.0, 21.0, 0.5, 0.5, 2, 2))
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(r.uniform(79.5, 83, 300), r.uniform(19, 22.5, 300), strict=True))] + [(300, 79.75, 21.25), (301, 80.75, 20.25), (302, 80.7500001, 20.5)]
    want = sorted((k, s, round((top - y) / w), round((x - west) / w)) for k, x, y in points for s, west, top, w, _, h, n in scenes if 0 <= round((top - y) / w) < h and 0 <= round((x - west) / w) < n)
    got = vectors.covered(spark.createDataFrame(points, "osm_id long, lon double, lat double"), spark.createDataFrame(scenes, GEO))
    assert sorted((x.osm_id, x.scene, x.r, x.c) for x in got.collect()) == want and {w[0] for w in want} >= {300, 301}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_roads_and_labels_of_any_size_stay_apart(spark, tmp_path):
    big = [(2**31 + o, line, 2_000_000 + p, 100_000 - s, 10.5, "O") for o in range(3) for line in (1, 2) for p in range(2) for s in range(3)]
    spark.createDataFrame(big, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    roads = tables.roads(spark, str(tmp_path)).collect()
    assert len({x.osm_id for x in roads}) == len({tuple(x.input_ord) for x in roads}) == len(big)
    assert [x.osm_id for x in sorted(roads, key=lambda x: tuple(x.input_ord))][0] == "2147483648-1-2000000-99998"
    far = 2**21 + 5
    px = spark.createDataFrame([(0, 0, far), (0, 1, far), (0, 1, 5), (0, 3, 1), (0, 2**21, far)], "scene long, r long, c long")
    labels = {(x.r, x.c): x.label for x in graph.label(px).collect()}
    assert labels == {(0, far): far, (1, far): far, (1, 5): 2**31 + 5, (3, 1): 3 * 2**31 + 1, (2**21, far): 2**52 + far}


def test_no_round_shuffles_the_edges(spark):
    edges = spark.createDataFrame([("x", i, i + 1, 1) for i in range(300)], "layer string, a long, b long, length long").withColumn("_h", F.xxhash64("layer", "a"))
    both = checkpoints.bucketed(edges, "_h")
    front = spark.createDataFrame([("x", 5, 0), ("x", 7, 2)], "layer string, node long, dist long")
    for few in (True, False):
        out = graph.reached(front, both, ["layer"], few)
        assert sorted(map(tuple, out.collect())) == [("x", 6, 1), ("x", 8, 3)]
        tree = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # what stands between the join and the scan of the edges, which are its left side
        left = re.search(r"Join.*?FileScan parquet[^\n]*", tree, re.DOTALL)[0]
        assert "Exchange" not in left and "Bucketed: true" in left
        assert few == ("BroadcastHashJoin" in tree)
    checkpoints.forget(both)
    assert not spark.catalog.tableExists(both._table)


def test_steepest_neighbour_equals_brute_force_and_copies_no_pixel(spark):
    r = np.random.default_rng(8)
    dem = r.integers(0, 6, (9, 7)).astype(float)
    rows = [(s, a if a < 5 else a + 2, b, float(dem[a, b]) + s) for s in (0, 1) for a in range(9) for b in range(7)]  # rows 5 and 6 are missing
    px = spark.createDataFrame(rows, "scene long, r long, c long, dem double")
    at = {(s, a, b): z for s, a, b, z in rows}
    want = []
    for (s, a, b), z in at.items():
        best = None
        for da, db in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)):
            to = at.get((s, a + da, b + db))
            fall = (z - to) / (30 if not da or not db else 1.4142 * 30) if to is not None else 0
            if fall > 0 and (best is None or fall > best[0]):
                best = (fall, a + da, b + db)
        if best:
            want.append((s, a, b, *best[1:]))
    out = raster.steepest(px)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_damage_classes(spark):
    df = spark.createDataFrame([(0.85, False), (0.2, False), (0.01, False), (0.01, True), (0.0, True)], "o double, b boolean")
    assert [r[0] for r in df.select(X.damage_class(F.col("o"), F.col("b"))).collect()] == ["likely_hit", "possibly_hit", "not_hit", "possibly_hit", "not_hit"]


def test_damage_of_buildings_roads_and_bridges(spark):
    geo = spark.createDataFrame([(0, 85.0, 28.0, 0.01, 0.01, 10, 10)], GEO)
    px = grid(spark, 10, lambda r, c: (0.0, False, r == 5)).withColumnRenamed("mask", "cons").withColumn("lib", F.col("r").isin(4, 5))
    houses = spark.createDataFrame([(101, 85.05, 27.95), (102, 85.05, 27.99), (103, 85.05, 27.97), (104, 80.0, 20.0)], "osm_id long, lon double, lat double")
    b = vectors.classify(vectors.window_overlap(houses, px, geo, ["cons", "lib"]), ["cons", "lib"], F.lit(False))
    assert sorted((x.osm_id, x.cons_class, x.lib_class, round(x.lib_overlap, 4)) for x in b.collect()) == [(101, "likely_hit", "likely_hit", 1.0), (102, "not_hit", "not_hit", 0.0), (103, "not_hit", "possibly_hit", 0.3333)]
    schema = "osm_id long, length_m double, is_bridge boolean, points array<struct<lon: double, lat: double>>"
    ways = spark.createDataFrame([(1, 500.0, True, [(85.05, 27.95), (85.06, 27.95)]), (2, 900.0, False, [(85.05, 27.91), (99.0, 27.95)]), (3, 100.0, False, [(99.0, 0.0)]), (4, 1.0, True, [])], schema)
    w = vectors.classify(vectors.road_overlap(ways, px, geo, ["cons", "lib"]), ["cons", "lib"], F.col("is_bridge"))
    assert sorted((x.osm_id, x.lib_class) for x in w.collect()) == [(1, "likely_hit"), (2, "not_hit")]  # no scene covers the others
    n = vectors.damage_counts(b, w).first()
    assert (n.likely_cons, n.likely_lib, n.possibly_lib, n.road_km_cons, n.road_km_lib, n.bridges_likely, n.bridges_possibly) == (1, 1, 1, 0.5, 0.5, 1, 0)


def test_road_graph_keeps_the_last_of_parallel_roads(spark):
    schema = "input_ord long, osm_id long, length_m double, points array<struct<lon: double, lat: double>>"
    roads = spark.createDataFrame([(0, 7, 5.0, [(1.0, 1.0), (2.0, 2.0)]), (1, 8, 9.0, [(2.0, 2.0), (5.0, 5.0), (1.0, 1.0)]), (2, 9, 1.0, [(3.0, 3.0)])], schema)
    assert [(x.osm_id, x.length) for x in segments.road_graph(roads).collect()] == [(8, 9)]
    assert sorted((x.node.lon, *x.node_ord) for x in segments.road_nodes(roads).collect()) == [(1.0, 0, 0), (2.0, 0, 1)]


def network(spark):
    edges = spark.createDataFrame([(1, 2, 500, 2000, False), (2, 3, 501, 1500, True), (3, 4, 502, 100, False)], "a long, b long, osm_id long, length long, severed boolean")
    source = spark.createDataFrame([(1,)], "node long")
    pre, post = graph.distances(edges, source), graph.distances(edges.where("not severed"), source)
    towns = spark.createDataFrame([(0, 3, 45), (1, 9, 8), (2, 4, 5), (3, 2, 7), (4, 1, 3), (5, None, 1)], "input_ord long, node long, building_count long")
    return edges, pre, post, vectors.cutoff_km(vectors.cutoff(towns, pre, post, post))


def test_cut_off_states_kilometres_and_ranks(spark):
    _, pre, _, states = network(spark)
    assert sorted(map(tuple, pre.collect())) == [(1, 0), (2, 2000), (3, 3500), (4, 3600)]
    out = {r.input_ord: r for r in vectors.priority(states).collect()}
    assert (out[0].state_cons, out[0].priority_rank, out[0].pre_km, out[0].post_km, out[0].detour_km) == ("cut_off", 1, 3.5, None, None)
    assert (out[1].state_lib, out[1].priority_rank, out[2].priority_rank, out[5].state_cons) == ("unknown", None, 2, "unknown")
    assert (out[4].state_lib, out[4].pre_km, out[4].post_km, out[4].detour_km) == ("still_connected", None, None, 0.0)
    assert tuple(vectors.cutoff_counts(states).first()) == (2, 2, 0, 2, 2)


def test_failed_and_critical_segment_and_paths(spark):
    edges, pre, _, states = network(spark)
    blamed = segments.blame(states, segments.first_severed(edges, pre))
    assert {r.input_ord: r.failed_segment for r in blamed.collect()} == {0: 501, 1: None, 2: 501, 3: None, 4: None, 5: None}
    assert tuple(segments.critical(blamed).first()) == (501, 50)
    way = segments.path_nodes(edges, pre, states.where("node in (4, 9)").select("node"))
    assert sorted(map(tuple, way.collect())) == [(4, 0, 4), (4, 1, 3), (4, 2, 2), (4, 3, 1)]


def test_distances_by_layer_and_many_rounds(spark):
    edges = spark.createDataFrame([(k, i, i + 1, 1) for k in ("x", "y") for i in range(20)], "layer string, a long, b long, length long")
    source = spark.createDataFrame([("x", 0), ("y", 20)], "layer string, node long")
    out = {(r.layer, r.node): r.dist for r in graph.distances(edges, source, ["layer"]).collect()}
    assert out == {("x", i): i for i in range(21)} | {("y", i): 20 - i for i in range(21)}


def test_scene_pairs(spark):
    rows = [(0, 121, "desc", "2026-08-14"), (1, 45, "desc", "2026-08-14"), (2, 121, "desc", "2026-08-26")]
    s = spark.createDataFrame(rows, "input_ord long, orbit long, direction string, taken string")
    assert tuple(vectors.scene_pair(s, "2026-08-26").first()) == (121, 0, 2, 12, None)
    late = spark.createDataFrame([(0, 121, "asc", "2026-07-27"), rows[2]], s.schema)
    assert vectors.scene_pair(late, "2026-08-26").first().fallback == "no_s1_pair"
    assert vectors.scene_pair(s, "2026-09-26").count() == 0


def test_metrics(spark):
    px = spark.createDataFrame([(16 <= r <= 48 and 29 <= c <= 34, 15 <= r <= 49 and 28 <= c <= 35, 0) for r in range(64) for c in range(64)], "pred boolean, ref boolean, k int")
    m = vectors.metrics(px, ["k"]).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.iou, m.precision, m.recall, m.f1) == (198, 0, 82, 3816, 0.7071, 1.0, 0.7071, 0.8285)
    status = px.select(vectors.disagreement(F.col("pred"), F.col("ref")).alias("s")).groupBy("s").count()
    assert dict(map(tuple, status.collect())) == {0: 4014, 1: 82}


def test_comparison_with_a_reference_of_another_extent(spark):
    px = spark.createDataFrame([(0, r, c, c < 2, 2.0 if r < 2 else 30.0, 100.0, (r, c) == (3, 3)) for r in range(4) for c in range(4)], "scene long, r long, c long, pred boolean, slope_deg double, distance_m double, shadow boolean")
    ref = spark.createDataFrame([(0, r, c, c == 1) for r in range(1, 6) for c in range(1, 4)], "scene long, r long, c long, ref boolean")
    out = {r.ground: r for r in vectors.compare(px, ref).collect()}
    pick = lambda k: tuple(out[k][n] for n in ("tp", "fp", "fn", "tn", "no_prediction", "no_reference", "iou"))
    assert pick("valley floor") == (1, 0, 0, 2, 0, 5, 1.0) and pick("steep gorge") == (2, 0, 0, 3, 0, 2, 1.0)
    assert pick("shadow") == (0, 0, 0, 1, 0, 0, 1.0) and pick("not covered") == (0, 0, 0, 0, 6, 0, 1.0)
    df = spark.createDataFrame([(0.6, 1799.9), (0.59, 1.0), (0.9, 1800.0), (None, 1.0), (0.9, None)], "iou double, total_runtime_s double")
    assert [(r.iou_met, r.runtime_met, r.passed) for r in vectors.gates(df).collect()] == [(True, True, True), (False, True, False), (True, False, False), (False, True, False), (True, False, False)]


def test_loose_pair_sentence(spark):
    pair = spark.createDataFrame([(7, 1, 2, 40, "no_s1_pair"), (7, 1, 2, 6, None)], "orbit long, pre_ord long, post_ord long, gap int, fallback string")
    assert [r.reason for r in report.pair_reason(pair).collect()] == ["Fallback to scenes 1 and 2 of orbit 7, 40 days apart.", "Selected scenes 1 and 2 of orbit 7, 6 days apart."]


def test_numbers_of_a_report(spark):
    text = "<style>p{9px}</style><b>12.345</b> S1A_IW_77 run_5 2026-08-26 10:30 &nbsp; 7km a8 #3 1.5 42"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(report.numbers(F.col("t")), report.invented(F.col("t"), F.array(F.lit(12.35)))).collect()
    assert sorted(got[0][0]) == [1.5, 12.35, 42.0] or sorted(got[0][0]) == [1.5, 12.34, 42.0]
    assert got[1][0] == [] and 42.0 in got[0][1]


def test_guards(spark):
    assert ingest.check_bbox(85.2, 27.9, 85.4, 28.1) and ingest.parse_numbers("1,2", 2) == (1.0, 2.0)
    for bad in (lambda: ingest.check_bbox(85.4, 27.9, 85.2, 28.1), lambda: ingest.check_snapshot("2026-08-26", "2026-08-26"), lambda: ingest.parse_numbers("1,2", 4)):
        with pytest.raises(ValueError):
            bad()
    ingest.check_snapshot("2026-07-27", "2026-08-26")


def test_every_query_is_registered_with_a_function():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
