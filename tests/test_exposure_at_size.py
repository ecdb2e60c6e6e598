"""Roads, nodes and distances of larger tables."""

import numpy as np
from pyspark.sql import functions as F

from rillmark.operators import graph, segments, vectors
from rillmark.sources import tables

GEO = "scene long, lon_min double, lat_max double, px_w double, px_h double, rows long, cols long"


def test_parts_at_one_place_are_two_nodes(spark, tmp_path):
    rows = [(k, 1, p, 7, 10.5, "O") for k, p in enumerate((5, 5 + 709 * 719, 5))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    r = tables.roads(spark, str(tmp_path))
    assert len({x.points[-1] for x in r.collect()}) == 1
    assert sorted(x.osm_id for x in segments.road_graph(r).collect()) == [f"1-1-{5 + 709 * 719}-7", "2-1-5-7"]
    assert sorted(x.node for x in segments.road_nodes(r).collect()) == ["p5", f"p{5 + 709 * 719}", "s7"]
    assert sorted((x.osm_id, tuple(x.first_ord)) for x in tables.courses(spark, str(tmp_path)).collect()) == [(f"1-1-{5 + 709 * 719}-7", (1, 1, 5 + 709 * 719, 7)), ("2-1-5-7", (0, 1, 5, 7))]


def test_overlap_in_place_equals_that_by_shuffle(spark):
    g = np.random.default_rng(3)
    geo = spark.createDataFrame([(0, 85.0, 28.0, 0.01, 0.01, 40, 30), (1, 85.2, 27.9, 0.02, 0.01, 30, 30), (2, 95.0, 28.0, 0.01, 0.01, 9, 9)], GEO)
    px = spark.createDataFrame([(s, r, c, bool(g.random() < 0.2), bool(g.random() < 0.4)) for s in (0, 1) for r in range(30) for c in range(30)], "scene long, r long, c long, cons boolean, lib boolean")
    point = lambda: (round(float(g.uniform(84.9, 85.9)), 3), round(float(g.uniform(27.5, 28.1)), 3))
    roads = spark.createDataFrame([(k, [point(), point(), point()]) for k in range(300)], "osm_id long, points array<struct<lon: double, lat: double>>")
    want = vectors.road_overlap(roads, px, geo, ["cons", "lib"])
    got = vectors.road_overlap_in_place(roads, px, geo, ["cons", "lib"], 3)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want) and got.count() > 300
    assert "hashpartitioning(osm_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_distances_over_open_edges_equal_those_of_each_graph(spark):
    g = np.random.default_rng(5)
    rows = [("x", int(a), int(b), int(w), bool(g.random() < 0.3)) for a, b, w in zip(g.integers(0, 40, 120), g.integers(0, 40, 120), g.integers(1, 99, 120), strict=True) if a != b]
    edges = spark.createDataFrame(rows, "scene string, a long, b long, length long, cut boolean")
    source = spark.createDataFrame([("x", rows[0][1])], "scene string, node long")
    both = {x.node: (x.dist, x.dist_cut) for x in graph.distances(edges, source, ["scene"], ["cut"]).collect()}
    for i, one in enumerate((edges, edges.where("not cut"))):
        assert {x.node: x.dist for x in graph.distances(one, source, ["scene"]).collect()} == {k: v[i] for k, v in both.items() if v[i] is not None}


def test_nearest_node_in_rings_equals_brute_force(spark):
    g = np.random.default_rng(7)
    lattice = lambda n: [(round(float(x), 3), round(float(y), 3)) for x, y in zip(g.uniform(85, 85.4, n), g.uniform(27.8, 28, n), strict=True)]
    nodes, points = [(f"n{k}", 1000 - k, *p) for k, p in enumerate(lattice(150))], [(k, *p) for k, p in enumerate(lattice(200))]
    nodes.append(("twin", 2000, *nodes[3][2:]))
    want = {}
    for k, x, y in points:
        near = min(((x - a) * (x - a) + (y - b) * (y - b), o, n) for n, o, a, b in nodes)
        if near[0] <= 0.05 * 0.05:
            want[k] = near[2]
    out = vectors.snap(spark.createDataFrame(points, "osm_id long, lon double, lat double"), spark.createDataFrame(nodes, "node string, node_ord long, lon double, lat double"))
    assert {x.osm_id: x.node for x in out.collect()} == want
    assert out.select(F.countDistinct("osm_id")).first()[0] == out.count()


def test_masks_as_bits_equal_set_pixels(spark, monkeypatch):
    g = np.random.default_rng(11)
    geo = spark.createDataFrame([(0, 85.0, 28.0, 0.01, 0.01, 20, 13), (7, 85.1, 27.9, 0.02, 0.01, 9, 9), (8, 85.0, 28.0, 0.01, 0.01, 5, 5)], GEO)
    px = spark.createDataFrame([(0, r, c, r == 19 and c == 12, bool(g.random() < 0.5)) for r in range(20) for c in range(13)] + [(7, 4, 4, False, True)], "scene long, r long, c long, cons boolean, lib boolean")
    point = lambda: (round(float(g.uniform(84.95, 85.3)), 3), round(float(g.uniform(27.75, 28.03)), 3))
    roads = spark.createDataFrame([(k, [point(), point(), (85.12, 27.81)]) for k in range(80)], "osm_id long, points array<struct<lon: double, lat: double>>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    ask = lambda: vectors.road_overlap_in_place(roads, px, geo, ["cons", "lib"], 3, ends=False)
    bits = ask()
    assert bits.columns == ["scene", "osm_id", "cons_overlap", "lib_overlap"]
    assert "MapInArrow" in bits._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(vectors, "TASK_BITS", 0)
    assert rows(bits) == rows(ask()) == rows(vectors.road_overlap(roads, px, geo, ["cons", "lib"]).drop("u", "v"))


def test_settlements_of_a_small_file_meet_scenes_in_all_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id as c_custkey", "'n' as c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    geo = spark.createDataFrame([(0, 85.0, 28.0, 0.01, 0.01, 40, 30)], GEO)
    here = vectors.covered(tables.settlements(spark, str(tmp_path), apart=True), geo)
    assert here.select(F.spark_partition_id().alias("p"), "osm_id").agg(F.countDistinct("p")).first()[0] > 1
    assert "hashpartitioning(bx" not in here._jdf.queryExecution().executedPlan().toString()


def test_many_edges_take_two_passes_with_the_same_distances(spark, monkeypatch):
    g = np.random.default_rng(13)
    # the last scene has no source; some nodes have long edges alone, some none that is open
    rows = [(int(s), int(a), int(b), int(w) + 300 * int(a > 50), bool(g.random() < 0.3 or a % 7 == 0)) for s, a, b, w in zip(g.integers(0, 3, 500), g.integers(0, 60, 500), g.integers(0, 60, 500), g.integers(1, 99, 500) ** 2 // 50, strict=True) if a != b]
    edges = spark.createDataFrame(rows, "scene long, a long, b long, length long, cut boolean")
    source = spark.createDataFrame([(0, rows[0][1]), (1, 3), (1, 4)], "scene long, node long")
    answer = lambda *ends: sorted((x.scene, x.node, x.dist, x.dist_cut or -1) for x in graph.distances(edges, source, ["scene"], ["cut"], *ends).collect())
    want = answer()
    made = []
    rounds = graph._rounds
    monkeypatch.setattr(graph, "_rounds", lambda known, either, *rest: made.append(either.count()) or rounds(known, either, *rest))
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    assert answer() == answer(graph.shortest_ends(edges, ["scene"], ["cut"])) == want
    assert len(made) == 4 and 0 < made[1] < 2 * len(rows) and made[0] < len(rows)
    one = lambda: sorted(map(tuple, graph.distances(edges.where("scene = 0").drop("scene"), source.where("scene = 0").select("node")).collect()))
    two = one()
    monkeypatch.setattr(graph, "FEW_EDGES", 10**6)
    assert one() == two


def test_distances_by_hubs_equal_those_of_single_steps(spark, monkeypatch):
    g = np.random.default_rng(19)
    rows = [(int(s), 2 * int(a), 2 * int(b) + 1, int(w) ** 2 // 50, bool(g.random() < 0.4 or b % 9 == 0)) for s, a, b, w in zip(g.integers(0, 3, 400), g.integers(0, 8, 400), g.integers(0, 60, 400), g.integers(1, 99, 400), strict=True)]
    edges = spark.createDataFrame(rows, "scene long, a long, b long, length long, cut boolean")
    source = spark.createDataFrame([(0, rows[0][2]), (1, 4), (1, 7), (1, 1001)], "scene long, node long")
    answer = lambda **how: sorted((x.scene, x.node, x.dist, -1 if x.dist_cut is None else x.dist_cut) for x in graph.distances(edges, source, ["scene"], ["cut"], **how).collect())
    want = answer()
    assert answer(two_sided=True) == want
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    monkeypatch.setattr(graph, "BROADCAST_FAR", 0)
    assert answer(two_sided=True) == want


def test_numbers_of_placed_courses_keep_the_order_of_first_roads(spark, tmp_path):
    g = np.random.default_rng(17)
    rows = [(int(o), k % 7, int(p), int(s), 10.5, "O") for k, (o, p, s) in enumerate(zip(g.integers(0, 500, 900), g.integers(0, 30, 900), g.integers(0, 9, 900), strict=True))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    first = {x.osm_id: tuple(x.first_ord) for x in tables.courses(spark, str(tmp_path)).collect()}
    placed = sorted(tables.placed_courses(spark, str(tmp_path)).collect(), key=lambda x: x.place)
    assert [first[x.osm_id] for x in placed] == sorted(first.values())


def test_ranking_makes_states_once(spark):
    made = spark.range(40).selectExpr("id % 2 as scene", "id as input_ord", "id % 5 as building_count", "cast(id as double) as pre_km", "if(id % 3 = 0, 'cut_off', 'unknown') as state_lib").groupBy("scene", "input_ord").agg(*[F.max(c).alias(c) for c in ("building_count", "pre_km", "state_lib")])
    out = vectors.priority(made, ["scene"])
    assert "max(state_lib" not in out._jdf.queryExecution().executedPlan().toString()
    ranks = {(x.scene, x.priority_rank) for x in out.where("state_lib = 'cut_off'").collect()}
    assert out.count() == 40 and ranks == {(s, k) for s in (0, 1) for k in range(1, 8)}
