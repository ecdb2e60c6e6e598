import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators import ingest, report, results

GOOD = {
    "scene": 1, "part": 0, "schema_version": "1.0.0", "run_id": "run_1", "run_timestamp": "2026-08-27T00:00:00Z", "flood_date": "2026-08-26", "bbox": {"west": 85.2, "south": 27.9, "east": 85.4, "north": 28.1}, "pipeline_version": "0.1", "config_hash": "c", "fallbacks_used": [], "warnings": [], "confidence_level": "high",
    "provenance": {"s1_post": {"product_id": "S1A_POST_9", "acquisition_day": "2026-08-26", "relative_orbit": 121}, "dem": {"source": "GLO-30", "resolution": 30.0}, "osm": {"snapshot_date": "2026-07-27"}}, "model": {"architecture": "threshold"},
    "hazard": {"flood_km2_cons": 1.25, "flood_km2_lib": 2.5, "debris_km2_cons": 0.0, "debris_km2_lib": 0.11, "permanent_km2": 7.0, "uncertain": 0.5, "signals": 2}, "damage": {"likely_cons": 33, "likely_lib": 34, "possibly_cons": 35, "possibly_lib": 36, "road_km_cons": 7.5, "road_km_lib": 8.25, "bridges_likely": 1, "bridges_possibly": 2},
    "cutoff": {"cons": 1, "lib": 2, "possibly": 1, "connected": 9, "unknown": 0, "critical_segment": "7-1", "critical_buildings": 45}, "buildings": [{"osm_id": 5, "class_cons": "not_hit", "class_lib": "likely_hit", "overlap": 1.0}], "roads": [],
    "settlements": [{"input_ord": 0, "name": "Syabru <b>", "building_count": 45, "state_cons": "cut_off", "state_lib": "cut_off", "pre_km": 3.5, "failed_segment": "7-1", "priority_rank": 1}, {"input_ord": 1, "building_count": 8, "state_cons": "still_connected", "state_lib": "cut_off", "pre_km": 0.0}],
    "flow": {"path_km": 1.0, "flooded": 0.1}, "stage_timings": {"a": 1.5}, "total_runtime_s": 19.5,
}


def read(spark, tmp_path, *docs):
    path = tmp_path / "docs"
    path.mkdir(exist_ok=True)
    (path / "x.json").write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
    return results.read_results(spark, str(path))


def changed(**parts):
    out = json.loads(json.dumps(GOOD))
    for key, value in parts.items():
        *way, last = key.split("__")
        at = out
        for k in way:
            at = at[int(k) if k.isdigit() else k]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return out


CASES = [
    ({}, []),
    ({"hazard__flood_km2_cons": -0.1}, ["hazard.flood_km2_cons is out of range"]),
    ({"hazard__uncertain": 1.5, "hazard__signals": 4}, ["hazard.signals is out of range", "hazard.uncertain is out of range"]),
    ({"bbox__west": 85.4}, ["bbox: west is not west of east"]),
    ({"bbox__north": 95.0}, ["bbox.north is not from -90 to 90"]),
    ({"bbox__south": None}, ["bbox.south is not from -90 to 90"]),
    ({"confidence_level": "sure"}, ["confidence_level is not known"]),
    ({"config_hash": None, "damage__likely_lib": None}, ["config_hash is missing", "damage.likely_lib is missing"]),
    ({"hazard": None}, ["hazard is missing"]),
    ({"buildings__0__overlap": 1.01}, ["buildings: an overlap is not from 0 to 1"]),
    ({"buildings__0__class_lib": "gone"}, ["buildings: a class is not known"]),
    ({"settlements__1__state_cons": None}, ["settlements: a state is not known"]),
    ({"buildings": None, "roads": None, "settlements": None}, []),
]


def test_documents_are_validated(spark, tmp_path):
    docs = [{**changed(**parts), "scene": k} for k, (parts, _) in enumerate(CASES)]
    got = {r.scene: r for r in read(spark, tmp_path, *docs, '{"scene": 99, "bbox": 5}', "{broken").collect()}
    assert [got[k].errors for k in range(len(CASES))] == [want for _, want in CASES]
    assert got[None].errors == ["not a results document"] and got[None].broken == "{broken"
    rest = {"scene": 50, "part": 1, "roads": [{"osm_id": "r", "class_cons": "not_hit", "class_lib": "x", "overlap": 0.0}]}
    assert read(spark, tmp_path, rest).first().errors == ["roads: a class is not known"]


def test_round_trip_and_figures(spark, tmp_path):
    docs = read(spark, tmp_path, GOOD).drop("broken", "errors")
    path = str(tmp_path / "again")
    results.write_results(docs, path)
    back = results.read_results(spark, path)
    assert back.drop("broken", "errors").collect() == docs.collect() and back.first().errors == []
    values = {r.name: r.value for r in results.figures(docs).collect()}
    assert len(values) == 19 and values["total_runtime_s"] == 19.5 and values["damage_possibly_lib"] == 36


def test_lists_come_in_parts_and_types_of_the_schema(spark):
    f = spark.range(1000).select(F.expr("case when id < 990 then 1 else 2 end").alias("scene"), F.col("id").alias("osm_id"), F.lit("not_hit").alias("class_cons"), F.lit("not_hit").alias("class_lib"), F.lit(0).alias("overlap"))
    parts = results.parts_of(f, "buildings", ["osm_id", "class_cons", "class_lib", "overlap"], ["osm_id"], size=100)
    sizes = {(r.scene, r.part): len(r.buildings) for r in parts.collect()}
    assert sum(sizes.values()) == 1000 and len([k for k in sizes if k[0] == 1]) == 10 and max(sizes.values()) < 150 and sizes[(2, 0)] == 10
    docs = results.assemble(spark.createDataFrame([(1, "a"), (3, "b")], "scene long, run_id string"), {"buildings": parts})
    assert docs.schema.simpleString() == T.StructType.fromDDL(results.SCHEMA).simpleString()
    assert docs.where("scene = 1").count() == 10 and docs.where("scene = 3").count() == 1 and docs.select(F.explode("buildings")).count() == 1000


def test_reports_in_two_languages(spark, tmp_path):
    bare = {**changed(settlements=[]), "scene": 2}
    docs = read(spark, tmp_path, GOOD, bare)
    html = {(r.scene, r.language): r.html for r in report.reports(docs).collect()}
    assert len(html) == 4
    en, ne = html[1, "en"], html[1, "ne"]
    assert "<tr><td>1</td><td><b>Syabru <b></b></td><td>45</td><td>3.5 km</td><td>cut_off</td><td>7-1</td></tr><tr><td>2</td><td><b>Unnamed place</b></td><td>8</td><td>N/A km</td><td>still_connected</td><td>Road or bridge cut</td></tr>" in en
    assert "1.25 to 2.5 square km" in en and "S1A_POST_9, orbit 121" in en and "2026-07-27" in en and "{" not in en.split("</style>")[1]
    assert "1.25 वर्ग किमी" in ne and "<td>2</td><td><b>बस्ती</b>" in ne and "7-1" not in ne
    assert "No place is cut off." in html[2, "en"] and "सम्पर्कबाहिर छैन" in html[2, "ne"]
    found = report.reports(docs).join(report.allowed(docs, results.figures(docs)), "scene")
    assert [r[0] for r in found.select(report.invented(F.col("html"), F.col("allowed"))).collect()] == [[]] * 4
    forged = found.where("scene = 1 and language = 'en'").select(report.invented(F.concat("html", F.lit(" 77 dead")), F.col("allowed"))).first()[0]
    assert forged == [77.0]


def test_views_at_a_level(spark, tmp_path):
    figures, places = results.register_views(read(spark, tmp_path, GOOD), "unit")
    assert tuple(spark.sql(f"SELECT * FROM {figures}(0.5D)").first()) == (1, 1.25, 0.0, 33, 1, 1, "7-1", 45)
    assert tuple(spark.sql(f"SELECT flood_km2, cut_off FROM {figures}(0.49D)").first()) == (2.5, 2)
    assert [tuple(r) for r in spark.sql(f"SELECT rank, name, building_count FROM {places}(0.9D)").collect()] == [(1, "Syabru <b>", 45)]
    assert [tuple(r) for r in spark.sql(f"SELECT rank, building_count FROM {places}(0D) ORDER BY rank").collect()] == [(1, 45), (2, 8)]


def test_boxes_and_terrain_tiles(spark):
    geo = spark.createDataFrame([(0, 85.0, 28.0, 0.5, 0.5, 2, 3), (1, -0.75, 0.25, 0.5, 0.5, 2, 2)], "scene long, lon_min double, lat_max double, px_w double, px_h double, rows long, cols long")
    assert tuple(ingest.scene_box(geo).where("scene = 0").first().bbox) == pytest.approx((84.75, 27.25, 86.25, 28.25))
    tiles = {(r.scene, r.tile) for r in ingest.dem_tiles(geo).collect()}
    assert tiles == {(0, f"N{y}_E0{x}") for y in (27, 28) for x in (84, 85, 86)} | {(1, f"{y}_{x}") for y in ("S01", "N00") for x in ("W001", "E000")}


def test_run_requests(spark):
    bodies = ['{"bbox": {"west": 1.5, "north": 2}, "flood_date": "2026-01-02", "use_baseline": true}', "{}", '{"flood_date": "soon"}', "{broken", None, '{"bbox": 7}']
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(ingest.request(F.col("b")).alias("q")).select("q.*").collect()
    assert tuple(got[0])[:4] == (1.5, 27.9, 85.4, 2.0) and str(got[0].flood_date) == "2026-01-02" and got[0].use_baseline and not got[0].refused
    assert [r.refused for r in got] == [False, False, True, True, True, True] and {str(r.flood_date) for r in got[1:]} == {"2026-08-26"}


def test_reports_list_the_first_settlements_of_all_parts(spark, tmp_path):
    more = {"scene": 1, "part": 1, "settlements": [{**GOOD["settlements"][0], "input_ord": -1, "name": "Earlier"}]}
    docs = read(spark, tmp_path, GOOD, more)
    html = report.reports(docs, ("en",)).first().html
    assert html.index("Earlier") < html.index("Syabru") and html.count("<b>") == 4
    assert report.reports(docs).count() == 2
