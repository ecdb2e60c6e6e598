"""Queries over metadata, results documents and report texts."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from rillmark.functions import expressions as X
from rillmark.operators import ingest, report, results, segments, vectors
from rillmark.operators.checkpoints import cut, shared
from rillmark.plans import exposure
from rillmark.plans.rasters import final_masks, hazard_figures
from rillmark.plans.sql import CUSTOMERS, GEO, ORACLE_SQL, PX, ROADS, km, query
from rillmark.sources import tables


DAY = exposure.LOOSE_DAY
#: The map's day and what a document says of the run's settings.
SNAPSHOT, VERSION, CONFIG = "1997-07-27", "0.1.0", "flood: -5, -3; debris: 2.2"


#: The lists of a document.
LISTS = ("buildings", "roads", "settlements")


def _documents(spark, d, listed: tuple[str, ...] = LISTS):
    """Documents of all scenes, written as JSON, read back with their schema and validated. Their figures count
    all features; of the lists they hold those that the query reads."""
    began = time.time()
    px = cut(final_masks(spark, d))
    flood = px.select("scene", "r", "c", "dem", "cons", "lib")
    geo = cut(tables.georeference(flood))
    houses, net = cut(exposure.buildings(spark, d, flood, geo)), exposure.Network(spark, d, flood, named=True)
    all_roads = tables.roads(spark, d, apart=True)
    hazard = hazard_figures(px).select("scene", F.struct(*results.FIGURES["hazard"], "signals").alias("hazard"))
    damage = vectors.damage_counts(houses, exposure.road_tallies(flood, geo, all_roads)).select("scene", F.struct(*results.FIGURES["damage"]).alias("damage"))
    blamed = cut(vectors.priority(net.blamed().drop("failed", "steps"), ["scene"]))
    worst = segments.critical(blamed, ["scene"]).select("scene", F.col("failed_segment").alias("critical_segment"), F.col("buildings").alias("critical_buildings"))
    ways = vectors.cutoff_counts(blamed, ["scene"]).join(worst, "scene", "left").fillna(0, ["critical_buildings"])
    ways = ways.select("scene", F.struct(*results.FIGURES["cutoff"], "unknown", "critical_segment", "critical_buildings").alias("cutoff"))
    path = cut(exposure.flow(spark, d, flood))
    along = vectors.flow_settlements(path, vectors.covered(tables.settlements(spark, d, apart=True), geo), flood, "lib")
    along = along.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("place", "osm_id", "km", "in_flood", "elevation"))).alias("settlements"))
    flow = vectors.flow_summary(path, flood, "lib").join(along, "scene", "left").select("scene", F.struct("path_km", "flooded", "settlements").alias("flow"))
    pair = vectors.scene_pair(tables.scenes(spark, d), DAY)
    image = lambda kind: F.struct(F.concat(F.lit("S1A_"), F.upper(F.lit(kind)), F.lit("_"), F.col(f"{kind}_ord")).alias("product_id"), F.to_date(f"{kind}_taken").alias("acquisition_day"), F.col("orbit").alias("relative_orbit"), F.col(f"{kind}_direction").alias("pass_direction"))
    seen = tables.scenes(spark, d)
    for kind in ("pre", "post"):
        own = seen.select(F.col("input_ord").alias(f"{kind}_ord"), F.col("direction").alias(f"{kind}_direction"), F.col("taken").alias(f"{kind}_taken"))
        pair = pair.join(own, f"{kind}_ord")
    used = F.when(F.col("fallback").isNotNull(), F.array("fallback")).otherwise(F.array().cast("array<string>"))
    town = ingest.snapshot_counts(tables.settlements(spark, d), tables.roads(spark, d), tables.hospitals(spark, d)).select(F.struct(F.to_date(F.lit(SNAPSHOT)).alias("snapshot_date"), "*").alias("osm"))
    # one row for the whole run, which every scene's document repeats
    run = pair.select(image("pre").alias("s1_pre"), image("post").alias("s1_post"), used.alias("fallbacks_used"), F.when(F.size(used) > 0, "medium").otherwise("high").alias("confidence_level")).join(town)
    terrain = ingest.dem_tiles(geo).groupBy("scene").agg(F.array_sort(F.collect_list("tile")).alias("tiles"))
    where = ingest.scene_box(geo)
    head = where.join(hazard, "scene").join(damage, "scene", "left").join(ways, "scene", "left").join(flow, "scene", "left").join(terrain, "scene").join(F.broadcast(run))
    zero = lambda g: F.coalesce(F.col(g), F.struct(*[F.coalesce(F.col(f"{g}.{f.name}"), F.lit(None if f.dataType.simpleString() == "string" else 0).cast(f.dataType)).alias(f.name) for f in head.schema[g].dataType]))
    head = head.select(
        "scene", F.lit("1.0.0").alias("schema_version"), F.concat(F.lit("run_"), "scene").alias("run_id"), F.current_timestamp().alias("run_timestamp"), F.to_date(F.lit(DAY)).alias("flood_date"), "bbox", F.lit(VERSION).alias("pipeline_version"), F.sha2(F.lit(CONFIG), 256).alias("config_hash"),
        "fallbacks_used", F.transform("fallbacks_used", lambda x: F.struct(x.alias("code"), F.lit("no pair of one track and direction").alias("message"), F.lit("ingest").alias("stage"))).alias("warnings"), "confidence_level",
        F.struct("s1_pre", "s1_post", F.struct(F.lit("GLO-30").alias("source"), "tiles", F.lit(30.0).alias("resolution")).alias("dem"), "osm").alias("provenance"),
        F.struct(F.lit("threshold").alias("architecture"), F.lit(1).alias("ensemble_size"), F.lit(-5.0).alias("threshold_cons"), F.lit(-3.0).alias("threshold_lib"), F.lit(True).alias("fallback_mode")).alias("model"),
        zero("hazard").alias("hazard"), zero("damage").alias("damage"), zero("cutoff").alias("cutoff"), "flow", F.create_map(F.lit("all"), F.lit(round(time.time() - began, 3))).alias("stage_timings"), F.lit(round(time.time() - began, 3)).alias("total_runtime_s"),
    )
    lists = {}
    if "buildings" in listed:
        b = houses.select("scene", "osm_id", X.point_text(F.col("lon"), F.col("lat")).alias("geometry"), F.col("cons_class").alias("class_cons"), F.col("lib_class").alias("class_lib"), F.bround("lib_overlap", 4).alias("overlap"), "lon", "lat")
        lists["buildings"] = results.parts_of(b, "buildings", b.columns[1:], ["osm_id"])
    if "roads" in listed:
        hit_roads = exposure.roads(flood, geo, all_roads.withColumn("length_m", F.bround("length_m", 1)), "osm_id", "highway_type", "length_m", "is_bridge")
        r = cut(hit_roads.select("scene", "osm_id", "highway_type", "length_m", "is_bridge", F.col("cons_class").alias("class_cons"), F.col("lib_class").alias("class_lib"), F.col("lib_share").alias("overlap")))
        lists["roads"] = results.parts_of(r, "roads", r.columns[1:], ["osm_id"])
    if "settlements" in listed:
        s = blamed.withColumn("place_type", F.when(F.col("building_count") >= 20, "village").otherwise("hamlet"))
        lists["settlements"] = results.parts_of(s, "settlements", ["osm_id", "name", "place_type", "lon", "lat", "building_count", "state_cons", "state_lib", "pre_km", "post_km", "detour_km", "failed_segment", "priority_rank"], ["input_ord"])
    path = shared(spark)
    results.write_results(results.assemble(head, lists), path)
    return cut(results.read_results(spark, path))


def _sql(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


_LISTED = f"""SELECT scene, 'building' AS kind, osm_id::VARCHAR AS id, class_cons AS cons, class_lib AS lib, overlap AS value FROM {_sql('building_damage')} UNION ALL SELECT scene, 'road', osm_id, class_cons, class_lib, overlap FROM {_sql('road_damage')}
UNION ALL SELECT scene, 'settlement', input_ord::VARCHAR, state_cons, state_lib, pre_km FROM {_sql('cutoff_states')} UNION ALL SELECT scene, 'flow', osm_id::VARCHAR, in_flood::VARCHAR, place::VARCHAR, km FROM {_sql('flow_settlements')}"""


@query(_LISTED)
def results_document(spark, d):
    """The features that the documents list, as read back from JSON."""
    docs = _documents(spark, d)
    kinds = (("building", "buildings", "osm_id", "class_cons", "class_lib", "overlap"), ("road", "roads", "osm_id", "class_cons", "class_lib", "overlap"), ("settlement", "settlements", "input_ord", "state_cons", "state_lib", "pre_km"), ("flow", "flow.settlements", "osm_id", "in_flood", "place", "km"))
    out = None
    for kind, column, *fields in kinds:
        rows = docs.select("scene", F.explode(column).alias("x")).select("scene", F.lit(kind).alias("kind"), *[F.col(f"x.{f}").cast(t).alias(n) for f, n, t in zip(fields, ("id", "cons", "lib", "value"), ("string", "string", "string", "double"), strict=True)])
        out = rows if out is None else out.union(rows)
    return out


def _figures() -> str:
    parts = []
    for group, names in results.FIGURES.items():
        source = _sql({"hazard": "hazard_area", "damage": "damage_stats", "cutoff": "cutoff_stats"}[group])
        if group != "hazard":
            source = f"(SELECT * FROM (SELECT unnest(range((max(vec_id) // 64 + 7) // 7)) AS scene FROM embeddings) LEFT JOIN {source} USING (scene))"
        columns = ", ".join(f"coalesce({c}, 0)::DOUBLE AS {group}_{c}" for c in names)
        parts.append(f"SELECT scene, name, value FROM (UNPIVOT (SELECT scene, {columns} FROM {source}) ON {', '.join(f'{group}_{c}' for c in names)} INTO NAME name VALUE value)")
    return " UNION ALL ".join(parts)


@query(_figures())
def metric_map(spark, d):
    """The figures of each document that are the same in every run: all but the runtime."""
    return results.figures(_documents(spark, d, ())).where("name <> 'total_runtime_s'")


_FIVE = f"""SELECT *, row_number() OVER (PARTITION BY scene ORDER BY input_ord) AS place FROM {_sql('cutoff_states')} JOIN {_sql('priority_rank')} USING (scene, input_ord) JOIN (SELECT scene, input_ord, failed_segment FROM {_sql('failed_segment')}) USING (scene, input_ord) QUALIFY place <= 5"""
_CELLS = "'<tr><td>' || coalesce(nullif(priority_rank, 0), place) || '</td><td><b>' || name || '</b></td><td>' || building_count || '</td><td>' || coalesce(pre_km::VARCHAR, 'N/A')"


@query(f"SELECT scene, language, 0 AS errors, 0 AS invented, string_agg(CASE language WHEN 'en' THEN {_CELLS} || ' km</td><td>' || state_cons || '</td><td>' || coalesce(failed_segment, 'Road or bridge cut') || '</td></tr>' ELSE {_CELLS} || ' किमी</td><td>' || state_cons || '</td></tr>' END, '' ORDER BY place) AS places FROM ({_FIVE}) CROSS JOIN (SELECT unnest(['en', 'ne']) AS language) GROUP BY scene, language")
def report_check(spark, d):
    """Reports of all scenes in two languages: their table of places, and how many numbers they have that
    their documents do not hold, and errors that these have: none."""
    docs = _documents(spark, d, ("settlements",))
    wrong = docs.groupBy("scene").agg(F.sum(F.size("errors")).cast("int").alias("errors"))  # of all parts
    found = report.reports(docs).join(report.allowed(docs, results.figures(docs)), "scene").join(wrong, "scene")
    places = F.regexp_extract("html", r'<table class="places">([\s\S]*?)</table>', 1)
    return found.select("scene", "language", "errors", F.size(report.invented(F.col("html"), F.col("allowed"))).alias("invented"), places.alias("places"))


_AT = "CROSS JOIN (SELECT unnest([0.5, 0.4])::DOUBLE AS level)"


@query(f"""SELECT level, scene, CASE WHEN level >= 0.5 THEN flood_km2_cons ELSE flood_km2_lib END AS flood_km2, CASE WHEN level >= 0.5 THEN debris_km2_cons ELSE debris_km2_lib END AS debris_km2, CASE WHEN level >= 0.5 THEN likely_cons ELSE likely_lib END AS buildings_likely, CASE WHEN level >= 0.5 THEN cons ELSE lib END AS cut_off, possibly, failed_segment AS critical_segment, coalesce(buildings, 0) AS critical_buildings
FROM {_sql('hazard_area')} JOIN {_sql('damage_stats')} USING (scene) JOIN {_sql('cutoff_stats')} USING (scene) LEFT JOIN {_sql('critical_segment')} USING (scene) {_AT}""")
def threshold_view(spark, d):
    """The figures at two confidence levels, by a SQL table function."""
    view, _ = results.register_views(_documents(spark, d, ()), "run")
    return spark.sql(f"SELECT 0.5D AS level, * FROM {view}(0.5D) UNION ALL SELECT 0.4D, * FROM {view}(0.4D)")


@query(f"""SELECT level, scene, coalesce(priority_rank, row_number() OVER (PARTITION BY level, scene ORDER BY input_ord)) AS rank, name, building_count, pre_km FROM {_sql('cutoff_states')} JOIN {_sql('priority_rank')} USING (scene, input_ord) {_AT} WHERE CASE WHEN level >= 0.5 THEN state_cons ELSE state_lib END = 'cut_off'""")
def threshold_settlements(spark, d):
    """The settlements that are cut off at two confidence levels, by a SQL table function."""
    _, places = results.register_views(_documents(spark, d, ("settlements",)), "run")
    return spark.sql(f"SELECT 0.5D AS level, * FROM {places}(0.5D) UNION ALL SELECT 0.4D, * FROM {places}(0.4D)")


#: Documents made from events, some of which break the rules.
_BODY = """to_json(named_struct('scene', event_id, 'part', 0L, 'run_id', concat('run_', event_id), 'run_timestamp', ts, 'flood_date', to_date(ts), 'pipeline_version', '0.1.0', 'config_hash', 'x', 'bbox', named_struct('west', value, 'south', 27.9D, 'east', 85.4D, 'north', 28.1D),
'confidence_level', case when event_id % 3 = 0 then 'sure' else 'high' end, 'hazard', named_struct('flood_km2_cons', value - 20, 'flood_km2_lib', value, 'debris_km2_cons', 0D, 'debris_km2_lib', 0D, 'permanent_km2', 1D, 'uncertain', value / 50, 'signals', event_id % 5),
'damage', named_struct('likely_cons', 0L, 'likely_lib', 0L, 'possibly_cons', 0L, 'possibly_lib', 0L, 'road_km_cons', 0D, 'road_km_lib', 0D, 'bridges_likely', 0L, 'bridges_possibly', 0L), 'cutoff', named_struct('cons', 0L, 'lib', 0L, 'possibly', 0L, 'connected', 0L), 'provenance', named_struct('dem', named_struct('source', 'x')),
'roads', array(named_struct('osm_id', 'a', 'class_cons', 'not_hit', 'class_lib', case when event_id % 7 = 0 then 'gone' else 'not_hit' end, 'overlap', value / 90))))"""


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN value > 180 THEN 'bbox.west is not from -180 to 180' END, CASE WHEN value >= 85.4 THEN 'bbox: west is not west of east' END, CASE WHEN event_id % 3 = 0 THEN 'confidence_level is not known' END, CASE WHEN value - 20 < 0 THEN 'hazard.flood_km2_cons is out of range' END, CASE WHEN value < 0 THEN 'hazard.flood_km2_lib is out of range' END,
CASE WHEN event_id % 5 > 3 THEN 'hazard.signals is out of range' END, CASE WHEN value / 50 > 1 OR value < 0 THEN 'hazard.uncertain is out of range' END, CASE WHEN event_id % 7 = 0 THEN 'roads: a class is not known' END, CASE WHEN value / 90 > 1 OR value < 0 THEN 'roads: an overlap is not from 0 to 1' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events""")
def document_errors(spark, d):
    """What validation finds in documents made from events."""
    path = shared(spark)
    spark.read.parquet(f"{d}/events.parquet").select(F.expr(_BODY).alias("value")).write.text(path)
    return results.read_results(spark, path).select(F.col("scene").alias("event_id"), F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {PX}, {GEO} SELECT scene, 'N' || lpad(y::VARCHAR, 2, '0') || '_E' || lpad(x::VARCHAR, 3, '0') AS tile FROM (SELECT scene, unnest(range(floor(lon_min - 0.005::DOUBLE)::BIGINT, floor(lon_min + (cols - 0.5::DOUBLE) * 0.01::DOUBLE)::BIGINT + 1)) AS x, lat_max, rows FROM ge) CROSS JOIN range(-90, 90) y(y) WHERE y BETWEEN floor(lat_max - (rows - 0.5::DOUBLE) * 0.01::DOUBLE) AND floor(lat_max + 0.005::DOUBLE)")
def dem_tiles(spark, d):
    """The terrain tiles of one degree that each scene needs."""
    return ingest.dem_tiles(tables.georeference(tables.pixels(spark, d)))


#: Lookarounds are not RE2: a digit after a letter, _, # or & goes, then a digit before a letter or _.
NUMBERS = r"""tx AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<style[\s\S]*?</style>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '\bS[12][AB]_[A-Z0-9_]+\b', ' ', 'g'),
'\brun_\d+\b', ' ', 'g'), '\b\d{4}-\d{2}-\d{2}\b', ' ', 'g'), '\b\d{1,2}:\d{2}\b', ' ', 'g'), '&[a-z]+;', ' ', 'g') AS t FROM documents),
ty AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([a-zA-Z_#&])[0-9]', '\1 ', 'g'), '[0-9]([a-zA-Z_])', ' \1', 'g') AS t FROM tx),
nu AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(t, '[0-9]+\.[0-9]+|[0-9]+'), lambda x: round_even(x::DOUBLE, 2))) AS n FROM ty)"""


@query(f"WITH {NUMBERS} SELECT n, count(*) AS documents FROM (SELECT doc_id, unnest(n) AS n FROM nu) GROUP BY n")
def report_numbers(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.explode(report.numbers(F.col("text"))).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH {NUMBERS} SELECT doc_id, len(list_filter(n, lambda x: NOT list_contains({report.COMMON}::DOUBLE[], x))) AS invented FROM nu")
def number_check(spark, d):
    """How many numbers of each text are not among the common ones."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.size(report.invented(F.col("text"), F.array().cast("array<double>"))).cast("long").alias("invented"))


@query(f"""WITH {CUSTOMERS} SELECT osm_id, 'cache_' || round_even(lon, 4) || '_' || round_even(lat - 0.2, 4) || '_' || round_even(lon + 0.2, 4) || '_' || round_even(lat, 4) || '_1998-01-01_v1' AS key, lon + 0.2 <= 180 AND lat - 0.2 >= -90 AS valid FROM cu""")
def cache_keys(spark, d):
    s = tables.settlements(spark, d)
    box = (F.col("lon"), F.col("lat") - 0.2, F.col("lon") + 0.2, F.col("lat"))
    return s.select("osm_id", ingest.cache_key(*box, F.lit("1998-01-01")).alias("key"), ingest.valid_box(*box).alias("valid"))


@query(f"WITH {ROADS}, r AS (SELECT sum(length)::BIGINT AS m, count_if(bridge)::BIGINT AS bridges FROM rp) SELECT (SELECT count(*) FROM customer) AS buildings, {km('m')} AS road_km, bridges, (SELECT count(*) FROM part WHERE p_size = 1) AS hospitals FROM r")
def osm_snapshot(spark, d):
    ingest.check_snapshot("1997-07-27", "1998-01-01")
    return ingest.snapshot_counts(tables.settlements(spark, d), tables.roads(spark, d), tables.hospitals(spark, d))


@query("SELECT event_id, value > 35.0 AS cloudy, CASE WHEN value > 35.0 THEN 's2_cloudy' END AS warning, strftime(ts, '%Y-%m-%d') AS day FROM events")
def cloud_gate(spark, d):
    """Events as optical scenes, their value as cloud cover."""
    e = ingest.cloud_gate(spark.read.parquet(f"{d}/events.parquet"), "value")
    return e.select("event_id", (~F.col("used")).alias("cloudy"), "warning", ingest.acquisition_day("ts").cast("string").alias("day"))


#: Bodies of run requests made from events: some lack fields, some hold what cannot be read.
_REQUEST = """case when event_id % 11 = 0 then 'no json' else to_json(named_struct('bbox', case when event_id % 2 = 0 then named_struct('west', 85 + value / 1000, 'north', case when event_id % 4 = 0 then 28.5D end) end, 'flood_date', case when event_id % 3 = 0 then date_format(ts, 'yyyy-MM-dd') when event_id % 3 = 1 then 'soon' end, 'use_baseline', case when event_id % 5 = 0 then true end)) end"""


@query("""SELECT event_id, CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN 85 + value / 1000 ELSE 85.2 END AS west, 27.9::DOUBLE AS south, 85.4::DOUBLE AS east, CASE WHEN event_id % 11 <> 0 AND event_id % 4 = 0 THEN 28.5 ELSE 28.1 END::DOUBLE AS north,
CASE WHEN event_id % 11 <> 0 AND event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2026-08-26' END AS flood_date, event_id % 11 <> 0 AND event_id % 5 = 0 AS use_baseline, event_id % 11 = 0 OR event_id % 3 = 1 AS refused, props->>'$.k' AS setting FROM events""")
def run_requests(spark, d):
    """Bodies of run requests, with defaults for what they lack."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("body", F.expr(_REQUEST))
    got = e.select("event_id", ingest.request(F.col("body")).alias("q"), ingest.setting(F.col("props"), "k").alias("setting"))
    return got.select("event_id", "q.west", "q.south", "q.east", "q.north", F.col("q.flood_date").cast("string").alias("flood_date"), "q.use_baseline", "q.refused", "setting")


@query("SELECT page_id, octet_length(encode(html)) AS length, sha256(html) AS sha256 FROM pages")
def content_hashes(spark, d):
    """Null pages have no hash."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.octet_length("html").cast("long").alias("length"), F.sha2("html", 256).alias("sha256"))


@query("""WITH s AS (SELECT o_orderkey AS ord, o_custkey AS orbit, o_orderpriority AS dir, o_orderdate::DATE AS day FROM orders), p AS (SELECT a.orbit, a.ord AS pre_ord, b.ord AS post_ord, b.day - a.day AS gap, a.day AS pd, b.day AS qd
FROM s a JOIN s b ON a.orbit = b.orbit AND a.dir = b.dir AND b.day - a.day BETWEEN 6 AND 12 AND a.day < DATE '1995-02-17' AND b.day >= DATE '1995-02-17')
SELECT 'Selected scenes ' || pre_ord || ' and ' || post_ord || ' of orbit ' || orbit || ', ' || gap || ' days apart.' AS reason FROM p ORDER BY qd, post_ord, pd DESC, pre_ord LIMIT 1""")
def pair_reason(spark, d):
    return report.pair_reason(vectors.scene_pair(tables.scenes(spark, d), exposure.EXACT_DAY)).select("reason")


@query(f"{exposure.CUT} SELECT input_ord, name, building_count, state_lib FROM x WHERE scene = 0 ORDER BY input_ord LIMIT 5")
def first_settlements(spark, d):
    return report.first_settlements(exposure.Network(spark, d, scene=0).states).select("input_ord", "name", "building_count", "state_lib")
