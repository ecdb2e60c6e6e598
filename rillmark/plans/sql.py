"""Common table expressions of the DuckDB SQL, and the registry of queries."""

from __future__ import annotations

from rillmark.sources.tables import CUSTOMER_AT, MEASURES, NORTH, PART_AT, PIXEL, ROAD_KEY, SUPPLIER_AT, WEST

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function as a query of its name, with SQL that gives the same rows where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Pixels as the tables module makes them.
PX = """e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings), ts AS (SELECT max(vec_id) // 64 + 1 AS n FROM embeddings),
q AS (SELECT unnest(range(vec_id // 64, (n + 6) // 7 * 7, n)) AS q, vec_id % 64 AS r, c, x FROM e, ts), b AS (SELECT q // 7 AS scene, r, c, {bands} FROM q GROUP BY ALL),
px AS MATERIALIZED (SELECT scene, r, c, {measures} FROM b WHERE b0 + b1 + b2 + b3 + b4 + b5 + b6 IS NOT NULL)""".format(
    bands=", ".join(f"max(CASE WHEN q % 7 = {k} THEN x END) AS b{k}" for k in range(7)), measures=", ".join(f"{x} AS {n}" for n, x in MEASURES.items())
)
SLOPE = """g AS (SELECT scene, r, c, (coalesce(lead(dem) OVER x, dem) - coalesce(lag(dem) OVER x, dem)) / (CASE WHEN lead(dem) OVER x IS NULL OR lag(dem) OVER x IS NULL THEN 30 ELSE 60 END) AS gx,
  (coalesce(lead(dem) OVER y, dem) - coalesce(lag(dem) OVER y, dem)) / (CASE WHEN lead(dem) OVER y IS NULL OR lag(dem) OVER y IS NULL THEN 30 ELSE 60 END) AS gy
  FROM px WINDOW x AS (PARTITION BY scene, r ORDER BY c), y AS (PARTITION BY scene, c ORDER BY r)), sl AS (SELECT scene, r, c, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope_deg FROM g)"""
NEAR = """nr AS (SELECT p.scene, p.r, p.c, min(((p.c - q.c) * (p.c - q.c) + (p.r - q.r) * (p.r - q.r)) * 1000000 + q.r * 1000 + q.c) AS k FROM px p JOIN px q ON p.scene = q.scene AND q.river GROUP BY ALL),
nd AS (SELECT nr.scene, nr.r, nr.c, sqrt(k // 1000000) * 30 AS distance_m, greatest(p.dem - q.dem, 0) AS hand_m FROM nr JOIN px p USING (scene, r, c) JOIN px q ON q.scene = nr.scene AND q.r = k // 1000 % 1000 AND q.c = k % 1000)"""
TERRAIN = f"""{PX}, {SLOPE}, {NEAR}, t AS MATERIALIZED (SELECT px.*, slope_deg, distance_m, hand_m, slope_deg > 40 AS shadow,
slope_deg <= 18 AND hand_m <= 25 AND distance_m <= 1500 AND NOT slope_deg > 40 AS valid FROM px JOIN sl USING (scene, r, c) JOIN nd USING (scene, r, c))"""
FLOOD = f"""{TERRAIN}, fl AS (SELECT *, (post_vv - pre_vv < -5 OR post_vh - pre_vh < -6.5) AND valid AS flood_cons, (post_vv - pre_vv < -3 OR post_vh - pre_vh < -4.5) AND valid AS flood_lib,
pre_vv < -18 AND slope_deg < 5 AS permanent_water FROM t)"""
#: Clouds grown by three steps, fusion, and three debris signals.
MASKS = f"""{FLOOD}, cd AS (SELECT DISTINCT p.scene, p.r, p.c FROM px p JOIN px k ON k.scene = p.scene AND k.cloud AND abs(k.r - p.r) + abs(k.c - p.c) <= 3),
m AS (SELECT fl.*, cd.r IS NULL AS clear, (green - swir) / (green + swir + 1e-6) AS w, CASE WHEN flood_lib THEN 0.8::DOUBLE ELSE 0 END AS prob, distance_m <= 450 AND slope_deg <= 35 AS corridor,
((swir + red) - (nir + blue)) / ((swir + red) + (nir + blue) + 1e-6) AS bsi_post, ((swir_pre + red_pre) - (nir_pre + blue_pre)) / ((swir_pre + red_pre) + (nir_pre + blue_pre) + 1e-6) AS bsi_pre FROM fl LEFT JOIN cd USING (scene, r, c)),
v AS (SELECT *, CASE WHEN corridor THEN (post_vh - pre_vh >= 2.2)::INT + (coherence_loss >= 0.35)::INT + (bsi_post - bsi_pre >= 0.15 AND clear)::INT ELSE 0 END AS votes FROM m),
z AS MATERIALIZED (SELECT *, votes >= 2 AS debris_cons, votes >= 1 AS debris_lib, flood_cons AND clear AND w < -0.1 OR clear AND w >= 0.12 AND NOT flood_cons AND prob < 0.25 AS unsure,
flood_lib AND clear AND w < -0.1 OR clear AND w >= 0.12 AND NOT flood_lib AND prob < 0.25 AS unsure_lib,
CASE WHEN clear AND w >= 0.12 AND prob >= 0.3 THEN TRUE WHEN flood_cons AND clear AND w < -0.1 THEN FALSE ELSE flood_cons END AS fused_cons,
CASE WHEN clear AND w >= 0.12 AND prob >= 0.3 THEN TRUE WHEN flood_lib AND clear AND w < -0.1 THEN FALSE ELSE flood_lib END AS fused_lib FROM v)"""
FOUR = "o4 AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(dr, dc))"


def filled(layers: str) -> str:
    """Of layers lay(scene, mask, r, c, on): px without those that the border does not reach, as fil."""
    return f"""{FOUR}, lay AS MATERIALIZED ({layers}), ext AS (SELECT scene, max(r) AS lr, max(c) AS lc FROM px GROUP BY scene),
ou(scene, mask, r, c) AS (SELECT l.scene, mask, r, c FROM lay l JOIN ext USING (scene) WHERE NOT l.on AND (r = 0 OR c = 0 OR r = lr OR c = lc)
UNION SELECT b.scene, b.mask, b.r, b.c FROM ou a CROSS JOIN o4 JOIN lay b ON b.scene = a.scene AND b.mask = a.mask AND b.r = a.r + dr AND b.c = a.c + dc WHERE NOT b.on),
fil AS MATERIALIZED (SELECT l.scene, l.mask, l.r, l.c FROM lay l LEFT JOIN ou USING (scene, mask, r, c) WHERE l.on OR ou.r IS NULL)"""


#: Labels of the pixels of fil.
LABEL = """lb(scene, mask, r, c, label) USING KEY (scene, mask, r, c) AS (SELECT scene, mask, r, c, r * 2147483648 + c FROM fil UNION
SELECT b.scene, b.mask, b.r, b.c, min(a.label) FROM lb a CROSS JOIN o4 JOIN recurring.lb b ON b.scene = a.scene AND b.mask = a.mask AND b.r = a.r + dr AND b.c = a.c + dc WHERE a.label < b.label GROUP BY ALL)"""
FINAL = f"""{MASKS}, {filled("SELECT scene, 'flood_cons' AS mask, r, c, fused_cons AS on FROM z UNION ALL SELECT scene, 'flood_lib', r, c, fused_lib FROM z UNION ALL SELECT scene, 'debris_cons', r, c, debris_cons FROM z UNION ALL SELECT scene, 'debris_lib', r, c, debris_lib FROM z")}, {LABEL},
nw AS (SELECT DISTINCT p.scene, p.r, p.c FROM px p JOIN px k ON k.scene = p.scene AND k.river AND abs(k.r - p.r) + abs(k.c - p.c) <= 2),
gr AS (SELECT lb.*, hand_m, count(*) OVER w AS n, max((nw.r IS NOT NULL)::INT) OVER w AS near FROM lb JOIN t USING (scene, r, c) LEFT JOIN nw USING (scene, r, c) WINDOW w AS (PARTITION BY lb.scene, mask, label)),
ke AS (SELECT * FROM gr WHERE n >= 8 AND (mask LIKE 'debris%' AND hand_m <= 37.5 OR mask LIKE 'flood%' AND near = 1 AND hand_m <= 25)),
f AS MATERIALIZED (SELECT z.*, fc.r IS NOT NULL AS flood_cons_clean, fb.r IS NOT NULL AS flood_lib_clean, dc.r IS NOT NULL AS debris_cons_clean, db.r IS NOT NULL AS debris_lib_clean FROM z
LEFT JOIN ke fc ON fc.mask = 'flood_cons' AND fc.scene = z.scene AND fc.r = z.r AND fc.c = z.c LEFT JOIN ke fb ON fb.mask = 'flood_lib' AND fb.scene = z.scene AND fb.r = z.r AND fb.c = z.c
LEFT JOIN ke dc ON dc.mask = 'debris_cons' AND dc.scene = z.scene AND dc.r = z.r AND dc.c = z.c LEFT JOIN ke db ON db.mask = 'debris_lib' AND db.scene = z.scene AND db.r = z.r AND db.c = z.c),
hz AS MATERIALIZED (SELECT scene, r, c, dem, flood_cons_clean OR debris_cons_clean AS cons, flood_lib_clean OR debris_lib_clean AS lib FROM f)"""


def tenth(x: str) -> str:
    """Tenths as units, halves to even."""
    return f"(({x}) // 10 + CASE WHEN ({x}) % 10 > 5 OR ({x}) % 10 = 5 AND ({x}) // 10 % 2 = 1 THEN 1 ELSE 0 END)"


def km2(mask: str) -> str:
    return f"{tenth(f'count_if({mask}) * 9')} / 1000"


def km(metres: str) -> str:
    return f"{tenth(metres)} / 100"


CUSTOMERS = f"cu AS (SELECT c_custkey AS osm_id, c_name AS name, {CUSTOMER_AT[0].format('c_custkey')} AS lon, {CUSTOMER_AT[1].format('c_custkey')} AS lat, c_custkey % 50 AS building_count FROM customer)"
#: Each scene's grid.
GEO = f"ge AS MATERIALIZED (SELECT scene, max(r) + 1 AS rows, max(c) + 1 AS cols, {WEST.format('scene')} AS lon_min, {NORTH.format('scene')} AS lat_max FROM px GROUP BY scene)"


def covered(points: str) -> str:
    """Points (lon, lat, ...) with the scenes on whose grids they lie, their rows and columns there."""
    return f"SELECT * FROM (SELECT p.*, ge.scene, rows, cols, round_even((lat_max - lat) / {PIXEL}::DOUBLE, 0)::BIGINT AS r, round_even((lon - lon_min) / {PIXEL}::DOUBLE, 0)::BIGINT AS c FROM {points} p CROSS JOIN ge) WHERE r BETWEEN 0 AND rows - 1 AND c BETWEEN 0 AND cols - 1"


ROADS = f"""rp AS (SELECT {" || '-' || ".join(ROAD_KEY)} AS osm_id, row_number() OVER (ORDER BY {", ".join(ROAD_KEY)}) AS ord, CASE WHEN l_linestatus = 'O' THEN 'primary' ELSE 'secondary' END AS highway_type, floor(l_extendedprice)::BIGINT AS length, l_linenumber = 1 AS bridge,
{SUPPLIER_AT[0].format('l_suppkey')} AS x1, {SUPPLIER_AT[1].format('l_suppkey')} AS y1, {PART_AT[0].format('l_partkey')} AS x2, {PART_AT[1].format('l_partkey')} AS y2, 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem)"""
