"""Queries of tile inference, training, augmentation with noise, array files and hashes of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions import counters
from rillmark.operators import hazard, inference, ingest, raster
from rillmark.operators.checkpoints import shared
from rillmark.plans.sql import FLOOD, PX, query
from rillmark.sources import npy, tables

RADAR = ["pre_vv", "post_vv", "pre_vh", "post_vh"]
#: The parameters of a fixed ensemble: one 3 x 3 kernel for each class and channel, and a bias.
_KERNEL, _BIAS = "(({m} * 7 + {k} * 5 + {ch} * 3 + {a} * 2 + {b}) % 11 - 5) / 100", "{k} / 10"


def _members(spark, many: int):
    kernels = f"flatten(transform(sequence(0, 2), k -> flatten(transform(sequence(0, {len(RADAR) - 1}), ch -> flatten(transform(sequence(0, 2), a -> transform(sequence(0, 2), b -> {_KERNEL.format(m='id', k='k', ch='ch', a='a', b='b')})))))))"
    return spark.range(many).selectExpr("id as member", f"concat({kernels}, transform(sequence(0, 2), k -> {_BIAS.format(k='k')})) as weights")


def _inference_sql(many: int) -> str:
    unsure = "var_pop(flood)" if many > 1 else "-(any_value(f1) * log2(any_value(f1)) + (1 - any_value(f1)) * log2(1 - any_value(f1)))"
    return f"""WITH {PX}, ch AS MATERIALIZED (SELECT scene, r, c, unnest([{', '.join(RADAR)}]) AS x, unnest(range({len(RADAR)})) AS ch FROM px), o AS (SELECT a.a, b.b FROM range(3) a(a), range(3) b(b)), kind AS (SELECT m.m, k.k, f.f FROM range({many}) m(m), range(3) k(k), range(3) f(f)),
w AS (SELECT m, k, f, ch.ch, a, b, {_KERNEL.format(m='m', k='k', ch='ch.ch', a='CASE WHEN f = 2 THEN 2 - a ELSE a END', b='CASE WHEN f = 1 THEN 2 - b ELSE b END')} AS w FROM kind, o, range({len(RADAR)}) ch(ch)),
s AS (SELECT q.scene, q.r - a + 1 AS r, q.c - b + 1 AS c, m, k, f, sum(w * x) + {_BIAS.format(k='any_value(k)')} AS s FROM ch q JOIN w USING (ch) GROUP BY ALL),
p AS (SELECT s.scene, s.r, s.c, m, k, exp(s) / sum(exp(s)) OVER (PARTITION BY s.scene, s.r, s.c, m, f) AS p FROM s JOIN px ON px.scene = s.scene AND px.r = s.r AND px.c = s.c),
em AS (SELECT scene, r, c, m, avg(p) FILTER (k = 2) AS flood, avg(p) FILTER (k = 1) AS water, least(greatest(avg(p) FILTER (k = 2), 1e-6), 1 - 1e-6) AS f1 FROM p GROUP BY scene, r, c, m)
SELECT scene, r, c, round(avg(flood), 6) AS flood, round({unsure}, 6) AS uncertainty, round(avg(water), 6) AS water FROM em GROUP BY scene, r, c"""


def _inferred(spark, d, many: int):
    # tiles smaller than a scene, so that there are seams to compare with the whole raster
    out = inference.infer(tables.pixels(spark, d), RADAR, _members(spark, many), side=24)
    return out.select("scene", "r", "c", *[F.round(x, 6).alias(x) for x in ("flood", "uncertainty", "water")])


@query(_inference_sql(2))
def tile_inference(spark, d):
    """Two members over tiles with margins, mirrored twice: mean and variance."""
    return _inferred(spark, d, 2)


@query(_inference_sql(1))
def single_inference(spark, d):
    """One member: its uncertainty is an entropy."""
    return _inferred(spark, d, 1)


#: The channels of the pixel model, near 1 in size; which regions are held out; rounds and rate.
STACK = {"x0": "pre_vv / 20", "x1": "pre_vh / 20", "x2": "post_vv / 20", "x3": "post_vh / 20", "x4": "(post_vv - pre_vv) / 5", "x5": "(post_vh - pre_vh) / 5", "x6": "least(greatest(slope_deg / 60, 0), 1)", "x7": "least(greatest(hand_m / 100, 0), 1)", "x8": "least(greatest(distance_m / 3000, 0), 1)"}
TARGET, HELD_OUT, ROUNDS, RATE = "case when flood_lib then 2 when permanent_water then 1 else 0 end", "scene % 3 = 1", 4, 0.1


def _train_sql() -> str:
    """The rounds unrolled: scores, probabilities, sums, gradient by scores, step of the optimiser."""
    many = len(STACK) + 1
    out = f"""WITH {FLOOD}, i0 AS MATERIALIZED (SELECT row_number() OVER () AS i, {HELD_OUT} AS held, {TARGET} AS y, [{', '.join(STACK.values())}, 1.0] AS v FROM fl), fx AS MATERIALIZED (SELECT i, held, y, unnest(v)::DOUBLE AS x, unnest(range({many})) AS j FROM i0),
w0 AS MATERIALIZED (SELECT c.c, j.j, 0::DOUBLE AS w, 0::DOUBLE AS m, 0::DOUBLE AS v FROM range(3) c(c), range({many}) j(j)), n AS (SELECT count(*) AS n FROM i0 WHERE NOT held)"""
    for k in range(ROUNDS + 1):
        out += f""", s{k} AS (SELECT i, held, y, c, sum(w * x) AS s FROM fx JOIN w{k} USING (j) GROUP BY ALL), p{k} AS MATERIALIZED (SELECT i, held, y, c, exp(s) / sum(exp(s)) OVER (PARTITION BY i) AS p FROM s{k})"""
        if k:
            out += f""", u{k - 1} AS (SELECT {k - 1} AS round, coalesce(count_if(top = 2 AND y = 2) / nullif(count_if(top = 2 OR y = 2), 0), 1) AS iou FROM (SELECT i, y, arg_max(c, p) AS top FROM p{k} WHERE held GROUP BY i, y))"""
        if k < ROUNDS:
            out += f""", t{k} AS MATERIALIZED (SELECT c, 2 * sum(CASE WHEN y = c THEN p ELSE 0 END) + 1e-5 AS top, sum(p + (y = c)::INT) + 1e-5 AS bottom FROM p{k} WHERE NOT held GROUP BY c), f{k} AS MATERIALIZED (SELECT i, max(CASE WHEN y = c THEN p END) AS pt FROM p{k} WHERE NOT held GROUP BY i),
l{k} AS (SELECT {k} AS round, avg(-(1 - pt) * (1 - pt) * ln(greatest(pt, 1e-7))) + 1 - (SELECT avg(top / bottom) FROM t{k}) AS loss FROM f{k}),
q{k} AS (SELECT i, c, p, (2 * (1 - pt) * ln(greatest(pt, 1e-7)) - (1 - pt) * (1 - pt) / pt) * pt * ((y = c)::INT - p) / n AS focal, top / (3 * bottom * bottom) - CASE WHEN y = c THEN 2 / (3 * bottom) ELSE 0 END AS q FROM p{k} JOIN f{k} USING (i) JOIN t{k} USING (c) CROSS JOIN n),
g{k} AS (SELECT i, c, focal + p * (q - sum(q * p) OVER (PARTITION BY i)) AS g FROM q{k}), d{k} AS (SELECT c, j, sum(g * x) AS g FROM g{k} JOIN fx USING (i) GROUP BY ALL),
a{k} AS (SELECT c, j, w, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m, 0.999::DOUBLE * v + 0.001::DOUBLE * g * g AS v FROM w{k} JOIN d{k} USING (c, j)),
w{k + 1} AS MATERIALIZED (SELECT c, j, w * (1 - {RATE}::DOUBLE * 1e-4) - {RATE}::DOUBLE * (m / (1 - 0.9::DOUBLE ** {k + 1})) / (sqrt(v / (1 - 0.999::DOUBLE ** {k + 1})) + 1e-8) AS w, m, v FROM a{k})"""
    rounds = " UNION ALL ".join(f"SELECT round, loss, iou FROM l{k} JOIN u{k} USING (round)" for k in range(ROUNDS))
    return f"{out}, h AS MATERIALIZED (SELECT round, loss, iou, iou >= coalesce(max(iou) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM ({rounds}))"


def _trained(spark, d):
    px = hazard.threshold_flood(hazard.terrain(tables.pixels(spark, d))).selectExpr("scene", *[f"{x} as {n}" for n, x in STACK.items()], f"{TARGET} as y")
    return inference.train(px.persist(), list(STACK), "y", F.expr(HELD_OUT), rounds=ROUNDS, rate=RATE)


@query(f"{_train_sql()} SELECT round, round(loss, 6) AS loss, round(iou, 6) AS iou, best FROM h")
def training_rounds(spark, d):
    """A pixel model's loss and held-out flood IoU by round."""
    rows = _trained(spark, d)[1]
    return spark.createDataFrame(rows, "round long, loss double, iou double, best boolean").select("round", F.round("loss", 6).alias("loss"), F.round("iou", 6).alias("iou"), "best")


_WEIGHTS = " UNION ALL ".join(f"SELECT {k} AS round, c, j, w FROM w{k + 1}" for k in range(ROUNDS))


@query(f"{_train_sql()} SELECT c AS class, j AS feature, round(w, 6) AS weight FROM ({_WEIGHTS}) WHERE round = (SELECT max(round) FROM h WHERE best)")
def trained_weights(spark, d):
    """The weights that did best on the held-out regions; the last feature is the bias."""
    w = _trained(spark, d)[0]
    return spark.createDataFrame([(c, j, float(w[c, j])) for c in range(w.shape[0]) for j in range(w.shape[1])], "class long, feature long, weight double").select("class", "feature", F.round("weight", 6).alias("weight"))


SEED = 11


def _uniform_sql(*parts: str) -> str:
    return f"""((('0x' || substr(md5('{SEED}:' || {" || ':' || ".join(f"({p})" for p in parts)}), 1, 13))::BIGINT + 0.5) / 4503599627370496)"""


def _normal_sql(*parts: str) -> str:
    return f"sqrt(-2 * ln({_uniform_sql(*parts, repr('a'))})) * cos(2 * pi() * {_uniform_sql(*parts, repr('b'))})"


_NOISY = ", ".join(f"round(CASE WHEN noisy THEN {c} + 0.5::DOUBLE * {_normal_sql('scene', 'r', 'c', repr(c))} ELSE {c} END, 6) AS {c}" for c in RADAR)


@query(f"""WITH {PX}, z AS (SELECT scene, max(r) + 1 AS h, max(c) + 1 AS w, {_uniform_sql('scene', repr('rows'))} > 0.5 AS fr, {_uniform_sql('scene', repr('columns'))} > 0.5 AS fc, floor({_uniform_sql('scene', repr('turns'))} * 4)::INT AS k, {_uniform_sql('scene', repr('noise'))} > 0.5 AS noisy FROM px GROUP BY scene),
f AS (SELECT px.*, h, w, k, noisy, CASE WHEN fr THEN h - 1 - r ELSE r END AS r1, CASE WHEN fc THEN w - 1 - c ELSE c END AS c1 FROM px JOIN z USING (scene)),
t AS (SELECT * EXCLUDE (r, c), CASE k WHEN 0 THEN r1 WHEN 1 THEN w - 1 - c1 WHEN 2 THEN h - 1 - r1 ELSE c1 END AS r, CASE k WHEN 0 THEN c1 WHEN 1 THEN r1 WHEN 2 THEN w - 1 - c1 ELSE h - 1 - r1 END AS c FROM f)
SELECT scene, r, c, {_NOISY} FROM t""")
def augmented_scenes(spark, d):
    """Scenes mirrored, turned and with radar noise, each by chance of its own."""
    out = raster.augment(tables.pixels(spark, d), RADAR, SEED)
    return out.select("scene", "r", "c", *[F.round(c, 6).alias(c) for c in RADAR])


@query(f"WITH {PX} SELECT scene, r, c, round(pre_vv + 0.5::DOUBLE * {_normal_sql('scene', 'r', 'c', repr('pre_vv'))}, 6) AS pre_vv FROM px")
def radar_noise(spark, d):
    """Speckle of 0.5 dB on every pixel."""
    noise = counters.normal(SEED, F.col("scene"), F.col("r"), F.col("c"), F.lit("pre_vv"))
    return tables.pixels(spark, d).select("scene", "r", "c", F.round(F.col("pre_vv") + 0.5 * noise, 6).alias("pre_vv"))


@query("SELECT vec_id // 64 AS tile, dense_rank() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS r, c, round(x, 6) AS value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings)")
def npy_tiles(spark, d):
    """Tiles of vectors written as .npy files, and their pixels read back from these."""
    npy.register(spark)
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null")
    tile = e.groupBy(F.expr("vec_id div 64").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    path = shared(spark)
    tile.select(F.concat(F.lit("tile_"), "tile").alias("name"), F.array(F.size("x"), F.size(F.col("x")[0]["embedding"])).alias("shape"), F.flatten("x.embedding").alias("values")).write.format("npy").mode("append").save(path)
    got = spark.read.format("npy").option("rows", "16").load(path)
    number = F.regexp_extract("file", r"tile_(\d+)\.npy$", 1).cast("long")
    return got.select(number.alias("tile"), F.col("place")[0].alias("r"), F.posexplode("values").alias("c", "x")).select("tile", "r", F.col("c").cast("long").alias("c"), F.round("x", 6).alias("value"))


#: The tables' files, as the comparison at this scale has them.
_FILES = "/root/testdata/sf0.01/*.parquet"


@query(f"SELECT parse_filename(filename) AS file, size::BIGINT AS length, sha256(content) AS sha256 FROM read_blob('{_FILES}')")
def input_hashes(spark, d):
    """SHA-256 of the input files."""
    return ingest.file_hashes(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")
