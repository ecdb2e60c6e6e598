"""Metadata of a run's inputs, and the guards that stop a run on bad ones."""

from __future__ import annotations

import datetime
import fnmatch
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.sources.npy import opened

#: Bytes of a file that a task holds.
CHUNK = 1 << 20
#: Fixed value: optical scenes with more cloud (per cent) are left out.
MAX_CLOUD = 35.0


def check_bbox(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    """The box, if it is one: longitudes and latitudes in range, west before east, south before north."""
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("west must lie before east, south before north, both on the globe")
    return west, south, east, north


def parse_numbers(text: str, n: int) -> tuple[float, ...]:
    """A box (4) or point (2) written as numbers with commas."""
    out = tuple(float(x) for x in text.split(","))
    if len(out) != n:
        raise ValueError(f"{n} numbers with commas are wanted")
    return out


def check_snapshot(snapshot: str, flood_date: str) -> None:
    """The map must be older than the flood; a later one would leak what it damaged."""
    if datetime.date.fromisoformat(snapshot) >= datetime.date.fromisoformat(flood_date):
        raise ValueError("the map snapshot must be earlier than the flood")


def valid_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """`check_bbox` over rows."""
    return west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90) & (west < east) & (south < north)


def cache_key(west: Column, south: Column, east: Column, north: Column, day: Column, version: str = "v1") -> Column:
    """A name for the inputs of a box and day, coordinates to four places."""
    return F.concat_ws("_", F.lit("cache"), *[F.bround(x, 4).cast("string") for x in (west, south, east, north)], day.cast("string"), F.lit(version))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files of any size, empty ones too: the driver lists names, a task opens its
    files one after another and holds a chunk. Names and bytes come through pyarrow's file systems."""
    system, top = opened(path)
    found = [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    files = spark.createDataFrame(found, "path string, length long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                digest = hashlib.sha256()
                with opened(path)[0].open_input_stream(one) as f:
                    while chunk := f.read(CHUNK):
                        digest.update(chunk)
                yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([length], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "length", "sha256"])

    return files.repartition("path").mapInArrow(work, "path string, length long, sha256 string")


def cloud_gate(scenes: DataFrame, cloud: str = "cloud_cover", most: float = MAX_CLOUD) -> DataFrame:
    """Adds used and warning (s2_cloudy where the cover exceeds the limit)."""
    over = F.col(cloud) > most
    return scenes.withColumn("used", ~over).withColumn("warning", F.when(over, "s2_cloudy"))


def snapshot_counts(buildings: DataFrame, roads: DataFrame, hospitals: DataFrame) -> DataFrame:
    """One row: buildings, road_km, bridges and hospitals of a map snapshot."""
    from rillmark.functions.expressions import km

    r = roads.agg(km(F.sum("length_m")).alias("road_km"), F.count_if("is_bridge").alias("bridges"))
    return buildings.agg(F.count(F.lit(1)).alias("buildings")).crossJoin(r).crossJoin(hospitals.agg(F.count(F.lit(1)).alias("hospitals")))


def request(body: Column) -> Column:
    """A run request in JSON as a struct: west, south, east, north, flood_date, use_baseline, with defaults
    for what it lacks, and refused: whether it is no JSON object or has a day that cannot be read."""
    x = F.from_json(body, "bbox struct<west: double, south: double, east: double, north: double>, flood_date string, use_baseline boolean, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    day = F.to_date(F.try_to_timestamp(x["flood_date"], F.lit("yyyy-MM-dd")))
    default = {"west": 85.2, "south": 27.9, "east": 85.4, "north": 28.1}
    sides = [F.coalesce(x["bbox"][k], F.lit(v)).alias(k) for k, v in default.items()]
    refused = body.isNull() | x["_bad"].isNotNull() | (x["flood_date"].isNotNull() & day.isNull())
    return F.struct(*sides, F.coalesce(day, F.lit("2026-08-26").cast("date")).alias("flood_date"), F.coalesce(x["use_baseline"], F.lit(False)).alias("use_baseline"), F.coalesce(refused, F.lit(True)).alias("refused"))


def scene_box(geo: DataFrame) -> DataFrame:
    """(scene, bbox): the outer edges of each scene's pixels."""
    west, north = F.col("lon_min") - F.col("px_w") / 2, F.col("lat_max") + F.col("px_h") / 2
    east, south = F.col("lon_min") + (F.col("cols") - 0.5) * F.col("px_w"), F.col("lat_max") - (F.col("rows") - 0.5) * F.col("px_h")
    return geo.select("scene", F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north")).alias("bbox"))


def dem_tiles(geo: DataFrame) -> DataFrame:
    """(scene, tile): the terrain tiles of one degree, named by their south-west corner, that a scene touches."""
    side = lambda a, b: F.sequence(F.floor(f"bbox.{a}"), F.floor(f"bbox.{b}"))
    corner = scene_box(geo).withColumn("x", F.explode(side("west", "east"))).withColumn("y", F.explode(side("south", "north")))
    name = lambda x, plus, minus, n: F.concat(F.when(F.col(x) >= 0, plus).otherwise(minus), F.lpad(F.abs(x).cast("string"), n, "0"))
    return corner.select("scene", F.concat(name("y", "N", "S", 2), F.lit("_"), name("x", "E", "W", 3)).alias("tile"))


def setting(config: Column, path: str) -> Column:
    """A value of a JSON configuration by its dotted path."""
    return F.get_json_object(config, f"$.{path}")


def acquisition_day(*columns: str) -> Column:
    """The day of the first of several time columns that is set."""
    return F.to_date(F.coalesce(*map(F.col, columns)))
