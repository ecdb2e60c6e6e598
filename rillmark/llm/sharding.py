"""Sharding by proportional stratified interleaving.

The rows of each stratum are put into a seeded random order and get the fractional rank
(position + offset) / size of the stratum, with a seeded offset from 0 to 1 for each stratum, so that
small strata do not all fall on the same ranks. Sorting all rows by that rank interleaves the strata
in proportion, and cutting the sorted order into equal runs gives shards that all match the mixture
and whose row counts differ by one at most (law `rows`).

Neither step sorts a stratum or the whole in one task: rows fall into value ranges of their random
key (then of their rank), the ranges are counted, a running sum over the small table of counts
gives each range's first position, and only the rows of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm._base import cut

#: Rows that one value range holds on average.
RANGE_ROWS = 4096


def _positions(df: DataFrame, group: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Adds the 0-based position of each row in its group's order, and <name>_of, the group's rows;
    bucket rises with that order."""
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy(*group)).alias(f"{name}_of")
    )
    same = F.col("_bucket") == F.col("_b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    rank = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order))
    ranked = df.withColumn("_in", rank - 1)
    return ranked.join(sizes, same).withColumn(name, F.col("_first") + F.col("_in")).drop("_bucket", "_b", "_first", "_in", *[f"_g_{g}" for g in group])


def stratified_shards(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard,
    and the stratum and fractional rank that placed it.

    Null text counts as empty; null strata are one stratum; rows with equal id and text are ordered
    among themselves arbitrarily, which changes no column; more than RANGE_ROWS of them are spread over
    their stratum's order by a hash of where they stand. An empty table gives no rows. Other
    columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        F.col(stratum_col).cast("string").alias("_s"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("_u", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long"))
    narrow = cut(narrow)
    total = narrow.count()
    ranges = max(1, total // RANGE_ROWS)
    width = (1 << 60) // ranges + 1
    # copies beyond a range's rows are told apart by their place in the checkpoint
    many = narrow.groupBy(F.col("_u").alias("_v"), F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > RANGE_ROWS)
    if not many.isEmpty():
        placed = narrow.withColumn("_place", F.monotonically_increasing_id()).join(many, (F.col("_u") == F.col("_v")) & F.col("_s").eqNullSafe(F.col("_t")), "left")
        own = F.shiftrightunsigned(F.xxhash64("_u", "_place"), 4)
        narrow = cut(placed.withColumn("_u", F.when(F.col("_copies").isNotNull(), own).otherwise(F.col("_u"))).drop("_place", "_v", "_t", "_copies"))
    ranked = _positions(narrow, ["_s"], F.expr(f"_u div {width}L"), ["_u", "_id", "size", "text_crc32"], "_rank")
    offset = (F.pmod(F.xxhash64("_s", F.lit(seed)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    ranked = ranked.withColumn("fraction", (F.col("_rank") + offset) / F.col("_rank_of")).withColumn("_all", F.lit(0))
    placed = _positions(ranked, ["_all"], F.floor(F.col("fraction") * ranges).cast("long"), ["fraction", "_u", "_s", "_id", "size", "text_crc32"], "_at")
    shard = F.expr(f"cast(_at * {shards}L div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_s").alias("stratum"),
        "fraction",
    )
