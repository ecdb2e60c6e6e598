"""Labels of connected pixels, and shortest distances, by rounds over written tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators.checkpoints import bucketed, cut, forget

#: Rows and columns of a tile that one task labels at once.
TILE = 128
#: Bits of a pixel number that hold its column.
WIDE = 31
#: Nodes that came nearer in a round and are broadcast at most; more are shuffled to the edges' buckets.
BROADCAST_FRONT = 100_000
#: Rounds of changes that are kept apart before they are merged into one table.
MERGE = 6
#: Edges that take one pass of rounds at most; of more, the share that the first of two passes has.
FEW_EDGES, SHORT = 1_000_000, 0.25
#: Hubs that are broadcast at most; of more, edges go both ways in rounds of single steps.
BROADCAST_HUBS = 500_000
#: Nodes whose shortest way may be missing after the first pass and that are broadcast at most.
BROADCAST_FAR = 500_000
#: Stands for no way; lengths of ways are below it.
FARTHEST = 2**63 - 1


def label_tile(mask: np.ndarray) -> np.ndarray:
    """The smallest flat index of each set pixel's component of four neighbours (-1: not set).
    Runs of rows and of columns take their smallest label in turn until nothing changes."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), -1)
    lines = []
    for turned in (False, True):
        m = mask.T if turned else mask
        at = np.flatnonzero(m.ravel())
        width = m.shape[1]
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (at[1:] % width == 0)
        flat = (at % width) * w + at // width if turned else at  # places in the upright tile
        lines.append((flat, np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(at)))))
    out = label.ravel()
    if not len(lines[0][0]):
        return label
    while True:
        before = out.copy()
        for at, start, size in lines:
            out[at] = np.repeat(np.minimum.reduceat(out[at], start), size)
        some = lines[0][0]
        out[some] = out[out[some]]
        if (out == before).all():
            return out.reshape(h, w)


def _label_tiles(mask: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Rows (keys, r, c, ...) with label, where components end at tile borders."""
    rest = [x for x in mask.columns if x not in keys]
    tiles = mask.groupBy(*keys, F.expr(f"r div {tile}").alias("_tr"), F.expr(f"c div {tile}").alias("_tc")).agg(F.collect_list(F.struct(*rest)).alias("p"))
    tiles = tiles.select(F.struct(*keys).alias("k"), "_tr", "_tc", "p")
    schema = T.StructType([tiles.schema["k"], tiles.schema["p"], T.StructField("label", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = []
            for tr, tc, p in zip(batch.column("_tr").to_pylist(), batch.column("_tc").to_pylist(), batch.column("p"), strict=True):
                r, c = (np.asarray(p.values.field(x), np.int64) for x in ("r", "c"))
                square = np.zeros((tile, tile), bool)
                square[r - tr * tile, c - tc * tile] = True
                own = label_tile(square)[r - tr * tile, c - tc * tile]
                labels.append((own // tile + tr * tile << WIDE) + own % tile + tc * tile)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("p"), pa.array(labels, pa.list_(pa.int64()))], names=["k", "p", "label"])

    out = tiles.mapInArrow(work, schema).select("k.*", F.explode(F.arrays_zip("p", "label")).alias("x"))
    return out.select(*keys, "x.p.*", "x.label")


def _smallest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, root): the smallest node reachable, of nodes in edges (keys, u, v). Each round takes
    the neighbours' smallest root, then that root's own, so rounds grow with the logarithm of a path."""
    both = cut(edges.union(edges.select(*keys, "v", "u")).distinct())
    state = cut(both.select(*keys, "u").distinct().withColumn("root", F.col("u")))
    while True:
        seen = both.join(state.select(*keys, F.col("u").alias("v"), F.col("root").alias("l")), [*keys, "v"]).groupBy(*keys, "u").agg(F.min("l").alias("l"))
        near = state.join(seen, [*keys, "u"]).select(*keys, "u", F.col("root").alias("old"), F.least("root", "l").alias("root"))
        jump = near.select(*keys, F.col("u").alias("root"), F.col("root").alias("far"))
        new = cut(near.join(jump, [*keys, "root"]).select(*keys, "u", "old", F.least("root", "far").alias("root")))
        moved = new.where("old <> root").limit(1).count()
        forget(state)
        state = new
        if not moved:
            forget(both)
            return state.select(*keys, "u", "root")


def label(mask: DataFrame, keys: Sequence[str] = ("scene",), tile: int = TILE) -> DataFrame:
    """Rows (keys, r, c, ...) of set pixels with `label`, the smallest pixel number r * 2**31 + c of its
    component of four neighbours (so scenes may have 2**31 columns and 2**32 rows). Tiles are labelled apart; only labels that meet at a border take
    part in rounds."""
    keys = list(keys)
    local = cut(_label_tiles(mask, keys, tile))
    if local.where(F.greatest(F.col("r") % tile, F.col("c") % tile) == tile - 1).isEmpty():
        return local  # no component reaches the end of a tile
    edges = None
    for axis, other in (("r", "c"), ("c", "r")):
        end = local.where(F.col(axis) % tile == tile - 1).select(*keys, (F.col(axis) + 1).alias(axis), other, F.col("label").alias("u"))
        meet = end.join(local.where(F.col(axis) % tile == 0).select(*keys, axis, other, F.col("label").alias("v")), [*keys, axis, other]).select(*keys, "u", "v")
        edges = meet if edges is None else edges.union(meet)
    roots = _smallest(edges.distinct(), keys).withColumnRenamed("u", "label")
    out = local.join(roots, [*keys, "label"], "left").withColumn("label", F.coalesce("root", "label"))
    return out.select(*local.columns)


def extents(px: DataFrame) -> DataFrame:
    """(scene, last_r, last_c)."""
    return px.groupBy("scene").agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))


def holes(background: DataFrame, size: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """The rows (keys, r, c, ...) of background pixels that no way of four neighbours joins to the
    scene's border."""
    keys = list(keys)
    labels = label(background, keys).join(size, "scene")
    edge = F.expr("r = 0 or c = 0 or r = last_r or c = last_c")
    inner = labels.groupBy(*keys, "label").agg(F.max(edge).alias("outer")).where("not outer").select(*keys, "label")
    return labels.join(inner, [*keys, "label"]).select(*background.columns)


def fill_holes(px: DataFrame, mask: str) -> DataFrame:
    """Background that the border does not reach becomes set: adds <mask>_filled."""
    px = cut(px)  # read several times below
    found = holes(px.where(f"not {mask}").select("scene", "r", "c"), extents(px)).withColumn("hole", F.lit(True))
    return px.join(found, ["scene", "r", "c"], "left").withColumn(f"{mask}_filled", F.col(mask) | F.coalesce("hole", F.lit(False))).drop("hole")


def keep_components(px: DataFrame, mask: str, name: str, *, min_size: int = 0, touching: str | None = None) -> DataFrame:
    """Adds a mask without components that are too small or touch no pixel of another mask. A scene
    in which that other mask has no pixel keeps its components."""
    px = cut(px)  # read several times below
    labels = label(px.where(mask).select("scene", "r", "c", *([touching] if touching else [])))
    touch = F.max(F.col(touching)) if touching else F.lit(True)
    sizes = labels.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("n"), touch.alias("t"))
    if touching:
        sizes = sizes.join(px.groupBy("scene").agg(F.max(F.col(touching)).alias("any")), "scene").withColumn("t", F.expr("t or not any"))
    kept = labels.join(sizes.where(f"n >= {min_size} and t"), ["scene", "label"]).select("scene", "r", "c", F.lit(True).alias(name))
    return px.join(kept, ["scene", "r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def clean_masks(px: DataFrame, limits: dict[str, float], *, connected: Sequence[str] = (), river: str = "river", near_river: str = "near_river", hand: str = "hand_m", min_size: int = 8) -> DataFrame:
    """Adds <mask>_clean for each mask of `limits`: holes filled, components under `min_size` pixels
    dropped, those of `connected` masks that touch no pixel near a river dropped (unless the scene
    has no river), pixels higher above the river than the mask's limit dropped. All masks go through
    the same two labellings."""
    px = cut(px)
    masks = list(limits)
    keys = ["scene", "mask"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col(m).alias("on")) for m in masks])).alias("m")
    long = px.select("scene", "r", "c", F.col(near_river).alias("near"), F.col(hand).alias("height"), each).select("scene", "m.mask", "r", "c", "near", "height", "m.on")
    filled = long.where("on").drop("on").union(holes(long.where("not on").drop("on"), extents(px), keys))
    there = label(filled, keys)
    wet = px.groupBy("scene").agg(F.max(F.col(river)).alias("wet"))
    part = there.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("touches")).join(wet, "scene")
    part = part.where((F.col("n") >= min_size) & (F.col("touches") | ~F.col("wet") | ~F.col("mask").isin(*connected))).select(*keys, "label")
    limit = F.coalesce(*[F.when(F.col("mask") == m, F.lit(float(x))) for m, x in limits.items()])
    kept = there.join(part, [*keys, "label"]).where(F.col("height") <= limit)
    wide = kept.groupBy("scene", "r", "c").agg(*[F.max(F.col("mask") == m).alias(f"{m}_clean") for m in masks])
    return px.join(wide, ["scene", "r", "c"], "left").fillna(False, [f"{m}_clean" for m in masks])


def _merged(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    ways = [c for c in out.columns if c not in (*keys, "node")]
    return out.groupBy(*keys, "node").agg(*[F.min(c).alias(c) for c in ways])


def reached(front: DataFrame, both: DataFrame, keys: Sequence[str], few: bool, closed: Sequence[str] = ()) -> DataFrame:
    """(keys, node, dist): what is one edge from the front (keys, node, dist), and dist_<c> for each `closed` c
    from the front's dist_<c> over edges that are not c. `both` holds every edge in both directions, bucketed by
    the hash of its first node; whether the front is broadcast or shuffled to these buckets, the edges stay
    where they are, and are not sorted."""
    ways = ["dist", *[f"dist_{c}" for c in closed]]
    near = front.select(F.xxhash64(*keys, "node").alias("_f"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("node").alias("_from"), *[F.col(w).alias(f"_{w}") for w in ways])
    # equal hashes are checked on each match; as an equality it would be one more key, and the buckets no use
    same = F.col("_h") == F.col("_f")
    for mine, other in [(k, f"_k_{k}") for k in keys] + [("a", "_from")]:
        same = same & ~(F.col(mine) < F.col(other)) & ~(F.col(mine) > F.col(other))
    joined = both.join(F.broadcast(near) if few else near.hint("shuffle_hash"), same)
    far = [F.col("_dist") + F.col("length"), *[F.when(~F.col(c), F.col(f"_dist_{c}") + F.col("length")) for c in closed]]
    return joined.groupBy(*keys, F.col("b").alias("node")).agg(*[F.min(x).alias(w) for w, x in zip(ways, far, strict=True)])


def _either(edges: DataFrame, keys: list[str], closed: list[str]) -> DataFrame:
    return edges.select(*keys, "a", "b", "length", *closed).union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "length", *closed))


def _rounds(tables: list[DataFrame], either: DataFrame, keys: list[str], closed: list[str]) -> list[DataFrame]:
    """Rounds over edges in both directions, from the nodes of `tables`, until no node comes nearer. Gives tables whose
    smallest ways are the answer. Edges are written once, bucketed by node, and no round shuffles them. A round
    writes only the nodes that came nearer; these tables are merged every few rounds."""
    ways = ["dist", *[f"dist_{c}" for c in closed]]
    both = bucketed(either.withColumn("_h", F.xxhash64(*keys, "a")), "_h")
    tables, front = list(tables), tables[-1]
    while size := front.count():
        known = _merged(tables, keys).select(*keys, "node", *[F.col(w).alias(f"was_{w}") for w in ways])
        reach = reached(front, both, keys, size <= BROADCAST_FRONT, closed)
        nearer = {w: F.when(F.col(f"was_{w}").isNull() | (F.col(w) < F.col(f"was_{w}")), F.col(w)) for w in ways}
        new = reach.join(known, [*keys, "node"], "left").select(*keys, "node", *[x.alias(w) for w, x in nearer.items()])
        front = cut(new.where(F.coalesce(*ways).isNotNull()))
        tables.append(front)
        if len(tables) > MERGE:
            merged = cut(_merged(tables, keys))
            forget(*tables[:-1])
            tables = [merged, front]
    forget(both)
    return tables


def _over(edges: DataFrame, near: DataFrame, keys: list[str], side: str, closed: list[str]) -> DataFrame:
    """`edges` that meet `near` (keys, node, ways) at their `side`, with the way to their other end; near is broadcast at
    `a`, and meets buckets of `b` in place."""
    ways = ["dist", *[f"dist_{c}" for c in closed]]
    own = near.select(*([F.xxhash64(*keys, "node").alias("_f")] if side == "b" else []), *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("node").alias("_from"), *[F.col(w).alias(f"_{w}") for w in ways])
    pairs = [(k, f"_k_{k}") for k in keys] + [(side, "_from")]
    if side == "a":
        joined = edges.join(F.broadcast(own), [F.col(x) == F.col(y) for x, y in pairs])
    else:
        same = F.col("_h") == F.col("_f")  # as in `reached`
        for x, y in pairs:
            same = same & ~(F.col(x) < F.col(y)) & ~(F.col(x) > F.col(y))
        joined = edges.join(own.hint("shuffle_hash"), same)
    far = [F.col("_dist") + F.col("length"), *[F.when(~F.col(c), F.col(f"_dist_{c}") + F.col("length")) for c in closed]]
    return joined.select(*edges.columns, *[x.alias(w) for w, x in zip(ways, far, strict=True)])


def _hub_rounds(known: DataFrame, hubs: DataFrame | None, edges: DataFrame, keys: list[str], closed: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Rounds over edges from few nodes a, the hubs, to other nodes b, from the nodes of `known`. Edges are written once,
    bucketed by b. A round goes from the hubs that came nearer, which are broadcast, to all b and back to
    hubs; ways to b are not moved, and only those to hubs are written. `hubs` are known ways to hubs. Gives tables whose
    smallest ways are the answer, and the ways to hubs."""
    ways = ["dist", *[f"dist_{c}" for c in closed]]
    edges = bucketed(edges.withColumn("_h", F.xxhash64(*keys, "b")), "_h")

    def least(far: DataFrame, *by: str) -> DataFrame:
        return far.groupBy(*by).agg(*[F.min(w).alias(w) for w in ways]).where(F.coalesce(*ways).isNotNull())

    first = least(_over(edges, known, keys, "b", closed), *keys, "a").withColumnRenamed("a", "node")
    front = state = cut(_merged([first, known if hubs is None else hubs], keys))
    while not front.isEmpty():
        there = least(_over(edges, front, keys, "a", closed), "_h", *keys, "b").withColumnRenamed("b", "node")
        back = least(_over(edges, there, keys, "b", closed), *keys, "a").withColumnRenamed("a", "node")
        was = state.select(*keys, "node", *[F.col(w).alias(f"was_{w}") for w in ways])
        nearer = [F.when(F.col(f"was_{w}").isNull() | (F.col(w) < F.col(f"was_{w}")), F.col(w)).alias(w) for w in ways]
        front = cut(back.join(was, [*keys, "node"], "left").select(*keys, "node", *nearer).where(F.coalesce(*ways).isNotNull()))
        state = cut(_merged([state, front], keys))
    rest = cut(least(_over(edges, state, keys, "a", closed), *keys, "b").withColumnRenamed("b", "node"))
    forget(edges)
    return [known, state, rest], state


def shortest_ends(edges: DataFrame, keys: Sequence[str] = (), closed: Sequence[str] = ()) -> DataFrame:
    """(keys, node, least_dist, least_dist_<c>): the shortest edge of each node, and the shortest that is not c
    (null: none), of edges (keys, a, b, length, c)."""
    each = [edges.select(*keys, F.col(x).alias("node"), "length", *closed) for x in "ab"]
    return each[0].union(each[1]).groupBy(*keys, "node").agg(*least_open(F.col("length"), closed))


def least_open(length: Column, closed: Sequence[str]) -> list[Column]:
    return [F.min(length).alias("least_dist"), *[F.min(F.when(~F.col(c), length)).alias(f"least_dist_{c}") for c in closed]]


def distances(edges: DataFrame, sources: DataFrame, keys: Sequence[str] = (), closed: Sequence[str] = (), ends: DataFrame | None = None, two_sided: bool = False) -> DataFrame:
    """Shortest length from the nearest source (keys, node) over undirected edges (keys, a, b, length),
    as (keys, node, dist), and dist_<c> over the edges without those that are c, for each boolean c of
    `closed` (null: no way). Lengths are 0 or more. `ends` are the edges' `shortest_ends`, if at hand. `two_sided`
    says that no node is the a of one edge and the b of another; few nodes a then are the hubs of the rounds.

    Many edges take two passes of rounds. The first has those up to `SHORT` of all in length: a way found in it that is
    no longer than its longest edge is shortest, as any other holds a longer edge. Of all edges the second has those that lead to
    other nodes and are shorter than the way there; a shortest way that is still missing has no other ones
    where it comes nearer. Many edges should be written before, as they are read several times."""
    keys, closed = list(keys), list(closed)
    ways = ["dist", *[f"dist_{c}" for c in closed]]
    edges = edges.select(*keys, "a", "b", "length", *closed)
    zero = F.lit(0).cast(dict(edges.dtypes)["length"])
    start = cut(sources.select(*keys, "node").distinct().select(*keys, "node", *[zero.alias(w) for w in ways]))
    by_hubs = two_sided and edges.select(*keys, "a").distinct().count() <= BROADCAST_HUBS

    def rounds(known: DataFrame, some: DataFrame, hubs: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame | None]:
        return _hub_rounds(known, hubs, some, keys, closed) if by_hubs else (_rounds([known], _either(some, keys, closed), keys, closed), None)

    if edges.count() <= FEW_EDGES:
        return _merged(rounds(start, edges)[0], keys)
    heads = cut(start.select(*keys).distinct()) if keys else None
    longest = edges.agg(F.percentile_approx("length", SHORT)).first()[0]
    short, hubs = rounds(start, edges.where(F.col("length") <= longest))
    known = cut(_merged(short, keys))
    ends = shortest_ends(edges, keys, closed) if ends is None else ends
    ends = ends.join(F.broadcast(heads), keys, "left_semi") if keys else ends  # elsewhere nothing is reached
    late = {w: F.col(f"least_{w}").isNotNull() & (F.col(w).isNull() | (F.col(w) > longest) & (F.col(f"least_{w}") < F.col(w))) for w in ways}
    far = ends.join(known, [*keys, "node"], "left").select(*keys, "node", *[F.when(x, F.coalesce(w, F.lit(FARTHEST))).otherwise(zero).alias(f"_{w}") for w, x in late.items()])
    far = cut(far.where(" or ".join(f"_{w} > 0" for w in ways)))
    size = far.count()
    if not size:
        return known
    useful = lambda end: F.coalesce(F.greatest(F.col("length") < F.col(f"_dist{end}"), *[~F.col(c) & (F.col("length") < F.col(f"_dist_{c}{end}")) for c in closed], F.lit(False)), F.lit(False))
    rest = edges
    for end in "ab":
        at = far.select(*keys, F.col("node").alias(end), *[F.col(f"_{w}").alias(f"_{w}{end}") for w in ways])
        rest = rest.join(F.broadcast(at) if size <= BROADCAST_FAR else at, [*keys, end], "left")
    tables, _ = rounds(known, rest.where(useful("a") | useful("b")).select(*edges.columns), hubs)
    forget(far)
    return _merged(tables, keys)
