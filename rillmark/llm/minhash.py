"""Near-duplicate groups by MinHash bands and odd sketches.

1. Each text's shingle set gets `bands * rows` MinHash values. The bands are the candidate search;
   the same values, folded into a parity bitmap (an odd sketch: value i flips one bit), are the
   verifier: the population count of two sketches' XOR estimates how many values differ.
2. Texts with equal shingle sets are one class from here on, so copies cost nothing more.
3. Classes that share a band are joined to families (a star per band, then connected components).
4. Each family's classes meet with their full shingle sets. Pairs whose sketches rule the similarity
   out are dropped; the others are confirmed on the full sets, unless links already found connect
   them, so a family yields fewer links than classes. A large family is dealt out in blocks, its hub
   to each of them. Only where that leaves it in several components do blocks meet in pairs: those of
   the classes outside the largest component with one another and with the largest component's.
5. Connected components of the confirmed links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import as_bytes, cut, flat, pieces, small_batches, text_key
from rillmark.llm.graph import components
from rillmark.llm.textbytes import mix, shingles, word_table, words

#: With 40 bands of 6 values, a pair at similarity 0.8 shares no band with probability 6e-6.
BANDS, ROWS = 40, 6
SKETCH_BITS = 1024
#: Classes of a family, and shingles in their sets, that one task compares with one another: 16 MB of
#: hashes, or one set that is larger by itself with what shares its block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Classes that a task remembers, to read repeated rows once.
SEEN = 1 << 18
#: Classes, of under 250 bytes, that are broadcast at most.
BROADCAST_ROWS = 40_000
WORD = word_table(b" \t\n\x0b\x0c\r")
_MULTIPLIERS = np.random.default_rng(20240501).integers(0, 2**32, size=(2, 512), dtype=np.uint64).astype(np.uint32)
_MULTIPLIERS[0] |= 1


def signatures(h: np.ndarray, offsets: np.ndarray, values: int) -> np.ndarray:
    """MinHash values (rows: non-empty sets, columns: functions) of the hash runs h[offsets[i]:offsets[i + 1]]."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, values), np.uint32)
    v = np.empty_like(x)
    starts = offsets[:-1]
    for i in range(values):
        np.multiply(x, _MULTIPLIERS[0, i], out=v)
        np.add(v, _MULTIPLIERS[1, i], out=v)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def odd_sketch(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit words."""
    n, k = sig.shape
    at = (mix(sig.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(k, dtype=np.uint64)) >> np.uint64(20)) % np.uint64(bits)
    flips = np.zeros((n, bits), np.uint8)
    np.add.at(flips, (np.repeat(np.arange(n), k), at.astype(np.int64).ravel()), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view(np.uint64)


def estimate(distance: np.ndarray, values: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """The similarity that a count of differing bits stands for."""
    return 1 + bits / (4 * values) * np.log(np.maximum(1 - 2 * distance / bits, 1e-9))


def farthest(threshold: float, values: int, bits: int = SKETCH_BITS) -> int:
    """The most differing bits that a pair at the threshold has, but for chances under one in a million."""
    j = threshold - 5 * math.sqrt(threshold * (1 - threshold) / values)
    mean = bits / 2 * (1 - math.exp(-4 * values * (1 - max(j, 0)) / bits))
    return math.ceil(mean + 3 * math.sqrt(mean))


def _ordered_sets(h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


_SIG = "_id long, _k1 long, _k2 long, row long, n long, s1 long, s2 long, bands array<long>, sketch binary"


def _sign(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Signatures of rows; `row` tells rows apart that are equal in id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = flat(batch.column("_text"))
            for i, j in pieces(offsets):
                h, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORD)
                h, at = shingles(h, at, width)
                sets = _ordered_sets(h, at)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                flat_sets = np.concatenate([sets[k] for k in full]) if len(full) else np.zeros(0, np.uint64)
                ends = np.concatenate([[0], np.cumsum(size[full])])
                s1, s2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                keys, sketches = [None] * (j - i), [None] * (j - i)
                if len(full):
                    s1[full] = np.add.reduceat(mix(flat_sets.copy()), ends[:-1]).view(np.int64)
                    s2[full] = np.add.reduceat(mix(flat_sets ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1]).view(np.int64)
                    sig = signatures(flat_sets, ends, bands * rows)
                    band = np.zeros((len(full), bands), np.uint64)
                    for r in range(rows):
                        band = mix(band ^ (sig[:, r::rows].astype(np.uint64) + np.uint64(1) + (np.arange(bands, dtype=np.uint64) << np.uint64(40))))
                    sk = odd_sketch(sig)
                    for k, row in enumerate(full):
                        keys[row], sketches[row] = band[k].view(np.int64), sk[k].tobytes()
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_k1"), part.column("_k2"), pa.array(np.arange(number, number + j - i)), pa.array(size), pa.array(s1), pa.array(s2), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["_id", "_k1", "_k2", "row", "n", "s1", "s2", "bands", "sketch"],
                )
                number += j - i

    return df.mapInArrow(work, _SIG)


def _shingle_sets(df: DataFrame, width: int) -> DataFrame:
    """(family, rep, text, sketch) to (family, rep, set, sketch): the sorted hashes as bytes. Rows equal
    in id and text bring their class more than once; a task reads it once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own = []
            for rep in batch.column("rep").to_pylist():
                own.append(rep not in seen)
                seen.add(rep)
            if len(seen) > SEEN:
                seen = set()
            batch = batch.filter(pa.array(own, pa.bool_()))
            data, offsets = flat(batch.column("_text"))
            for i, j in pieces(offsets):
                h, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORD)
                h, at = shingles(h, at, width)
                part = batch.slice(i, j - i)
                sets = pa.array([s.tobytes() for s in _ordered_sets(h, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("family"), part.column("rep"), sets, part.column("sketch")], names=["family", "rep", "set", "sketch"])

    return df.mapInArrow(work, "family long, rep long, set binary, sketch binary")


def links_in_block(reps: list[int], sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray | None, percent: int, most: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links of at least `percent` per cent similarity connect. With
    `side`, only classes of different sides are compared; classes of equal `known` components count
    as connected. Each class is compared by sketch with all later ones that no link connects to it
    yet, and on the full sets where the sketches allow a link."""
    m = len(reps)
    if m < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.zeros(int(ids.max()) + 1, np.int8)
    group = np.arange(m) if known is None else np.unique(np.array(known), return_inverse=True)[1]
    out = []
    for u in range(m - 1):
        rest = np.arange(u + 1, m)
        rest = rest[group[rest] != group[u]]
        if side is not None:
            rest = rest[side[rest] != side[u]]
        # no more than the smaller set can be shared, no less than the larger is in the union
        a, b = np.minimum(size[rest], size[u]), np.maximum(size[rest], size[u])
        rest = rest[100 * a >= percent * b]
        if len(rest):
            rest = rest[np.bitwise_count(sketches[rest] ^ sketches[u]).sum(axis=1) <= most]
        if not len(rest):
            continue
        own[ids[ends[u] : ends[u + 1]]] = 1
        take = np.concatenate([ids[ends[k] : ends[k + 1]] for k in rest])
        starts = np.concatenate([[0], np.cumsum(size[rest])[:-1]])
        both = np.add.reduceat(own[take].astype(np.int64), starts)
        own[ids[ends[u] : ends[u + 1]]] = 0
        for k in rest[100 * both >= percent * (size[rest] + size[u] - both)]:
            if group[k] != group[u]:
                group[group == group[k]] = group[u]
                out.append((reps[u], reps[k]))
    return out


def _confirm(df: DataFrame, percent: int, most: int) -> DataFrame:
    """Rows of one task (family, lo, hi, block, comp, rep, set, sketch) come sorted; links go out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, there = None, [], set()

        def done() -> pa.RecordBatch:
            rows = sorted(held, key=lambda r: (-len(r[2]), r[0]))
            side = np.array([r[1] for r in rows]) if key and key[1] != key[2] else None
            got = links_in_block([r[0] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows], np.array([np.frombuffer(r[3], np.uint64) for r in rows]), side, percent, most, [r[4] for r in rows]) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            for family, lo, hi, block, comp, rep, one, sketch in zip(*(batch.column(c).to_pylist() for c in ("family", "lo", "hi", "block", "comp", "rep", "set", "sketch")), strict=True):
                if (family, lo, hi) != key:
                    yield done()
                    key, held, there = (family, lo, hi), [], set()
                if rep not in there:
                    there.add(rep)
                    held.append((rep, block, one, sketch, comp))
        yield done()

    parts = df.select("family", "lo", "hi", "block", "comp", "rep", "set", "sketch").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    return parts.mapInArrow(work, "a long, b long")


def _blocks(classes: Column, shingles: Column, block: int) -> Column:
    """Blocks for so many classes with so many shingles in all."""
    return F.greatest(F.ceil(classes / block), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1).cast("long"))


def _across_blocks(sets: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Rows (family, rep, set, sketch) of large families, dealt out so that each pair of classes of
    different components meets in a task. `roots` (family, rep, comp, size) are what is linked so far."""
    parts = roots.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("family").agg(F.max(F.struct("n", "comp", "size")).alias("top"), F.sum("n").alias("all"), F.sum("size").alias("sizes"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    outer, inner = _blocks(F.col("all") - F.col("top.n"), F.col("sizes") - F.col("top.size"), block), _blocks(F.col("top.n"), F.col("top.size"), block)
    whole = whole.select(F.col("family").alias("f"), F.col("top.comp").alias("largest"), outer.alias("outer"), inner.alias("inner"))
    known = roots.select(F.col("family").alias("g"), F.col("rep").alias("k"), "comp").join(whole, F.col("g") == F.col("f"))
    rows = sets.join(known, (F.col("family") == F.col("g")) & (F.col("rep") == F.col("k")))
    # outer blocks are numbered from 0, those of the largest component after them
    big = F.col("comp") == F.col("largest")
    own = F.when(big, F.col("outer") + F.pmod(F.xxhash64("rep", F.lit(1)), F.col("inner"))).otherwise(F.pmod(F.xxhash64("rep", F.lit(1)), F.col("outer")))
    most = F.when(big, F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    return rows.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "comp", "rep", "set", "sketch")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """One row per document row: _id, _k1, _k2, n (shingles), rep (class_id), component, and where n
    is over 0 `grp`, which names the group whether its ids are null or not."""
    small_batches(docs.sparkSession)
    rows_in = docs.select(F.col(id_col).cast("long").alias("_id"), *text_key(text_col), as_bytes(text_col).alias("_text"))
    sig = cut(_sign(rows_in, width, bands, rows))
    classes = sig.where("n > 0").groupBy("s1", "s2").agg(F.min("_id").alias("rep"), F.min("n").alias("size"), F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "row")).alias("one"))
    # a class is named by its smallest id, or by its key where all ids are null
    classes = classes.select("s1", "s2", "rep", "size", F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"), F.col("one.row").alias("leads"), F.xxhash64("s1", "s2").alias("cls"))
    classes = cut(classes)
    # one row for each class, however many are equal in id and text
    lead = sig.where("n > 0").join(classes.drop("s1", "s2"), F.col("row") == F.col("leads"))
    lead = lead.select("cls", "rep", "k1", "k2", "bands", "sketch")
    banded = lead.select("cls", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    edges = banded.join(stars, "band").select("cls", "hub").where("cls <> hub")
    family = components(edges, "cls", "hub")
    family = cut(family.select(F.col("node").alias("m"), F.col("root").alias("family")).union(family.select("root", "root").distinct()))
    members = lead.join(family.select("m", "family"), F.col("cls") == F.col("m")).select("family", "cls", "rep", "k1", "k2", "sketch")

    def sets_of(some: DataFrame, few: bool = False) -> DataFrame:
        texts = rows_in.join(F.broadcast(some) if few else some, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
        return _shingle_sets(texts.select("family", F.col("cls").alias("rep"), "_text", "sketch"), width)

    family = cut(family.join(classes.select(F.col("cls").alias("c"), "size"), F.col("m") == F.col("c")).drop("c"))
    sizes = family.groupBy("family").agg(_blocks(F.count(F.lit(1)), F.sum("size"), block).alias("blocks")).withColumnRenamed("family", "f")
    # the hub, whose number is the family's, joins each block
    own = F.array(F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")))
    dealt = sets_of(members).join(sizes, F.col("family") == F.col("f")).withColumn("block", F.explode(F.when(F.col("rep") == F.col("family"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own)))
    most = farthest(percent / 100, bands * rows)
    links = _confirm(dealt.withColumns({"lo": F.col("block"), "hi": F.col("block"), "comp": F.col("rep")}), percent, most)
    linked = components(links, "a", "b")
    large = sizes.where("blocks > 1").select("f")
    if not large.isEmpty():
        roots = family.join(large, F.col("family") == F.col("f")).join(linked, F.col("m") == F.col("node"), "left")
        roots = cut(roots.select("family", F.col("m").alias("rep"), F.coalesce("root", "m").alias("comp"), "size"))
        apart = cut(roots.groupBy("family").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y"))
        size = apart.agg(F.sum("k")).first()[0]
        if size:
            again = members.join(apart.select(F.col("family").alias("f")), F.col("family") == F.col("f")).drop("f")
            sets = sets_of(again, size <= BROADCAST_ROWS)  # then their texts need no shuffle of all texts
            more = cut(_confirm(_across_blocks(sets, roots, block), percent, most))
            if not more.isEmpty():
                linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b")
    group = linked.select("node", "root").union(linked.select("root", "root").distinct())
    named = group.join(classes.select("cls", "rep"), F.col("node") == F.col("cls"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component")).withColumnRenamed("root", "r")
    named = named.join(lowest, F.col("root") == F.col("r")).select(F.col("cls").alias("g"), "root", "component")
    whole = classes.join(named, F.col("cls") == F.col("g"), "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("root", "cls").alias("grp"))
    return sig.select("_id", "_k1", "_k2", "n", "s1", "s2").join(whole, (F.col("n") > 0) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document row: id, n_shingles, class_id (smallest id with an equal shingle set),
    component_id (smallest id reachable over links of at least `percent` per cent Jaccard
    similarity), kept (id = component_id).

    Sets are of distinct `width`-word shingles of lower-cased (A-Z) words between ASCII white space;
    a shorter text's words are one shingle. Texts without words, and null texts, have empty sets
    and link with nothing. A null id is never a group's smallest id unless all its ids are null, and
    its row is never kept beside one with an id. Repeated rows are alike and both kept if one is.
    An empty table gives no rows; other columns are ignored.
    """
    out = _grouped(docs, id_col, text_col, width, percent, bands, rows, block)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("_id")).alias("class_id"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The documents, with all their columns, that stand for their group: one row of each, that with
    the smallest id (nulls last), of several with that id one text. Texts without words are in no
    group; of rows with equal id and text, one stays."""
    key = [F.xxhash64("_id", "_k1").alias("_j1"), F.xxhash64("_k2", "_id").alias("_j2")]
    out = _grouped(docs, id_col, text_col, width, percent, bands, rows, block).select("n", "grp", F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), *key).alias("one"))
    best = out.where("n > 0").groupBy("grp").agg(F.min("one").alias("one")).select("one")
    kept = best.union(out.where("n = 0").select("one").distinct()).select(F.col("one._j1").alias("_l1"), F.col("one._j2").alias("_l2"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), *text_key(text_col)).select("_row", *key)
    rest = named.join(kept, (F.col("_j1") == F.col("_l1")) & (F.col("_j2") == F.col("_l2")), "left_semi")
    one = Window.partitionBy("_j1", "_j2").orderBy(F.lit(1))
    return rest.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select("_row.*")
