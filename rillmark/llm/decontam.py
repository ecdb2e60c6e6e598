"""Benchmark decontamination with suffix arrays of the training text.

Documents are taken in shards of bounded size. A shard's words become integers and its suffix array
is built by prefix doubling (a document's end sorts before every word, so no match crosses
documents). Every suffix of every benchmark item is then binary-searched in the shard, all of them
together and one word deeper a round, which yields the longest verbatim match of each suffix and the
array range that holds its places. Matches of a whole window mark document words as hit.

Shards are independent, so nothing is shuffled. Benchmark items reach the tasks in blocks of bounded
size, several to a pass: a shard's suffix array is built once and searched for one block after the
other. A benchmark that is larger takes further passes over rows that carry the marks of those before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import as_bytes, flat, pieces, small_batches
from rillmark.llm.textbytes import word_table, words

#: Bytes of benchmark text in one block, which is what a task holds besides its shard.
BLOCK_BYTES = 4 << 20
#: Blocks that one pass sends to the tasks.
PASS_BLOCKS = 4
#: Bytes of document text in one shard; a longer document is a shard of its own.
SHARD_BYTES = 6 << 20
WORD = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `ids` (0 to fewer than 2**31) in the order of their suffixes, as far as `depth`
    words can tell them apart. Prefix doubling; groups that are already single are left alone."""
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    first = max(1, min(62 // bits, depth))
    padded = np.concatenate([ids.astype(np.int64), np.zeros(first, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(first):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="quicksort")
    sorted_key = key[order]
    new = np.ones(n, bool)
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    reach = first
    while reach < depth:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        at = order[slots]
        pair = (rank[at] << 32) + rank[np.minimum(at + reach, n)] + 1
        again = np.argsort(pair, kind="quicksort")
        at, pair = at[again], pair[again]
        order[slots] = at
        fresh = np.ones(len(slots), bool)
        np.not_equal(pair[1:], pair[:-1], out=fresh[1:])
        new[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        reach *= 2
    return order


class Block:
    """A block of items: their words, the windows in them and which items have each window."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.cumsum([0, *(len(t) for _, t in items)])
        self.h, self.offsets = words(data, offsets, WORD)
        self.names = [str(i) for i, _ in items]
        self.vocabulary = np.unique(self.h)
        counts = np.diff(self.offsets)
        #: for each suffix: its words up to its item's end, and the words it needs to count as a window
        self.left = np.repeat(self.offsets[1:], counts) - np.arange(len(self.h))
        self.item = np.repeat(np.arange(len(items)), counts)
        self.need = np.minimum(window, np.repeat(counts, counts))
        self.depth = int(counts.max(initial=1))


def longest_matches(text: np.ndarray, order: np.ndarray, query: np.ndarray, left: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of the query: the length of its longest match in `text`, and the first and
    last + 1 slots of the suffix array whose suffixes start with its first `need` words (none: equal)."""
    n, m = len(text), len(query)
    lo, hi, length = np.zeros(m, np.int64), np.full(m, n, np.int64), np.zeros(m, np.int64)
    wlo, whi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    live, depth = np.flatnonzero((left > 0) & (query > 0)), 0
    padded = np.append(text, 0)

    def bound(a: np.ndarray, b: np.ndarray, want: np.ndarray) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = padded[np.minimum(order[np.minimum(mid, n - 1)] + depth, n)] < want
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a

    while len(live):
        want = query[live + depth]
        a = bound(lo[live], hi[live], want)
        b = bound(a, hi[live], want + 1)
        found = (a < b) & (want > 0)
        live, a, b = live[found], a[found], b[found]
        lo[live], hi[live] = a, b
        depth += 1
        length[live] = depth
        whole = need[live] == depth
        wlo[live[whole]], whi[live[whole]] = a[whole], b[whole]
        live = live[left[live] > depth]
    return length, wlo, whi


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and for each the number of its range."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + lo[which], which


@dataclass
class Shard:
    """A shard's words as integers with a 0 after each document, their suffix array, and where the
    shard's words stand among them."""

    offsets: np.ndarray
    vocabulary: np.ndarray
    text: np.ndarray
    place: np.ndarray
    order: np.ndarray


def index_shard(h: np.ndarray, offsets: np.ndarray, depth: int) -> Shard:
    docs, n = len(offsets) - 1, len(h)
    vocabulary, inverse = np.unique(h, return_inverse=True)
    text = np.zeros(n + docs, np.int64)
    place = np.arange(n) + np.repeat(np.arange(docs), np.diff(offsets))
    text[place] = inverse + 1
    return Shard(offsets, vocabulary, text, place, suffix_array(text, depth))


def search_shard(h: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """`search_index` over a shard's words (h, offsets by document)."""
    return search_index(index_shard(h, offsets, block.depth), block)


def search_index(shard: Shard, block: Block) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Whether each word of a shard is hit, the items of each document, and the longest match of each
    benchmark suffix."""
    offsets, vocabulary, text, place, order = shard.offsets, shard.vocabulary, shard.text, shard.place, shard.order
    docs, n = len(offsets) - 1, len(place)
    hit = np.zeros(n, bool)
    items: list[np.ndarray] = [np.zeros(0, np.int64)] * docs
    if not n or not len(block.h):
        return hit, items, np.zeros(len(block.h), np.int64)
    slot = np.minimum(np.searchsorted(vocabulary, block.h), len(vocabulary) - 1)
    query = np.where(vocabulary[slot] == block.h, slot + 1, 0)
    length, lo, hi = longest_matches(text, order, query, block.left, block.need)
    some = np.flatnonzero(lo < hi)
    if len(some):
        # equal windows have the same range and length: their places are marked once
        _, one = np.unique(np.stack([lo[some], block.need[some]]), axis=1, return_index=True)
        edge = np.zeros(n + docs + 1, np.int64)
        for need in np.unique(block.need[some[one]]):
            of = some[one][block.need[some[one]] == need]
            at = order[_ranges(lo[of], hi[of])[0]]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + need, -1)
        hit = np.cumsum(edge)[:-1][place] > 0
        # documents and items: each (window, document) once, then each item that has the window
        _, window = np.unique(np.stack([lo[some], block.need[some]]), axis=1, return_inverse=True)
        window = window.ravel()
        first = np.unique(window, return_index=True)[1]
        slots, which = _ranges(lo[some[first]], hi[some[first]])
        doc_at = np.searchsorted(offsets[1:] + np.arange(docs), order[slots], "right")
        seen = np.unique(doc_at * len(first) + which)
        pairs = np.unique(window * len(block.names) + block.item[some])
        of_window = np.searchsorted(pairs // len(block.names), np.arange(len(first) + 1))
        got, src = _ranges(of_window[seen % len(first)], of_window[seen % len(first) + 1])
        both = np.unique((seen // len(first))[src] * len(block.names) + pairs[got] % len(block.names))
        cuts = np.searchsorted(both // len(block.names), np.arange(docs + 1))
        for d in np.flatnonzero(np.diff(cuts)):
            items[d] = both[cuts[d] : cuts[d + 1]] % len(block.names)
    return hit, items, length


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]))).tolist()


def _schema(carried: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("_row", carried),
            T.StructField("_text", T.BinaryType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_runs", T.ArrayType(T.LongType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )


def _pass(df: DataFrame, blocks: list[Block], keep_text: bool, schema: T.StructType) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(blocks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        depth = max(b.depth for b in blocks)
        for batch in batches:
            data, offsets = flat(batch.column("_text"))
            earlier_runs, earlier_items = batch.column("hit_runs").to_pylist(), batch.column("items").to_pylist()
            for i, j in pieces(offsets, SHARD_BYTES):
                h, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORD)
                shard = index_shard(h, at, depth)
                hit, found = np.zeros(len(h), bool), [[] for _ in range(j - i)]
                for block in blocks:
                    some, items, _ = search_index(shard, block)
                    hit |= some
                    for d, own in enumerate(items):
                        found[d] += [block.names[k] for k in own]
                runs, names = [], []
                for d in range(j - i):
                    own = hit[at[d] : at[d + 1]]
                    if before := earlier_runs[i + d]:
                        own = own.copy()
                        for a, b in zip(before[::2], before[1::2], strict=True):
                            own[a:b] = True
                    runs.append(_runs(own) if own.any() else [])
                    names.append((earlier_items[i + d] or []) + found[d])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row").slice(i, j - i),
                        batch.column("_text").slice(i, j - i) if keep_text else pa.nulls(j - i, pa.binary()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(runs, pa.list_(pa.int64())),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    names=schema.names,
                )

    return df.mapInArrow(work, schema)


def _marked(docs: DataFrame, benchmark: DataFrame, carried: Column, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """One row per document row: `carried` as _row, n_words, hit_runs, items."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), as_bytes(item_text_col).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    out = docs.select(
        carried.alias("_row"),
        as_bytes(text_col).alias("_text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<long>").alias("hit_runs"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    schema = _schema(out.schema["_row"].dataType)
    for first in range(0, blocks, PASS_BLOCKS):
        held: dict[int, list] = {b: [] for b in range(first, min(first + PASS_BLOCKS, blocks))}
        for r in items.where(F.col("b").between(first, first + PASS_BLOCKS - 1)).collect():
            held[r["b"]].append((r["i"] if r["i"] is not None else "null", bytes(r["t"])))
        out = _pass(out, [Block(rows, window) for rows in held.values()], first + PASS_BLOCKS < blocks, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: id, n_words, n_hit, hit_runs (first and last + 1 word of each hit
    run, in turn), items (ids of the items with occurring windows, as strings, sorted), contaminated.

    A window is `window` consecutive words of an item; an item of fewer words is one window. Null or
    wordless texts have no words and no hits, wordless items no windows; an empty benchmark leaves
    every document clean. Repeated rows are judged alike. Other columns are ignored.
    """
    out = _marked(docs, benchmark, F.col(id_col).cast("string"), text_col, item_col, item_text_col, window, block_bytes)
    lengths = F.aggregate(F.col("hit_runs"), F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("k")), lambda a, x: F.struct((a["s"] + a["k"] * x).alias("s"), (-a["k"]).alias("k")), lambda a: a["s"])
    return out.select(
        F.col("_row").cast(dict(docs.dtypes)[id_col]).alias(id_col),
        "n_words",
        lengths.alias("n_hit"),
        "hit_runs",
        F.array_sort(F.array_distinct("items")).alias("items"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs. Each row is judged
    by its own text, whatever its id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = _marked(docs, benchmark, row, text_col, item_col, item_text_col, window, block_bytes)
    return marked.where(F.size("hit_runs") == 0).select("_row.*")


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
