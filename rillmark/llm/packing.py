"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Only lengths decide a packing, and there are at most `capacity` of them: the instance is the count of
pieces of each length. On those counts the driver fixes sets of one or two pieces that dominate all
other ways to fill a sequence around their largest piece, and packs the rest best-fit decreasing,
whole classes of equal pieces at a time. The plan is a table of (length, range of positions among
pieces of that length, sequence, offset) whose size depends on the capacity, not on the documents;
it is broadcast to the pieces, whose positions come from per-task counts and a running sum.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import cut, small_batches

CAPACITY = 2048
Pattern = tuple[tuple[int, int], ...]  # (length, how many), in the order in which they stand


def dominating_sets(counts: list[int], capacity: int) -> list[tuple[int, Pattern]]:
    """Takes provably optimal sets out of `counts` and returns them with their multiplicities.

    With a piece of length s and room r = capacity - s beside it, these fill a sequence at least as
    well as any other choice around that piece: the piece alone if nothing fits; with a piece of
    exactly r; with the longest fitting piece if no two pieces fit together, or if at most two fit
    and none of those pairs is longer than it.
    """
    fixed = []

    def smallest(k: int, without: int) -> list[int]:
        out = []
        for x in range(1, capacity + 1):
            out += [x] * min(counts[x] - (x == without), k - len(out))
            if len(out) >= k:
                break
        return out

    def longest(r: int, s: int) -> int:
        return next((x for x in range(r, 0, -1) if counts[x] - (x == s) > 0), 0)

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while counts[s]:
                r = capacity - s
                low = smallest(3, s)
                mate = 0
                if low and low[0] <= r:
                    best = longest(r, s)
                    if best == r or len(low) < 2 or low[0] + low[1] > r:
                        mate = best
                    elif len(low) < 3 or sum(low) > r:
                        sizes = [x for x in range(1, r + 1) if counts[x] - (x == s) > 0]
                        pairs = max((a + b for a in sizes for b in sizes if a + b <= r and (a != b or counts[a] - (a == s) > 1)), default=0)
                        mate = best if best >= pairs else 0
                    if not mate:
                        break
                n = counts[s] if not mate else counts[s] // 2 if mate == s else min(counts[s], counts[mate])
                if not n:
                    break
                counts[s] -= n
                if mate:
                    counts[mate] -= n
                fixed.append((n, ((s, 1), (mate, 1)) if mate and mate != s else ((s, 2),) if mate else ((s, 1),)))
                changed = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing of all counted pieces, equal open sequences together."""
    groups: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        groups[room].append([pattern, n])

    for s in range(capacity, 0, -1):
        left = counts[s]
        while left:
            k = bisect_left(rooms, s)
            if k < len(rooms):
                room = rooms[k]
                pattern, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            else:
                room, pattern, n = capacity, (), -(-left // (capacity // s))
            q = room // s
            full = min(n, left // q)
            if full:
                put(room - q * s, (*pattern, (s, q)), full)
                left -= full * q
            if full < n and left:
                put(room - left * s, (*pattern, (s, left)), 1)
                full, left = full + 1, 0
            if full < n and pattern:
                put(room, pattern, n - full)
    return [(n, p) for room in groups.values() for p, n in room]


def plan(counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first position, end position, per sequence, first sequence, first offset) for
    counts[length] pieces of each length. Equal rows pack no more than the capacity."""
    counts = list(counts)
    done = [0] * (capacity + 1)
    out, sequence = [], 0
    for n, pattern in [*dominating_sets(counts, capacity), *best_fit(counts, capacity)]:
        offset = 0
        for s, q in pattern:
            out.append((s, done[s], done[s] + n * q, q, sequence, offset))
            done[s] += n * q
            offset += q * s
        sequence += n
    return out


class Encoder:
    """Token ids of a text as the tokenizer file gives them, followed by the end id.

    The same vocabulary as merge ranks is read by a faster library; texts that hold a piece of the
    special token's name go to the tokenizer file itself, which treats that name as one token.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None, end: int = 0):
        self.tokenizer, self.end, self.fast, self.slow = tokenizer, end, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text:
            return np.append(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32(self.end)).astype("<u4")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.tokenizer)
        return np.array([*self.slow.encode(text, add_special_tokens=False).ids, self.end], "<u4")


_encoders: dict[tuple, Encoder] = {}


def _encoder(*args) -> Encoder:
    if args not in _encoders:
        _encoders.clear()
        _encoders[args] = Encoder(*args)
    return _encoders[args]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: the first takes what is over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, *, id_col: str, text_col: str, tokenizer: str, ranks: str | None, pattern: str | None, capacity: int, keep_ids: bool) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, ids (null unless kept), and the task
    that made it with its count of earlier pieces of that length."""
    import zlib

    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind)]
        + [T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("_task", T.IntegerType()), ("_seen", T.LongType()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks, pattern)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            row, out = [], [[] for _ in range(6)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    own = ids[start : start + length]
                    row.append(i)
                    for column, x in zip(out, (k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if keep_ids else None, seen[length]), strict=True):
                        column.append(x)
                    seen[length] += 1
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
            arrays = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *arrays[:5], pa.array([task] * len(row), pa.int32()), arrays[5]], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def pack(docs: DataFrame, *, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, ids (the piece's
    token ids, if kept).

    A document is its ids and a 0; null and empty texts are that 0 alone. Only longer documents than
    the capacity are cut, and their first piece takes what is over. Repeated rows are packed each
    for itself; a null id stays null. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    made = cut(tokenize(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, ranks=ranks, pattern=pattern, capacity=capacity, keep_ids=keep_ids))
    counts = [0] * (capacity + 1)
    for r in made.groupBy("length").count().collect():  # at most one row per length
        counts[r["length"]] = r["count"]
    rows = plan(counts, capacity)
    slots = docs.sparkSession.createDataFrame(rows, "s long, lo long, hi long, q long, seq long, at long")
    per_task = made.groupBy(F.col("length").alias("l"), F.col("_task").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("l").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    per_task = per_task.select("l", "t", F.coalesce(before, F.lit(0)).alias("before"))
    placed = made.join(per_task, (F.col("length") == F.col("l")) & (F.col("_task") == F.col("t"))).withColumn("_r", F.col("before") + F.col("_seen"))
    placed = placed.join(F.broadcast(slots), (F.col("length") == F.col("s")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi")))
    nth = F.col("_r") - F.col("lo")
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("seq") + F.expr("(_r - lo) div q")).alias("sequence_id"), (F.col("at") + (nth % F.col("q")) * F.col("length")).alias("offset"), "ids")
