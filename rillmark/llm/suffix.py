"""Exact removal of repeated strings, by column-wise suffix sorting of collections.

A start is repeated when the `length` symbols from it (bytes, or words between blanks) also start
somewhere else in the collection. Sorting every suffix of a large collection is out of reach, so
texts are first cut into aligned documents: of the `length - gram + 1` grams inside a start's string,
the one with the smallest hash is its anchor. Equal strings have equal anchors at equal distances, so
starts need only be compared with starts of the same anchor hash, in the columns counted from it.

The symbols around an anchor that its starts span are one small document. Small documents with equal
symbols are one with a count, of which two copies are sorted, so that the rounds themselves find
copies equal. Anchors that nothing shares are left out. A group of more than `group` different small
documents is split by more context first: starts are dealt into classes of fewer columns, whose
strings all hold one longer region; starts of one class with equal regions are a group again.

`repeated_columns` sorts the small documents of whole groups column by column from right to left:
each round inserts one symbol per document, turns the order of the suffixes one column further right
by a stable sort of the collection's Burrows-Wheeler transform, and updates the common prefixes of
neighbours. Columns, transform and prefixes are sequential external files that a round reads and
writes anew. A suffix that shares `length` symbols with a neighbour is a repeated start.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import as_bytes, cut, flat, pieces, small_batches, text_key
from rillmark.llm.textbytes import mix, prefix_hash, slice_hash, word_bounds, word_table

LENGTH = 400
#: Bytes of an anchor gram, and words of one where symbols are words.
GRAM, GRAM_WORDS = 50, 10
#: Starts looked at in one go; longer texts are taken in pieces.
PIECE = 1 << 19
#: Small documents that are sorted together, of as many whole groups as fill a table.
TABLE = 8192
#: Different small documents of a group that is sorted as it is; larger groups are split.
GROUP = 1024
#: Keys of texts that a task remembers, to read copies once.
SEEN = 1 << 18
#: Columns of starts that one small document spans after the first, second, ... split of its group.
#: After the last one all small documents of a group are equal.
WIDTHS = (40, 1)
#: What stands between blanks is a word.
WORD = word_table(b" \t\n\v\f\r")
_U = np.uint64
_POS = 21
_STEP = _U(0x9E3779B97F4A7C15)


def symbols_of(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of texts (bytes, or 64-bit hashes of words), n + 1 offsets into them, and the
    first byte and the end of each."""
    if not words:
        at = np.arange(len(data) + 1)
        return data, offsets, at[:-1], at[1:]
    start, end = word_bounds(data, offsets, WORD)
    return slice_hash(prefix_hash(data), start, end), np.searchsorted(start, offsets), start, end


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: row, first start, last start, anchor (all within the row),
    gram hash, and hash of the symbols that the run's strings span."""
    window = length - gram + 1
    n = len(data)
    prefix = prefix_hash(data)
    at = np.arange(max(0, n - gram + 1))
    full = slice_hash(prefix, at, at + gram)
    slot = np.uint64((1 << _POS) - 1)
    key = (full & ~slot) | (slot - at.astype(np.uint64))  # the last of equal grams is the smallest
    blocks = -(-(len(key) + window) // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    square = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    sizes = np.diff(offsets)
    valid = np.maximum(sizes - length + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), valid)
    if not len(rows):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    ends = np.cumsum(valid)
    start = np.arange(ends[-1]) - np.repeat(ends - valid, valid) + np.repeat(offsets[:-1], valid)
    best = np.minimum(behind[start], ahead[start + window - 1])
    anchor = (slot - (best & slot)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    lo, hi, a, row = start[new], start[last], anchor[new], rows[new]
    span = mix(slice_hash(prefix, lo, hi + length) + (a - lo).astype(np.uint64) * _STEP)
    base = offsets[row]
    return row, lo - base, hi - base, a - base, full[a], span


def _cut_rows(offsets: np.ndarray, length: int, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, first symbols and ends of pieces that come to about `limit` symbols: each start
    of a row lies in one piece, with all of its string."""
    rows, begins, ends, held = [], [], [], 0
    for i in np.flatnonzero(np.diff(offsets) >= length):
        a = offsets[i]
        while a + length <= offsets[i + 1]:
            b = min(a + limit + length - 1, offsets[i + 1])
            rows.append(i), begins.append(a), ends.append(b)
            held += b - a
            a = b - length + 1
            if held >= limit:
                yield np.array(rows), np.array(begins), np.array(ends)
                rows, begins, ends, held = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(begins), np.array(ends)


#: lo, hi - lo and a - lo of a run in one number, and back.
def _pack(lo: np.ndarray, hi: np.ndarray, a: np.ndarray) -> np.ndarray:
    return (lo << 24) | ((hi - lo) << 12) | (a - lo)


_LO, _MORE, _LEAD = "shiftright(p, 24)", "(shiftright(p, 12) & 4095)", "(p & 4095)"
_RUNS = "k1 long, k2 long, p long, fp long, ctx long"


def _longs(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)


def _find_anchors(df: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("_text"))
            k1, k2 = batch.column("_k1").to_numpy(zero_copy_only=False), batch.column("_k2").to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                values, at, _, _ = symbols_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                for rows, begins, ends in _cut_rows(at, length):
                    part = np.concatenate([values[a:b] for a, b in zip(begins, ends, strict=True)])
                    row, lo, hi, a, gram_hash, span = anchors(part, np.concatenate([[0], np.cumsum(ends - begins)]), length, gram)
                    shift = begins[row] - at[rows[row]]
                    of = rows[row] + i
                    yield _longs(["k1", "k2", "p", "fp", "ctx"], k1[of], k2[of], _pack(lo + shift, hi + shift, a + shift), gram_hash.view(np.int64), span.view(np.int64))

    return df.mapInArrow(work, _RUNS)


class _File:
    """A sequential file of numbers that is written anew, then read from its beginning."""

    def __init__(self, kind: np.dtype):
        self.kind, self.file = kind, tempfile.TemporaryFile()  # noqa: SIM115

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(np.ascontiguousarray(values, self.kind).data)

    def read(self, n: int) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(n * self.kind.itemsize), self.kind)


def _symbol_table(parts: list[np.ndarray], lead: np.ndarray, width: int, window: int) -> np.ndarray:
    """Documents as rows, columns in the common alignment; 0 is no symbol, which equals nothing."""
    if parts and parts[0].dtype != np.uint8:
        sizes = [len(p) for p in parts]
        ids = np.unique(np.concatenate(parts), return_inverse=True)[1] + 1
        kind = np.uint16 if ids.max(initial=0) < 65536 else np.uint32
        parts = np.split(ids.astype(kind), np.cumsum(sizes)[:-1])
    else:
        parts, kind = [p.astype(np.uint16) + np.uint16(1) for p in parts], np.uint16
    table = np.zeros((len(parts), width), kind)
    for i, part in enumerate(parts):
        at = window - 1 - lead[i]
        table[i, at : at + len(part)] = part
    return table


def repeated_columns(parts: list[np.ndarray], lead: np.ndarray, last: np.ndarray, length: int, window: int) -> np.ndarray:
    """For aligned documents (symbols; symbols before column 0; last start's column, 0 or less), which
    starts are repeated: a boolean row per document whose column j is start column j - window + 1.

    Column-wise construction: rounds go from the last column to the first."""
    m, width = len(parts), window - 1 + length
    out = np.zeros((m, window), bool)
    if m < 2:
        return out
    table = _symbol_table(parts, lead, width, window)
    transform, prefixes = _File(table.dtype), _File(np.dtype(np.int32))
    with tempfile.TemporaryFile() as columns, transform.file, prefixes.file:
        for c in range(width - 1, -1, -1):
            columns.write(np.ascontiguousarray(table[:, c]).data)
        columns.seek(0)
        each = m * table.dtype.itemsize
        kind = table.dtype
        del table
        order = np.arange(m)
        transform.write(np.frombuffer(columns.read(each), kind))
        # first column in which a suffix differs from the one before it
        prefixes.write(np.full(m + 1, length))
        pair = np.empty(2 * (m - 1), np.int64)
        for c in range(length - 1, -window, -1):
            bwt, was = transform.read(m), prefixes.read(m + 1)
            rank = np.argsort(bwt, kind="stable")
            order, turned = order[rank], bwt[rank]
            pair[0::2], pair[1::2] = rank[:-1] + 1, rank[1:] + 1
            common = np.minimum.reduceat(was, pair)[::2]
            differ = np.full(m + 1, c, np.int32)
            differ[1:m] = np.where((turned[1:] == turned[:-1]) & (turned[1:] > 0), common, c)
            if c <= 0:
                far = differ - c >= length
                out[order[far[:-1] | far[1:]], c + window - 1] = True
            if c > 1 - window:
                transform.write(np.frombuffer(columns.read(each), kind)[order])
                prefixes.write(differ)
    column = np.arange(window) - window + 1
    return out & (column >= -lead[:, None]) & (column <= last[:, None])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of true values in the rows of a table."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


_FOUND = "fp long, ctx long, copy long, p long, groups long, bytes binary"


def _extract(df: DataFrame, length: int, words: bool) -> DataFrame:
    """(key, text, list of runs) to one small document per run: the bytes that its strings span.
    Copies of a text share its key and its runs: a task reads one of those that come to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], names=["fp", "ctx", "copy", "p", "groups", "bytes"])

            keys = list(zip(batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), strict=True))
            for key, text, runs in zip(keys, batch.column("_text"), batch.column("runs"), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                if len(seen) > SEEN:
                    seen = {key}
                runs = runs.as_py()
                view = memoryview(text.as_buffer())
                if words:
                    start, end = word_bounds(np.frombuffer(view, np.uint8), np.array([0, len(view)]), WORD)
                for r in runs:
                    lo = r["p"] >> 24
                    hi = lo + (r["p"] >> 12 & 4095) + length
                    part = view[start[lo] : end[hi - 1]] if words else view[lo:hi]
                    for column, x in zip(out, (r["fp"], r["ctx"], r["copy"], r["p"], r["groups"], bytes(part)), strict=True):
                        column.append(x)
                    if len(out[0]) >= 4096:
                        yield made()
                        out = [[] for _ in range(6)]
            yield made()

    return df.select("_k1", "_k2", "_text", "runs").mapInArrow(work, _FOUND)


def _values(part: bytes, words: bool) -> np.ndarray:
    data = np.frombuffer(part, np.uint8)
    return symbols_of(data, np.array([0, len(data)]), True)[0] if words else data


def _sort_columns(df: DataFrame, length: int, window: int, words: bool) -> DataFrame:
    """(fp, ctx, first, last): the columns of repeated starts of each small document. Groups come one
    after another; whole groups fill a table before it is sorted."""
    names = ["fp", "ctx", "first", "last"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        parts: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            if not parts:
                return _longs(names, [], [], [], [])
            fp, ctx, copy, p = (np.array(x) for x in zip(*keys, strict=True))
            lead = p & 4095
            flags = repeated_columns(parts, lead, (p >> 12 & 4095) - lead, length, window)
            flags[copy > 0] = False  # the first copy speaks for all
            row, first, last = _runs(flags)
            return _longs(names, fp[row], ctx[row], first - window + 1, last - window + 1)

        was, last = None, None
        for batch in batches:
            for fp, ctx, copy, p, part in zip(*(batch.column(c).to_pylist() for c in ("fp", "ctx", "copy", "p", "bytes")), strict=True):
                if (fp, ctx, copy) == last:
                    continue  # another task has read a copy of the text
                last = (fp, ctx, copy)
                if fp != was and len(parts) >= TABLE:
                    yield done()
                    keys, parts = [], []
                was = fp
                keys.append((fp, ctx, copy, p))
                parts.append(_values(part, words))
        yield done()

    return df.repartition("fp").sortWithinPartitions("fp", "ctx", "copy").mapInArrow(work, "fp long, ctx long, first long, last long")


def _split(df: DataFrame, length: int, width: int, words: bool) -> DataFrame:
    """Small documents of groups that are too large, as texts of their own (fp and ctx with the copy
    are their keys), to runs whose starts lie in `width` columns and share all of one region."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, ctx, copy, p, part in zip(*(batch.column(c).to_pylist() for c in ("fp", "ctx", "copy", "p", "bytes")), strict=True):
                prefix = prefix_hash(_values(part, words))
                lead, more = p & 4095, p >> 12 & 4095
                kind = np.arange((4096 - lead) // width, (4096 - lead + more) // width + 1)
                first = kind * width - 4096 + lead  # the class's first start, as a place in the bytes
                lo, hi, a = np.maximum(first, 0), np.minimum(first + width - 1, more), first + width - 1
                region = slice_hash(prefix, a, first + length)
                key = mix(region ^ mix(kind.astype(np.uint64) * _STEP + _U(fp % (1 << 64))))
                span = mix(slice_hash(prefix, lo, hi + length) + (a - lo).astype(np.uint64) * _STEP)
                m = len(kind)
                yield _longs(["k1", "k2", "p", "fp", "ctx"], np.full(m, fp), np.full(m, ctx ^ copy), _pack(lo, hi, a), key.view(np.int64), span.view(np.int64))

    return df.mapInArrow(work, _RUNS)


#: Sorted ranges x, those that meet or overlap as one.
_TOGETHER = """aggregate(x, cast(array() as array<struct<lo: bigint, hi: bigint>>), (done, r) -> if(size(done) > 0 and r.lo <= try_element_at(done, -1).hi + 1,
  concat(slice(done, 1, size(done) - 1), array(named_struct('lo', try_element_at(done, -1).lo, 'hi', greatest(try_element_at(done, -1).hi, r.hi)))), concat(done, array(r))))"""


def _repeated(runs: DataFrame, texts: DataFrame, length: int, window: int, words: bool, group: int, widths: tuple[int, ...]) -> DataFrame:
    """k1, k2, lo, hi: the ranges of repeated starts of texts (k1, k2, _text), given their runs."""
    member = F.struct("k1", "k2", "p")
    spans = runs.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("one"), F.max(member).alias("other"))
    groups = spans.groupBy("fp").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("all")).where("all > 1").select(F.col("fp").alias("f"), "groups")
    shared = cut(spans.join(groups, F.col("fp") == F.col("f")).select("fp", "ctx", "n", "groups", "one", "other"))
    copies = F.array_compact(F.array(F.struct(F.lit(0).cast("long").alias("copy"), F.col("one").alias("of")), F.when(F.col("n") > 1, F.struct(F.lit(1).cast("long").alias("copy"), F.col("other").alias("of")))))
    asked = shared.select("fp", "ctx", "groups", F.explode(copies).alias("x")).groupBy(F.col("x.of.k1").alias("r1"), F.col("x.of.k2").alias("r2")).agg(F.collect_list(F.struct(F.col("x.of.p").alias("p"), "fp", "ctx", F.col("x.copy").alias("copy"), "groups")).alias("runs"))
    # all columns go to the tasks, so that this join and the one that removes bytes share one shuffle of the texts
    found = _extract(texts.join(asked, (F.col("_k1") == F.col("r1")) & (F.col("_k2") == F.col("r2"))), length, words)
    hits = _sort_columns(found.where(F.col("groups") <= group), length, window, words)
    if widths and shared.where(F.col("groups") > group).limit(1).count():
        large = cut(found.where(F.col("groups") > group).dropDuplicates(["fp", "ctx", "copy"]))
        width = min(widths[0], length)
        parts = large.select(F.col("fp").alias("_k1"), F.col("ctx").bitwiseXOR(F.col("copy")).alias("_k2"), F.col("bytes").alias("_text"))
        inner = _repeated(_split(large, length, width, words), parts, length, width, words, group, widths[1:])
        lead = large.where("copy = 0").select(F.col("fp").alias("f"), F.col("ctx").alias("c"), F.expr(_LEAD).alias("lead"))
        # classes are decided apart, and the last ones have one column each: their ranges are put together first
        ranges = inner.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("x")).select("k1", "k2", F.explode(F.expr(_TOGETHER)).alias("x"))
        hits = hits.union(ranges.join(lead, (F.col("k1") == F.col("f")) & (F.col("k2") == F.col("c"))).select("f", "c", F.expr("x.lo - lead"), F.expr("x.hi - lead")))
    hits = hits.toDF("f", "c", "first", "last")
    at = f"{_LO} + {_LEAD}"
    return runs.join(hits, (F.col("fp") == F.col("f")) & (F.col("ctx") == F.col("c"))).select("k1", "k2", F.expr(f"{at} + first").alias("lo"), F.expr(f"{at} + last").alias("hi"))


def repeated_starts(keyed: DataFrame, *, length: int = LENGTH, gram: int | None = None, words: bool = False, group: int = GROUP, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Of rows (_k1, _k2, _text, ...): k1, k2, lo, hi, the ranges of repeated starts, in symbols. The
    keys name a text; rows with equal keys are copies, and each range may come once for every copy."""
    gram = min(gram or (GRAM_WORDS if words else GRAM), length)
    if gram < 1 or length - gram + 1 > 4095:
        raise ValueError("the gram must fit in the string, and the string in 4095 starts")
    if not widths or widths[-1] != 1:
        raise ValueError("the last width must be 1")
    runs = _find_anchors(keyed.select("_k1", "_k2", "_text"), length, gram, words)
    return _repeated(runs, keyed, length, length - gram + 1, words, group, widths)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    return docs.select(*text_key(text_col), as_bytes(text_col).alias("_text"), rest.alias("_rest"), F.col(text_col).isNull().alias("_null"))


def spans_of(starts: list[dict], length: int, words: bool = False, text: bytes = b"") -> list[tuple[int, int]]:
    """Maximal covered byte ranges (first, end) of the ranges of repeated starts; those in words
    reach from the first byte of a word to the end of another."""
    ranges = [(r["lo"], r["hi"] + length) for r in starts]
    if words and ranges:
        start, end = word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]), WORD)
        ranges = [(int(start[a]), int(end[b - 1])) for a, b in ranges]
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, words: bool = False, **options) -> DataFrame:
    """All columns of `docs`, then `kept_bytes` (the text's UTF-8 bytes without those that any string
    of `length` symbols covers which also starts elsewhere in the collection) and `removed_spans`
    (array of first and end, in bytes of the input text).

    Symbols are bytes or, with `words`, what stands between blanks; the blanks themselves may differ.
    Strings are judged on the input texts and never cross them; every occurrence goes, the first
    too. Repeated rows are repeats of one another; time and memory grow in proportion to their number,
    whether their ids differ, are equal or null. Null and short texts lose nothing by themselves
    (null is empty). An empty table gives no rows. A column named like one of the two is replaced.
    """
    docs = docs.drop("kept_bytes", "removed_spans")
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, text_col)
    starts = repeated_starts(keyed, length=length, words=words, **options)
    # a set, which each task makes of its own rows first: copies of a text bring the same ranges
    starts = starts.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    joined = keyed.join(starts, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left").select("_rest", "_null", "_text", "starts")
    rest = joined.schema["_rest"].dataType
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("_rest", rest), T.StructField("_null", T.BooleanType()), T.StructField("_text", T.BinaryType()), T.StructField("kept_bytes", T.BinaryType()), T.StructField("removed_spans", span)])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, runs in zip(batch.column("_text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                cut_out = spans_of(runs or [], length, words, text)
                edges = [0, *(x for s in cut_out for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cut_out else text)
                removed.append([{"first": a, "end": b} for a, b in cut_out])
            columns = [batch.column("_rest"), batch.column("_null"), batch.column("_text"), pa.array(kept, pa.binary()), pa.array(removed, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["_rest", "_null", "_text", "kept_bytes", "removed_spans"])

    out = joined.mapInArrow(work, schema)
    text = F.when(~F.col("_null"), F.col("_text").cast("string")).alias(text_col)
    return out.select(*[text if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns], "kept_bytes", "removed_spans")
