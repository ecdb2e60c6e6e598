"""Ranked lexical search over an index in the order of a recursive graph bisection.

1. A sample of bounded size is bisected again and again: documents change sides while that lowers the
   logarithmic gap cost of their terms' postings (terms hashed to slots). Each node of the tree keeps
   by how much a slot speaks for its left side.
2. Every document of the table goes down the tree by its own terms to a leaf. Documents in the order of
   their leaves, cut into shards of some hundred, are the clustered index: a shard holds for each term its
   documents' impacts and the highest of them. Order and shards decide what work is done, never a result.
3. A query's bound in a shard is the sum of its terms' weights times the highest impacts. Queries visit
   their most promising shards first, then some more, then all the others whose bound is not below
   the score of their k-th best document so far; a shard with an equal bound is visited, since it may
   hold a smaller id. Shards below are never scored, and cannot hold a document of the answer.
4. Scores are 64-bit integers, exact also as the doubles that add them up. Equal scores are
   ordered by document id.

Queries come in blocks of bounded size; an index holds the postings of the terms that its block asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import as_bytes, cut, flat, pieces, small_batches
from rillmark.llm.textbytes import mix, word_table, words

TOP = 50
#: Documents that the bisection is fitted on (about), slots that each gives at most, slots in all, and levels.
SAMPLE, SAMPLE_SLOTS, SLOTS, DEPTH = 2048, 256, 1 << 14, 6
#: Documents of a shard (about), and shards that a query visits in its first and second round.
SHARD, FIRST, SECOND = 512, 4, 32
#: Bytes of query texts in one block.
BLOCK_BYTES = 4 << 20
TERM = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def slots_of(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(50)).astype(np.int64)


def _cost(n: float, d: np.ndarray) -> np.ndarray:
    """Gap cost of terms that d of n documents hold."""
    return d * np.log2((n + 1) / (d + 1))


def bisect(docs: list[np.ndarray], depth: int = DEPTH, rounds: int = 12) -> np.ndarray:
    """For each node of the tree and each slot, how many bits a document with that slot saves on the
    left side. `docs` are arrays of different slots; nodes of few documents are 0, which is left."""
    tree = np.zeros(((1 << depth) - 1, SLOTS), np.float32)
    parts = {0: np.arange(len(docs))}
    for node in range(len(tree)):
        own = parts.pop(node, np.zeros(0, np.int64))
        if len(own) < 8:
            continue
        size = np.array([len(docs[i]) for i in own])
        slot, doc = np.concatenate([docs[i] for i in own]).astype(np.int64), np.repeat(np.arange(len(own)), size)
        right = np.arange(len(own)) >= len(own) // 2
        n = [float((~right).sum()), float(right.sum())]  # sides swap in pairs, so their sizes stay
        for _ in range(rounds):
            there = right[doc]
            left, other = np.bincount(slot[~there], minlength=SLOTS), np.bincount(slot[there], minlength=SLOTS)
            now = _cost(n[0], left) + _cost(n[1], other)
            to_right = now - _cost(n[0], np.maximum(left - 1, 0)) - _cost(n[1], other + 1)
            to_left = now - _cost(n[0], left + 1) - _cost(n[1], np.maximum(other - 1, 0))
            gain = np.bincount(doc, weights=np.where(there, to_left[slot], to_right[slot]), minlength=len(own))
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            m = min(len(a), len(b))
            swap = gain[a[:m]] + gain[b[:m]] > 1e-9
            if not swap.any():
                break
            right[a[:m][swap]], right[b[:m][swap]] = True, False
        there = right[doc]
        left, other = np.bincount(slot[~there], minlength=SLOTS), np.bincount(slot[there], minlength=SLOTS)
        tree[node] = np.log2((left + 0.5) / (n[0] + 1)) - np.log2((other + 0.5) / (n[1] + 1))
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return tree


def route(doc: np.ndarray, slot: np.ndarray, docs: int, tree: np.ndarray) -> np.ndarray:
    """The leaf of each document, counted from the left, given its different slots."""
    node, depth = np.zeros(docs, np.int64), (len(tree) + 1).bit_length() - 1
    for _ in range(depth):
        saved = np.bincount(doc, weights=tree[node[doc], slot], minlength=docs)
        node = 2 * node + 1 + (saved < 0)
    return node - len(tree)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of a batch's rows with the hashes of their terms and offsets."""
    data, offsets = flat(batch.column("_text"))
    for i, j in pieces(offsets):
        yield i, j, *words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], TERM)


def fit_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, depth: int = DEPTH) -> np.ndarray:
    """The bisection tree of about `sample` documents, chosen by a hash of id and length."""
    total = docs.count()
    share = min(1 << 30, (sample << 30) // max(total, 1) + 1)
    chance = F.pmod(F.xxhash64(id_col, F.length(text_col), F.lit(23)), F.lit(1 << 30))
    rows = docs.select(chance.alias("h"), as_bytes(text_col).alias("_text")).where(F.col("h") < share)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, h, at in _terms(batch):
                for a, b in zip(at[:-1], at[1:], strict=True):
                    out.append(np.sort(np.unique(slots_of(h[a:b]) * 40503 % SLOTS)[:SAMPLE_SLOTS] * 25719 % SLOTS))
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(out, pa.list_(pa.int64()))], names=["h", "slots"])

    got = rows.mapInArrow(work, "h long, slots array<long>").where(F.size("slots") > 0).orderBy("h", "slots").limit(2 * sample).collect()
    return bisect([np.array(r.slots) for r in got], depth)


def _forward(docs: DataFrame, tree: np.ndarray, asked: np.ndarray) -> DataFrame:
    """(_id, n, leaf, terms, tf) of documents with a term: places in the sorted hashes `asked`, and counts."""
    schema = T.StructType([docs.schema["_id"], T.StructField("n", T.LongType()), T.StructField("leaf", T.IntegerType()), T.StructField("terms", T.BinaryType()), T.StructField("tf", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at in _terms(batch):
                m = j - i
                doc = np.repeat(np.arange(m), np.diff(at))
                pair = np.unique(doc * np.int64(SLOTS) + slots_of(h))
                leaf = route(pair // SLOTS, pair % SLOTS, m, tree)
                term = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                hit = asked[term] == h
                key, tf = np.unique(doc[hit] * np.int64(len(asked)) + term[hit], return_counts=True)
                ends = np.searchsorted(key, np.arange(m + 1) * np.int64(len(asked)))
                ids, tf = (key % len(asked)).astype(np.int32), tf.astype(np.int32)
                n = np.diff(at)
                some = pa.array(n > 0)
                rows = [batch.column("_id").slice(i, m), pa.array(n), pa.array(leaf.astype(np.int32))]
                rows += [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (ids, tf)]
                yield pa.RecordBatch.from_arrays(rows, names=schema.names).filter(some)

    return docs.mapInArrow(work, schema)


def _frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; a task sends one row per term at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(flat(batch.column("terms"))[0].view(np.int32), minlength=size)
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n[term])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for term, n in forward.select("terms").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class _Shard:
    """Postings of some documents, by term."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, impacts: np.ndarray, size: int):
        self.terms, self.ends, self.docs, self.impacts, self.size = terms, ends, docs, impacts, size

    @classmethod
    def build(cls, term: np.ndarray, doc: np.ndarray, value: np.ndarray, size: int) -> _Shard:
        order = np.lexsort((doc, term))
        term, doc, value = term[order], doc[order], value[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        return cls(term[first], np.append(first, len(term)), doc, value, size)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked terms the shard has, and their places."""
        at = np.minimum(np.searchsorted(self.terms, asked), max(len(self.terms) - 1, 0))
        here = self.terms[at] == asked if len(self.terms) else np.zeros(len(asked), bool)
        return here, at[here]

    def best(self) -> np.ndarray:
        return np.maximum.reduceat(self.impacts, self.ends[:-1]) if len(self.terms) else np.zeros(0, np.int32)

    def scores(self, asked: np.ndarray, weights: np.ndarray) -> np.ndarray:
        here, at = self.find(asked)
        a, many = self.ends[at], self.ends[at + 1] - self.ends[at]
        stop = np.cumsum(many)
        if not len(stop) or not stop[-1]:
            return np.zeros(self.size, np.int64)
        take = np.arange(stop[-1]) - np.repeat(stop - many - a, many)
        products = np.repeat(weights[here], many) * self.impacts[take]
        return np.bincount(self.docs[take], weights=products, minlength=self.size).astype(np.int64)  # below 2**53, so exact


class Queries:
    """A block of queries: the sorted hashes of their terms, and each query's different terms."""

    def __init__(self, rows: list[tuple[object, bytes]]):
        data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
        h, at = words(data, np.cumsum([0, *(len(t) for _, t in rows)]), TERM)
        self.items = [i for i, _ in rows]
        self.asked, inverse = np.unique(h, return_inverse=True)
        own = [np.unique(inverse[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.ends, self.terms = np.cumsum([0, *map(len, own)]), np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64)

    def weigh(self, n: int, frequency: np.ndarray) -> np.ndarray:
        return np.array([weight(n, int(x)) for x in frequency[self.terms]], np.int64)


def _shards(forward: DataFrame, total: int, length: int, shard: int) -> DataFrame:
    """Rows (shard, ids, terms, ends, docs, impacts), one for each run of `shard` documents of a partition."""
    # the place in the checkpoint tells equal leaves apart, so that no leaf is too large for a partition
    parts = max(1, total // (8 * shard))
    ordered = forward.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, "leaf", "_place").sortWithinPartitions("leaf", "_place").drop("_place", "leaf")
    kind = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(forward.schema["_id"].dataType)), *[T.StructField(x, T.BinaryType()) for x in ("terms", "ends", "docs", "impacts")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            nonlocal number, held, count
            rows = pa.Table.from_batches(held).combine_chunks()
            n = rows["n"].to_numpy()
            data, offsets = flat(rows["terms"])
            term, tf = data.view(np.int32), flat(rows["tf"])[0].view(np.int32).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), np.diff(offsets) // 4)
            m = 50 + (50 * n * total) // length
            s = _Shard.build(term, doc.astype(np.int32), impact(tf, m[doc]).astype(np.int32), len(n))
            ids = rows["_id"].combine_chunks()
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (s.terms, s.ends.astype(np.int32), s.docs, s.impacts)]
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), ids), *binary], names=kind.names)
            number, held, count = number + 1, [], 0
            return out

        for batch in batches:
            while len(batch):
                some = batch.slice(0, shard - count)
                held.append(some)
                count += len(some)
                batch = batch.slice(len(some))
                if count == shard:
                    yield done()
        if held:
            yield done()

    return ordered.mapInArrow(work, kind)


def _opened(row: tuple, size: int) -> _Shard:
    return _Shard(*[np.frombuffer(x, np.int32) for x in row], size)


def _bounds(shards: DataFrame, queries: Queries, weights: np.ndarray) -> DataFrame:
    """(shard, q, bound) where the bound is over 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = np.repeat(np.arange(len(queries.items)), np.diff(queries.ends))
        for batch in batches:
            for k in range(len(batch)):
                s = _opened([batch.column(x)[k].as_buffer() for x in ("terms", "ends", "docs", "impacts")], 0)
                best = np.zeros(len(queries.asked), np.int64)
                best[s.terms] = s.best()
                bound = np.bincount(query, weights=weights * best[queries.terms], minlength=len(queries.items)).astype(np.int64)
                q = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), batch.column("shard")[k].as_py())), pa.array(q), pa.array(bound[q])], names=["shard", "q", "bound"])

    return shards.select("shard", "terms", "ends", "docs", "impacts").mapInArrow(work, "shard long, q long, bound long")


def _visit(shards: DataFrame, pairs: DataFrame, queries: Queries, weights: np.ndarray, top: int) -> DataFrame:
    """(q, _id, score): of each pair (shard, q, least) the best documents with at least that score."""
    asked = pairs.groupBy(F.col("shard").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("q", "least"))).alias("asked"))
    kind = shards.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("_id", kind), T.StructField("score", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = batch.column("ids")[k].values
                s = _opened([batch.column(x)[k].as_buffer() for x in ("terms", "ends", "docs", "impacts")], len(ids))
                order = np.empty(len(ids), np.int64)
                order[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                qs, at, got = [], [], []
                for x in batch.column("asked")[k].as_py():
                    a, b = queries.ends[x["q"]], queries.ends[x["q"] + 1]
                    score = s.scores(queries.terms[a:b], weights[a:b])
                    good = np.flatnonzero(score >= max(x["least"], 1))
                    good = good[np.lexsort((order[good], -score[good]))[:top]]
                    qs.append(np.full(len(good), x["q"])), at.append(good), got.append(score[good])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(got))], names=schema.names)

    return shards.join(asked, F.col("shard") == F.col("_s")).select("ids", "terms", "ends", "docs", "impacts", "asked").mapInArrow(work, schema)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _answers(docs: DataFrame, tree: np.ndarray, queries: Queries, top: int, shard: int, rounds: tuple[int, int]) -> DataFrame | None:
    """(q, rank, _id, score) of a block of queries."""
    spark = docs.sparkSession
    forward = cut(_forward(docs, tree, queries.asked))
    total, length = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return None
    weights = queries.weigh(total, _frequencies(forward, len(queries.asked)))
    shards = cut(_shards(forward, total, length, shard))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row is a whole shard
    left = cut(_bounds(shards, queries, weights).withColumn("least", F.lit(0).cast("long")))
    found = None
    for many in (*rounds, None):
        turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "shard"))
        now = left if many is None else left.withColumn("_turn", turn).where(F.col("_turn") <= many).drop("_turn")
        new = _visit(shards, now.select("shard", "q", "least"), queries, weights, top)
        found = cut(_best(new if found is None else new.union(found), top).select("q", "_id", "score"))
        if many is None:
            break
        least = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).otherwise(0).alias("least"))
        rest = left.join(now.select("shard", "q"), ["shard", "q"], "left_anti").drop("least").join(least, "q", "left")
        left = cut(rest.withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).where("bound >= least"))
        if left.isEmpty():
            break
    small_batches(spark)
    return cut(_best(found, top))


def search(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", top: int = TOP, sample: int = SAMPLE, depth: int = DEPTH, shard: int = SHARD, rounds: tuple[int, int] = (FIRST, SECOND), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each query's `top` documents with a score above 0: its id, rank (from 1), document id, score.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased in A-Z.
    With N documents that have a term, L terms in them, n terms in one and df documents with a term, a
    term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))) and a document scores, over the query's different
    terms, w * ((10**9 tf) div (1000 tf + 20 (50 + (50 n N) div L))). Equal scores are ranked by document id, null last.
    Null and empty texts have no terms. Rows of `docs` with equal ids are documents of their own; queries
    equal in id and text are one query. No query or no document gives no rows; other columns are
    ignored. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).alias("_id"), as_bytes(text_col).alias("_text"))
    kind, item = narrow.schema["_id"].dataType, queries.schema[query_id].dataType
    schema = T.StructType([T.StructField(query_id, item), T.StructField("rank", T.IntegerType()), T.StructField(id_col if id_col != query_id else "doc_id", kind), T.StructField("score", T.LongType())])
    tree, block, held = None, [], 0
    asked = queries.select(F.col(query_id).alias("i"), as_bytes(query_text).alias("t")).distinct()

    def answer() -> DataFrame | None:
        nonlocal tree
        own = Queries(block)
        if not len(own.asked):
            return None
        tree = fit_order(docs, id_col, text_col, sample, depth) if tree is None else tree
        got = _answers(narrow, tree, own, top, shard, rounds)
        names = spark.createDataFrame(list(enumerate(own.items)), T.StructType([T.StructField("_q", T.LongType()), T.StructField("_item", item)]))
        return None if got is None else got.join(F.broadcast(names), F.col("q") == F.col("_q")).select(F.col("_item").alias(schema.names[0]), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(schema.names[2]), "score")

    parts = []
    for row in asked.toLocalIterator():
        block.append((row.i, bytes(row.t)))
        held += len(row.t)
        if held >= block_bytes:
            parts.append(answer())
            block, held = [], 0
    if block:
        parts.append(answer())
    out = None
    for part in parts:
        out = part if out is None else out if part is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out
