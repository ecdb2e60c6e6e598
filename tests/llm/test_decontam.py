import random
import re

import numpy as np
from pyspark.sql import functions as F

from rillmark.llm import decontam
from tests.llm.fixtures import SCHEMA, corpus, documents

PATTERN = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(PATTERN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def benchmark():
    r = random.Random(5)
    rows = corpus()
    out = [(1, "one"), (2, ""), (3, None), (4, "never seen words in here at all")]
    for k in range(5, 25):
        w = words(r.choice(rows)[1])
        a = r.randrange(max(1, len(w) - 30))
        out.append((k, " ".join(w[a : a + r.randint(3, 30)]).upper()))
    return [*out, (30, out[7][1]), (31, out[8][1] + " " + out[9][1])]


def brute(rows, items, window=10):
    out = []
    for i, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for k, t in items:
            v = words(t)
            need = min(window, len(v))
            for a in range(len(v) - need + 1 if v else 0):
                for b in range(len(w) - need + 1):
                    if w[b : b + need] == v[a : a + need]:
                        hit |= set(range(b, b + need))
                        names.add(str(k))
        out.append((i, len(w), len(hit), sorted(names), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect())


def test_equals_brute_force_in_one_and_in_many_blocks(spark):
    items = spark.createDataFrame(benchmark(), "item_id long, text string")
    want = brute(corpus(), benchmark())
    assert any(x[4] for x in want) and not all(x[4] for x in want)
    assert got(decontam.contamination(documents(spark), items)) == want
    assert got(decontam.contamination(documents(spark), items, block_bytes=400)) == want


def test_empty_tables_and_filter(spark):
    items = spark.createDataFrame(benchmark(), "item_id long, text string")
    none = items.where("item_id < 0")
    assert decontam.contamination(documents(spark, []), items).count() == 0
    assert decontam.contamination(documents(spark), none).where("contaminated or n_hit <> 0 or size(items) <> 0").count() == 0
    kept = decontam.decontaminate(documents(spark), items)
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in brute(corpus(), benchmark()) if not x[4])


def test_null_document_ids(spark):
    docs = spark.createDataFrame([(None, "a one b", None, None, None), (None, None, None, None, None)], SCHEMA)
    out = decontam.contamination(docs, spark.createDataFrame([(None, "one"), (2, "b")], "item_id long, text string"))
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in out.select("n_words", "n_hit", "items").collect()) == [(0, 0, []), (3, 2, ["2", "null"])]


def test_suffix_array_orders_suffixes_and_finds_longest_matches():
    r = np.random.default_rng(2)
    text = r.integers(1, 4, 500)
    text[[100, 300, 499]] = 0
    order = decontam.suffix_array(text, 600)
    suffixes = [tuple(text[i:]) for i in order]
    assert suffixes == sorted(suffixes)
    query = text[40:60]
    left = np.arange(20, 0, -1)
    length, lo, hi = decontam.longest_matches(text, order, query, left, np.minimum(left, 3))
    assert length.tolist() == left.tolist()
    for k in range(18):
        places = sorted(order[lo[k] : hi[k]])
        assert places == [p for p in range(498) if (text[p : p + 3] == query[k : k + 3]).all()]


def test_hit_runs_count_hit_words(spark):
    items = spark.createDataFrame(benchmark(), "item_id long, text string")
    out = decontam.contamination(documents(spark), items)
    assert out.where((F.size("hit_runs") % 2 != 0) | (F.col("n_hit") > F.col("n_words"))).count() == 0


def test_filter_judges_rows_with_null_and_repeated_ids(spark):
    rows = [(None, "a one b", None, None, None), (None, "clean", None, None, None), (None, None, None, None, None), (3, "one", "en", "s", 1), (3, "clean too", "en", "s", 2), (3, "clean too", "en", "s", 2)]
    items = spark.createDataFrame([(1, "one"), (2, "never seen")], "item_id long, text string")
    for block_bytes in (decontam.BLOCK_BYTES, 4):
        kept = decontam.decontaminate(spark.createDataFrame(rows, SCHEMA), items, block_bytes=block_bytes)
        assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if "one" not in (r[1] or "")), key=str)
