import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rillmark.llm import search
from tests.llm.fixtures import corpus, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, top):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n, total, df = len(tfs), sum(sum(c.values()) for _, c in tfs), Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c in tfs:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def rows(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_equals_brute_force_in_several_rounds_and_blocks(spark):
    data = [(i, t) for i, t, *_ in corpus(240)] + [(None, "one two a b"), (None, None), (7, "x" * 1_200_000), (8, "one " * 300_000)] + [(900 + k, "one hot text abcd") for k in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string").select("*", F.lit(1).alias("score"), F.lit(2).alias("rank"), F.lit("q").alias("item_id"))
    asked = [(f"i{k}", data[k * 7][1]) for k in range(20)] + [("none", None), ("blank", " \t"), ("hot", "ONE hot text"), ("odd", "Ünï\U0001f600 x, one")]
    queries = spark.createDataFrame(asked + asked[:3], "item_id string, text string")
    want = brute(data, asked, 9)
    assert rows(search.search(docs, queries, top=9, sample=40, depth=3, shard=8, rounds=(1, 3))) == want
    assert rows(search.search(docs.repartition(5), queries, top=9, sample=1, depth=2, shard=500, block_bytes=400)) == want


def test_empty_tables_and_queries_without_terms(spark):
    docs, queries = documents(spark), spark.createDataFrame([("a", "one")], "item_id string, text string")
    assert search.search(documents(spark, []), queries).count() == 0
    assert search.search(docs, queries.limit(0)).count() == 0
    out = search.search(docs, spark.createDataFrame([("a", "?!"), ("b", None)], "item_id string, text string"))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_bisection_parts_two_vocabularies_and_bounds_prune(spark):
    r = np.random.default_rng(1)
    kinds = [r.choice(4000, 300, replace=False) + 4096 * k for k in range(2)]
    docs = [np.unique(r.choice(kinds[i % 2], 40)) for i in range(200)]
    tree = search.bisect(docs, 1)
    doc, slot = np.repeat(np.arange(200), [len(d) for d in docs]), np.concatenate(docs)
    leaf = search.route(doc, slot, 200, tree)
    assert set(leaf[::2]) != set(leaf[1::2]) and len(set(leaf[::2])) == len(set(leaf[1::2])) == 1
    # a shard's bound is at least every score in it
    term, at = r.integers(0, 50, 400), r.integers(0, 30, 400)
    pair = np.unique(term * 30 + at)
    s = search._Shard.build(pair // 30, (pair % 30).astype(np.int32), r.integers(1, 1000, len(pair)).astype(np.int32), 30)
    asked, w = np.arange(0, 60, 3), r.integers(0, 9000, 20)
    here, places = s.find(asked)
    assert s.scores(asked, w).max() <= (w[here] * s.best()[places]).sum() and here.sum() == 17
