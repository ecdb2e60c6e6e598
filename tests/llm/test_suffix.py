import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from rillmark.llm import suffix
from tests.llm.fixtures import SCHEMA, corpus, documents


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return sorted(out, key=str)


def got(df):
    out = df.select("doc_id", F.col("text"), "kept_bytes", "removed_spans").collect()
    return sorted(((r.doc_id, sum(s.end - s.first for s in r.removed_spans), len(r.removed_spans), bytes(r.kept_bytes)) for r in out), key=str)


def repetitive(seed=1):
    r = random.Random(seed)
    block = lambda k: "".join(r.choice("abé ") for _ in range(k))
    one, two = block(90), block(70)
    rows = []
    for i in range(40):
        parts = [block(r.randint(0, 60)), r.choice([one, two, one[5:], two[:60], "a" * 150, ""]), block(r.randint(0, 20)), r.choice([one, one[20:80], ""])]
        rows.append((i, "".join(parts), None, None, None))
    return rows + [(50, "z" * 500, None, None, None), (51, one, None, None, None), (51, one, None, None, None)]


def test_equals_brute_force(spark):
    for length, gram in ((40, 8), (60, 60), (25, 5)):
        assert got(suffix.without_repeats(documents(spark, repetitive()), length=length, gram=gram)) == brute(repetitive(), length)


def test_documents_of_the_shared_fixture_and_groups_beyond_a_table(spark):
    for group in (8192, 1):
        assert got(suffix.without_repeats(documents(spark), length=100, gram=20, group=group)) == brute(corpus(), 100)


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    sizes = np.array([0, 1000, 1010, 1900])
    parts = [p for _, a, b in suffix._cut_rows(sizes, 100, 64) for p in zip(a, b, strict=True)]
    starts = sorted(s for a, b in parts for s in range(a, b - 99))
    assert starts == [*range(0, 901), *range(1010, 1801)]


def test_columns_and_empty_table(spark):
    docs = documents(spark)
    assert suffix.without_repeats(docs).columns == [*docs.columns, "kept_bytes", "removed_spans"]
    assert suffix.without_repeats(documents(spark, [])).count() == 0
    rows = [(None, "x" * 30 + "y" * 10, None, None, None), (None, "x" * 30 + "q" * 10, None, None, None), (None, None, None, None, None)]
    out = suffix.without_repeats(spark.createDataFrame(rows, SCHEMA), length=30, gram=10)
    assert sorted(bytes(r.kept_bytes) for r in out.collect()) == [b"", b"q" * 10, b"y" * 10]


def brute_words(rows, words):
    """Bytes that go because of a repeated run of words."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    tokens = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^ \t-\r]+", b)] for b in texts]
    run = lambda w, s: tuple(x[2] for x in w[s : s + words])
    runs = Counter(run(w, s) for w in tokens for s in range(len(w) - words + 1))
    out = []
    for (i, *_), b, w in zip(rows, texts, tokens, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(w) - words + 1):
            if runs[run(w, s)] > 1:
                gone[w[s][0] : w[s + words - 1][1]] = True
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_runs_of_words_equal_brute_force(spark):
    for rows, words, group in ((corpus(), 50, 8192), (corpus(), 12, 2), (repetitive(), 8, 8192)):
        out = suffix.without_repeats(documents(spark, rows), length=words, words=True, group=group).collect()
        assert sorted(((r.doc_id, bytes(r.kept_bytes)) for r in out), key=str) == brute_words(rows, words)


def test_rounds_find_what_sorting_all_strings_finds():
    r = random.Random(5)
    parts, lead = [], []
    for _ in range(60):
        before = r.randint(0, 7)
        parts.append(np.array([r.choice((3, 7)) for _ in range(r.randint(12, 12 + before))], np.uint8))
        lead.append(before)
    parts.append(parts[0].copy())
    lead.append(lead[0])
    last = np.array([len(p) - 12 - k for p, k in zip(parts, lead, strict=True)])
    flags = suffix.repeated_columns(parts, np.array(lead), last, 12, 8)
    seen = Counter((c, bytes(p[c + k : c + k + 12])) for p, k, e in zip(parts, lead, last, strict=True) for c in range(-k, min(e, 0) + 1))
    for p, k, e, f in zip(parts, lead, last, flags, strict=True):
        assert [c - 7 for c in np.flatnonzero(f)] == [c for c in range(-k, min(e, 0) + 1) if seen[c, bytes(p[c + k : c + k + 12])] > 1]


def test_pipeline_removes_passages_of_over_50_words_below_400_bytes(spark):
    passage = " ".join(f"w{k}" for k in range(51))
    assert len(passage) < 400
    rows = [(1, f"one here {passage} and on", "en", "s", 0), (2, f"two\n{passage.replace(' ', '  ')}\nnext", "en", "s", 0), (3, " ".join(f"w{k}" for k in range(49)), "en", "s", 0)]
    out = corpus_pipeline.remove_repeats(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "one here  and on"), (2, "two\n\nnext"), (3, rows[2][1])]
    assert sorted((r.doc_id, r.n_chars) for r in out) == [(1, 16), (2, 9), (3, 0)]


def test_many_repeated_rows_cost_no_more_than_their_number(spark):
    r = random.Random(9)
    text = "".join(r.choice("abcdefgh ") for _ in range(2800))
    near = text[:1500] + "#" + text[1500:]
    for n in (20, 200):
        rows = [(7, text, "en", "s", 1)] * n + [(None, text, None, None, None)] * n + [(100 + i, text, "en", "s", 1) for i in range(n)] + [(1, near, "en", "s", 1), (2, "x" * 500, "en", "s", 1), (3, near[:399], "en", "s", 1)]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
        for options in ({}, {"group": 1}):
            out = Counter((r.doc_id, bytes(r.kept_bytes), len(r.removed_spans)) for r in suffix.without_repeats(docs, **options).collect())
            assert out == Counter({(7, b"", 1): n, (None, b"", 1): n, (1, b"#", 2): 1, (2, b"", 1): 1, (3, near[:399].encode(), 0): 1} | {(100 + i, b"", 1): 1 for i in range(n)})


def test_copies_reach_the_rounds_once(spark):
    """What the tasks extract and sort does not grow with the copies of a text."""
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(1500))
    many = []
    for n in (2, 150):
        keyed = suffix._keyed(spark.createDataFrame([(i % 3, text, None, None, None) for i in range(n)], SCHEMA), "text")
        runs = suffix._find_anchors(keyed.select("_k1", "_k2", "_text"), 400, 50, False)
        asked = runs.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "fp", "ctx", F.lit(0).cast("long").alias("copy"), F.lit(1).cast("long").alias("groups"))).alias("runs"))
        many.append(suffix._extract(keyed.join(asked, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).coalesce(1), 400, False).count())
    assert many[0] == many[1] > 0
