import re

import numpy as np

from rillmark.llm import minhash
from rillmark.llm.graph import components
from tests.llm.fixtures import SCHEMA, corpus, documents


def sets_of(rows, width):
    out = []
    for i, text, *_ in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", lower)
        out.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def brute(rows, width=4, percent=80):
    sets = sets_of(rows, width)
    group = {i: i for i, _ in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_equals_brute_force(spark):
    assert got(minhash.near_duplicates(documents(spark), width=4)) == brute(corpus())


def test_large_families_are_dealt_out_as_pairs_of_blocks(spark):
    for block in (1, 3):
        assert got(minhash.near_duplicates(documents(spark), width=4, block=block)) == brute(corpus())


def test_blocks_of_a_family_meet_where_the_hub_does_not_link_them(spark):
    words = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 150]), "en", "s", 0) for k in range(60)]  # each links with the next only
    rows += [(100 + k, " ".join([*words[:200], f"x{k}"]), "en", "s", 0) for k in range(20)]
    assert got(minhash.near_duplicates(documents(spark, rows), width=4, block=4)) == brute(rows)


def test_chain_of_links_and_empty_table(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(9 - k, " ".join(words[10 * k : 10 * k + 150]), "en", "s", 0) for k in range(10)]
    assert got(minhash.near_duplicates(documents(spark, rows), width=4)) == brute(rows)
    assert minhash.near_duplicates(documents(spark, []), width=4).count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c d e f", "en", "s", 0), (4, "A b c d e f", "en", "s", 0), (None, "x y", None, None, None), (None, None, None, None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (-1, -1, True), (-1, 4, False), (4, 4, True)]


def test_estimate_is_close_at_high_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:1900], pool[100:2000]
    h = np.concatenate([a, b])
    sk = minhash.odd_sketch(minhash.signatures(h, np.array([0, len(a), len(h)]), 240))
    d = np.bitwise_count(sk[0] ^ sk[1]).sum()
    assert abs(minhash.estimate(d, 240) - 0.9) < 0.08
    assert d <= minhash.farthest(0.8, 240)


def test_components_of_a_path_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 104), (104, 100), (7, 7)]
    out = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.root) for r in out) == sorted([(i, 1) for i in range(2, 41)] + [(102, 100), (104, 100)])


def test_filter_keeps_columns_and_one_of_each_group(spark):
    docs = documents(spark)
    kept = minhash.drop_near_duplicates(docs, width=4)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == [i for i, _, _, k in dict.fromkeys(brute(corpus())) if k]


def test_filter_judges_rows_with_null_and_repeated_ids(spark):
    a, b, c = ("a b c d e f", "A b c d e f", "x y z u v w")
    rows = [(None, a, "en", "s", 0), (4, b, "en", "s", 0), (None, c, None, None, None), (None, c.upper(), None, None, None), (None, None, None, None, None), (None, None, None, None, None), (9, a, "fr", "s", 0), (9, "p q r s t", "fr", "s", 0), (7, "k l m n", "fr", "s", 0), (7, "K l m n", "fr", "s", 0)]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA), width=3).collect()
    assert sorted((r.doc_id or -1, (r.text or "").lower()) for r in kept) == [(-1, ""), (-1, c), (4, a), (7, "k l m n"), (9, "p q r s t")]
    assert (4, b) in {(r.doc_id, r.text) for r in kept}


def test_many_repeated_rows_meet_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    text, near = " ".join(words), " ".join([*words, "x"])
    seen = []
    confirm = minhash._confirm
    monkeypatch.setattr(minhash, "_confirm", lambda df, *a: (seen.append(df.count()), confirm(df, *a))[1])
    for n in (2, 200):
        rows = [(7, text, "en", "s", 1)] * n + [(None, text, None, None, None)] * n + [(9, near, "en", "s", 1), (None, " ".join(words[::-1]), None, None, None), (None, " ".join(words[::-1]), None, None, None)]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
        out = minhash.near_duplicates(docs, width=4).collect()
        assert sorted(((r.doc_id or -1, r.component_id or -1, r.kept) for r in out)) == sorted([(7, 7, True)] * n + [(-1, 7, False)] * n + [(9, 7, False)] + [(-1, -1, True)] * 2)
        kept = minhash.drop_near_duplicates(docs, width=4).collect()
        assert sorted((r.doc_id or -1, len(r.text)) for r in kept) == [(-1, len(text)), (7, len(text))]
    # classes of rows that a task may read once each: at most one for each of the shuffle's splits
    assert max(seen) <= 2 * 5


def test_blocks_are_dealt_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    words = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 150]), "en", "s", 0) for k in range(40)]
    rows += [(100 + k, " ".join([*words[:200], f"x{k}"]), "en", "s", 0) for k in range(12)]
    assert got(minhash.near_duplicates(documents(spark, rows), width=4)) == brute(rows)
