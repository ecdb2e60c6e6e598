import zlib
from collections import Counter

from rillmark.llm import sharding
from tests.llm.fixtures import corpus, documents


def test_columns_counts_slots_and_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 8)
    rows = corpus(300)
    out = sharding.stratified_shards(documents(spark, rows), 16).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == want
    shards = Counter(r.shard for r in out)
    assert sorted(shards) == list(range(16)) and max(shards.values()) - min(shards.values()) <= 1
    for s, n in shards.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    for stratum, n in Counter(r.stratum for r in out).items():
        for s in range(16):
            # within one of its fractional range, whose width small strata shift by less than two rows more
            assert abs(sum(r.stratum == stratum and r.shard == s for r in out) - n / 16) <= 3
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_same_seed_same_order_and_few_rows(spark):
    docs = documents(spark)
    pick = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.select("doc_id", "shard", "slot").collect())
    assert pick(sharding.stratified_shards(docs, 4)) == pick(sharding.stratified_shards(docs.repartition(7), 4))
    assert pick(sharding.stratified_shards(docs, 4)) != pick(sharding.stratified_shards(docs, 4, seed=5))
    assert pick(sharding.stratified_shards(documents(spark, corpus(1)[:2]), 16)) and sharding.stratified_shards(documents(spark, [])).count() == 0


def test_order_and_ranks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 8)
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(200)] + [(1000 + i, "x", "en", f"only{i}", 1) for i in range(150)]
    out = sharding.stratified_shards(documents(spark, rows), 16).collect()
    by_place = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.fraction for r in by_place] == sorted(r.fraction for r in out)
    for stratum, n in Counter(r.stratum for r in out).items():
        own = sorted(r.fraction for r in out if r.stratum == stratum)
        assert 0 < own[0] < 1 / n and all(abs(b - a - 1 / n) < 1e-9 for a, b in zip(own, own[1:], strict=False))
    # strata of one row each do not all fall on the same rank
    assert max(Counter(r.shard for r in out if r.stratum.startswith("only")).values()) < 30


def test_identical_rows_beyond_a_range_are_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 16)
    rows = [(None, "same", "en", "hot", 1)] * 150 + [(i, f"t{i}", "en", None if i % 2 else "hot", 1) for i in range(150)]
    out = sharding.stratified_shards(documents(spark, rows), 16).collect()
    assert len(out) == 300 and sorted({r.shard for r in out}) == list(range(16))
    for s in range(16):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) in (18, 19)
        # half of all rows are copies, and every shard matches the mixture of strata
        assert abs(sum(r.stratum is None for r in own) - 75 / 16) <= 2
    ranges = Counter(int(r.fraction * 18) for r in out if r.doc_id is None)
    assert len(ranges) >= 12 and max(ranges.values()) < 40
