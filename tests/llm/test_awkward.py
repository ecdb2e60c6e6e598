"""Null and repeated ids, texts of over 1 MB, and other awkward rows through every operator on documents."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from rillmark.llm import html, langid, media, packing, sharding, toxicity
from rillmark.llm.queries import TOKENIZER
from tests.llm.fixtures import SCHEMA, documents


def rows():
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 8))) for _ in range(220_000))
    out = [(None, "one two", "en", "s", 1), (None, "one two", "en", "s", 1), (None, None, None, None, None), (None, "", "en", None, 0), (1, long, "en", "hot", 1), (None, long[:1_100_000], None, "hot", 1), (2, "z" * 1_050_000, "fr", "hot", 1)]
    return out + [(3, "x y", "fr", "hot", 1)] * 40


def key(rows):
    return Counter((i, len((t or "").encode())) for i, t, *_ in rows)


def test_packing(spark):
    out = packing.pack(documents(spark, rows()), capacity=2048, **TOKENIZER).collect()
    whole = Counter()
    for r in out:
        whole[r.doc_id] += r.length
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(i for i, *_ in rows())
    fill = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert fill[r.sequence_id] == r.offset
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and whole[3] == 40 * next(r.length for r in out if r.doc_id == 3)


def test_languages_and_toxicity(spark):
    docs = documents(spark, rows())
    names, table = langid.prototypes(docs)
    out = langid.identify(docs, names, table, keep=[F.col("doc_id"), F.octet_length("text").alias("size")]).collect()
    assert Counter((r.doc_id, r["size"] or 0) for r in out) == key(rows()) and len({(r.lang_pred, r.score) for r in out if r.doc_id == 3}) == 1
    model = toxicity.fit([(b"bad vermin here", 1), (b"a fine day", 0)] * 5, 0.5)
    out = toxicity.score_texts(docs, model, keep=[F.col("doc_id"), F.octet_length("text").alias("size")]).collect()
    assert Counter((r.doc_id, r["size"] or 0) for r in out) == key(rows()) and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id == 3}) == 1


def test_shards_and_media(spark):
    docs = documents(spark, [r for r in rows() if r[0] != 2])
    out = sharding.stratified_shards(docs, 4).collect()
    assert Counter((r.doc_id, r.size - 1, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in rows() if i != 2)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    small = documents(spark, [r for r in rows() if len(r[1] or "") < 1000])
    out = media.describe(media.store(small)).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == key(r for r in rows() if len(r[1] or "") < 1000)
    assert len({r.payload_sha256 for r in out if r.doc_id == 3}) == 1


def test_pages_of_over_a_megabyte(spark):
    body = "<p>word &amp; <b>bold</b></p>" * 40_000
    pages = spark.createDataFrame([(None, "u", body), (None, "u", body), (1, None, "<p>" + "q" * 1_100_000), (2, "u", None)], "page_id long, url string, html string")
    out = html.extract(pages).collect()
    assert Counter(r.page_id for r in out) == Counter({None: 2, 1: 1, 2: 1})
    texts = [r.text or "" for r in out if r.page_id is None]
    assert texts[0] == texts[1] and texts[0].count("word & bold") == 40_000 and max(len(r.text or "") for r in out) >= 1_100_000


def test_schema_is_the_documents_one(spark):
    assert spark.createDataFrame([], SCHEMA).columns == documents(spark).columns[:5]
