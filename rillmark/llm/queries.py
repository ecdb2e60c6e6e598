"""The registered query of each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import codes, decontam, fertility, html, langid, media, minhash, packing, search, sharding, suffix, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Files of the public tokenizer that the packing query uses.
TOKENIZER = {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), capacity=2048, **TOKENIZER).drop("ids")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 5, 0)
    names, table = langid.prototypes(docs.where(~held))
    return langid.identify(docs, names, table, keep=[F.col("doc_id"), held.alias("held_out")])


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept_bytes")).alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"), min_revisit_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(_read(spark, sf_dir, "documents")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(_read(spark, sf_dir, "documents"), 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 4, 2)
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").where(~held))
    return toxicity.score_texts(docs, model, keep=[F.col("doc_id"), held.alias("held_out")], threshold=0.3)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), top=50)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(_read(spark, sf_dir, "embeddings"))


#: Vocabularies of the quality rules: one with byte tokens, one of bytes for many languages.
VOCABULARIES = [
    {"kind": "pieces", "path": public_tokenizers.path("piece_bpe_32k.model")},
    {"kind": "ranks", "path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN},
]


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(_read(spark, sf_dir, "documents"), VOCABULARIES)


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_best_fit_packing, op3_language_id, op4_minhash_near_dedup, op5_suffix_array_dedup, op6_warc, op7_media_columns, op8_benchmark_decontamination, op9_sharding, op10_toxicity, op11_ranked_search, op12_vector_codes, op13_quality_rules)
}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SEARCH = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents), ok AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM ok),
tf AS MATERIALIZED (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL), df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
part AS (SELECT item_id, doc_id, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS x FROM q JOIN df USING (t) JOIN tf USING (t) JOIN ok USING (doc_id) CROSS JOIN total),
s AS (SELECT item_id, doc_id, sum(x)::BIGINT AS score FROM part GROUP BY ALL HAVING sum(x) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 50"""


def _codes_sql() -> str:
    """The rounds unrolled: a{k} assigns with codebook b{k}, from which b{k + 1} follows."""
    parts, entries, rounds = codes.PARTS, codes.ENTRIES, codes.ROUNDS
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT i, (k - 1) // (n // {parts}) AS p, (k - 1) % (n // {parts}) AS j, x FROM (SELECT i, len(v) AS n, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS k FROM v)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, j, x FROM x WHERE i <= {entries})"""
    for k in range(rounds + 1):
        out += f""", a{k} AS MATERIALIZED (SELECT i, x.p, e, sum((x.x - b.x) * (x.x - b.x))::BIGINT AS d FROM x JOIN b{k} b ON b.p = x.p AND b.j = x.j GROUP BY i, x.p, e QUALIFY row_number() OVER (PARTITION BY i, x.p ORDER BY d, e) = 1)"""
        if k < rounds:
            out += f""", m{k} AS (SELECT x.p, a.e, x.j, sum(x.x)::BIGINT AS s, count(*)::BIGINT AS n FROM x JOIN a{k} a ON a.i = x.i AND a.p = x.p GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"""
    return f"""{out}, c AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY i)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN v USING (i)"""


_LEAKS = r"""WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, g)), n AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""".format(
    words=r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE_SQL: dict[str, str] = {"op8_benchmark_decontamination": _LEAKS, "op11_ranked_search": _SEARCH, "op12_vector_codes": _codes_sql()}
