"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Each stage works on all that its predecessor kept, and its decisions take effect: texts without a
language go (and others get theirs), one document of each near-duplicate group stays, passages that repeat lose their bytes
(documents that have nothing else go), documents with benchmark passages go, and what is left is
packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import decontam, langid, minhash, packing, suffix
from rillmark.llm._base import shared_dir
from rillmark.llm.queries import TOKENIZER


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that have a language. Rejects texts in which none can be found (`und`);
    texts without a language get the one that is found, other labels stay."""
    names, table = langid.prototypes(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = langid.identify(docs, names, table, keep=[row]).where("lang_pred <> 'und'")
    return judged.select(*[F.coalesce(F.col("_row")[c], F.col("lang_pred")).alias(c) if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every run of 50 words that occurs twice loses its bytes, so that each passage of over 50 words
    goes, however few bytes it has. Documents that have only blanks left go too."""
    out = suffix.without_repeats(docs, length=50, words=True)
    touched = F.size("removed_spans") > 0
    out = out.withColumn("text", F.when(touched, F.col("kept_bytes").cast("string")).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where(~touched | F.col("text").rlike(r"\S")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten benchmark words occurs go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their ids and their places in sequences."""
    return packing.pack(docs, capacity=2048, keep_ids=True, **TOKENIZER)


STAGES = [
    ("language_id", identify_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]
#: SQL has no tokenizer and no trained profiles; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
