"""The corpus pipeline: language ID, line dedup, near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. ``run`` writes each stage's rows and gives them, read again, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskara.llm import bpe, langid, line_dedup, mixing, shingles
from maskara.llm.store import free, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, with a posterior of langid.MIN_SCORE or more."""
    at = free(docs, "_language")
    marked = langid.with_language(docs, langid.fit_documents(docs), at)
    return marked.filter((F.col(f"{at}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{at}.score") >= langid.MIN_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the boilerplate lines, however short (blank lines stay); n_chars follows the text."""
    at = free(docs, "_removed")
    out = line_dedup.drop_boilerplate(docs, removed=at)
    n_chars = F.when(F.col(at) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 in shingles of five words, that with the smallest doc_id."""
    return shingles.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.round_trip(bpe.encode(docs.select("doc_id", "text")))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("source_mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL has no forward algorithm, XXH64 or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(at := scratch(spark, name))
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
