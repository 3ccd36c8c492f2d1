"""Corpus pipeline: stages over ``documents``, each written as Parquet and read back.

Quality rules, exact n-gram Jaccard join, removal of repeated passages, redaction of secrets, and
packing into training sequences. Every stage works on all that the one before it kept; all but the
last return the columns of ``documents``.

Defined results: a null or empty text has no word, so the quality rules reject it; a null or repeated
doc_id passes through all stages, as each works on texts; ties of near copies go by doc_id, then by a hash of
the text; columns besides doc_id and text (n_chars apart, which follows the text) pass unchanged up to the
last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from heliogrid.llm.common import staged, table
from heliogrid.llm.queries import vocabulary


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` in the columns of ``like``; n_chars follows the text."""
    if "n_chars" in like.columns:
        df = df.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.keep(docs)


def stage_ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least doc_id, rows without an id last.

    Of rows that share doc_id and text one stays; rows that share a doc_id only are documents of their own.
    """
    return ngram_join.representatives(docs)


def stage_suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere leave the texts; a text that is nothing else goes."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    out = suffix_dedup.dedup(row).where("n_removed < n_bytes or n_bytes = 0")
    return _columns(out.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]), docs)


def stage_secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return _columns(secret_scan.redact(docs, secret_scan.train(docs)), docs)


def stage_best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, with the training sequence and the place in it that each takes."""
    return packing.best_fit(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("ngram_jaccard_join", stage_ngram_jaccard_join),
    ("suffix_array_dedup", stage_suffix_array_dedup),
    ("secret_scans", stage_secret_scans),
    ("best_fit_packing", stage_best_fit_packing),
]

#: SQL can't express the suffix sort, the models and the packing; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
