"""A corpus pipeline: five stages, each on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``; where a stage changes
a text, n_chars follows. Every stage handles texts of any length whole and gives an empty table for
an empty one; extra columns pass through all but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.bpe_codec import bpe_encode
from evidentia.llm.common import table
from evidentia.llm.decontamination import without_leaks
from evidentia.llm.line_dedup import line_dedup
from evidentia.llm.ngram_join import one_of_each_group
from evidentia.llm.quality_classifier import quality_scores
from evidentia.llm.queries import tokenizer_path
from evidentia.plans.staging import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged by their statistics; repeated rows share one verdict; a score at the
    threshold stays."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).filter("quality_kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; so do documents that had words and keep none.

    Null and empty texts stay as they are; of repeated rows each has the same lines taken out, as one
    document; of equal lines the first in the order of (doc_id, line) stays, null ids first."""
    kept = line_dedup(docs)
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = kept.filter(~emptied).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the one with the least id.

    Null ids come first; a null text is an empty one, and empty texts are copies of each other; of rows
    that repeat an id and its text one stays; of unlike texts under one id each stays."""
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows go or stay together; null and empty items are in no text."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, a row for each; a null text is an empty one."""
    return bpe_encode(docs, tokenizer_path(), digests=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", dedup_lines),
    ("n-gram join", near_duplicates),
    ("decontamination", decontaminate),
    ("BPE", encode),
]
#: Similarity joins over components, edit distances and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name.replace(' ', '_')}")
    return docs
