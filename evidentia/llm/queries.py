"""The registered queries of the corpus operators: thin projections of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import oracles, oracles_manifest
from evidentia.llm.bpe_codec import bpe_encode
from evidentia.llm.centroid_clusters import cluster_report
from evidentia.llm.common import table
from evidentia.llm.decontamination import benchmark_leaks
from evidentia.llm.line_dedup import duplicate_lines
from evidentia.llm.merkle_manifest import merkle_manifest
from evidentia.llm.ngram_join import near_duplicates
from evidentia.llm.quality_classifier import quality_scores
from evidentia.llm.quality_rules import quality_rules
from evidentia.llm.secret_scan import BASE, secret_scan
from evidentia.llm.sharding import shard_rows
from evidentia.llm.simhash_join import simhash_groups
from evidentia.llm.token_counts import token_counts
from evidentia.llm.toxicity import toxicity_scores

TOKENIZER = "word_bpe_49k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of the lines that go; texts do not travel for this."""
    documents = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    every = documents.select("doc_id", F.xxhash64(text).alias("text_hash"), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    removed = duplicate_lines(documents)
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_hash") == F.col("r.text_hash"))
    gone = F.coalesce("r.removed", F.array().cast("array<int>"))
    return every.alias("d").join(removed.alias("r"), same, "left").select("d.doc_id", "d.n_lines", F.size(gone).alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rules", ",").alias("rules"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["name"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"], x["stop"])), ",")
    base: Column = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return scanned.select("doc_id", *[count(k) for k in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_prior", "quality_evidence", "quality_score", F.col("quality_kept").alias("kept"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.col("leaks.item_id").alias("item_ids"), F.array_min("leaks.distance").alias("least_distance"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_simhash": op12_simhash,
    "op13_merkle_manifest": op13_merkle_manifest,
}
#: The others are beyond SQL, or too slow in it on whole tables; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op2_quality_rules": oracles.quality_rules_sql(),
    "op4_ngram_join": oracles.NGRAM_JOIN,
    "op7_secret_scan": oracles.SECRET_SCAN,
    "op11_centroid_clusters": oracles_manifest.clusters_sql(),
    "op13_merkle_manifest": oracles_manifest.MERKLE,
}
