"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import ann, bpe, centroids, decontaminate, merkle, mixing, simhash, substring, topk, toxicity, urlfilter, warc, wordlm
from voxelmill.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = bpe.round_trip(docs, path)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return wordlm.score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), targets, keep_text=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round("keep_prob", 6).alias("keep_prob"), "selected")


def op8_mixing_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins met in full: documents of cells that should grow repeat."""
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeat=True).select("doc_id", "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round("keep_prob", 6).alias("keep_prob"), "copies", "selected")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    # a text without removals keeps its own spacing in the operator; the digest joins words by one space
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(spaced.cast("binary"), 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return warc.read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digests(decontaminate.find_hits(docs, bench))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_digest(*centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_ann, op3_simhash, op4_topk, op5_lm, op6_toxicity, op7_urls, op8_mixing, op8_mixing_repeats, op9_substring, op10_warc, op11_decontaminate, op12_centroids, op13_merkle)}
ORACLE_SQL: dict[str, str] = {"op2_ann": ann.oracle_sql(), "op4_topk": topk.oracle_sql(), "op7_urls": urlfilter.oracle_sql(), "op8_mixing": mixing.oracle_sql(), "op10_warc": warc.oracle_sql(), "op11_decontaminate": decontaminate.oracle_sql(), "op12_centroids": centroids.oracle_sql(), "op13_merkle": merkle.oracle_sql()}
