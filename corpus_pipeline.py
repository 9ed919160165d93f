"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last the columns of documents.

Every stage takes any row: null and empty texts are texts without words, repeated rows are rows of their own (or copies,
where copies go), null ids are ids, and further columns, also such that bear an output's name, are left behind. An empty
table gives an empty result. What that means for a stage stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import bpe, mixing, simhash, substring, toxicity
from voxelmill.llm.queries import tokenizer_path
from voxelmill.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go. Null and empty texts have the model's bias as their score; repeated rows share one."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), out="tox_score", flag="tox_flag")
    return scored.filter("tox_flag = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least doc_id, with each of the rows that share it. Rows
    without a doc_id stay. Texts without words are one group, linked like any other."""
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages go from the texts; ``n_chars`` follows. No row goes; a null text stays null, and repeated rows
    (same doc_id and text) are one place, so that neither loses words to the other."""
    return substring.dedup_substrings(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities stay. Repeated rows draw alike; documents without words weigh in no
    margin and stay with their cell's probability."""
    return mixing.mix(docs).filter("selected").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; none for null and empty texts."""
    return bpe.token_lists(docs, tokenizer_path()).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("substring_dedup", drop_substrings), ("mixing", mix_sources), ("bpe", tokenize)]

#: A trained model and the tokenizer's merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
