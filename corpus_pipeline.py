"""From raw documents to packed sequences: the stages a training corpus goes through, each a written table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import packing, quality, simhash, substrings, toxicity
from narrata.shared import cut


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _rows(docs: DataFrame) -> DataFrame:
    """Every row as one value, so that added columns clash with none of its own."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    model = quality.fit(docs, _labels(spark, sf_dir))
    scored = _rows(docs).withColumn("score", quality.scorer(docs, model)(F.col("row.text")))
    return scored.where("score >= 0.3").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    field = toxicity.fit(docs, _labels(spark, sf_dir))
    judged = _rows(docs).withColumn("judged", toxicity.scorer(docs, field)(F.col("row.text")))
    return judged.where("judged.score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints, the one with the smallest id."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document stays even if nothing is left of it."""
    stripped = substrings.strip_repeats(docs)
    new = {"text": F.col("cut.kept_text"), "n_chars": F.when(F.col("cut.n_removed") > 0, F.length("cut.kept_text")).otherwise(F.col("row.n_chars")).cast("bigint")}
    return stripped.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", strip_repeats),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None  # its stages cannot be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
