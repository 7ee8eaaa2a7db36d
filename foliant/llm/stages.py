"""Stages of the corpus pipeline: documents in, documents out, five times.

Quality rules and decontamination judge each row by its own text and filter it
where it lies. Near-duplicates are known by id: a filter of the ids that go picks
rows in the map, and an exact join settles which of these stay. Every stage but
the last returns the columns of ``documents``; the last adds the shard of each row.

Rows with a null id are judged like any other by the stages that read texts, and
are never near-duplicates of others. Rows that repeat an id go or stay together as
near-duplicates. Null or empty texts fail the quality rules. An empty table stays
empty; further columns of the documents are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import materialize
from foliant.llm.decontaminate import clean
from foliant.llm.minhash_dedup import near_duplicates
from foliant.llm.mixing import mix_sources
from foliant.llm.quality_rules import passing
from foliant.llm.repeat_filter import seen
from foliant.llm.sharding import shard_rows

WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
BUDGET_PERCENT, MAX_EPOCHS, SEED = 80, 2, 17
SHARD_BYTES = 16 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates (five-word shingles, 0.8)."""
    gone = near_duplicates(docs, shingle=5, percent=80).filter("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    gone = materialize(gone, "near-duplicates")
    doubtful = seen(gone)(F.col("doc_id").cast("long"))
    # Ids that go grow with the corpus: a sort-merge join at every size.
    rest = docs.filter(doubtful).join(gone.hint("merge"), F.col("doc_id") == F.col("__id"), "left_anti")
    return docs.filter(~doubtful).unionAll(rest)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; a document that is taken in two epochs is there twice."""
    return mix_sources(docs, WEIGHTS, BUDGET_PERCENT, MAX_EPOCHS, SEED).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the leading hash bits that are their shard."""
    return shard_rows(docs, SHARD_BYTES).select("row.*", F.col("shard").alias("shard_prefix"), "shard_bits")


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("source mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
