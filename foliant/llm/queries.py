"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import oracles, stages
from foliant.llm.decontaminate import contaminated
from foliant.llm.langid import fit, identify
from foliant.llm.lexical_search import ranked_search
from foliant.llm.license_scan import license_scan
from foliant.llm.line_dedup import line_digest
from foliant.llm.minhash_dedup import near_duplicates
from foliant.llm.mixing import mix_sources
from foliant.llm.quality_rules import quality_rules
from foliant.llm.sharding import shard_rows
from foliant.llm.source_divergence import source_divergence
from foliant.llm.suffix_dedup import remove_repeats, repeat_digest
from foliant.llm.token_counts import read_pieces, token_counts
from foliant.llm.vector_dedup import similar_vectors

#: Vocabulary of the token counts.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Target weights of the mix; what isn't named has weight 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
BUDGET_PERCENT, MAX_EPOCHS, SEED = 60, 4, 17
#: Bytes of text of a shard.
SHARD_BYTES = 16 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(remove_repeats(_table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), read_pieces(vocabulary))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), WEIGHTS, BUDGET_PERCENT, MAX_EPOCHS, SEED)
    return mixed.select("row.doc_id", "domain", "lang", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"), SHARD_BYTES).select("row.doc_id", "n_bytes", "shard_bits", "shard", "shard_bytes", "shard_rows")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=3, top=200)


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op10."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_token_counts, op3_language_id, op4_minhash_near_dedup, op5_source_mixing, op6_sharding,
        op7_quality_rules, op8_benchmark_decontamination, op9_line_dedup, op10_license_scan,
        op11_embedding_near_dedup, op12_ranked_lexical_search, op13_source_divergence_audit, pipeline,
        license_base_columns, quality_base_columns,
    )
}
SQL = {
    "op1_suffix_array_dedup": oracles.OP1,
    "op4_minhash_near_dedup": oracles.OP4,
    "op5_source_mixing": oracles.mixing_sql(WEIGHTS, BUDGET_PERCENT, MAX_EPOCHS, SEED),
    "op6_sharding": oracles.sharding_sql(SHARD_BYTES),
    "op9_line_dedup": oracles.OP9,
    "op11_embedding_near_dedup": oracles.OP11,
    "op12_ranked_lexical_search": oracles.OP12,
    "op13_source_divergence_audit": oracles.OP13,
    "license_base_columns": oracles.LICENSE_BASE,
    "quality_base_columns": oracles.QUALITY_BASE,
}
