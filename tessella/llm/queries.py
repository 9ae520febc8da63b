"""The thin queries over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat_format, decontamination, ngram_jaccard, packing, quality_rules, sharding, substring_dedup, token_counts, token_files, toxicity
from tessella.llm import words as W
from tessella.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    W.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words found in documents."""
    return decontamination.digest(decontamination.contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 50-word passages removed from all but the first document."""
    return substring_dedup.dedup_corpus(spark, _table(spark, sf_dir, "documents")).drop("kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and divergence from language references of all documents."""
    return quality_rules.ruled(spark, _table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    return sharding.sharded(_table(spark, sf_dir, "documents"), W.shared(spark, "shard-map"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to record files and read back."""
    path = W.shared(spark, "tokens")
    token_files.write(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), path)
    return token_files.read(spark, path)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.counted(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have Jaccard 0.8 or more."""
    return ngram_jaccard.near_duplicates(spark, _table(spark, sf_dir, "documents")).drop("tx")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    both = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat_format.digest(chat_format.formatted(turns.unionByName(both)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_substring_dedup,
        op3_quality_rules,
        op4_sharding,
        op5_toxicity,
        op6_token_files,
        op7_token_counts,
        op8_ngram_jaccard,
        op9_chat_format,
        op10_packing,
        pipeline,
    )
}
