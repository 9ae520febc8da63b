"""A training-corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared
folder and reads again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, ngram_jaccard, packing, substring_dedup, toxicity
from tessella.llm import words as W

#: No SQL expresses the model and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    W.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.without_toxic(spark, docs, _table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each component: the one with the smallest doc_id, of those that share it the one whose text
    has the smallest hash, and one of equal ones. Rows without words or without a doc_id stay."""
    found = ngram_jaccard.near_duplicates(spark, docs).where("doc_id IS NOT NULL")
    number, text, copies = (W.free(docs.columns, x) for x in ("keep_id", "keep_text", "keep_copies"))
    # rows without words are a group each, and their copies all stay
    each = found.groupBy(F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"), "doc_id", "tx").agg(F.count(F.lit(1)).alias("n"))
    alone = F.when(F.col("component_id").isNull(), F.struct("doc_id", "tx"))
    least = each.groupBy("component_id", alone.alias("alone")).agg(F.min(F.struct("doc_id", "tx", "n")).alias("r"))
    # a checkpoint, so that the plan of the next join is not the whole search's, once for each use
    keep = least.select("r.doc_id", "r.tx", F.when(F.col("component_id").isNull(), 0).otherwise(F.col("r.n"))).toDF(number, text, copies).checkpoint()
    mine = docs.withColumns({number: F.col("doc_id").cast("long"), text: F.xxhash64(F.coalesce("text", F.lit("")))})
    out = mine.join(keep.where(F.col(copies) <= 1), [number, text])
    repeated = keep.where(F.col(copies) > 1)
    if not repeated.isEmpty():
        out = out.unionByName(mine.join(repeated, [number, text]).dropDuplicates([number, text]))
    return out.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; what repeats nothing keeps its very text."""
    return substring_dedup.rewritten(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontamination.without_contaminated(spark, docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    place = W.shared(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}-{name}")
        docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
