"""From raw documents to training tokens: five stages, each one of the library's operators."""

from pyspark.sql import DataFrame, SparkSession

from panelfold.llm import containment, mixing, passages, simhash, tokens
from panelfold.session import materialize

# SQL can't train a classifier or hash shingles as SimHash does; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return passages.good(docs, passages.train(docs, labels, "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, written as compressed segments and read back."""
    return tokens.round_trip(docs, tokens.byte_bpe())


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontaminate), ("mixing to target weights", mix),
          ("token-ID output", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
