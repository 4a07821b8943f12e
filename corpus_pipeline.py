"""From documents to token shards: classify, deduplicate, decontaminate, mix, write ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. Stages run one after
another with their result written as Parquet and read again, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import decontaminate, mixing, quality, simhash, tokens
from batchloom.llm.common import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id."""
    return simhash.keep_first(docs, order=("doc_id",))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of any benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced sample takes them; sources come near their target words."""
    return mixing.resample(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids in the shards, found through the index."""
    found = tokens.read_all(tokens.write_tokens(docs), docs)
    return found.select(F.col("key").alias("doc_id"), "copy", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", clean),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_ids),
]

#: A fitted classifier, a balanced sample and a tokenizer are beyond SQL; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split("/")[0].strip().replace(" ", "-"))
    return docs
