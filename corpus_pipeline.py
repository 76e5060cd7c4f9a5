"""A corpus from raw documents to shuffled shards: five stages over the table documents.

Each stage works on all rows that its predecessor kept. Where a stage needs another table (labels,
benchmark), it reads the one in ``sf_dir``. No stage goes by doc_id alone: null and repeated doc_ids, ties and repeated
rows are rows like others, and what becomes of them is said with each stage. Null and empty texts are texts without
words; very long ones are taken whole. Columns beyond those of documents, of whatever name, pass through. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldwright.llm import decontaminate, mixing, neardup, shard, toxicity
from fieldwright.llm.common import materialize, released


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain finds toxic go. Rows of equal text are judged alike; without labels all stay."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles and a similarity of 0.8, one row stays: the smallest doc_id, null last, then the least hash.

    Texts without words are one group, and so are repeated rows.
    """
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go, each row by its own text; an empty benchmark leaves all."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source comes to its target; null is a source. Of repeated rows as many are taken as the budget allows."""
    return mixing.mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its shard and slot of a reproducible shuffle; null doc_ids count first, and repeated rows get a place each."""
    return shard.shard(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents after all stages; between stages they are written as Parquet and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for _, stage in first:
        before, rows = rows, materialize(stage(spark, rows, sf_dir), "stage")
        released(before)
    return last(spark, rows, sf_dir)


#: The fitted chain and XXH64 are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version of all stages.
ORACLE_SQL = None
