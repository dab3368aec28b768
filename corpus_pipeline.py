"""From raw documents to training shards, in five stages.

Each stage reads the documents that the stage before wrote, takes its decisions and returns the
documents that are left; the last one returns the placement of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxtally.llm import decontam, mixing, near_dedup, quality, sharding
from boxtally.llm.common import table
from boxtally.session import scratch_path

#: Text bytes a training shard holds at most, nearly.
SHARD_BYTES = 128 * 2**20


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, target_bytes=SHARD_BYTES)


STAGES = [
    ("quality", keep_quality), ("near_dedup", drop_near_copies), ("decontamination", decontaminate),
    ("mixing", mix_sources), ("sharding", assign_shards),
]

# No SQL: the quality model is trained, and the mix and the shards follow from it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
