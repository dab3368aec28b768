"""Stored tables: Parquet with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.operators.tables import publish
from boxtally.schemas import PARTITIONS, TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table; filters and column choices reach the files."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_queue(spark: SparkSession, root: str) -> DataFrame:
    """The review queue with its integer flags and text times in proper types."""
    raw = read_table(spark, root, "annotation_candidates")
    casts = {c: F.col(c).cast("boolean") for c in ("recovery_attempted", "added_to_dataset")}
    casts |= {c: F.try_to_timestamp(c) for c in ("created_at", "reviewed_at")}
    return raw.withColumns(casts)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table in declared order and type; absent ones become null."""
    schema = df.sparkSession.createDataFrame([], TABLES[name]).schema
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _with_month(df: DataFrame, name: str) -> DataFrame:
    if "created_month" in PARTITIONS.get(name, ()) and "created_month" not in df.columns:
        df = df.withColumn("created_month", F.date_format("created_at", "yyyy-MM"))
    return df


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Replace a stored table in one step.

    Runs go to month folders, range-partitioned by time: a busy month is many
    files of equal size, each with a narrow time range, so a window of hours
    opens few of them.
    """
    out = conform(_with_month(df, name), name)
    if name in PARTITIONS:
        out = out.repartitionByRange("created_at").sortWithinPartitions("created_at")
    publish(out, f"{root}/{name}", PARTITIONS.get(name))


def append_table(df: DataFrame, root: str, name: str) -> None:
    writer = conform(_with_month(df, name), name).write.mode("append")
    if name in PARTITIONS:
        writer = writer.partitionBy(*PARTITIONS[name])
    writer.parquet(f"{root}/{name}")


def runs_since(spark: SparkSession, root: str, since: str) -> DataFrame:
    """Stored runs from a time on: the folder filter beside the time filter."""
    at = F.lit(since).cast("timestamp")
    return read_table(spark, root, "runs").filter(
        (F.col("created_month") >= F.date_format(at, "yyyy-MM")) & (F.col("created_at") >= at))
