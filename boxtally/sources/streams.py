"""Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.schemas import EVENT, EVENT_PAYLOAD


def event_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Domain events as JSON lines; the payload is parsed to its declared fields."""
    reader = spark.readStream.schema(EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _with_file(reader.json(path)).withColumn("payload", F.from_json("payload", EVENT_PAYLOAD))


def _with_file(rows: DataFrame) -> DataFrame:
    """Name the file of each row: counts per file can be told apart from counts of the same file again."""
    return rows.withColumn("source_file", F.col("_metadata.file_path"))


def webhook_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Raw callback bodies, one JSON document per line; others drop out."""
    from boxtally.operators.chat import parse_callbacks

    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_callbacks(reader.text(path))


def table_stream(spark: SparkSession, sf_dir: str, name: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """A given Parquet table as a stream of its files, with the ``source_file`` of each row."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _with_file(reader.parquet(sf_dir))
