"""Run a stream over the data that is there, into a table of the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from boxtally.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keep operator state in RocksDB, off the heap, while a query starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def drain_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in append mode and read the result."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    with rocksdb_state(spark):
        q = (stream.writeStream.outputMode("append").format("parquet")
             .option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def drain_each(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None],
               checkpoint: str | None = None, mode: str = "append") -> None:
    """Process all available input batch by batch."""
    spark = stream.sparkSession
    where = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    with rocksdb_state(spark):
        q = (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", where)
             .trigger(availableNow=True).start())
        q.awaitTermination()
