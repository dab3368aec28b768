"""Streams over chat callbacks, domain events and runs."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxtally.functions.messages import route_message
from boxtally.operators.chat import flatten_callbacks
from boxtally.operators.dedup import first_per_key
from boxtally.operators.review import candidates_from_events
from boxtally.streaming.runner import drain_each

log = logging.getLogger(__name__)

Sink = Callable[[DataFrame, int], None]


def chat_messages(parsed: DataFrame, repeat_window: str | None = None) -> DataFrame:
    """Callbacks to routed messages, repeats dropped however late they come.

    The ids are keyed state without expiry: it holds one short text per message and lives in the state store,
    which :mod:`boxtally.streaming.runner` keeps off the heap. With ``repeat_window`` ids are
    forgotten that long after arrival, where state must be bounded by the traffic of that span.
    """
    if repeat_window is None:
        once = flatten_callbacks(parsed).dropDuplicates(["id"])
    else:
        messages = flatten_callbacks(parsed.withColumn("received_at", F.current_timestamp()))
        once = messages.withWatermark("received_at", repeat_window).dropDuplicatesWithinWatermark(["id"])
    return once.withColumn("route", route_message(F.col("type"), F.col("mime_type")))


def hour_of(at: Column) -> Column:
    return F.date_trunc("hour", at).alias("hour")


def batch_folder(batch: DataFrame, path: str, batch_id: int) -> str:
    """Folder of a batch of the query that runs it.

    The query id lives in the checkpoint: a replayed batch meets its own folder again, while a query
    with a new checkpoint counts batches from 0 in folders of its own.
    """
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{path}/query={query}/batch_id={batch_id}"


def count_sink(path: str, *keys: str | Column) -> Sink:
    """Write how many rows of each source file have each value of ``keys``.

    A file is read whole by one batch of a query, so these are its final numbers. A replayed batch writes its
    folder again; another query over the same files writes the same numbers in a folder of its own, and
    :func:`summed_counts` takes each file once. Batches need the column ``source_file``.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("source_file", *keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
            batch_folder(batch, path, batch_id))

    return handle


def summed_counts(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """Counts over all files that any query has seen; ``keys`` are the counted columns with their types."""
    rows = spark.read.schema(f"source_file string, {keys}, n long").parquet(f"{path}/query=*/batch_id=*")
    names = [c for c in rows.columns if c not in ("source_file", "n")]
    once = rows.groupBy("source_file", *names).agg(F.max("n").alias("n"))
    return once.groupBy(*names).agg(F.sum("n").alias("n"))


def fan_out(sinks: dict[str, Sink], retry: str) -> Sink:
    """Give each batch to every sink; a failing sink is logged and does not stop the others.

    The batch it failed on is written below ``retry`` for :func:`replay`. If that fails too, so does the
    query, and its checkpoint does not advance.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, batch_id)
                except Exception:
                    log.exception("sink %s failed on batch %s", name, batch_id)
                    batch.write.mode("overwrite").parquet(batch_folder(batch, f"{retry}/{name}", batch_id))
        finally:
            batch.unpersist()

    return handle


def replay(spark: SparkSession, retry: str, name: str, schema: str | StructType, handle: Sink) -> None:
    """Give the batches a sink failed on to it again, as a stream with a checkpoint of its own."""
    if not _exists(spark, f"{retry}/{name}"):
        return  # it never failed
    failed = spark.readStream.schema(schema).parquet(f"{retry}/{name}/query=*/batch_id=*")
    drain_each(failed, f"replay-{name}", handle, f"{retry}/{name}-checkpoint")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def queue_sink(path: str) -> Sink:
    """Append the review candidates of each batch; nothing stored is read.

    A run may come again in another batch, or after a lost checkpoint: :func:`read_queue` takes the first.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        candidates_from_events(batch).write.mode("overwrite").parquet(batch_folder(batch, path, batch_id))

    return handle


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue: the earliest candidate of every run."""
    rows = spark.read.parquet(f"{path}/query=*/batch_id=*")
    return first_per_key(rows, ["run_id"], ["created_us", "id"]).select(*rows.columns)
