"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str | int = "*", *, memory: str = "12g") -> SparkSession:
    """Session for tests and benches. On a cluster the caller brings its own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("boxtally")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` (or a checkpoint folder the application already
    set) wins. Only where neither is there and all runs on one machine, as in
    tests, a folder is made; a cluster must name one.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder path of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/boxtally/{name}-{uuid.uuid4().hex}"


#: rows that one task of a keyed step takes
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for a keyed step over ``rows`` rows: at least the set number of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal rows to tasks by key. About ``rows`` of them come: the tasks grow with that, the memory of one does not.

    Shuffles that the planner adds have a set number of partitions, whatever the table. While that suffices the
    planner may still join small ones; joins and groups on the same keys then need no further shuffle.
    """
    n = tasks(df.sparkSession, rows)
    return df.repartition(n, *keys) if n > tasks(df.sparkSession, 0) else df.repartition(*keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from the written table.

    A lost executor costs a re-read, and the known file size lets the planner
    choose a broadcast only where the table is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast only after counting; a larger table is joined by shuffle.

    The rows of ``df`` must be narrow (numbers or single words), so that the row
    bound is a size bound.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
