"""Exact de-duplication with streaming state that never expires.

Documents arrive as a file stream. Keyed state in RocksDB (on disk, committed to
the shared checkpoint folder, so a lost executor restores it) holds per digest
of the normalised text: the largest id so far, its content locator (file, id) and
the number of rows. Nothing is ever evicted, so a copy that arrives any time later
meets its group. On a hit, equal digests are not taken for equal texts: the full bytes
under each digest are compared, and rows whose digest agrees while the text does not
are grouped by the text itself.

Defined cases: null text counts as empty; ids rank nulls lowest, and a group with
null ids only keeps null; rows repeated in full (same id and text) are one document
and all of them carry ``kept``. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.llm.common import ascii_lower
from boxtally.session import scratch_path
from boxtally.streaming.runner import rocksdb_state

Digest = Callable[[Column], Column]
#: Spark passes over files that are this much older than the newest seen one (7 days unless set): none ever is.
MAX_FILE_AGE = "36500d"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


@contextmanager
def _small_stores(spark: SparkSession):
    """Many small stores: no space set aside in advance, and commits write what changed."""
    wanted = {"allowFAllocate": "false", "changelogCheckpointing.enabled": "true"}
    keys = {f"spark.sql.streaming.stateStore.rocksdb.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def digest_state(spark: SparkSession, path: str, digest: Digest = sha256, checkpoint: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    """Drain the document files at ``path`` into keyed state and return the newest state.

    Columns: ``digest, keep_id, keep_file, group_size``. Given the same ``checkpoint``
    again, only files that came since are read. Each micro-batch writes the groups it
    touched to a folder of its own, so a replayed batch replaces itself; the newest entry
    of a group is the one with the most rows.
    """
    root = checkpoint or scratch_path(spark, "exact-dedup")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern the path may name one file or a folder of files; a plain path must be a folder.
    rows = source.parquet(f"{path[:-1]}[{path[-1]}]").select(
        digest(normalised(F.col("text"))).alias("digest"),
        F.struct("doc_id", F.col("_metadata.file_path").alias("file")).alias("at"))
    groups = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("group_size"))
    flat = groups.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"),
                         "group_size")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    with rocksdb_state(spark), _small_stores(spark):
        q = (flat.writeStream.outputMode("update").foreachBatch(store)
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    written = spark.read.schema(flat.schema).parquet(f"{root}/state/batch=*")
    return written.groupBy("digest").agg(
        F.max_by(F.struct("keep_id", "keep_file"), "group_size").alias("k"), F.max("group_size").alias("group_size")
    ).select("digest", "k.keep_id", "k.keep_file", "group_size")


def exact_groups(spark: SparkSession, path: str, digest: Digest = sha256) -> DataFrame:
    """One row per document row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    docs = spark.read.parquet(path)
    if not docs.take(1):
        return docs.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                           F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
    state = digest_state(spark, path, digest)
    norm = normalised(F.col("text"))
    rows = docs.select("doc_id", norm.alias("norm"), digest(norm).alias("digest"))
    # Full bytes: the distinct texts of a digest. Copies fold into one before the shuffle, so a large group moves
    # its text once per task. A digest of several texts is torn.
    torn = (rows.groupBy("digest", "norm").agg(F.count("*").alias("copies")).groupBy("digest")
            .agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))
    torn_path = scratch_path(spark, "torn-digests")
    torn.write.parquet(torn_path)
    torn = spark.read.schema(torn.schema).parquet(torn_path)
    out = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"),
           F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("text_sha256")]
    sha = sha256(F.col("norm")).alias("text_sha256")
    if not torn.take(1):
        narrow = rows.select("doc_id", "digest", sha)
        return narrow.join(state, "digest").select(*out)
    whole = rows.select("doc_id", "digest", sha).join(torn, "digest", "left_anti").join(state, "digest").select(*out)
    split = rows.join(torn, "digest", "left_semi").select("doc_id", "norm", sha)
    by_text = split.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return whole.unionByName(split.join(by_text, "norm").select(*out))
