"""The review queue and the ground truth it feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.functions.outcome import is_interesting
from boxtally.operators.dedup import first_per_key
from boxtally.operators.tables import new_rows

DEFAULT_FORMAT = "Code128"


def candidates_from_events(events: DataFrame) -> DataFrame:
    """Finished runs worth a look, as queue rows (first event per run)."""
    done = events.filter((F.col("type") == "INGEST_COMPLETED") & is_interesting(
        F.col("status"), F.col("scanner_count"), F.col("vision_count"),
        F.col("recovery_attempted"), F.col("recovery_labels_resolved")))
    first = first_per_key(done, ["run_id"], ["t_us", "event_id"])
    return first.select(
        F.concat(F.lit("cand-"), "run_id").alias("id"), "run_id", "session_id",
        F.coalesce("source", F.lit("unknown")).alias("source"), "image_ref",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scanner_count", "vision_count")],
        F.coalesce("recovery_attempted", F.lit(False)).alias("recovery_attempted"),
        F.coalesce("recovery_labels_resolved", F.lit(0)).alias("recovery_labels_resolved"),
        F.col("t_us").alias("created_us"))


def insert_candidates(queue: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue after the insert, and the rows that were new."""
    fresh = new_rows(queue, batch, ["run_id"], ["created_us", "id"])
    return queue.unionByName(fresh.select(*queue.columns)), fresh


def _page(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def list_pending(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Unreviewed, newest first. A limit is a page option, off by default."""
    return _page(queue.filter(F.col("reviewed_us").isNull()).orderBy(F.col("created_us").desc(), "id"), limit)


def list_reviewed(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviewed and not exported, latest review first."""
    ready = F.col("reviewed_us").isNotNull() & ~F.col("added_to_dataset")
    return _page(queue.filter(ready).orderBy(F.col("reviewed_us").desc(), "id"), limit)


def pending_with_runs(annotations: DataFrame, runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending annotations with what the reviewer needs of the run."""
    wanted = runs.select(F.col("id").alias("run_id"), "source", F.col("status").alias("run_status"),
                         "filename", "scanner_count", "vision_count", "primary_issue")
    return _page(annotations.filter(F.col("status") == "pending").join(wanted, "run_id").orderBy(
        F.col("created_us").desc(), "run_id"), limit)


def _reviewed_columns(stored: DataFrame, reviews: DataFrame) -> list[str]:
    codes = ["expected_barcodes"] if "expected_barcodes" in stored.columns and "expected_barcodes" in reviews.columns else []
    return ["reviewed_us", "reviewed_by", "expected_outcome", *codes]


def apply_review(queue: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First review of an unreviewed candidate counts; also says which did.

    ``reviews``: ``id, reviewed_us, reviewed_by, expected_outcome`` and the codes the reviewer reads on the photo,
    ``expected_barcodes`` (left as they are if either side has no such column).
    """
    first = first_per_key(reviews, ["id"], ["reviewed_us", "reviewed_by"])
    written = _reviewed_columns(queue, reviews)
    new = first.select("id", *[F.col(c).alias(f"n_{c}") for c in written])
    joined = queue.join(new, "id", "left")
    open_ = F.col("reviewed_us").isNull() & F.col("n_reviewed_us").isNotNull()
    put = {c: F.when(open_, F.col(f"n_{c}")).otherwise(F.col(c)) for c in written}
    updated = joined.withColumns(put).select(*queue.columns)
    free = queue.filter(F.col("reviewed_us").isNull()).select("id", F.lit(True).alias("_free"))
    judged = reviews.join(free, "id", "left").join(
        first.select("id", F.struct("reviewed_us", "reviewed_by").alias("_first")), "id")
    done = F.col("_free").isNotNull() & (F.struct("reviewed_us", "reviewed_by") == F.col("_first"))
    return updated, judged.withColumn("accepted", done).drop("_free", "_first")


def apply_review_overwrite(annotations: DataFrame, reviews: DataFrame) -> DataFrame:
    """The other review path: no guard, the latest review of a run wins."""
    last = first_per_key(reviews, ["run_id"], [F.col("reviewed_us").desc(), "reviewed_by"])
    written = _reviewed_columns(annotations, reviews)
    new = last.select("run_id", *[F.col(c).alias(f"n_{c}") for c in written])
    joined = annotations.join(new, "run_id", "left")
    hit = F.col("n_reviewed_us").isNotNull()
    put = {c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in written}
    put["status"] = F.when(hit, "reviewed").otherwise(F.col("status"))
    return joined.withColumns(put).select(*annotations.columns)


def mark_exported(queue: DataFrame, ids: DataFrame) -> DataFrame:
    named = ids.select("id", F.lit(True).alias("_named")).distinct()
    return queue.join(named, "id", "left").withColumn(
        "added_to_dataset", F.col("added_to_dataset") | F.col("_named").isNotNull()).select(*queue.columns)


def queue_stats(queue: DataFrame) -> DataFrame:
    reviewed = F.col("reviewed_us").isNotNull()
    return queue.agg(
        F.count_if(~reviewed).alias("pending"),
        F.count_if(reviewed & ~F.col("added_to_dataset")).alias("reviewed"),
        F.count_if("added_to_dataset").alias("exported"), F.count(F.lit(1)).alias("total"))


def with_existing_image(rows: DataFrame, inventory: DataFrame, column: str = "image_ref") -> DataFrame:
    """Rows whose image is in the inventory; null references drop out."""
    return rows.join(inventory.select(F.col("path").alias(column)), column, "left_semi")


def _suffix(path: Column) -> Column:
    found = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(".jpg"))


def export_ready(queue: DataFrame, inventory: DataFrame) -> DataFrame:
    """Reviewed, unexported candidates whose image exists, and the image name of their entry."""
    ready = queue.filter(F.col("reviewed_us").isNotNull() & ~F.col("added_to_dataset"))
    return with_existing_image(ready, inventory).select("id", "run_id", F.concat(
        F.lit("annotation_"), "run_id", _suffix(F.col("image_ref"))).alias("image"))


def export_entries(queue: DataFrame, expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """New ground-truth boxes of reviewed candidates, one row per expected code.

    ``expected``: ``run_id, box_no, value, format``. A reviewed candidate
    without codes gives one row with a null box, so its image is kept.
    """
    kept = export_ready(queue, inventory)
    boxes = expected.select("run_id", "box_no", F.coalesce("value", F.lit("")).alias("value"),
                            F.coalesce("format", F.lit(DEFAULT_FORMAT)).alias("format"),
                            F.lit("decoded").alias("box_status"))
    return kept.join(boxes, "run_id", "left")


def reviewed_codes(queue: DataFrame) -> DataFrame:
    """``run_id, box_no, value, format``: the codes that reviewers wrote on candidates, one row each."""
    return queue.select("run_id", F.posexplode("expected_barcodes").alias("box_no", "code")).select(
        "run_id", (F.col("box_no") + 1).alias("box_no"), "code.value", "code.format")


def image_entries(entries: DataFrame) -> DataFrame:
    """Ground-truth images of :func:`export_entries`, with their counts."""
    return entries.groupBy("image", "run_id").agg(
        F.count("box_status").cast("int").alias("expected_barcode_symbol_count"),
        F.count_if(F.col("box_status") == "decoded").cast("int").alias("expected_decoded_count")).select(
        "image", F.lit("annotation").alias("source"), F.col("run_id").alias("annotation_run_id"),
        "expected_barcode_symbol_count", "expected_decoded_count")


def images_summary(images: DataFrame) -> DataFrame:
    """Images, symbols and decoded symbols of a ground-truth image table, old and new entries alike."""
    zero = F.lit(0).cast("long")
    return images.agg(
        F.count(F.lit(1)).alias("image_count"),
        F.coalesce(F.sum("expected_barcode_symbol_count"), zero).alias("expected_barcode_symbol_count"),
        F.coalesce(F.sum("expected_decoded_count"), zero).alias("expected_decoded_count"))


def dataset_summary(boxes: DataFrame) -> DataFrame:
    """Images, symbols and decoded symbols of a ground-truth box table.

    The image list is the ``image`` column itself, not an array in one row.
    """
    per_image = boxes.groupBy("image").agg(
        F.count("box_status").alias("symbols"), F.count_if(F.col("box_status") == "decoded").alias("decoded"))
    zero = F.lit(0)
    return per_image.agg(
        F.count(F.lit(1)).alias("image_count"),
        F.coalesce(F.sum("symbols"), zero).alias("expected_barcode_symbol_count"),
        F.coalesce(F.sum("decoded"), zero).alias("expected_decoded_count"))
