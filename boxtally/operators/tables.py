"""Maintenance of stored tables, and the publication of whole ones.

Every function returns the new rows. Tables that change while they are read, or in few of their rows, are kept
with a log of changes (:mod:`boxtally.sources.change_log`), which applies these functions to the rows they touch.
:func:`publish` replaces a whole table: it writes beside the old one and swaps the folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.operators.blocks import BLOCK, in_blocks
from boxtally.operators.dedup import first_per_key

MESSAGE_LIMIT = 500


def new_rows(target: DataFrame, batch: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of the batch to insert: first per key, keys not stored yet."""
    return first_per_key(batch, key, order).join(target.select(*key), key, "left_anti")


def insert_if_absent(target: DataFrame, batch: DataFrame, key: list[str], order: list) -> DataFrame:
    """The table after the insert; stored rows stay as they are."""
    return target.unionByName(new_rows(target, batch, key, order).select(*target.columns))


def split_unique(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows accepted and refused by a unique key that ignores nulls.

    The winner of a key is a minimum, combined before the shuffle.
    """
    rank = F.struct(*order)
    keyed = rows.filter(F.col(key).isNotNull())
    judged = keyed.join(keyed.groupBy(key).agg(F.min(rank).alias("_win")), key)
    loses = rank > F.col("_win")
    free = rows.filter(F.col(key).isNull())
    return (judged.filter(~loses).select(*rows.columns).unionByName(free),
            judged.filter(loses).select(*rows.columns))


def first_item_per_label(items: DataFrame, order: list) -> DataFrame:
    """One item per (session, photo, label); items without a label index all stay."""
    keyed = items.filter(F.col("label_index").isNotNull())
    return first_per_key(keyed, ["session_id", "source_image", "label_index"], order).unionByName(
        items.filter(F.col("label_index").isNull()))


def new_codes(found: DataFrame, known: DataFrame, order: list) -> DataFrame:
    """Codes a session does not hold yet, first occurrence of each."""
    fresh = found.join(known.select("session_id", "barcode_value"), ["session_id", "barcode_value"], "left_anti")
    return first_per_key(fresh, ["session_id", "barcode_value"], order)


#: run columns a completion overwrites
COMPLETED = ("status", "scanner_count", "vision_count", "scanner_vision_match", "count_delta",
             "found_count", "missing_count", "unassigned_count", "recovery_attempted", "recovery_labels_tried",
             "recovery_barcodes_found", "recovery_labels_resolved", "recovery_succeeded", "latency_ms",
             "primary_issue", "issue_count", "issues", "error_code", "error_message", "pipeline_version",
             "scanner_version", "vision_prompt_version", "vision_model", "recovery_version")


def apply_completion(runs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Overwrite runs that have a result; image sizes only where the result has them.

    ``results`` has one row per run id. Zero sizes count as unknown. Columns that the
    run table does not store are left out.
    """
    stored = [c for c in COMPLETED if c in runs.columns]
    new = results.select(F.col("id"), F.lit(True).alias("_done"), *[
        F.col(c).alias(f"n_{c}") for c in (*stored, "image_width", "image_height")])
    joined = runs.join(new, "id", "left")
    done = F.col("_done").isNotNull()
    put = {c: F.when(done, F.col(f"n_{c}")).otherwise(F.col(c)) for c in stored}
    put |= {c: F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit(0)), F.col(c))
            for c in ("image_width", "image_height")}
    put["processed_at"] = F.when(done, now).otherwise(F.col("processed_at"))
    return joined.withColumns(put).select(*runs.columns)


def apply_failure(runs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Mark runs failed. The message is stored up to its limit, and whole where the table has ``error_detail``."""
    new = failures.select("id", F.col("error_class").alias("_class"), F.col("error_text").alias("_text"))
    joined = runs.join(new, "id", "left")
    hit = F.col("_class").isNotNull()
    return joined.withColumns({
        "status": F.when(hit, "failed").otherwise(F.col("status")),
        "error_code": F.when(hit, F.col("_class")).otherwise(F.col("error_code")),
        "error_message": F.when(hit, F.substring("_text", 1, MESSAGE_LIMIT)).otherwise(F.col("error_message")),
        "processed_at": F.when(hit, now).otherwise(F.col("processed_at")),
    } | ({"error_detail": F.when(hit, F.col("_text")).otherwise(F.col("error_detail"))} if "error_detail" in runs.columns else {})
    ).select(*runs.columns)


PATCHED = ("status", "expected_count", "found_count", "missing_count", "image_count", "message", "candidates")


def apply_partial_update(sessions: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """Overwrite only what the patch carries; stamp times by the new status.

    A patch without any value changes nothing, not even the activity time.
    """
    fields = [c for c in PATCHED if c in patch.columns]
    joined = sessions.join(patch.select("id", *[F.col(c).alias(f"p_{c}") for c in fields]), "id", "left")
    touched = F.lit(False)
    for c in fields:
        touched = touched | F.col(f"p_{c}").isNotNull()
    put = {c: F.coalesce(F.col(f"p_{c}"), F.col(c)) for c in fields}

    def stamp(column: str, when: Column) -> None:
        put[column] = F.when(when, now).otherwise(F.col(column))

    stamp("updated_at", touched)
    stamp("last_activity_at", touched)
    if "status" in fields:
        stamp("completed_at", F.col("p_status") == "complete")
        stamp("closed_at", F.col("p_status") == "closed")
    return joined.withColumns(put).select(*sessions.columns)


def close_sessions(sessions: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Close the named sessions that are active or complete."""
    joined = sessions.join(ids.select("id", F.lit(True).alias("_named")), "id", "left")
    hit = F.col("_named").isNotNull() & F.col("status").isin("active", "complete")
    put = {c: F.when(hit, now).otherwise(F.col(c)) for c in ("closed_at", "updated_at", "last_activity_at")}
    put["status"] = F.when(hit, "closed").otherwise(F.col("status"))
    return joined.withColumns(put).select(*sessions.columns)


def without_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among the keys (clear and cascading delete)."""
    gone = keys.select(F.col(keys.columns[0]).alias(column))
    return rows.join(gone, column, "left_anti").select(*rows.columns)


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], ids: DataFrame,
                   key: str = "id") -> dict[str, DataFrame]:
    """Parents without the ids, and every child table without their rows."""
    out = {name: without_keys(df, ids, column) for name, (df, column) in children.items()}
    out["parents"] = without_keys(parents, ids, key)
    return out


def orders_of_complete_sessions(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Order lines of finished sessions; inserting them by session id is repeatable."""
    done = sessions.filter(F.col("status") == "complete").select(
        F.col("id").alias("session_id"), "customer_id", "branch_id", "action")
    return done.join(items, "session_id")


def new_orders(sessions: DataFrame, items: DataFrame, stored: DataFrame, block: int = BLOCK) -> DataFrame:
    """Order rows of finished sessions that have no order in ``stored`` yet, with their items by line.

    The session is the key of an order, so that a repeated run adds nothing. An order of more than ``block``
    items has further rows with the next blocks; one without items has an empty list.
    """
    done = sessions.filter(F.col("status") == "complete").select(
        F.col("id").alias("session_id"), "customer_id", "branch_id", "action").join(
        stored.select("session_id"), "session_id", "left_anti")
    placed = in_blocks(items.join(done.select("session_id"), "session_id", "left_semi"), "session_id", ["line_id"], block)
    lists = placed.groupBy("session_id", "block").agg(F.array_sort(F.collect_list(
        F.struct("place", "line_id", "barcode_value", "label_index"))).alias("items"))
    none = F.array().cast(lists.schema["items"].dataType)
    return done.join(lists, "session_id", "left").select(
        "session_id", "customer_id", "branch_id", "action", F.coalesce("block", F.lit(0)).alias("block"),
        F.lit("created").alias("status"), F.coalesce("items", none).alias("items"))


def _lines(items: DataFrame, missing: DataFrame) -> DataFrame:
    columns = ["session_id", "line_id", "kind", "label_index", "barcode_value", "source_image"]
    held = items.withColumns({"kind": F.lit("item")})
    lost = missing.filter(~F.col("resolved")).withColumns(
        {"kind": F.lit("missing"), "barcode_value": F.lit(None).cast("string")})
    return held.select(*columns).unionByName(lost.select(*columns))


def session_lines(sessions: DataFrame, items: DataFrame, missing: DataFrame) -> DataFrame:
    """Sessions with their items and unresolved missing labels as ordered lines."""
    lines = _lines(items, missing)
    return sessions.select(F.col("id").alias("session_id"), "status", "expected_count").join(
        lines, "session_id", "left")


def session_result(sessions: DataFrame, items: DataFrame, missing: DataFrame, ids: DataFrame | None = None,
                   block: int = BLOCK) -> DataFrame:
    """Nested result of sessions (those of ``ids``, or all): items and unresolved missing labels by line.

    One row per session, also without lines, and per further block of lines: all items, then all missing labels.
    """
    def wanted(rows: DataFrame, column: str) -> DataFrame:
        return rows if ids is None else rows.join(ids.select(F.col("id").alias(column)), column, "left_semi")

    base = wanted(sessions, "id").withColumnRenamed("id", "session_id")
    placed = in_blocks(wanted(_lines(items, missing), "session_id"), "session_id", ["kind", "line_id"], block)

    def of(kind: str, *columns: str) -> Column:
        entry = F.struct("place", "line_id", *columns)
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))

    nested = placed.groupBy("session_id", "block").agg(
        of("item", "barcode_value", "label_index", "source_image").alias("items"), of("missing", "label_index", "source_image").alias("missing"))
    return base.join(nested, "session_id", "left").withColumn("block", F.coalesce("block", F.lit(0)))


def active_customers(customers: DataFrame) -> DataFrame:
    return customers.filter("active").select("id", "name").orderBy("name", "id")


def active_branches(branches: DataFrame, customers: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Active branches of active customers, by name; of one customer or of all."""
    if customer_id is not None:
        branches = branches.filter(F.col("customer_id") == customer_id)
    owners = customers.filter("active").select(F.col("id").alias("customer_id"))
    return branches.filter("active").join(owners, "customer_id").select(
        "customer_id", "id", "name").orderBy("name", "id")


def by_id(table: DataFrame, value: str) -> DataFrame:
    return table.filter(F.col("id") == value)


def publish(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table at ``path``: write beside it, then swap folders.

    Reads of the same path inside ``rows`` stay valid, since the old folder is
    only set aside after the new one is complete. Between the two renames there is no table at ``path``: a
    reader that comes just then fails and has to try again.
    """
    spark = rows.sparkSession
    staged, old = f"{path}.staged", f"{path}.old"
    fs, at = _filesystem(spark, path)
    fs.delete(at(staged), True)
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(staged)
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(at(staged), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"cannot publish {path}")
    fs.delete(at(old), True)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    new = jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), new
