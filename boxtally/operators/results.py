"""Results of photos: items, summaries, stored runs.

Items are rows, not arrays, so a crowded photo is many small rows. Arrays are
built only for nested results (:func:`nest_items`) and for the text of a reply.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.functions import geometry as g
from boxtally.functions import outcome as o
from boxtally.functions.messages import reply_line, reply_text
from boxtally.operators import matching, photos
from boxtally.operators.blocks import BLOCK, in_blocks
from boxtally.operators.greedy import GATHER_LIMIT
from boxtally.session import cut_lineage, deal

_ITEM = ["image_id", "kind", "label_index", "det_index", "barcode_value", "barcode_format",
         "barcode_box", "label_box", "match_basis", "label_status"]


def audit_to_pixels(audits: DataFrame) -> DataFrame:
    """Label lists in 0..1000 coordinates to one row per label in clamped pixels."""
    w, h = F.col("image_width"), F.col("image_height")

    def pixels(b: Column) -> Column:
        return F.when(b.isNotNull(), g.clamp(g.normalized_to_pixels(
            b["top"], b["left"], b["bottom"], b["right"], w, h), w, h))

    rows = audits.select("image_id", "image_width", "image_height", F.explode("labels").alias("l"))
    return rows.select("image_id", F.col("l.label_index").alias("label_index"),
                       pixels(F.col("l.label_bbox")).alias("label_box"),
                       pixels(F.col("l.barcode_bbox")).alias("barcode_box"),
                       F.col("l.status").alias("status"), F.col("l.confidence").alias("confidence"))


def usable_inputs(labels: DataFrame, detections: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings of photos that could be scanned, labels of those also audited."""
    scanned = images.filter(F.col("scan_state") != "error").select("image_id")
    audited = images.filter((F.col("scan_state") != "error") & (F.col("audit_state") == "ok")).select("image_id")
    return (labels.join(audited, "image_id", "left_semi"),
            detections.join(scanned, "image_id", "left_semi"))


def assemble_items(labels: DataFrame, detections: DataFrame, matches: DataFrame, rows: int | None = None) -> DataFrame:
    """Found, missing and unassigned items of every photo, with tasks for about ``rows`` rows.

    One full join on (photo, reading): both sides met = found, label alone =
    missing, reading alone = unassigned.
    """
    def dealt(df: DataFrame, side: str) -> DataFrame:
        return df if rows is None else deal(df, rows, "image_id", side)

    seen = dealt(labels.select("image_id", "label_index", "label_box", F.col("barcode_box").alias("seen_box"),
                               F.col("status").alias("label_status")), "label_index").join(
        dealt(matches.select("image_id", "label_index", "det_index", F.col("basis").alias("match_basis")), "label_index"),
        ["image_id", "label_index"], "left")
    read = detections.select("image_id", "det_index", F.col("value").alias("barcode_value"),
                             F.col("format").alias("barcode_format"), F.col("box").alias("read_box"))
    both = dealt(seen, "det_index").join(dealt(read, "det_index"), ["image_id", "det_index"], "full")
    kind = (F.when(F.col("label_index").isNull(), "unassigned")
            .when(F.col("barcode_value").isNull(), "missing").otherwise("found"))
    return both.withColumn("kind", kind).withColumn(
        "barcode_box", F.coalesce("read_box", "seen_box")).select(*_ITEM)


#: what nested results and replies show of an item
SHOWN = ["kind", "label_index", "det_index", "barcode_value", "barcode_format", "match_basis"]


def unpacked(rows: DataFrame, known: str) -> DataFrame:
    """Rows of an outer inline without those of empty arrays, where ``known`` is null.

    A plain inline lets the planner put a condition on the size of the array below the steps that derive it, which would then
    run once for the condition, and once more in each step that refers to another.
    """
    return rows.where(F.col(known).isNotNull())


@dataclass(frozen=True)
class PhotoItems:
    """Items of small photos, as one array ``items`` per ``image_id``, and of crowded ones, as rows (None without any)."""
    few: DataFrame
    many: DataFrame | None

    def rows(self) -> DataFrame:
        few = unpacked(self.few.select("image_id", F.inline_outer("items")), "kind")
        return few if self.many is None else few.unionByName(self.many)


def photo_items(labels: DataFrame, detections: DataFrame, images: DataFrame, rows: int | None = None,
                fields: Sequence[str] = tuple(_ITEM[1:]), limit: int = GATHER_LIMIT) -> PhotoItems:
    """Match and assemble in one step: the items of :func:`assemble_items` over :func:`usable_inputs`, with these ``fields``.

    What belongs to a small photo comes together once; all follows inside its row. Crowded photos are matched by
    grid cell and assembled by joins. About ``rows`` rows come.
    """
    large = matching.crowded_images(labels, detections, limit=limit)
    if large is None:
        return PhotoItems(photos.gather_items(labels, images, detections, fields, rows), None)

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.join(large, "image_id", how)

    few = photos.gather_items(*[part(df, "left_anti") for df in (labels, images, detections)], fields, rows)
    usable = usable_inputs(part(labels, "left_semi"), part(detections, "left_semi"), images)
    many = assemble_items(*usable, matching.match_labels(*usable, images, limit, rows), rows)
    return PhotoItems(few, many.select("image_id", *fields))


def result_summary(images: DataFrame, items: DataFrame, recovery: DataFrame | None = None) -> DataFrame:
    """Counts, outcome and status of every photo, from its items."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("found", "missing", "unassigned")]
    lost = F.array_sort(F.collect_list(F.when(F.col("kind") == "missing", F.col("label_index").cast("long"))))
    counted = items.groupBy("image_id").agg(*kinds, lost.alias("missing_labels"))
    if recovery is not None:
        return _summary(images.join(counted, "image_id", "left").join(recovery, "image_id", "left"))
    return _summary(images.join(counted, "image_id", "left").withColumns(
        {c: F.lit(None).cast("long") for c in ("labels_tried", "barcodes_found", "labels_resolved")}))


def result_summary_of_counts(images: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from :func:`matching.photo_counts`: no items are made to count them."""
    tried = F.col("labels_tried") > 0
    return _summary(images.join(counts.select(
        "image_id", F.col("matched").alias("found_count"), (F.col("visible") - F.col("matched")).alias("missing_count"),
        (F.col("readings") - F.col("matched")).alias("unassigned_count"), "missing_labels",
        *[F.when(tried, F.col(c)).alias(c) for c in ("labels_tried", "barcodes_found", "labels_resolved")]), "image_id", "left"))


def _summary(joined: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    counts = {c: F.coalesce(c, zero) for c in (
        "found_count", "missing_count", "unassigned_count", "barcodes_found", "labels_resolved")}
    counts["recovery_attempted"] = F.col("labels_tried").isNotNull()
    counts["visible_label_count"] = F.coalesce("found_count", zero) + F.coalesce("missing_count", zero)
    full = joined.withColumns(counts).withColumn("labels_tried", F.coalesce("labels_tried", zero))
    scan_ok, audit_ok = F.col("scan_state") != "error", F.col("audit_state") == "ok"
    visible, missing = F.col("visible_label_count"), F.col("missing_count")
    out = full.withColumns({
        "ok": scan_ok,
        "audit_available": scan_ok & audit_ok,
        "outcome": o.outcome(scan_ok, audit_ok, visible, missing),
        "all_found": o.all_found(scan_ok, audit_ok, visible, missing),
    }).withColumn("status", o.status_from_outcome(F.col("outcome"), F.col("ok"))).withColumn(
        "message", o.photo_message(F.col("outcome"), visible))
    return out.withColumns(o.run_counters(F.col("found_count"), F.col("unassigned_count"), visible,
                                          F.col("labels_resolved")))


def with_issues(summary: DataFrame, variant: str) -> DataFrame:
    """Add the issue array of each photo and its two headline codes."""
    c = F.col
    error = F.when(~c("ok"), "invalid_image").when(~c("audit_available"), "audit_failed")
    text = F.when(~c("ok"), "cannot identify image file").when(~c("audit_available"), "audit failed")
    code = c("error_code") if "error_code" in summary.columns else error
    message = c("error_message") if "error_message" in summary.columns else text
    issues = o.derive_issues(
        ok=c("ok"), outcome_=c("outcome"), audit_ok=c("audit_available"), missing=c("missing_count"),
        scanner=c("scanner_count"), vision=c("vision_count"), attempted=c("recovery_attempted"),
        tried=c("labels_tried"), resolved=c("labels_resolved"), decoded=c("barcodes_found"),
        error_code=code, error_message=message, variant=variant,
        missing_labels=c("missing_labels") if "missing_labels" in summary.columns else None)
    return summary.withColumn("issues", issues).withColumns({
        "first_issue": o.primary_issue(c("issues"), "first"),
        "gravest_issue": o.primary_issue(c("issues"), "severity"),
    })


def run_item_rows(items: DataFrame) -> DataFrame:
    """Stored form of the found and missing items of a run."""
    missing = F.col("kind") == "missing"

    def blank(c: str) -> Column:
        return F.when(~missing, F.col(c)).alias(c)

    return items.filter(F.col("kind").isin("found", "missing")).select(
        F.col("image_id").alias("run_id"), "label_index", blank("barcode_value"),
        blank("barcode_format"), "barcode_box", "label_box", blank("match_basis"),
        F.col("kind").alias("status"))


def explode_items(results: DataFrame) -> DataFrame:
    """Nested results (arrays of found and missing) to item rows."""
    none = F.lit(None).cast("string")

    def rows(status: str, blank: bool) -> Column:
        return F.transform(status, lambda x: F.struct("image_id", x["label_index"], *[
            (none if blank else x[c]).alias(c) for c in ("barcode_value", "barcode_format", "match_basis")], F.lit(status).alias("status")))

    return unpacked(results.select(F.inline_outer(F.concat(rows("found", False), rows("missing", True)))), "status")


_NEST_ORDER = ["label_index", "det_index", "barcode_value", "match_basis"]


def _rank(kind: Column) -> Column:
    return F.when(kind == "found", 0).when(kind == "missing", 1).otherwise(2)


def nest_items(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Arrays of items per photo and block: found, missing, then unassigned, in label and reading order.

    ``block`` numbers the nested rows of a photo from 0; the items of a photo, taken block by block and in each
    as found, missing, unassigned, are in order. A photo of up to ``block`` items is one row.
    """
    entry = F.struct("place", *SHOWN[1:])

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(kind)

    shown = items.select("image_id", *SHOWN).withColumn("_rank", _rank(F.col("kind")))
    placed = in_blocks(shown, "image_id", ["_rank", *_NEST_ORDER], block)
    return placed.groupBy("image_id", "block").agg(of("found"), of("missing"), of("unassigned"))


def nest_photos(items: PhotoItems, block: int = BLOCK) -> DataFrame:
    """:func:`nest_items` of photos: a small one, whose items are in its row, is sorted and cut into blocks there."""
    n, at = F.size("sorted"), F.col("block")
    ordered = F.sort_array(F.transform("items", lambda x: F.struct(
        _rank(x["kind"]).alias("_rank"), *[x[c] for c in _NEST_ORDER], x["barcode_format"])))
    numbered = F.transform("sorted", lambda x, i: F.struct(x["_rank"], F.struct(
        i.cast("long").alias("place"), *[x[c] for c in SHOWN[1:]]).alias("entry")))
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.expr(f"(size(sorted) - 1) div {block}").cast("int")))
    few = unpacked(items.few.withColumn("sorted", ordered).select("image_id", numbered.alias("sorted"), F.explode_outer(blocks).alias("block")), "block")
    part = few.select("image_id", at.cast("long").alias("block"), F.slice("sorted", at * block + 1, F.lit(block)).alias("part"))

    def of(kind: str) -> Column:
        return F.transform(F.filter("part", lambda x: x["_rank"] == _rank(F.lit(kind))), lambda x: x["entry"]).alias(kind)

    nested = part.select("image_id", "block", *map(of, ("found", "missing", "unassigned")))
    return nested if items.many is None else nested.unionByName(nest_items(items.many, block))


def reply_lines(items: DataFrame, block: int = 1024) -> DataFrame:
    """The reply on a photo as rows ``image_id, line_no, line``: line 0 is the heading with the total.

    Matched codes come first, by label, then the others in reading order. Lines are numbered within
    blocks of consecutive positions, and blocks by their counts, so a crowded photo is not sorted as one.
    """
    read = items.filter(F.col("kind").isin("found", "unassigned")).select(
        "image_id", "kind", "label_index", "det_index", "barcode_value", "barcode_format",
        F.coalesce(F.floor(F.coalesce("label_index", "det_index") / block), F.lit(-1)).alias("block"))
    key = ["image_id", "kind", "block"]
    read = cut_lineage(read)
    n = read.count()
    read = deal(read, n, *key)
    sizes = deal(cut_lineage(read.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))), n, "image_id")
    before = Window.partitionBy("image_id").orderBy("kind", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy(*key).orderBy("label_index", "det_index", "barcode_value", "barcode_format")
    label = F.when(F.col("kind") == "found", F.col("label_index"))
    lines = read.withColumn("_nth", F.row_number().over(order)).join(starts, key).select(
        "image_id", (F.col("start") + F.col("_nth")).alias("line_no"),
        reply_line(label, F.col("barcode_value"), F.col("barcode_format")).alias("line"))
    head = sizes.groupBy("image_id").agg(F.sum("n").alias("n")).select(
        "image_id", F.lit(0).cast("long").alias("line_no"), F.format_string("Found %d barcodes:", "n").alias("line"))
    return head.unionByName(lines)


def reply_photos(items: PhotoItems) -> DataFrame:
    """:func:`reply_lines` of photos: the lines of a small one are made in its row."""
    read = F.sort_array(F.transform(F.filter("items", lambda x: x["kind"] != "missing"), lambda x: F.struct(
        x["kind"], x["label_index"], x["det_index"], x["barcode_value"], x["barcode_format"])))

    def line(x: Column, i: Column) -> Column:
        label = F.when(x["kind"] == "found", x["label_index"])
        return F.struct((i + 1).cast("long").alias("line_no"), reply_line(label, x["barcode_value"], x["barcode_format"]).alias("line"))

    head = F.struct(F.lit(0).cast("long").alias("line_no"), F.format_string("Found %d barcodes:", F.size("read")).alias("line"))
    lines = F.when(F.size("read") > 0, F.concat(F.array(head), F.transform("read", line)))
    few = unpacked(items.few.select("image_id", read.alias("read")).select("image_id", F.inline_outer(lines)), "line_no")
    return few if items.many is None else few.unionByName(reply_lines(items.many))


def reply_texts(lines: DataFrame, rows: int | None = None) -> DataFrame:
    """One text per photo: ``image_id, reply``, from the rows of :func:`reply_lines` (about ``rows``).

    A message is a single value, so its lines come together here; where a photo may exceed what one
    value holds, send the rows.
    """
    whole = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines")
    none = F.lit(None).cast("string")
    dealt = lines if rows is None else deal(lines, rows, "image_id")
    return dealt.groupBy("image_id").agg(whole).select(
        "image_id", reply_text(F.col("lines"), F.col("image_id").cast("string"), none).alias("reply"))


def scanner_status(images: DataFrame, detections: DataFrame) -> DataFrame:
    """``found`` / ``not_found`` / ``error`` and the number of readings per photo."""
    counted = detections.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    error = F.col("scan_state") == "error"
    n = F.when(error, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return images.join(counted, "image_id", "left").select(
        "image_id", F.when(error, "error").when(n > 0, "found").otherwise("not_found").alias("status"),
        n.alias("count"))


def scan_rows(images: DataFrame, detections: DataFrame, timed: bool = True) -> DataFrame:
    """The printed table of a scan: status, number of codes and time of every photo."""
    return scanner_status(images, detections).join(images.select("image_id", "elapsed_ms"), "image_id").select(
        "image_id", "status", F.col("count").alias("barcodes"), _seconds(timed))


def audit_rows(images: DataFrame, labels: DataFrame, timed: bool = True) -> DataFrame:
    """The printed table of an audit: its state, visible and clear labels (a dash where it saw none) and time."""
    joined = images.join(audit_counts(labels), "image_id", "left")
    return joined.select("image_id", F.col("audit_state").alias("status"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("visible", "clear")], _seconds(timed))


def _seconds(timed: bool) -> Column:
    shown = F.format_string("%.2fs", F.col("elapsed_ms") / F.lit(1000.0)) if timed else F.lit(None).cast("string")
    return F.coalesce(shown, F.lit("-")).alias("time")


def audit_counts(labels: DataFrame) -> DataFrame:
    """Visible and clear labels per photo."""
    return labels.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("visible"), F.count_if(F.col("status") == "clear").alias("clear"))


def unique_values(detections: DataFrame) -> DataFrame:
    """Distinct decoded values per photo, one row each."""
    return detections.select("image_id", "value").distinct()


def pipeline_summary(images: DataFrame, counts: DataFrame) -> DataFrame:
    """Decoded against visible per photo, with the recovery counters, from :func:`matching.photo_counts` with status."""
    zero = F.lit(0).cast("long")
    n = {c: F.coalesce(c, zero) for c in ("readings", "values", "visible", "clear", "matched",
                                          "labels_tried", "barcodes_found", "labels_resolved")}
    return images.select("image_id").join(counts, "image_id", "left").select(
        "image_id", n["readings"].alias("decoded_count"), n["values"].alias("unique_value_count"),
        n["visible"].alias("visible_labels"), n["clear"].alias("clear_labels"),
        (n["labels_tried"] > 0).alias("recovery_attempted"),
        n["labels_tried"].alias("labels_tried"), n["barcodes_found"].alias("barcodes_found"),
        n["labels_resolved"].alias("labels_resolved"),
        (n["readings"] == n["visible"]).alias("match"),
        (n["readings"] - n["visible"]).alias("difference"), n["matched"].alias("matched_labels"),
        (n["matched"] == n["visible"]).alias("all_labels_matched"))


def summary_rows(summary: DataFrame) -> DataFrame:
    """The printed table of a run: matched/visible, OK / DIFF / ERR, decoded."""
    ready = F.col("audit_available")
    matched = F.when(ready, F.concat_ws("/", F.col("found_count").cast("string"),
                                        F.col("visible_label_count").cast("string"))).otherwise("-/-")
    verdict = F.when(~ready, "ERR").when(F.col("missing_count") == 0, "OK").otherwise("DIFF")
    return summary.select("image_id", matched.alias("matched"), verdict.alias("verdict"),
                          (F.col("found_count") + F.col("unassigned_count")).alias("decoded"),
                          F.format_string("%.2fs", F.col("elapsed_ms") / F.lit(1000.0)).alias("time"))
