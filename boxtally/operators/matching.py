"""Spatial matching of decoder readings to label observations.

Inputs
  labels      ``image_id, label_index, label_box, barcode_box (nullable), status``
  detections  ``image_id, det_index, value, format, box``
  images      ``image_id, image_width, image_height``
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.functions import geometry as g
from boxtally.functions.text import is_primary_code
from boxtally.operators import photos
from boxtally.operators.greedy import GATHER_LIMIT, fold_groups, large_groups
from boxtally.operators.photos import SECOND_SCAN
from boxtally.session import cut_lineage, deal

#: grid cell in pixels; a label region covers one to four of them
CELL = 512

PAIR = ["image_id", "distance", "label_index", "det_index", "basis", "value"]
_ORDER = ["distance", "label_index", "det_index", "basis"]


def label_targets(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Region in which a reading counts for a label, and its centre."""
    w, h = F.col("image_width"), F.col("image_height")
    t = F.col("target")
    framed = labels.join(images.select("image_id", "image_width", "image_height"), "image_id").select(
        "image_id", "label_index", "image_width", "image_height",
        g.target_basis(F.col("barcode_box")).alias("basis"),
        g.clamp(g.target_box(F.col("label_box"), F.col("barcode_box")), w, h).alias("target"))
    return framed.select(
        "image_id", "label_index", "image_width", "image_height", "basis",
        g.center_x(t).alias("tx"), g.center_y(t).alias("ty"),
        g.pad(t, g.target_padding(g.width(t)), g.target_padding(g.height(t))).alias("region"))


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))


def points_in_regions(regions: DataFrame, points: DataFrame, *, by_cell: bool) -> DataFrame:
    """Join ``region`` boxes with the points ``px, py`` they contain, per image.

    With ``by_cell`` the join key is the image and a grid cell, so a crowded
    image is spread over many tasks and regions meet only points nearby. A
    point has one cell, so no pair appears twice. Without it the key is the
    image alone, which leaves small images in the partition in which the
    assignment needs them anyway.
    """
    key = ["image_id"]
    if by_cell:
        r = F.col("region")
        regions = regions.withColumn("cell_x", _cells(r["x1"], r["x2"])).withColumn(
            "cell_y", _cells(r["y1"], r["y2"]))
        points = points.withColumns({"cell_x": F.floor(F.col("px") / CELL),
                                     "cell_y": F.floor(F.col("py") / CELL)})
        key += ["cell_x", "cell_y"]
    return regions.join(points, key).filter(g.contains_point(F.col("region"), F.col("px"), F.col("py")))


def centers(detections: DataFrame) -> DataFrame:
    box = F.col("box")
    return detections.select("image_id", "det_index", "value",
                             g.center_x(box).alias("px"), g.center_y(box).alias("py"))


def candidate_pairs(labels: DataFrame, detections: DataFrame, images: DataFrame,
                    *, by_cell: bool = True) -> DataFrame:
    """Every label and reading whose centre lies in the padded target of the label."""
    pairs = points_in_regions(label_targets(labels, images), centers(detections), by_cell=by_cell)
    distance = g.normalized_distance(F.col("tx"), F.col("ty"), F.col("px"), F.col("py"),
                                     F.col("image_width"), F.col("image_height"))
    return pairs.select("image_id", distance.alias("distance"), "label_index", "det_index",
                        "basis", "value")


def _assign_by_fold(pairs: DataFrame) -> DataFrame:
    order = {c: F.col(c) for c in _ORDER}
    return fold_groups(pairs, "image_id", order, lambda a, b: (
        (a["label_index"] == b["label_index"]) | (a["det_index"] == b["det_index"]))).select(*PAIR)


def _assign_by_rounds(pairs: DataFrame) -> DataFrame:
    """Nearest-first assignment without gathering an image.

    A pair that is the nearest of its label *and* of its reading is certain to
    be chosen. Each round takes all such pairs and drops what they rule out.
    Both minima combine before the shuffle.
    """
    left = cut_lineage(pairs.select(*PAIR))
    done = left.limit(0)
    rank = F.struct(*_ORDER, "value").alias("best")

    def nearest(side: str) -> DataFrame:
        best = left.groupBy("image_id", side).agg(F.min(rank).alias("best"))
        return best.select("image_id", "best.*")

    while not left.isEmpty():
        both = cut_lineage(nearest("label_index").join(
            nearest("det_index").select("image_id", *_ORDER), ["image_id", *_ORDER], "left_semi"))
        done = done.unionByName(both.select(*PAIR))
        left = cut_lineage(
            left.join(both.select("image_id", "label_index"), ["image_id", "label_index"], "left_anti")
            .join(both.select("image_id", "det_index"), ["image_id", "det_index"], "left_anti"))
    return done


def assign_matches(pairs: DataFrame, limit: int = GATHER_LIMIT) -> DataFrame:
    """Global nearest-first one-to-one choice among candidate pairs of each image.

    Ties go to the lower label, then the lower reading.
    """
    pairs = cut_lineage(pairs)
    return match_pairs(lambda left, _, by_cell: left, pairs, pairs, large_groups([pairs], "image_id", limit))


def match_pairs(pairs_of: Callable[..., DataFrame], left: DataFrame, right: DataFrame,
                large: DataFrame | None, rows: int | None = None) -> DataFrame:
    """Assign the pairs of two sides; ``large`` names the crowded images, ``rows`` says how many rows there are.

    Small images are partitioned by image once, and the joins and the fold all
    run on that. Crowded ones join by grid cell and are assigned in rounds.
    """
    def small(a: DataFrame, b: DataFrame) -> DataFrame:
        if rows is None:
            return _assign_by_fold(pairs_of(a.repartition("image_id"), b.repartition("image_id"), by_cell=False))
        return _assign_by_fold(pairs_of(deal(a, rows, "image_id"), deal(b, rows, "image_id"), by_cell=False))

    if large is None:
        return small(left, right)

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.join(large, "image_id", how)

    crowded = pairs_of(part(left, "left_semi"), part(right, "left_semi"), by_cell=True)
    return small(part(left, "left_anti"), part(right, "left_anti")).unionByName(_assign_by_rounds(crowded))


def crowded_images(labels: DataFrame, *scans: DataFrame, limit: int = GATHER_LIMIT) -> DataFrame | None:
    """Photos with more rows, or more possible pairs, than one array should hold; None if there are none."""
    big = photos.crowded_photos(labels, *scans, limit=limit)
    return None if big.isEmpty() else cut_lineage(big)


def match_labels(labels: DataFrame, detections: DataFrame, images: DataFrame,
                 limit: int = GATHER_LIMIT, rows: int | None = None) -> DataFrame:
    """Candidate pairs and assignment in one plan, with tasks for about ``rows`` rows."""
    return _match(labels, detections, images, crowded_images(labels, detections, limit=limit), rows)


def _match(labels: DataFrame, detections: DataFrame, images: DataFrame, large: DataFrame | None,
           rows: int | None = None) -> DataFrame:
    return match_pairs(lambda a, b, by_cell: candidate_pairs(a, b, images, by_cell=by_cell),
                       labels, detections, large, rows)


def unmatched_labels(labels: DataFrame, matches: DataFrame) -> DataFrame:
    return labels.join(matches.select("image_id", "label_index"), ["image_id", "label_index"], "left_anti")


def unassigned_detections(detections: DataFrame, matches: DataFrame) -> DataFrame:
    return detections.join(matches.select("image_id", "det_index"), ["image_id", "det_index"], "left_anti")


def photo_counts(labels: DataFrame, detections: DataFrame, images: DataFrame, recovery: DataFrame | None = None,
                 limit: int = GATHER_LIMIT, rows: int | None = None, status: bool = False) -> DataFrame:
    """``image_id, visible, readings, matched, labels_tried, barcodes_found, labels_resolved, missing_labels`` of each photo
    with rows; with ``status`` also ``clear``, its clear labels, and ``values``, the different values of those readings.

    ``labels_tried`` is the number of labels the first choice left over, for which ``recovery`` is the rescan; its
    readings count only where there were any; ``missing_labels`` lists the labels without a reading, one value per
    photo by definition. Small photos need one shuffle and no written table.
    """
    frames = [detections] + ([] if recovery is None else [recovery])
    large = crowded_images(labels, *frames, limit=limit)

    def small(*parts: DataFrame) -> DataFrame:
        found = photos.matched(photos.gather(parts[0], images, *parts[1:], rows=rows, status=status), status)
        return found.select("image_id", F.col("seen").alias("visible"), (F.col("read") + F.col("found")).alias("readings"),
                            F.size("final").cast("long").alias("matched"), F.col("tried").alias("labels_tried"),
                            F.col("found").alias("barcodes_found"),
                            (F.size("final") - F.size("first")).cast("long").alias("labels_resolved"),
                            *(("clear", "values") if status else ()), F.col("missing").alias("missing_labels"))

    if large is None:
        return small(labels, *frames)
    few = [df.join(large, "image_id", "left_anti") for df in (labels, *frames)]
    many = [df.join(large, "image_id", "left_semi") for df in (labels, *frames)]
    if recovery is None:
        readings, final = many[1], _match(many[0], many[1], images, large)
        tried = unmatched_labels(many[0], final).groupBy("image_id").agg(F.count(F.lit(1)).alias("labels_tried"))
        counters = tried.withColumns({c: F.lit(0).cast("long") for c in ("barcodes_found", "labels_resolved")})
    else:
        readings, final, counters = _recover_crowded(*many, images, large)
    zero = F.lit(0).cast("long")
    counted = large
    shares = [(many[0], "visible"), (readings, "readings"), (final, "matched")]
    for part, name in shares + ([] if not status else [
            (many[0].filter("status = 'clear'"), "clear"), (readings.select("image_id", "value").distinct(), "values")]):
        counted = counted.join(part.groupBy("image_id").agg(F.count(F.lit(1)).alias(name)), "image_id", "left")
    counted = counted.join(counters, "image_id", "left")
    names = [c for c in counted.columns if c != "image_id"]
    lost = unmatched_labels(many[0], final).groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.col("label_index").cast("long"))).alias("missing_labels"))
    few = small(*few)
    return few.unionByName(counted.join(lost, "image_id", "left").select(
        "image_id", *[F.coalesce(c, zero).alias(c) for c in names], F.coalesce("missing_labels", F.array().cast("array<long>")).alias("missing_labels")))


def _with_visible(images: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of every image, also of those without labels or readings."""
    zero = F.lit(0).cast("long")
    return images.select("image_id").join(counts, "image_id", "left").select(
        "image_id", F.coalesce("visible", zero).alias("visible_label_count"),
        F.coalesce("matched", zero).alias("matched_label_count"),
        (F.coalesce("visible", zero) == F.coalesce("matched", zero)).alias("all_labels_matched"),
        (F.coalesce("labels_tried", zero) > 0).alias("recovery_attempted"),
        *[F.coalesce(c, zero).alias(c) for c in ("labels_tried", "barcodes_found", "labels_resolved")])


def reconcile(labels: DataFrame, detections: DataFrame, images: DataFrame) -> DataFrame:
    """Per image: visible labels, matched labels, whether all are matched."""
    return _with_visible(images, photo_counts(labels, detections, images)).select(
        "image_id", "visible_label_count", "matched_label_count", "all_labels_matched")


def with_recovery(labels: DataFrame, detections: DataFrame, recovery: DataFrame,
                  images: DataFrame, limit: int = GATHER_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Match, rescan what stayed unmatched, match once more.

    Returns the detections that took part, the final matches and per image the
    recovery counters. Readings of the rescan are appended without
    de-duplication; images without unmatched labels keep their first result. The rows of small photos are
    written once, as the three results share them.
    """
    large = crowded_images(labels, detections, recovery, limit=limit)

    def part(df: DataFrame, how: str) -> DataFrame:
        return df if large is None else df.join(large, "image_id", how)

    few = [part(df, "left_anti") for df in (labels, detections, recovery)]
    found = cut_lineage(photos.matched(photos.gather(few[0], images, *few[1:])))
    final = found.select("image_id", F.inline("final")).select(*PAIR)
    counters = found.where("tried > 0").select(
        "image_id", F.col("tried").alias("labels_tried"), F.col("found").alias("barcodes_found"),
        (F.size("final") - F.size("first")).cast("long").alias("labels_resolved"))
    rescanned = few[2].join(counters.select("image_id"), "image_id", "left_semi").withColumn(
        "det_index", F.col("det_index") + F.lit(SECOND_SCAN))
    readings = few[1].unionByName(rescanned.select(*detections.columns))
    if large is None:
        return readings, final, counters
    more = _recover_crowded(*[part(df, "left_semi") for df in (labels, detections, recovery)], images, large)
    return tuple(a.unionByName(b.select(*a.columns)) for a, b in zip((readings, final, counters), more))


def _recover_crowded(labels: DataFrame, detections: DataFrame, recovery: DataFrame, images: DataFrame,
                     large: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for crowded photos, pass by pass over written tables."""
    first = cut_lineage(_match(labels, detections, images, large))
    open_labels = unmatched_labels(labels, first)
    tried = cut_lineage(open_labels.groupBy("image_id").agg(F.count(F.lit(1)).alias("labels_tried")))
    again = tried.select("image_id")

    second_scan = recovery.join(again, "image_id", "left_semi").withColumn(
        "det_index", F.col("det_index") + F.lit(SECOND_SCAN))
    all_detections = detections.unionByName(second_scan.select(*detections.columns))
    redo = cut_lineage(_match(labels.join(again, "image_id", "left_semi"),
                              all_detections.join(again, "image_id", "left_semi"), images, large))
    final = first.join(again, "image_id", "left_anti").unionByName(redo)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("image_id").agg(F.count(F.lit(1)).alias(name))

    zero = F.lit(0).cast("long")
    counters = (tried.join(count(second_scan, "found"), "image_id", "left")
                .join(count(first, "before"), "image_id", "left")
                .join(count(redo, "after"), "image_id", "left")
                .select("image_id", "labels_tried", F.coalesce("found", zero).alias("barcodes_found"),
                        (F.coalesce("after", zero) - F.coalesce("before", zero)).alias("labels_resolved")))
    return all_detections, final, counters


def reconcile_with_recovery(labels: DataFrame, detections: DataFrame, recovery: DataFrame,
                            images: DataFrame) -> DataFrame:
    """:func:`reconcile` after one recovery pass, with its counters."""
    return _with_visible(images, photo_counts(labels, detections, images, recovery))


def match_conflicts(matches: DataFrame) -> DataFrame:
    """Labels or readings used more than once; empty unless something is wrong."""
    def twice(side: str) -> DataFrame:
        used = matches.groupBy("image_id", F.col(side).alias("index")).agg(
            F.count(F.lit(1)).alias("uses")).filter(F.col("uses") > 1)
        return used.withColumn("side", F.lit(side))

    return twice("label_index").unionByName(twice("det_index"))


def uncovered_boxes(boxes: DataFrame, detections: DataFrame) -> DataFrame:
    """Boxes that do not yet hold the centre of a readable primary code.

    The covered boxes are found by grid cell, where equal centres count once,
    and taken out by identity.
    """
    primary = centers(detections.filter(is_primary_code(F.col("value"))))
    regions = boxes.select("image_id", "proposal_id", F.col("box").alias("region"))
    covered = points_in_regions(regions, primary.select("image_id", "px", "py").distinct(), by_cell=True)
    return boxes.join(covered.select("image_id", "proposal_id"), ["image_id", "proposal_id"], "left_anti")
