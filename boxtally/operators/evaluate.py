"""Scores of results against ground truth, and the gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.functions import geometry as g
from boxtally.functions.outcome import LATENCY_LIMIT_MS
from boxtally.operators.greedy import GATHER_LIMIT, keep_greedily
from boxtally.operators.matching import centers, crowded_images, match_pairs, points_in_regions
from boxtally.operators.metrics import p95_nearest_rank
from boxtally.session import deal

RECALL_GATE, PRECISION_GATE, OUTCOME_GATE = 0.90, 0.95, 0.80

#: padding in pixels of an expected box when readings are matched to it
BENCHMARK_PADDING = 25


def value_scores(expected: DataFrame, found: DataFrame, images: DataFrame) -> DataFrame:
    """Recall over distinct expected values, precision over all readings.

    Works on ``image_id, value`` rows: both sides are counted per value first,
    so a photo with very many readings is spread over its values.
    """
    key, rows = ["image_id", "value"], expected.count() + found.count()
    want = deal(expected.select(*key), rows, *key).distinct().withColumn("wanted", F.lit(1))
    read = deal(found.select(*key), rows, *key).groupBy(*key).agg(F.count(F.lit(1)).alias("reads"))
    both = deal(want.join(read, key, "full"), rows, "image_id")
    hit = F.col("wanted").isNotNull() & F.col("reads").isNotNull()
    per_image = both.groupBy("image_id").agg(
        F.count("wanted").alias("expected"), F.count_if(hit).alias("hits"),
        F.coalesce(F.sum("reads"), F.lit(0)).alias("found"),
        F.coalesce(F.sum(F.when(hit, F.col("reads"))), F.lit(0)).alias("matching"))
    zero = F.lit(0).cast("long")
    n = {c: F.coalesce(c, zero).alias(c) for c in ("expected", "hits", "found", "matching")}
    counted = images.select("image_id").join(per_image, "image_id", "left").select("image_id", *n.values())

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / F.nullif(F.col(b), F.lit(0)))

    return counted.withColumns({"value_recall": share("hits", "expected"),
                                "value_precision": share("matching", "found")})


def missing_values(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected values that were not read, one row each."""
    key = ["image_id", "value"]
    return expected.select(*key).distinct().join(found.select(*key), key, "left_anti")


def run_scores(runs: DataFrame) -> DataFrame:
    """0/1 scores of runs joined with what was expected of them."""
    def score(test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)

    attempted = F.coalesce("recovery_attempted", F.lit(False))
    return runs.withColumns({
        "outcome_correct": score(F.coalesce("status", F.lit("failed")) == F.col("expected_outcome")),
        "count_exact": score(F.col("found_count") == F.col("expected_decoded_count")),
        "recovery_gain": score(~attempted | (F.col("recovery_labels_resolved") > 0)),
        "latency_ok": score(F.coalesce("latency_ms", F.lit(0)) <= LATENCY_LIMIT_MS),
    })


def aggregate_thresholds(scores: DataFrame) -> DataFrame:
    """Mean recall, precision and outcome accuracy, and whether all gates hold.

    Scores are fractions of small counts; sums of fixed-point values keep the
    means independent of the order of rows.
    """
    def mean(c: str) -> Column:
        exact = F.sum(F.round(F.col(c) * F.lit(1e9)).cast("long")) / F.count(c)
        return F.coalesce(exact / F.lit(1e9), F.lit(0.0))

    means = scores.agg(mean("value_recall").alias("mean_recall"),
                       mean("value_precision").alias("mean_precision"),
                       mean("outcome_correct").alias("outcome_accuracy"))
    passed = ((F.col("mean_recall") >= RECALL_GATE) & (F.col("mean_precision") >= PRECISION_GATE)
              & (F.col("outcome_accuracy") >= OUTCOME_GATE))
    return means.withColumn("score", F.when(passed, 1.0).otherwise(0.0))


def benchmark_pairs(expected: DataFrame, detections: DataFrame, *, by_cell: bool = True) -> DataFrame:
    """Readings whose centre lies in a padded expected box, with their pixel distance."""
    pad, b = F.lit(BENCHMARK_PADDING), F.col("box")
    regions = expected.select("image_id", "label_index", g.center_x(b).alias("tx"), g.center_y(b).alias("ty"),
                              g.pad(b, pad, pad).alias("region"))
    near = points_in_regions(regions, centers(detections), by_cell=by_cell)
    dx, dy = F.col("tx") - F.col("px"), F.col("ty") - F.col("py")
    return near.select("image_id", F.sqrt(dx * dx + dy * dy).alias("distance"), "label_index", "det_index",
                       F.lit("expected").alias("basis"), "value")


def benchmark_matches(expected: DataFrame, detections: DataFrame) -> DataFrame:
    """Readings assigned to expected boxes, nearest first."""
    return match_pairs(benchmark_pairs, expected, detections, crowded_images(expected, detections))


_BENCHMARK = ("symbols", "decoded", "found", "matched", "exact", "mismatches", "bonus", "unique_expected", "unique_found")


def symbol_benchmark(expected: DataFrame, detections: DataFrame, images: DataFrame, limit: int = GATHER_LIMIT) -> DataFrame:
    """Per image: symbols, exact reads, false positives, mismatches, bonus reads.

    ``expected``: ``image_id, label_index, box, state (decoded | unreadable), value``.
    A mismatch is both a miss and a false positive. Small photos are one row each, by one shuffle, in which
    readings are matched and judged; crowded ones are matched by cell and counted.
    """
    large = crowded_images(expected, detections, limit=limit)
    if large is None:
        counted = _benchmark_rows(expected, detections)
    else:
        few, many = ([df.join(large, "image_id", how) for df in (expected, detections)] for how in ("left_anti", "left_semi"))
        matches = match_pairs(benchmark_pairs, *many, large)
        counted = _benchmark_rows(*few).unionByName(_benchmark_joins(*many, matches, large))
    zero = F.lit(0).cast("long")
    out = images.select("image_id").join(counted, "image_id", "left").select(
        "image_id", *[F.coalesce(c, zero).alias(c) for c in _BENCHMARK])
    return out.withColumn("false_positives", F.col("found") - F.col("matched") + F.col("mismatches")).drop("matched")


def _benchmark_rows(expected: DataFrame, detections: DataFrame) -> DataFrame:
    """Counts of small photos, each from its two lists."""
    b, pad = F.col("box"), F.lit(BENCHMARK_PADDING)
    truth = F.struct("label_index", "state", F.col("value").alias("truth"), g.center_x(b).alias("tx"), g.center_y(b).alias("ty"),
                     g.pad(b, pad, pad).alias("region")).alias("truth")
    reading = F.struct("det_index", "value", g.center_x(b).alias("px"), g.center_y(b).alias("py")).alias("reading")
    photos = expected.select("image_id", truth).unionByName(
        detections.select("image_id", reading), allowMissingColumns=True).groupBy("image_id").agg(
        F.collect_list("truth").alias("truths"), F.collect_list("reading").alias("readings"))

    def pairs_of(t: Column) -> Column:
        def pair(r: Column) -> Column:
            dx, dy = t["tx"] - r["px"], t["ty"] - r["py"]
            return F.struct(F.sqrt(dx * dx + dy * dy).alias("distance"), t["label_index"].alias("label_index"),
                            r["det_index"].alias("det_index"), (t["state"] == "decoded").alias("decoded"),
                            (t["truth"] == r["value"]).alias("same"))

        return F.transform(F.filter("readings", lambda r: g.contains_point(t["region"], r["px"], r["py"])), pair)

    pairs = F.array_sort(F.flatten(F.transform("truths", pairs_of)))
    chosen = photos.withColumn("pairs", pairs).withColumn("pairs", keep_greedily(F.col("pairs"), lambda x, y: (
        (x["label_index"] == y["label_index"]) | (x["det_index"] == y["det_index"]))))
    readable = F.filter("truths", lambda t: t["state"] == "decoded")
    unique = F.array_distinct(F.transform(readable, lambda t: t["truth"]))
    sizes = {
        "symbols": F.col("truths"), "decoded": readable, "found": F.col("readings"), "matched": F.col("pairs"),
        "exact": F.filter("pairs", lambda p: p["decoded"] & p["same"]), "mismatches": F.filter("pairs", lambda p: p["decoded"] & ~p["same"]),
        "bonus": F.filter("pairs", lambda p: ~p["decoded"]), "unique_expected": unique,
        "unique_found": F.array_intersect(unique, F.transform("readings", lambda r: r["value"]))}
    return chosen.select("image_id", *[F.size(sizes[c]).cast("long").alias(c) for c in _BENCHMARK])


def _benchmark_joins(expected: DataFrame, detections: DataFrame, matches: DataFrame, images: DataFrame) -> DataFrame:
    """The same counts of crowded photos, from rows."""
    def count(df: DataFrame, **aggs: Column) -> DataFrame:
        return df.groupBy("image_id").agg(*[c.alias(n) for n, c in aggs.items()])

    decoded = F.col("state") == "decoded"
    want = count(expected, symbols=F.count(F.lit(1)), decoded=F.count_if(decoded))
    read = count(detections, found=F.count(F.lit(1)))
    truth = expected.select("image_id", "label_index", "state", F.col("value").alias("truth"))
    same = F.col("truth") == F.col("value")
    judged = count(matches.join(truth, ["image_id", "label_index"]),
                   matched=F.count(F.lit(1)), exact=F.count_if(decoded & same),
                   mismatches=F.count_if(decoded & ~same), bonus=F.count_if(~decoded))
    unique = expected.filter(decoded).select("image_id", "value").distinct()
    hit = unique.join(detections.select("image_id", "value").distinct(), ["image_id", "value"], "left_semi")
    zero = F.lit(0).cast("long")
    joined = images.select("image_id")
    for part in (want, read, judged, count(unique, unique_expected=F.count(F.lit(1))),
                 count(hit, unique_found=F.count(F.lit(1)))):
        joined = joined.join(part, "image_id", "left")
    return joined.select("image_id", *[F.coalesce(c, zero).alias(c) for c in _BENCHMARK])


def benchmark_gate(per_image: DataFrame) -> DataFrame:
    """Totals over all images and the four conditions for a pass."""
    names = [c for c in per_image.columns if c != "image_id"]
    t = per_image.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    passed = ((F.col("exact") == F.col("decoded")) & (F.col("false_positives") == 0)
              & (F.col("mismatches") == 0) & (F.col("unique_found") == F.col("unique_expected")))
    return t.withColumn("passed", passed)


def benchmark_latency(timings: DataFrame) -> DataFrame:
    """Per image: first run apart, median and nearest-rank p95 of the warm ones."""
    warm = F.when(F.col("run_no") > 1, F.col("latency_ms"))
    marked = timings.withColumn("warm_ms", warm)
    return marked.groupBy("image_id").agg(
        F.max(F.when(F.col("run_no") == 1, F.col("latency_ms"))).alias("first_ms"),
        F.percentile("warm_ms", F.lit(0.5)).alias("median_ms"), p95_nearest_rank("warm_ms").alias("p95_ms"))


def spatial_matches(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """``image_id, truth_index, label_index``: labels paired with ground truth in space, nearest centres first.

    A label counts for a truth box if its centre lies in the padded box; each is used once.
    """
    t = truth.select("image_id", F.col("truth_index").alias("label_index"), F.col("truth_box").alias("box"))
    seen = labels.select("image_id", F.col("label_index").alias("det_index"), F.lit(None).cast("string").alias("value"),
                         F.col("label_box").alias("box"))
    return benchmark_matches(t, seen).select("image_id", F.col("label_index").alias("truth_index"), F.col("det_index").alias("label_index"))


def spatial_benchmark(truth: DataFrame, labels: DataFrame, matches: DataFrame, images: DataFrame) -> DataFrame:
    """Label counts and label positions against ground truth.

    ``matches`` pairs ``image_id, label_index`` with ``truth_index``.
    """
    a, b = F.col("truth_box"), F.col("label_box")
    paired = matches.join(truth.select("image_id", "truth_index", "truth_box"), ["image_id", "truth_index"]).join(
        labels.select("image_id", "label_index", "label_box"), ["image_id", "label_index"])
    sized = paired.join(images.select("image_id", "image_width", "image_height"), "image_id")
    distance = g.normalized_distance(g.center_x(a), g.center_y(a), g.center_x(b), g.center_y(b),
                                     F.col("image_width"), F.col("image_height"))
    return sized.select("image_id", "truth_index", "label_index", distance.alias("center_distance"),
                        g.iou(a, b).alias("iou"),
                        g.contains_point(a, g.center_x(b), g.center_y(b)).alias("center_inside"))


def label_count_accuracy(truth: DataFrame, labels: DataFrame, images: DataFrame, unmatched: DataFrame,
                         expected_unmatched: DataFrame) -> DataFrame:
    """Per image: label count and unmatched count as expected, and extra labels."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("image_id").agg(F.count(F.lit(1)).alias(name))

    out = images.select("image_id")
    for df, name in ((truth, "expected"), (labels, "seen"), (unmatched, "open"), (expected_unmatched, "want_open")):
        out = out.join(count(df, name), "image_id", "left")
    n = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("expected", "seen", "open", "want_open")}
    return out.select(
        "image_id", n["expected"].alias("expected"), n["seen"].alias("seen"),
        (n["expected"] == n["seen"]).alias("count_correct"), (n["open"] == n["want_open"]).alias("unmatched_correct"),
        F.greatest(n["seen"] - n["expected"], F.lit(0)).alias("extra_labels"))
