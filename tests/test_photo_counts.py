"""Clear labels and different values of a photo are counted in the row in which it is matched."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.operators import matching, results
from test_greedy import BOX, exchanges, random_photo


def test_clear_labels_and_values_by_both_ways(spark):
    l, d, i, labels, dets = random_photo(spark, 9)
    l = l.withColumn("status", F.when(F.col("label_index") % 3 == 0, "blurred").otherwise("clear"))
    extra = spark.createDataFrame([(a, li, f"r{li % 4}", "Code128", (b or t)) for a, li, t, b, _ in labels if li % 2],
                                  f"image_id int, det_index int, value string, format string, box {BOX}")

    def counted(limit):
        rows = matching.photo_counts(l, d, i, extra, limit, status=True).collect()
        return {r.image_id: (r.readings, r["values"], r.visible, r.clear, r.matched) for r in rows}

    readings, final, _ = matching.with_recovery(l, d, extra, i, 10)
    values, matched = {}, {r.image_id: r["count"] for r in final.groupBy("image_id").count().collect()}
    for r in readings.collect():
        values.setdefault(r.image_id, []).append(r.value)
    want = {}
    for image in {r[0] for r in labels} | set(values):
        own, read = [r[1] for r in labels if r[0] == image], values.get(image, [])
        want[image] = (len(read), len(set(read)), len(own), sum(li % 3 != 0 for li in own), matched.get(image, 0))
    assert counted(10_000) == counted(10) == want
    assert exchanges(spark, lambda: matching.photo_counts(l, d, i, extra, 10_000, status=True)) == 1
    told = results.pipeline_summary(i, matching.photo_counts(l, d, i, extra, status=True)).collect()
    assert {r.image_id: (r.decoded_count, r.unique_value_count, r.visible_labels, r.clear_labels, r.matched_labels)
            for r in told if r.image_id in want} == want
