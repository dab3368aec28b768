from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from boxtally.functions import rates
from boxtally.operators import metrics

FIELDS = """status string, source string, primary_issue string, pipeline_version string,
    scanner_version string, recovery_version string, vision_prompt_version string, vision_model string,
    found_count int, missing_count int, unassigned_count int, count_delta int, latency_ms int,
    recovery_labels_tried int, recovery_labels_resolved int, scanner_vision_match boolean,
    recovery_attempted boolean, recovery_succeeded boolean"""

DEFAULTS = dict(
    status="complete", source="web", primary_issue="none", pipeline_version="ingest-v1",
    scanner_version="scanner-0.8", recovery_version="recovery-v1", vision_prompt_version="p1",
    vision_model="m1", found_count=6, missing_count=0, unassigned_count=0, count_delta=0,
    latency_ms=3000, recovery_labels_tried=0, recovery_labels_resolved=0, scanner_vision_match=True,
    recovery_attempted=False, recovery_succeeded=False)


def runs(spark, *changes):
    names = [f.split()[0] for f in FIELDS.split(",")]
    rows = [tuple((DEFAULTS | c)[n] for n in names) for c in changes]
    return spark.createDataFrame(rows, FIELDS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_mixed_outcomes(spark):
    m = one(metrics.compute_metrics(runs(
        spark, {}, {},
        dict(recovery_attempted=True, recovery_labels_resolved=1, recovery_succeeded=True),
        dict(status="needs_user_input", recovery_attempted=True))))
    assert (m.images_processed, m.boxes_processed) == (4, 24)
    assert [m.first_pass_complete_pct, m.final_complete_pct, m.recovery_attempted_pct,
            m.recovery_success_pct, m.user_retry_required_pct, m.recovered_complete_pct,
            m.still_incomplete_pct] == [50.0, 75.0, 50.0, 50.0, 25.0, 25.0, 25.0]


def test_no_runs_give_zeros(spark):
    m = one(metrics.compute_metrics(runs(spark, {}).limit(0)))
    assert m.images_processed == 0 and m.p95_latency_ms == 0.0 and m.final_complete_pct == 0.0
    assert m.avg_labels_tried == 0.0


@pytest.mark.parametrize("latencies, expected", [
    (range(100, 2001, 100), 1900.0), ([5000], 5000.0), ([0, 1000, 2000], 2000.0), ([0], 0.0)])
def test_p95_is_nearest_rank_of_positive(spark, latencies, expected):
    m = one(metrics.compute_metrics(runs(spark, *[dict(latency_ms=v) for v in latencies])))
    assert m.p95_latency_ms == expected


def test_recovery_rate_counts_attempts_only(spark):
    df = runs(spark, *[dict(recovery_attempted=a, recovery_succeeded=s, recovery_version=v) for a, s, v in [
        (True, True, "recovery-v1"), (True, False, "recovery-v1"), (True, True, "recovery-v2"),
        (True, True, "recovery-v2"), (True, True, "recovery-v2"), (False, False, "recovery-v1")]])
    rows = metrics.version_rates(df, ["recovery_success_by_recovery_version"]).collect()
    assert {r.version: (r.total, r.rate_pct) for r in rows} == {
        "recovery-v1": (2, 50.0), "recovery-v2": (3, 100.0)}


def test_rates_per_version(spark):
    status = ["complete", "complete", "needs_user_input"]
    df = runs(spark, *[dict(status=s, pipeline_version="a") for s in status],
              *[dict(status=s, pipeline_version=None) for s in status[1:] + status[2:] * 2])
    rows = metrics.version_rates(df, ["completion_by_pipeline_version"]).collect()
    assert {r.version: (r.total, r.rate_pct) for r in rows} == {"a": (3, 66.7), "unknown": (4, 25.0)}


def test_string_metadata(spark):
    meta = dict(final_status="complete", found_count="6", recovery_attempted="True",
                recovery_labels_resolved="1", latency_ms="3000", scanner_vision_match="True",
                count_delta="0", recovery_succeeded="True", primary_issue="none")
    df = spark.createDataFrame([(1, meta), (2, {})], "id int, metadata map<string,string>")
    m = one(metrics.compute_metrics(metrics.runs_from_metadata(df.filter("id = 1"))))
    assert (m.recovery_attempted_pct, m.recovery_success_pct, m.boxes_processed) == (100.0, 100.0, 6)
    assert (m.p95_latency_ms, m.scanner_vision_match_pct) == (3000.0, 100.0)
    empty = metrics.runs_from_metadata(df.filter("id = 2"))
    assert one(metrics.compute_metrics(empty)).boxes_processed == 0
    assert [tuple(r) for r in metrics.primary_issue_counts(empty).collect()] == [("none", 1)]


def test_group_by_is_checked(spark):
    with pytest.raises(ValueError, match="group_by"):
        metrics.compute_grouped_metrics(runs(spark, {}), "status; drop table runs")


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    pairs = [(n, d) for d in (1, 3, 7, 8, 20, 40, 400, 2000, 4000) for n in rng.sample(range(d + 1), min(d + 1, 300))]
    pairs += [(0, 0)]
    df = spark.createDataFrame(pairs, "n long, d long")
    for r in df.select("n", "d", rates.pct("n", "d").alias("p"), rates.avg1("n - 5 * d", "d").alias("a")).collect():
        assert r.p == (round(100.0 * r.n / r.d, 1) if r.d else 0.0)
        assert r.a == (round((r.n - 5 * r.d) / r.d, 1) if r.d else 0.0)


@pytest.mark.parametrize("ms, shown", [(0, "0ms"), (999, "999ms"), (1000, "1.0s"), (1250, "1.3s"),
                                       (1150, "1.1s"), (1050, "1.1s"), (61234, "61.2s")])
def test_latency_text(spark, ms, shown):
    df = spark.createDataFrame([(ms,)], "ms int")
    assert one(df.select(rates.format_latency("ms").alias("t"))).t == shown


def test_window_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "runs")
    spark.sql("select timestamp_ntz'2024-01-02 00:00:00' as created_at, 1 as id").write.parquet(path)
    plan = metrics.in_window(spark.read.parquet(path), 24, "2024-01-03 00:00:00")
    assert plan.count() == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in text


def test_metrics_combine_before_the_shuffle(spark):
    df = metrics.compute_grouped_metrics(runs(spark, {}), "source")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and "partial_percentile" in text
