"""Dashboard series as one table-driven aggregation.

A series is a row of :data:`SERIES`: which runs it takes, by which field it is
split and what it measures. The runs are scanned once. A run becomes one small row per series it belongs
to, with the value it gives there; equal rows are counted in each task before the shuffle, and means and
percentiles follow from values and their counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT_NAMES = ("ingest_one", "web_analyze_barcode", "process_whatsapp_message")


@dataclass(frozen=True)
class Series:
    chart: str
    name: str
    measure: str = "count"  # count | error_rate | user_correct | p50 | p99
    where: str = "true"
    by: str | None = None


SERIES: tuple[Series, ...] = (
    # operations
    Series("ops-volume", "Traces", by="source"),
    Series("ops-outcomes", "Outcomes", by="status"),
    Series("ops-retry-rate", "Retries", where="status = 'needs_user_input'", by="source"),
    Series("ops-completion-kpi", "Completed", where="status = 'complete'"),
    Series("ops-latency-p50", "P50 latency", "p50", by="source"),
    Series("ops-latency-p99", "P99 latency", "p99", by="source"),
    Series("ops-error-rate", "Error rate", "error_rate", by="source"),
    # quality
    Series("quality-scanner-vision-match", "Match", where="scanner_vision_match"),
    Series("quality-scanner-vision-match", "Mismatch", where="not scanner_vision_match"),
    Series("quality-count-delta", "Delta", by="count_delta"),
    Series("quality-missing-labels", "Traces", by="missing_count"),
    Series("quality-unassigned", "Traces", by="unassigned_count"),
    Series("quality-first-pass", "First-pass",
           where="status = 'complete' and not recovery_attempted"),
    Series("quality-recovered", "Recovered", where="status = 'complete' and recovery_attempted"),
    # The title says "after recovery"; the filter has always been the status alone.
    Series("quality-still-incomplete", "Incomplete", where="status = 'needs_user_input'"),
    Series("quality-primary-issue", "Traces", by="primary_issue"),
    Series("quality-user-confirmed", "user_correct", "user_correct", by="source"),
    # recovery
    Series("recovery-funnel-total", "Total"),
    Series("recovery-funnel-attempted", "Attempted", where="recovery_attempted"),
    Series("recovery-funnel-succeeded", "Succeeded", where="recovery_succeeded"),
    Series("recovery-funnel-complete", "Complete",
           where="recovery_attempted and status = 'complete'"),
    Series("recovery-attempt-rate", "Attempts", where="recovery_attempted", by="source"),
    Series("recovery-labels", "Tried", where="recovery_attempted", by="recovery_labels_tried"),
    Series("recovery-labels", "Resolved", where="recovery_attempted",
           by="recovery_labels_resolved"),
    # versions
    Series("versions-completion-by-pipeline", "Completed", where="status = 'complete'",
           by="pipeline_version"),
    Series("versions-mismatch-by-scanner", "Mismatch", where="not scanner_vision_match",
           by="scanner_version"),
    Series("versions-recovery-by-recovery", "Succeeded", where="recovery_succeeded",
           by="recovery_version"),
    Series("versions-completion-by-vision-prompt", "Completed", where="status = 'complete'",
           by="vision_prompt_version"),
    Series("versions-latency-by-pipeline", "P99 latency", "p99", by="pipeline_version"),
    Series("versions-retry-by-vision-model", "Retries", where="status = 'needs_user_input'",
           by="vision_model"),
)

def _member(number: int, s: Series) -> list[Column]:
    """The small rows of a run for one series: value and how often; null where the series leaves the run out."""
    key = F.col(s.by).cast("string") if s.by else F.lit("all")

    def row(value: Column, weight: Column) -> Column:
        r = F.struct(F.lit(number).alias("s"), F.coalesce(key, F.lit("unknown")).alias("group_value"),
                     value.cast("int").alias("v"), weight.cast("long").alias("w"))
        return r if s.where == "true" else F.when(F.expr(s.where), r)

    if s.measure == "count":
        return [row(F.lit(None), F.lit(1))]
    if s.measure == "error_rate":
        return [row(F.when(F.col("status") == "failed", 1).otherwise(0), F.lit(1))]
    if s.measure == "user_correct":
        return [row(F.lit(1), F.col("_right")), row(F.lit(0), F.col("_wrong"))]
    return [row(F.col("latency_ms"), F.lit(1))]


_KEY = ["s", "bucket", "group_value"]


def chart_series(runs: DataFrame, feedback: DataFrame, *, stride: str = "1 hour",
                 series: tuple[Series, ...] = SERIES) -> DataFrame:
    """Every point of every series: ``chart_key, series, bucket, group_value, n, value``.

    Verdicts of users are counted per trace before they meet the runs.
    """
    root = runs.filter(F.col("name").isin(*ROOT_NAMES))
    if any(s.measure == "user_correct" for s in series):
        verdicts = feedback.groupBy("trace_id").agg(F.count_if(F.col("correct")).alias("_right"),
                                                    F.count_if(~F.col("correct")).alias("_wrong"))
        root = root.join(verdicts, "trace_id", "left")
    members = [m for i, s in enumerate(series) for m in _member(i, s)]
    bucket = F.window("created_at", stride)["start"].alias("bucket")
    # Null members become null rows of the generator; the filter follows in the same stage.
    rows = root.select(bucket, F.inline(F.array(*members))).filter(F.col("w") > 0)
    values = rows.groupBy(*_KEY, "v").agg(F.sum("w").alias("w"))
    points = values.groupBy(*_KEY).agg(
        F.sum("w").alias("n"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"),
        F.percentile("v", F.array(F.lit(0.5), F.lit(0.99)), F.col("w")).alias("p"))

    def of(*measures: str) -> Column:
        return F.col("s").isin([i for i, s in enumerate(series) if s.measure in measures])

    out = points.withColumn("value", F.when(of("count"), F.col("n").cast("double")).when(of("p50"), F.round(F.col("p")[0], 3)).when(
        of("p99"), F.round(F.col("p")[1], 3)).otherwise(F.col("mean")))

    def name(of_series: list[str]) -> Column:
        return F.get(F.array(*[F.lit(x) for x in of_series]), F.col("s"))

    return out.select(name([x.chart for x in series]).alias("chart_key"),
                      name([x.name for x in series]).alias("series"),
                      "bucket", "group_value", "n", "value")
