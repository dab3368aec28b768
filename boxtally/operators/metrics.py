"""Operational metrics over runs: one aggregation per question.

Counts combine on the map side, and the percentiles keep one counter per
distinct latency, so a version or source that holds most runs costs one small
buffer per task and not one large group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from boxtally.functions.rates import avg1, format_latency, pct
from boxtally.functions.text import meta_bool, meta_int, meta_str, variant_bool, variant_int, variant_str

# The field names of runs, as stored and as metadata carries them.
GROUP_FIELDS = (
    "pipeline_version", "scanner_version", "recovery_version",
    "vision_prompt_version", "vision_model", "source",
)

#: rate -> (numerator, denominator) among the counters of :func:`_counters`
_RATES = {
    "first_pass_complete_pct": ("first_pass_complete", "images_processed"),
    "final_complete_pct": ("final_complete", "images_processed"),
    "recovery_attempted_pct": ("recovery_attempted", "images_processed"),
    "recovery_success_pct": ("recovery_succeeded", "recovery_attempted"),
    "user_retry_required_pct": ("user_retry", "images_processed"),
    "scanner_vision_match_pct": ("matched", "images_processed"),
    "recovered_complete_pct": ("recovered_complete", "images_processed"),
    "still_incomplete_pct": ("user_retry", "images_processed"),
}
_AVERAGES = {
    "avg_count_delta": ("sum_count_delta", "images_processed"),
    "avg_missing_count": ("sum_missing", "images_processed"),
    "avg_unassigned_count": ("sum_unassigned", "images_processed"),
    "avg_labels_tried": ("sum_tried", "recovery_attempted"),
    "avg_labels_resolved": ("sum_resolved", "recovery_attempted"),
}


_TEXT_FIELDS = ("source", "primary_issue", "pipeline_version", "scanner_version", "recovery_version",
                "vision_prompt_version", "vision_model")
_INT_FIELDS = ("found_count", "missing_count", "unassigned_count", "count_delta", "latency_ms",
               "recovery_labels_tried", "recovery_labels_resolved")
_BOOL_FIELDS = ("scanner_vision_match", "recovery_attempted", "recovery_succeeded")


def runs_from_metadata(traces: DataFrame, column: str = "metadata") -> DataFrame:
    """Typed run columns from loosely typed metadata: a map of strings, or a variant whose values keep their types."""
    m = F.col(column)
    if isinstance(traces.schema[column].dataType, VariantType):
        text, whole, truth = variant_str, variant_int, variant_bool
    else:
        text = meta_str
        whole, truth = (lambda m, c, read=read: read(meta_str(m, c)) for read in (meta_int, meta_bool))
    put = {"status": text(m, "final_status")}
    put |= {c: text(m, c) for c in _TEXT_FIELDS}
    put |= {c: whole(m, c) for c in _INT_FIELDS}
    put |= {c: truth(m, c) for c in _BOOL_FIELDS}
    return traces.select("*", *[v.alias(k) for k, v in put.items()])


def check_group_by(field: str) -> str:
    """Refuse a grouping field before any plan is built."""
    if field not in GROUP_FIELDS:
        raise ValueError(f"invalid group_by {field!r}; valid: {sorted(GROUP_FIELDS)}")
    return field


def in_window(runs: DataFrame, hours: int, now: Column | str) -> DataFrame:
    """Runs created in the last ``hours`` before ``now``, both ends included.

    A plain comparison of the stored column, so it reaches the scan and prunes
    date partitions.
    """
    now = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    return runs.filter(F.col("created_at") >= now - F.make_interval(hours=F.lit(hours)))


def recent_runs(runs: DataFrame, hours: int, now: str, limit: int | None = None) -> DataFrame:
    """Newest runs first. The limit is a report option, off by default."""
    window = in_window(runs, hours, now).orderBy(F.col("created_at").desc(), F.col("id"))
    return window if limit is None else window.limit(limit)


def is_truncated(window: DataFrame, limit: int) -> DataFrame:
    """Whether a report of ``limit`` rows leaves rows out or just fills up."""
    return window.limit(limit).agg((F.count(F.lit(1)) >= limit).alias("truncated"))


def p95_nearest_rank(latency: str) -> Column:
    """Nearest-rank 95th percentile of the positive values of a column; 0.0 without any."""
    disc = f"percentile_disc(0.95) within group (order by case when {latency} > 0 then {latency} end)"
    return F.coalesce(F.expr(disc), F.lit(0.0))


def _counters() -> list[Column]:
    complete = F.col("status") == "complete"
    tried = F.col("recovery_attempted")
    zero = F.lit(0)
    return [
        F.count(F.lit(1)).alias("images_processed"),
        F.coalesce(F.sum("found_count"), zero).alias("boxes_processed"),
        F.count_if(complete & ~tried).alias("first_pass_complete"),
        F.count_if(complete).alias("final_complete"),
        F.count_if(tried).alias("recovery_attempted"),
        F.count_if(tried & (F.col("recovery_labels_resolved") > 0)).alias("recovery_succeeded"),
        F.count_if(F.col("status") == "needs_user_input").alias("user_retry"),
        F.count_if(F.col("scanner_vision_match")).alias("matched"),
        F.count_if(complete & tried).alias("recovered_complete"),
        F.coalesce(F.sum("count_delta"), zero).alias("sum_count_delta"),
        F.coalesce(F.sum("missing_count"), zero).alias("sum_missing"),
        F.coalesce(F.sum("unassigned_count"), zero).alias("sum_unassigned"),
        F.coalesce(F.sum(F.when(tried, F.col("recovery_labels_tried"))), zero).alias("sum_tried"),
        F.coalesce(F.sum(F.when(tried, F.col("recovery_labels_resolved"))), zero).alias("sum_resolved"),
        p95_nearest_rank("latency_ms").alias("p95_latency_ms"),
    ]


def _with_rates(counted: DataFrame) -> DataFrame:
    """Add the rates; the exact counts stay beside them."""
    rates = {n: pct(a, b) for n, (a, b) in _RATES.items()}
    averages = {n: avg1(a, b) for n, (a, b) in _AVERAGES.items()}
    return counted.withColumns(rates | averages)


def compute_metrics(runs: DataFrame) -> DataFrame:
    """All indicators of a set of runs in one row."""
    return _with_rates(runs.agg(*_counters()))


def compute_grouped_metrics(runs: DataFrame, group_by: str) -> DataFrame:
    """The same indicators per version or source; an absent key is ``unknown``."""
    key = F.coalesce(F.col(check_group_by(group_by)), F.lit("unknown"))
    return _with_rates(runs.groupBy(key.alias("group_key")).agg(*_counters()))


#: rate name -> (version field, which runs count at all, which of them match)
VERSION_RATES = {
    "completion_by_pipeline_version": ("pipeline_version", None, "status = 'complete'"),
    "mismatch_by_scanner_version": ("scanner_version", None, "not scanner_vision_match"),
    "recovery_success_by_recovery_version": (
        "recovery_version", "recovery_attempted", "recovery_succeeded"),
    "retry_by_vision_model": ("vision_model", None, "status = 'needs_user_input'"),
}


def version_rates(runs: DataFrame, names: Iterable[str] = VERSION_RATES) -> DataFrame:
    """Share of matching runs per version, for several rates in one pass.

    Every run is expanded to one small row per rate and counted before the
    shuffle, instead of one scan of the runs per rate.
    """
    rows = []
    for name in names:
        field, counts, matches = VERSION_RATES[name]
        row = F.struct(F.lit(name).alias("rate"),
                       F.coalesce(F.col(field), F.lit("unknown")).alias("version"),
                       F.expr(matches).alias("hit"))
        rows.append(row if counts is None else F.when(F.expr(counts), row))
    expanded = runs.select(F.inline(F.array(*rows))).filter(F.col("rate").isNotNull())
    counted = expanded.groupBy("rate", "version").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("matched"))
    return counted.withColumn("rate_pct", pct("matched", "total"))


def stored_grouped_metrics(runs: DataFrame, group_by: str) -> DataFrame:
    """The grouped report of the run store: null keys out, zero latencies in.

    The average latency rounds half away from zero, the interpolated percentile
    half to even, as casts of exact and of floating numbers to integers do.
    """
    field = check_group_by(group_by)
    status = F.col("status")
    averages = {f"avg_{n}": F.avg(c) for n, c in
                (("missing", "missing_count"), ("unassigned", "unassigned_count"),
                 ("count_delta", "count_delta"))}
    return runs.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("group_key")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s)
          for s in ("complete", "needs_user_input", "needs_retry", "failed")],
        F.count_if("recovery_attempted").alias("recovery_attempted"),
        F.count_if("recovery_succeeded").alias("recovery_succeeded"),
        F.round(F.avg("latency_ms")).cast("int").alias("avg_latency"),
        F.rint(F.coalesce(F.percentile("latency_ms", F.lit(0.95)), F.lit(0.0))).cast("int")
        .alias("p95_latency"),
        *[c.alias(n) for n, c in averages.items()],
    ).orderBy(F.col("total").desc(), "group_key")


def primary_issue_counts(runs: DataFrame) -> DataFrame:
    """Runs per headline issue, most frequent first; empty and null are ``none``."""
    code = F.coalesce(F.nullif(F.col("primary_issue"), F.lit("")), F.lit("none"))
    return (runs.groupBy(code.alias("primary_issue")).agg(F.count(F.lit(1)).alias("runs"))
            .orderBy(F.col("runs").desc(), "primary_issue"))


def recovery_funnel(runs: DataFrame) -> DataFrame:
    """From all runs to those completed after recovery, with exact counts."""
    tried = F.col("recovery_attempted")
    counted = runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(tried).alias("attempted"),
        F.count_if(tried & (F.col("recovery_labels_resolved") > 0)).alias("succeeded"),
        F.count_if(tried & (F.col("status") == "complete")).alias("completed"),
    )
    step = "stack(4, 1, 'total', total, total, 2, 'attempted', attempted, total, " \
           "3, 'succeeded', succeeded, attempted, 4, 'completed', completed, total) " \
           "as (step_no, step, runs, denominator)"
    return counted.selectExpr(step).withColumn("share_pct", pct("runs", "denominator"))


COMPARED_METRICS = (
    "final_complete_pct", "user_retry_required_pct", "scanner_vision_match_pct",
    "recovery_success_pct",
)


def version_comparison(runs: DataFrame, group_by: str) -> DataFrame:
    """One printed row per version: runs, four rates and the tail latency."""
    m = compute_grouped_metrics(runs, group_by)
    return m.select("group_key", "images_processed", *COMPARED_METRICS,
                    format_latency("p95_latency_ms").alias("p95")).orderBy("group_key")


def version_metric(runs: DataFrame, group_by: str, metric: str) -> DataFrame:
    """The bars of one compared metric."""
    if metric not in COMPARED_METRICS:
        raise ValueError(f"unknown metric {metric!r}; valid: {sorted(COMPARED_METRICS)}")
    m = compute_grouped_metrics(runs, group_by)
    return m.select("group_key", F.col(metric).alias("value")).orderBy("group_key")


def feedback_on_runs(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """User feedback beside the run it is about."""
    scored = feedback.select("trace_id", F.col("correct").cast("int").alias("score"), "comment")
    return scored.join(runs, "trace_id")


def user_correctness(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Average user score by source."""
    joined = feedback_on_runs(feedback, runs.select("trace_id", "source"))
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("correct"),
        F.avg("score").alias("user_correct"))
