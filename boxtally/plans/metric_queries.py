"""Metrics, charts and version comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.functions import rates, text
from boxtally.operators import charts, metrics
from boxtally.plans.catalog import query
from boxtally.plans.fixtures import build


def r1(x: str) -> str:
    """Correctly rounded one-decimal text of a double, back as a double."""
    return f"cast(printf('%.1f', cast({x} as double)) as double)"


def pct(n: str, d: str) -> str:
    return f"case when ({d}) = 0 then 0e0 else {r1(f'100e0 * ({n}) / ({d})')} end"


def avg(n: str, d: str) -> str:
    return f"case when ({d}) = 0 then 0e0 else {r1(f'cast({n} as double) / ({d})')} end"


_COUNTS = """
  count(*) as images_processed,
  cast(sum(found_count) as bigint) as boxes_processed,
  count(*) filter (status = 'complete' and not recovery_attempted) as first_pass_complete,
  count(*) filter (status = 'complete') as final_complete,
  count(*) filter (recovery_attempted) as recovery_attempted,
  count(*) filter (recovery_attempted and recovery_labels_resolved > 0) as recovery_succeeded,
  count(*) filter (status = 'needs_user_input') as user_retry,
  count(*) filter (scanner_vision_match) as matched,
  count(*) filter (status = 'complete' and recovery_attempted) as recovered_complete,
  cast(sum(count_delta) as bigint) as sum_count_delta,
  cast(sum(missing_count) as bigint) as sum_missing,
  cast(sum(unassigned_count) as bigint) as sum_unassigned,
  cast(coalesce(sum(recovery_labels_tried) filter (recovery_attempted), 0) as bigint) as sum_tried,
  cast(coalesce(sum(recovery_labels_resolved) filter (recovery_attempted), 0) as bigint) as sum_resolved,
  coalesce(cast(quantile_disc(latency_ms, 0.95) filter (latency_ms > 0) as double), 0e0)
    as p95_latency_ms
"""
_RATES = f"""
  {pct('first_pass_complete', 'images_processed')} as first_pass_complete_pct,
  {pct('final_complete', 'images_processed')} as final_complete_pct,
  {pct('recovery_attempted', 'images_processed')} as recovery_attempted_pct,
  {pct('recovery_succeeded', 'recovery_attempted')} as recovery_success_pct,
  {pct('user_retry', 'images_processed')} as user_retry_required_pct,
  {pct('matched', 'images_processed')} as scanner_vision_match_pct,
  {pct('recovered_complete', 'images_processed')} as recovered_complete_pct,
  {pct('user_retry', 'images_processed')} as still_incomplete_pct,
  {avg('sum_count_delta', 'images_processed')} as avg_count_delta,
  {avg('sum_missing', 'images_processed')} as avg_missing_count,
  {avg('sum_unassigned', 'images_processed')} as avg_unassigned_count,
  {avg('sum_tried', 'recovery_attempted')} as avg_labels_tried,
  {avg('sum_resolved', 'recovery_attempted')} as avg_labels_resolved
"""


def _grouped(field: str, where: str = "true") -> str:
    return f"""
select m.*, {_RATES} from (
  select coalesce({field}, 'unknown') as group_key, {_COUNTS} from runs where {where} group by 1) m
"""


@query("A1 A5 P27 P28", f"select m.*, {_RATES} from (select {_COUNTS} from runs) m", "runs")
def compute_metrics(spark, d):
    return metrics.compute_metrics(build(spark, d, "runs"))


@query("A2", _grouped("pipeline_version"), "runs")
def metrics_by_pipeline_version(spark, d):
    return metrics.compute_grouped_metrics(build(spark, d, "runs"), "pipeline_version")


@query("A2", _grouped("source"), "runs")
def metrics_by_source(spark, d):
    return metrics.compute_grouped_metrics(build(spark, d, "runs"), "source")


@query("A2 P45 P46", _grouped(
    "vision_model", "created_at >= timestamp '2001-08-01 00:00:00' - interval 720 hour"), "runs")
def metrics_in_window_by_vision_model(spark, d):
    window = metrics.in_window(build(spark, d, "runs"), 720, "2001-08-01 00:00:00")
    return metrics.compute_grouped_metrics(window, "vision_model")


def _rate_sql(name: str) -> str:
    field, counts, matches = metrics.VERSION_RATES[name]
    return f"""select '{name}' as rate, coalesce({field}, 'unknown') as version, count(*) as total,
      count(*) filter ({matches}) as matched from runs where {counts or 'true'} group by 2"""


@query("A3", f"""
select v.*, {pct('matched', 'total')} as rate_pct
from ({' union all '.join(_rate_sql(n) for n in metrics.VERSION_RATES)}) v""", "runs")
def version_rates(spark, d):
    return metrics.version_rates(build(spark, d, "runs"))


@query("A4", """
select scanner_version as group_key, count(*) as total,
  count(*) filter (status = 'complete') as complete,
  count(*) filter (status = 'needs_user_input') as needs_user_input,
  count(*) filter (status = 'needs_retry') as needs_retry,
  count(*) filter (status = 'failed') as failed,
  count(*) filter (recovery_attempted) as recovery_attempted,
  count(*) filter (recovery_succeeded) as recovery_succeeded,
  cast(round(avg(latency_ms)) as int) as avg_latency,
  cast(round_even(coalesce(quantile_cont(latency_ms, 0.95), 0), 0) as int) as p95_latency,
  avg(missing_count) as avg_missing, avg(unassigned_count) as avg_unassigned,
  avg(count_delta) as avg_count_delta
from runs where scanner_version is not null group by 1""", "runs")
def stored_grouped_metrics(spark, d):
    return metrics.stored_grouped_metrics(build(spark, d, "runs"), "scanner_version")


@query("A6", """
select coalesce(nullif(primary_issue, ''), 'none') as primary_issue, count(*) as runs
from runs group by 1""", "runs")
def primary_issue_counts(spark, d):
    return metrics.primary_issue_counts(build(spark, d, "runs"))


@query("A7", f"""
with c as (select count(*) as total, count(*) filter (recovery_attempted) as attempted,
    count(*) filter (recovery_attempted and recovery_labels_resolved > 0) as succeeded,
    count(*) filter (recovery_attempted and status = 'complete') as completed from runs),
s as (select 1 as step_no, 'total' as step, total as runs, total as denominator from c
  union all select 2, 'attempted', attempted, total from c
  union all select 3, 'succeeded', succeeded, attempted from c
  union all select 4, 'completed', completed, total from c)
select s.*, {pct('runs', 'denominator')} as share_pct from s""", "runs")
def recovery_funnel(spark, d):
    return metrics.recovery_funnel(build(spark, d, "runs"))


def _series_sql(s: charts.Series) -> str:
    key = f"coalesce(cast({s.by} as varchar), 'unknown')" if s.by else "'all'"
    value = {
        "count": "cast(count(*) as double)",
        "error_rate": "avg(case when status = 'failed' then 1 else 0 end)",
        "user_correct": "avg(case when correct then 1 else 0 end)",
        "p50": "round(quantile_cont(latency_ms, 0.5), 3)",
        "p99": "round(quantile_cont(latency_ms, 0.99), 3)",
    }[s.measure]
    source = "root join feedback f using (trace_id)" if s.measure == "user_correct" else "root"
    return f"""select '{s.chart}' as chart_key, '{s.name}' as series,
      time_bucket(interval 1 hour, created_at) as bucket, {key} as group_value,
      count(*) as n, {value} as value
      from {source} where {s.where} group by 3, 4"""


_CHART_SQL = "with root as (select * from runs where name in ({}))\n{}".format(
    ", ".join(f"'{n}'" for n in charts.ROOT_NAMES),
    "\nunion all\n".join(_series_sql(s) for s in charts.SERIES))


@query("A8", _CHART_SQL, "runs feedback")
def chart_series(spark, d):
    return charts.chart_series(build(spark, d, "runs"), build(spark, d, "feedback"))


@query("A17 J9 P47", """
select source, count(*) as n, cast(sum(case when correct then 1 else 0 end) as bigint) as correct,
  avg(case when correct then 1 else 0 end) as user_correct
from feedback join runs using (trace_id) group by 1""", "runs feedback")
def user_correctness(spark, d):
    return metrics.user_correctness(build(spark, d, "feedback"), build(spark, d, "runs"))


@query("J9", """
select trace_id, case when correct then 1 else 0 end as score, id as run_id, status
from feedback join runs using (trace_id)""", "runs feedback")
def feedback_to_runs(spark, d):
    joined = metrics.feedback_on_runs(build(spark, d, "feedback"), build(spark, d, "runs"))
    return joined.select("trace_id", "score", F.col("id").alias("run_id"), "status")


@query("A18 P40", f"""
select group_key, images_processed, final_complete_pct, user_retry_required_pct,
  scanner_vision_match_pct, recovery_success_pct,
  case when p95_latency_ms >= 1000 then printf('%.1fs', p95_latency_ms / 1000e0)
       else concat(cast(cast(p95_latency_ms as bigint) as varchar), 'ms') end as p95
from ({_grouped('recovery_version')}) g""", "runs")
def version_comparison(spark, d):
    return metrics.version_comparison(build(spark, d, "runs"), "recovery_version")


@query("A18", f"""
select group_key, user_retry_required_pct as value from ({_grouped('vision_prompt_version')}) g""", "runs")
def version_metric(spark, d):
    return metrics.version_metric(build(spark, d, "runs"), "vision_prompt_version",
                                  "user_retry_required_pct")


@query("L3 P45", """
select id, status, created_at from runs
where created_at >= timestamp '2001-08-01 00:00:00' - interval 168 hour
order by created_at desc, id""", "runs")
def recent_runs(spark, d):
    return metrics.recent_runs(build(spark, d, "runs").select("id", "status", "created_at"), 168,
                               "2001-08-01 00:00:00")


@query("L3", """
select count(*) >= 2000 as truncated from (select id from runs
where created_at >= timestamp '2001-08-01 00:00:00' - interval 8760 hour limit 2000) r""", "runs")
def recent_runs_truncated(spark, d):
    return metrics.is_truncated(
        metrics.in_window(build(spark, d, "runs"), 8760, "2001-08-01 00:00:00"), 2000)


@query("P40", """
select latency_ms, count(*) as runs,
  case when latency_ms < 1000 then concat(cast(latency_ms as varchar), 'ms')
       when latency_ms % 1000 in (250, 750) then concat(cast(latency_ms // 1000 as varchar),
         case when latency_ms % 1000 = 250 then '.3s' else '.8s' end)
       else printf('%.1fs', latency_ms / 1000e0) end as shown
from runs group by 1""", "runs")
def format_latency(spark, d):
    return build(spark, d, "runs").groupBy("latency_ms").agg(F.count(F.lit(1)).alias("runs")).withColumn(
        "shown", rates.format_latency("latency_ms"))


@query("P24 P25", """
select run_id,
  coalesce(try_cast(case when regexp_full_match(trim(found_count), '[+-]?[0-9]+')
    then trim(found_count) end as bigint), 0) as found_count,
  coalesce(lower(recovery_attempted) in ('true', '1', 'yes'), false) as recovery_attempted
from run_metadata""", "run_metadata")
def coerce_metadata(spark, d):
    m = build(spark, d, "run_metadata")
    return m.select("run_id", text.meta_int(F.col("found_count")).alias("found_count"),
                    text.meta_bool(F.col("recovery_attempted")).alias("recovery_attempted"))


@query("P24 P25 P26", """
with t as (select run_id, body, json_type(body, '$.found_count') as ft, json_extract_string(body, '$.found_count') as f,
  json_type(body, '$.recovery_attempted') as rt, json_extract_string(body, '$.recovery_attempted') as r from run_json)
select run_id, cast(case when ft in ('BIGINT', 'UBIGINT') then cast(f as bigint) when ft = 'DOUBLE' then trunc(cast(f as double))
    when ft = 'BOOLEAN' then case when f = 'true' then 1 else 0 end
    when ft = 'VARCHAR' and regexp_full_match(trim(f), '[+-]?[0-9]+') then cast(trim(f) as bigint) else 0 end as bigint) as found_count,
  coalesce(case when rt in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast(r as double) <> 0 when rt = 'BOOLEAN' then r = 'true'
    when rt = 'VARCHAR' then lower(r) in ('true', '1', 'yes') when rt in ('ARRAY', 'OBJECT') then r not in ('[]', '{}') end, false) as recovery_attempted,
  json_extract_string(body, '$.primary_issue') as primary_issue from t""", "run_json")
def typed_metadata(spark, d):
    """Metadata as JSON whose values keep their types."""
    traces = build(spark, d, "run_json").select("run_id", F.parse_json("body").alias("metadata"))
    return metrics.runs_from_metadata(traces).select("run_id", "found_count", "recovery_attempted", "primary_issue")


@query("P26", "select run_id, primary_issue, found_count as found_text from run_metadata", "run_metadata")
def metadata_strings(spark, d):
    m = build(spark, d, "run_metadata")
    packed = m.select("run_id", F.create_map(
        F.lit("primary_issue"), "primary_issue", F.lit("found_count"), "found_count").alias("m"))
    return packed.select("run_id", text.meta_str(F.col("m"), "primary_issue").alias("primary_issue"),
                         text.meta_str(F.col("m"), "found_count").alias("found_text"))


@query("A1 P24 P25 P26", """
select count(*) as images_processed, cast(sum(coalesce(try_cast(case when regexp_full_match(trim(found_count), '[+-]?[0-9]+')
    then trim(found_count) end as bigint), 0)) as bigint) as boxes_processed,
  count(*) filter (lower(recovery_attempted) in ('true', '1', 'yes')) as recovery_attempted
from run_metadata""", "run_metadata")
def metrics_from_metadata(spark, d):
    names = ("found_count", "recovery_attempted", "primary_issue")
    entries = [x for n in names for x in (F.lit(n), F.col(n))]
    traces = build(spark, d, "run_metadata").select("run_id", F.create_map(*entries).alias("metadata"))
    return metrics.compute_metrics(metrics.runs_from_metadata(traces)).select(
        "images_processed", "boxes_processed", "recovery_attempted")
