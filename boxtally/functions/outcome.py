"""From a reconciled photo to its outcome, status, counters and issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "struct<code:string,severity:string,message:string,evidence:string>"

LATENCY_LIMIT_MS = 10_000


def outcome(scan_ok: Column, audit_ok: Column, visible: Column, missing: Column) -> Column:
    return (F.when(~scan_ok | ~audit_ok, "retryable_error")
            .when((missing > 0) | (visible == 0), "needs_better_photo")
            .otherwise("complete"))


def all_found(scan_ok: Column, audit_ok: Column, visible: Column, missing: Column) -> Column:
    return scan_ok & audit_ok & (visible > 0) & (missing == 0)


def photo_message(outcome_: Column, visible: Column) -> Column:
    """The hint shown with a photo that has to be taken again."""
    hint = F.when(
        visible == 0, "No barcode labels were identified. Please take a closer, well-lit photo."
    ).otherwise("Please photograph the marked barcode area more closely.")
    return F.when(outcome_ == "needs_better_photo", hint)


def status_from_outcome(outcome_: Column, ok: Column) -> Column:
    return (F.when(outcome_ == "complete", "complete")
            .when(outcome_ == "needs_better_photo", "needs_user_input")
            .when(ok, "needs_retry")
            .otherwise("failed"))


def run_counters(found: Column, unassigned: Column, visible: Column, resolved: Column) -> dict[str, Column]:
    """Counters stored with a run. Every decoded code counts for the scanner."""
    scanner = found + unassigned
    return {
        "scanner_count": scanner,
        "vision_count": visible,
        "scanner_vision_match": scanner == visible,
        "count_delta": visible - scanner,
        "recovery_succeeded": resolved > 0,
    }


def _issue(code, severity: str, message: Column, evidence: Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(code.alias("code"), F.lit(severity).alias("severity"),
                    message.alias("message"), evidence.alias("evidence"))


def _pair(a: str, va: Column, b: str, vb: Column) -> Column:
    return F.to_json(F.struct(va.alias(a), vb.alias(b)))


def derive_issues(*, ok: Column, outcome_: Column, audit_ok: Column, missing: Column,
                  scanner: Column, vision: Column, attempted: Column, tried: Column,
                  resolved: Column, decoded: Column, error_code: Column,
                  error_message: Column, variant: str, missing_labels: Column | None = None) -> Column:
    """Array of issues of a photo.

    ``missing_labels``: the indices of the labels without a code, for the evidence of the missing codes.

    ``variant='service'`` puts missing codes before the count mismatch, asks for
    the audit in both, and names other failures PIPELINE_ERROR.
    ``variant='persisted'`` puts the mismatch first, reports missing codes even
    without the audit, and keeps the code of the error.
    """
    if variant not in ("service", "persisted"):
        raise ValueError(f"unknown issue variant {variant!r}")
    service = variant == "service"
    other = F.lit("PIPELINE_ERROR") if service else F.coalesce(error_code, F.lit("UNKNOWN_ERROR"))
    bad_image = (outcome_ == "retryable_error") & ~audit_ok
    text = F.coalesce(error_message, F.lit("Unknown error"))
    error = F.struct(error_code.alias("code"), error_message.alias("message"))
    failed = F.when(~ok, _issue(F.when(bad_image, "BAD_IMAGE").otherwise(other), "error", text,
                                F.to_json(F.struct(error.alias("error")) if service else error)))
    named = [] if missing_labels is None else [
        F.coalesce(missing_labels, F.array().cast("array<long>")).alias("label_indices" if service else "missing_labels")]
    lost = F.when((missing > 0) & audit_ok if service else missing > 0, _issue(
        "BARCODE_MISSING", "warning",
        F.format_string("%d label(s) without a decoded barcode", missing),
        F.to_json(F.struct(missing.alias("missing_count"), *named))))
    differs = F.when(audit_ok & (scanner != vision), _issue(
        "VISION_SCANNER_MISMATCH", "info",
        F.format_string("Scanner decoded %d barcode(s) but vision found %d label(s)", scanner, vision),
        _pair("scanner_count", scanner, "vision_count", vision)))
    vain = F.when(attempted & (resolved == 0), _issue(
        "RECOVERY_FAILED", "info",
        F.format_string("Recovery tried %d label(s) but resolved 0", tried),
        _pair("labels_tried", tried, "barcodes_found", decoded)))
    middle = [lost, differs] if service else [differs, lost]
    return F.array_compact(F.array(failed, *middle, vain))


def primary_issue(issues: Column, rule: str) -> Column:
    """Headline issue: ``severity`` = first of the gravest, ``first`` = first in the list."""
    if rule == "first":
        return F.try_element_at(issues, F.lit(1))["code"]
    if rule != "severity":
        raise ValueError(f"unknown primary issue rule {rule!r}")

    def of(level: str) -> Column:
        return F.try_element_at(F.filter(issues, lambda i: i["severity"] == level), F.lit(1))["code"]

    first = F.try_element_at(issues, F.lit(1))["code"]
    return F.coalesce(of("error"), of("warning"), of("info"), first, F.lit("none"))


def is_interesting(status: Column, scanner: Column, vision: Column,
                   attempted: Column, resolved: Column) -> Column:
    """Whether a finished run belongs in the review queue."""
    return F.coalesce(
        status.isin("failed", "needs_retry", "needs_user_input")
        | (scanner != vision) | (attempted & (resolved == 0)), F.lit(False))


def online_feedback(status: Column, scanner: Column, vision: Column, attempted: Column,
                    resolved: Column, elapsed_ms: Column) -> Column:
    """Six ``<key, score, comment>`` rows of a run, as an array for ``inline``."""
    def row(key: str, test: Column, comment: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), test.cast("int").alias("score"),
                        comment.alias("comment"))

    def text(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), value.cast("string"))

    # Booleans are printed with a capital, as the feedback comments carry them.
    flag = F.when(attempted, "True").otherwise("False")
    return F.array(
        row("complete", status == "complete", text("status", status)),
        row("scanner_vision_match", scanner == vision,
            F.concat_ws(" ", text("scanner", scanner), text("vision", vision))),
        row("recovery_required", attempted, text("attempted", flag)),
        row("recovery_success", resolved > 0, text("resolved", resolved)),
        row("user_retry_required", status == "needs_user_input", text("status", status)),
        row("latency_ok", elapsed_ms <= LATENCY_LIMIT_MS, text("elapsed_ms", elapsed_ms)),
    )


def feedback_score(correct: Column) -> Column:
    return correct.cast("int")
