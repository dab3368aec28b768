"""Checks of stored rows: each gives the names of the broken rules, if any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.functions.messages import COMMENT_LIMIT

# What the enumerated columns may hold.
ALLOWED = {
    "run_status": ("pending", "processing", "complete", "needs_user_input", "needs_retry", "failed"),
    "item_status": ("found", "missing"),
    "annotation_status": ("pending", "reviewed", "exported"),
    "session_status": ("active", "complete", "expired", "failed", "closed", "needs_user_selection"),
    "order_action": ("create_order", "verify_order_before_shipment"),
}


def violations(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules whose condition does not hold."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*broken))


def pixel_box_rules(b: Column) -> dict[str, Column]:
    return {"x_order": b["x2"] >= b["x1"], "y_order": b["y2"] >= b["y1"]}


def normalized_box_rules(b: Column) -> dict[str, Column]:
    rules = {f"{side}_range": b[side].between(0, 1000) for side in ("top", "left", "bottom", "right")}
    return rules | {"vertical_order": b["bottom"] > b["top"], "horizontal_order": b["right"] > b["left"]}


def audit_rules(boxes: Column, visible: Column, clear: Column, without: Column) -> dict[str, Column]:
    return {
        "not_negative": F.least(boxes, visible, clear, without) >= 0,
        "visible_within_boxes": visible <= boxes,
        "clear_within_visible": clear <= visible,
        "without_within_boxes": without <= boxes,
    }


def label_rules(label_index: Column) -> dict[str, Column]:
    return {"label_index_from_one": label_index >= 1}


def enum_rule(column: Column, kind: str) -> dict[str, Column]:
    return {kind: column.isin(*ALLOWED[kind])}


def order_context_rules(customer_id: Column, branch_id: Column, action: Column) -> dict[str, Column]:
    return {
        "customer_required": F.trim(customer_id) != "",
        "branch_required": F.trim(branch_id) != "",
    } | enum_rule(action, "order_action")


def feedback_rules(comment: Column) -> dict[str, Column]:
    return {"comment_length": comment.isNull() | (F.length(comment) <= COMMENT_LIMIT)}


def broken_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with at least one broken rule, with the names."""
    return rows.withColumn("violations", violations(rules)).filter(F.size("violations") > 0)


def orphans(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows that refer to a parent that is not there; null references are allowed."""
    known = parents.select(F.col(key).alias(column))
    return children.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
