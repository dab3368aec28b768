"""Box conflicts on numpy arrays, for tasks that judge many pairs of rows at once.

Each function gives what its namesake among the column expressions gives (tested). Boxes are mappings of
``x1, y1, x2, y2`` to integer arrays; values are codes, below 0 where they are null.
"""

from __future__ import annotations

import numpy as np


def _sides(b):
    return b["x2"] - b["x1"], b["y2"] - b["y1"]


def _area(b):
    w, h = _sides(b)
    return np.maximum(w, 1) * np.maximum(h, 1)


def _shared(a, b):
    w = np.minimum(a["x2"], b["x2"]) - np.maximum(a["x1"], b["x1"])
    h = np.minimum(a["y2"], b["y2"]) - np.maximum(a["y1"], b["y1"])
    return np.maximum(w, 0) * np.maximum(h, 0)


def _iou(a, b):
    shared = _shared(a, b)
    joint = _area(a) + _area(b) - shared
    return np.where((shared == 0) | (joint <= 0), 0.0, shared / np.maximum(joint, 1))


def _center_gaps(a, b):
    return (np.abs((a[low] + a[high]) / 2.0 - (b[low] + b[high]) / 2.0) for low, high in (("x1", "x2"), ("y1", "y2")))


def _pad(b, edge):
    return {"x1": b["x1"] - edge, "y1": b["y1"] - edge, "x2": b["x2"] + edge, "y2": b["y2"] + edge}


def same_reading(a, b, tolerance: float):
    """:func:`boxtally.operators.dedup.same_reading`."""
    p, q = a["box"], b["box"]
    dx, dy = _center_gaps(p, q)
    longest = np.maximum.reduce([*_sides(p), *_sides(q), np.ones_like(p["x1"])])
    reach = np.maximum(40.0, longest * 0.35)
    same = ((dx <= reach) & (dy <= reach)) | (_iou(_pad(p, 20), _pad(q, 20)) >= 0.20)
    misread = (dx <= tolerance) & (dy <= tolerance)
    known = (a["format"] == b["format"]) & (a["format"] >= 0) & (a["value"] >= 0) & (b["value"] >= 0)
    return known & np.where(a["value"] == b["value"], same, misread)


def overlaps(a, b):
    """:func:`boxtally.operators.proposals.overlaps`."""
    p, q = a["box"], b["box"]
    shared = _shared(p, q)
    return (_iou(p, q) >= 0.35) | (shared / _area(p) >= 0.75) | (shared / _area(q) >= 0.75)
