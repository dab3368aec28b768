"""Box geometry as native column expressions.

A box is a struct column ``<x1, y1, x2, y2>`` of integers. Everything stays in
generated code; no expression here reads another row. A struct built here is
taken apart again by the optimizer, so nested calls cost one expression per
coordinate. Callers that may hold a null box guard the outermost call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    """Struct of four integer coordinates; arguments are names or columns."""
    named = zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("int").alias(n) for v, n in named])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / F.lit(2.0)


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / F.lit(2.0)


def area(b: Column) -> Column:
    """Area with each side counted as at least one pixel."""
    return (F.greatest(F.lit(1), width(b)) * F.greatest(F.lit(1), height(b))).cast("long")


def normalized_to_pixels(top: Column, left: Column, bottom: Column, right: Column,
                         image_width: Column, image_height: Column) -> Column:
    """0..1000 coordinates to pixels, half to even; a non-positive image is an error."""
    def scale(v: Column, side: Column) -> Column:
        checked = F.when(side > 0, side).otherwise(
            F.raise_error(F.lit("image size must be positive")).cast("int"))
        return F.rint(v * checked / F.lit(1000.0))

    return box(scale(left, image_width), scale(top, image_height),
               scale(right, image_width), scale(bottom, image_height))


def contains_point(b: Column, px: Column, py: Column) -> Column:
    """Inclusive on every side."""
    return px.between(b["x1"], b["x2"]) & py.between(b["y1"], b["y2"])


def pad(b: Column, px: Column, py: Column) -> Column:
    """Grow by ``px``/``py`` on each side; may leave the image."""
    return box(b["x1"] - px, b["y1"] - py, b["x2"] + px, b["y2"] + py)


def clamp(b: Column, image_width: Column, image_height: Column) -> Column:
    """Limit to ``[0, width] x [0, height]``, both ends included."""
    def into(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0)), top)

    return box(into(b["x1"], image_width), into(b["y1"], image_height),
               into(b["x2"], image_width), into(b["y2"], image_height))


def pad_ratio(b: Column, ratio: float, image_width: Column, image_height: Column) -> Column:
    """Grow by a share of each side, cut at the image frame."""
    px, py = F.rint(width(b) * F.lit(ratio)), F.rint(height(b) * F.lit(ratio))
    grown = pad(b, px.cast("int"), py.cast("int"))
    return box(F.greatest(F.lit(0), grown["x1"]), F.greatest(F.lit(0), grown["y1"]),
               F.least(image_width, grown["x2"]), F.least(image_height, grown["y2"]))


def normalized_distance(ax: Column, ay: Column, bx: Column, by: Column,
                        image_width: Column, image_height: Column) -> Column:
    """Distance of two points, each axis as a share of the image side."""
    dx, dy = (ax - bx) / image_width, (ay - by) / image_height
    return F.sqrt(dx * dx + dy * dy)


def target_box(label_box: Column, barcode_box: Column) -> Column:
    """The barcode region of a label when known, else the whole label."""
    return F.coalesce(barcode_box, label_box)


def target_basis(barcode_box: Column) -> Column:
    return F.when(barcode_box.isNotNull(), "barcode_bbox").otherwise("label_bbox")


def target_padding(side: Column) -> Column:
    """15 % of a side, at least 20 pixels."""
    return F.greatest(F.lit(20), F.rint(side * F.lit(0.15)).cast("int"))


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), w).cast("long") * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 for boxes that do not overlap."""
    shared = overlap_area(a, b)
    joint = area(a) + area(b) - shared
    return F.when((shared == 0) | (joint <= 0), F.lit(0.0)).otherwise(shared / joint)


def containment(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies within ``outer``."""
    return overlap_area(inner, outer) / area(inner)


def centers_within(a: Column, b: Column, tolerance: float) -> Column:
    t = F.lit(float(tolerance))
    return (F.abs(center_x(a) - center_x(b)) <= t) & (F.abs(center_y(a) - center_y(b)) <= t)


def same_physical(a: Column, b: Column) -> Column:
    """Two readings of one printed code: near centres or overlapping surroundings."""
    longest = F.greatest(width(a), height(a), width(b), height(b), F.lit(1))
    reach = F.greatest(F.lit(40.0), longest * F.lit(0.35))
    near = (F.abs(center_x(a) - center_x(b)) <= reach) & (F.abs(center_y(a) - center_y(b)) <= reach)
    edge = F.lit(20)
    return near | (iou(pad(a, edge, edge), pad(b, edge, edge)) >= 0.20)


def polygon_to_box(points: Column) -> Column:
    """Bounding box of an array of ``<x, y>`` corners."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def map_polygon(points: Column, ox: Column, oy: Column, sx: Column, sy: Column) -> Column:
    """Crop coordinates to image coordinates: scale, round half to even, shift."""
    return F.transform(points, lambda p: _point(ox + F.rint(p["x"] * sx), oy + F.rint(p["y"] * sy)))


def unrotate_polygon(points: Column, ox: Column, oy: Column, crop_width: Column) -> Column:
    """Undo the quarter turn of a crop for corners found on the turned copy."""
    return F.transform(points, lambda p: _point(ox + p["y"] - oy, oy + crop_width - (p["x"] - ox)))
