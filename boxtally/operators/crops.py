"""Work lists of image regions to decode, and folding of decode attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.functions import geometry as g
from boxtally.functions.text import is_primary_code

TILE_ROWS, TILE_COLUMNS, TILE_OVERLAP = 4, 3, 0.12
RECOVERY_PADDING = 0.20


def _window(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    w, h = F.col("image_width"), F.col("image_height")
    return g.box(F.greatest(F.lit(0), F.rint(x1)), F.greatest(F.lit(0), F.rint(y1)),
                 F.least(w, F.rint(x2)), F.least(h, F.rint(y2)))


def plan_tiles(images: DataFrame, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS,
               overlap: float = TILE_OVERLAP) -> DataFrame:
    """Regular tiles and tiles shifted by half a cell, with overlap, per image.

    A fixed number of tiles per image, so the work list grows with the images
    and needs no shuffle.
    """
    if rows < 1 or columns < 1:
        raise ValueError("rows and columns must be at least 1")
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    shifted = rows > 1 and columns > 1
    slots = [("regular", r, c) for r in range(rows) for c in range(columns)]
    if shifted:
        slots += [("shifted", r, c) for r in range(rows - 1) for c in range(columns - 1)]
    tiles = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("tile_row"),
                               F.lit(c).alias("tile_column")) for k, r, c in slots])
    cw, ch = F.col("image_width") / F.lit(float(columns)), F.col("image_height") / F.lit(float(rows))
    shift = F.when(F.col("kind") == "shifted", F.lit(0.5)).otherwise(F.lit(0.0))
    x, y = (F.col("tile_column") + shift) * cw, (F.col("tile_row") + shift) * ch
    right = F.when(F.col("kind") == "shifted", x + cw).otherwise((F.col("tile_column") + 1) * cw)
    bottom = F.when(F.col("kind") == "shifted", y + ch).otherwise((F.col("tile_row") + 1) * ch)
    mx, my = (right - x) * F.lit(overlap), (bottom - y) * F.lit(overlap)
    return images.select("image_id", "image_width", "image_height", F.inline(tiles)).withColumn(
        "box", _window(x - mx, y - my, right + mx, bottom + my))


def plan_recovery_crops(unmatched: DataFrame, images: DataFrame) -> DataFrame:
    """Crop window around every unmatched label; empty regions are left out."""
    b = F.col("target")
    sized = unmatched.join(images.select("image_id", "image_width", "image_height"), "image_id")
    aimed = sized.withColumn("target", g.target_box(F.col("label_box"), F.col("barcode_box"))).filter(
        (g.width(b) > 0) & (g.height(b) > 0))

    def margin(side: Column) -> Column:
        return F.greatest(F.lit(20), F.rint(side * F.lit(RECOVERY_PADDING)).cast("int"))

    grown = g.pad(b, margin(g.width(b)), margin(g.height(b)))
    return aimed.select("image_id", "label_index", g.clamp(
        grown, F.col("image_width"), F.col("image_height")).alias("box"))


def fold_decode_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts of each crop up to and with the first that read a primary code.

    The first success is a minimum that combines before the shuffle; crops
    without one keep all their attempts and stay ``unresolved`` for the next pass.
    """
    success = F.when(is_primary_code(F.col("value")), F.col("attempt_no"))
    first = attempts.groupBy("crop_id").agg(F.min(success).alias("first_success"))
    kept = attempts.join(first, "crop_id").filter(
        F.col("first_success").isNull() | (F.col("attempt_no") <= F.col("first_success")))
    return kept.withColumn("unresolved", F.col("first_success").isNull()).drop("first_success")


def _cluster(values: np.ndarray, present: np.ndarray, k: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """1-D k-means of many short rows at once; rows are sorted, absent cells are inf.

    Returns the centres and which rows converged without an empty cluster.
    """
    n = present.sum(axis=1)
    rank = np.rint(np.arange(k)[None, :] * (n - 1)[:, None] / max(k - 1, 1)).astype(int)
    centers = np.take_along_axis(values, rank, axis=1)
    ok = np.ones(len(values), dtype=bool)
    moving = ok.copy()
    filled = np.where(present, values, 0.0)
    for _ in range(rounds):
        if not moving.any():
            break
        gap = np.abs(filled[:, :, None] - centers[:, None, :])
        member = (gap.argmin(axis=2)[:, :, None] == np.arange(k)) & present[:, :, None]
        size = member.sum(axis=1)
        ok &= ~(moving & (size == 0).any(axis=1))
        moving &= ok
        moved = (filled[:, :, None] * member).sum(axis=1) / np.maximum(size, 1)
        settled = (np.abs(centers - moved) < 0.5).all(axis=1)
        centers = np.where(moving[:, None], moved, centers)
        moving &= ~settled
    return np.sort(centers, axis=1), ok


def _spacing(centers: np.ndarray, fallback: np.ndarray) -> np.ndarray:
    gaps = np.diff(centers, axis=1)
    gaps = np.where(gaps > 0, gaps, np.nan)
    some = ~np.isnan(gaps).all(axis=1)
    out = fallback.astype(float).copy()
    out[some] = np.nanmedian(gaps[some], axis=1)
    return out


def _dense(lists: pa.Array) -> np.ndarray:
    """List values as rows of one matrix, sorted, filled up with inf."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lists), int(sizes.max())), np.inf)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _gaps(batches: Iterator[pa.RecordBatch], rows: int, columns: int) -> Iterator[pa.RecordBatch]:
    """Empty grid cells of all images of a batch at once; nothing is done image by image."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, w, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        xs, ys = _dense(batch.column(3)), _dense(batch.column(4))
        present = np.isfinite(xs)
        cx, okx = _cluster(np.sort(xs, axis=1), present, columns)
        cy, oky = _cluster(np.sort(ys, axis=1), present, rows)
        col = np.abs(np.where(present, xs, 0.0)[:, :, None] - cx[:, None, :]).argmin(axis=2)
        row = np.abs(np.where(present, ys, 0.0)[:, :, None] - cy[:, None, :]).argmin(axis=2)
        taken = np.zeros((len(ids), rows * columns), dtype=bool)
        image, point = np.nonzero(present)
        taken[image, row[image, point] * columns + col[image, point]] = True
        image, cell = np.nonzero(~taken & (okx & oky)[:, None])
        dx, dy = _spacing(cx, w / columns), _spacing(cy, h / rows)
        found = (ids[image], w[image], h[image], (cell // columns).astype(np.int32), (cell % columns).astype(np.int32),
                 cx[image, cell % columns], cy[image, cell // columns], dx[image], dy[image])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=_CELL_COLUMNS)


_CELL_COLUMNS = ["image_id", "image_width", "image_height", "grid_row", "grid_column", "cx", "cy", "dx", "dy"]


def infer_grid_gaps(detections: DataFrame, images: DataFrame, rows: int = TILE_ROWS,
                    columns: int = TILE_COLUMNS, width_ratio: float = 1.0,
                    height_ratio: float = 1.0) -> DataFrame:
    """Crop windows for the empty cells of a grid of labels.

    Only images with at least ``max(rows, columns)`` and fewer than
    ``rows * columns`` primary codes qualify. They are counted before anything
    is gathered, so an array never holds more than a dozen points.
    """
    primary = detections.filter(is_primary_code(F.col("value")))
    counted = primary.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n").between(max(rows, columns), rows * columns - 1))
    center = F.struct(g.center_x(F.col("box")).alias("x"), g.center_y(F.col("box")).alias("y"))
    points = primary.join(counted, "image_id", "left_semi").groupBy("image_id").agg(
        F.collect_list(center).alias("points"))
    sized = points.join(images.select("image_id", "image_width", "image_height"), "image_id")
    lists = sized.select(F.col("image_id").cast("long").alias("image_id"), "image_width", "image_height",
                         F.col("points.x").alias("xs"), F.col("points.y").alias("ys"))
    cells = lists.mapInArrow(lambda it: _gaps(it, rows, columns), (
        "image_id long, image_width int, image_height int, grid_row int, grid_column int, cx double, cy double, dx double, dy double"))
    hw, hh = F.col("dx") * width_ratio / 2, F.col("dy") * height_ratio / 2
    return cells.select("image_id", "grid_row", "grid_column", _window(
        F.col("cx") - hw, F.col("cy") - hh, F.col("cx") + hw, F.col("cy") + hh).alias("box"))
