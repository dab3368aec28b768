"""Plain sequential definitions of the ordered operators, for small fixtures."""

from __future__ import annotations

import statistics


def greedy(rows, order, conflict):
    kept = []
    for r in sorted(rows, key=order):
        if not any(conflict(k, r) for k in kept):
            kept.append(r)
    return kept


def center(b):
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def box_area(b):
    return max(1, b[2] - b[0]) * max(1, b[3] - b[1])


def shared(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def iou(a, b):
    s = shared(a, b)
    return s / (box_area(a) + box_area(b) - s) if s else 0.0


def grow(b, p):
    return b[0] - p, b[1] - p, b[2] + p, b[3] + p


def same_reading(a, b):
    """Rows are ``(ord, value, format, box)``."""
    if a[2] != b[2]:
        return False
    (ax, ay), (bx, by) = center(a[3]), center(b[3])
    dx, dy = abs(ax - bx), abs(ay - by)
    if a[1] != b[1]:
        return dx <= 15 and dy <= 15
    sides = [s for q in (a[3], b[3]) for s in (q[2] - q[0], q[3] - q[1])]
    reach = max(40.0, max(sides + [1]) * 0.35)
    return (dx <= reach and dy <= reach) or iou(grow(a[3], 20), grow(b[3], 20)) >= 0.20


def overlapping(a, b):
    x, y = a[2], b[2]
    s = shared(x, y)
    return iou(x, y) >= 0.35 or s / box_area(x) >= 0.75 or s / box_area(y) >= 0.75


def means_1d(values, k):
    """Centres of a one-dimensional clustering started at even ranks, or None."""
    values = sorted(values)
    at = [values[round(i * (len(values) - 1) / (k - 1))] for i in range(k)]
    for _ in range(30):
        cells = [[] for _ in range(k)]
        for v in values:
            cells[min(range(k), key=lambda i: abs(v - at[i]))].append(v)
        if not all(cells):
            return None
        nxt = [sum(c) / len(c) for c in cells]
        moved = max(abs(a - b) for a, b in zip(at, nxt))
        at = nxt
        if moved < 0.5:
            break
    return sorted(at)


def grid_gaps(points, w, h, rows=4, columns=3):
    if not max(rows, columns) <= len(points) < rows * columns:
        return set()
    xs, ys = means_1d([p[0] for p in points], columns), means_1d([p[1] for p in points], rows)
    if xs is None or ys is None:
        return set()

    def near(v, at):
        return min(range(len(at)), key=lambda i: abs(v - at[i]))

    def gap(at, otherwise):
        steps = [b - a for a, b in zip(at, at[1:]) if b > a]
        return statistics.median(steps) if steps else otherwise

    taken = {(near(y, ys), near(x, xs)) for x, y in points}
    dx, dy = gap(xs, w / columns), gap(ys, h / rows)
    return {(r, c, max(0, round(xs[c] - dx / 2)), max(0, round(ys[r] - dy / 2)),
             min(w, round(xs[c] + dx / 2)), min(h, round(ys[r] + dy / 2)))
            for r in range(rows) for c in range(columns) if (r, c) not in taken}
