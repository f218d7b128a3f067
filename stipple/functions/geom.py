"""Plane geometry as column expressions. A ring is two arrays of doubles, closed or open, in either direction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _next(c: Column) -> Column:
    """The array shifted by one: the other ends of the edges."""
    return F.concat(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1))


def edges(xs: Column, ys: Column) -> Column:
    """array<struct<x1, y1, x2, y2>> of a ring."""
    starts = F.zip_with(xs, ys, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ends = F.zip_with(_next(xs), _next(ys), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(starts, ends, lambda p, q: F.struct(p["a"].alias("x1"), p["b"].alias("y1"), q["a"].alias("x2"), q["b"].alias("y2")))


def contains(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a ring of fewer than 3 vertices contains nothing."""
    crossing = F.filter(edges(xs, ys), lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * F.try_divide(y - s["y1"], s["y2"] - s["y1"]) + s["x1"]))
    return (F.size(xs) >= 3) & (F.size(crossing) % 2 == 1)


def contains_constant(ring: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd rule for a ring known beforehand, unrolled into plain comparisons that stay in generated code."""
    inside = F.lit(False)
    if len(ring) < 3:
        return inside
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
        inside = inside != (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at))
    return inside


def bbox(xs: Column, ys: Column) -> Column:
    """struct<xmin, xmax, ymin, ymax>; right for negative coordinates too."""
    return F.struct(F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))


def in_box(x: Column, y: Column, xmin: float | Column, xmax: float | Column, ymin: float | Column, ymax: float | Column) -> Column:
    """Inclusive bounds."""
    return x.between(xmin, xmax) & y.between(ymin, ymax)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Whether two bounding boxes share a point."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def translate(c: Column, by: float | Column) -> Column:
    """All coordinates of one axis moved."""
    return F.transform(c, lambda v: v + by)


def open_ring(xs: Column, ys: Column) -> tuple[Column, Column]:
    """The ring without a closing vertex that repeats the first."""
    closed = (F.size(xs) > 1) & (F.element_at(xs, 1) == F.element_at(xs, -1)) & (F.element_at(ys, 1) == F.element_at(ys, -1))
    return tuple(F.when(closed, F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c) for c in (xs, ys))


def centroid(xs: Column, ys: Column) -> Column:
    """struct<x, y>: the mean of the vertices, the closing one counted once."""
    a, b = open_ring(xs, ys)
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), F.size(c))
    return F.struct(mean(a).alias("x"), mean(b).alias("y"))


def segment_distance2(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    u, v = x - (x1 + t * dx), y - (y1 + t * dy)
    return u * u + v * v


def boundary_distance2(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Squared distance from a point to the nearest edge of a ring."""
    return F.array_min(F.transform(edges(xs, ys), lambda e: segment_distance2(x, y, e["x1"], e["y1"], e["x2"], e["y2"])))


def cell(c: Column, side: float) -> Column:
    """The grid cell of a coordinate; negative ones count downwards."""
    return F.floor(c / F.lit(float(side)))


def scan_fill(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells (i, j) whose centres are in a ring given in grid units, row by row."""
    x1, y1 = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)
    whole = np.isfinite(x1) & np.isfinite(y1)
    x1, y1 = x1[whole], y1[whole]
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    ok = y1 != y2
    x1, y1, x2, y2 = x1[ok], y1[ok], x2[ok], y2[ok]
    out_i, out_j = [], []
    if len(x1):
        for j in range(int(np.floor(min(y1.min(), y2.min()))), int(np.ceil(max(y1.max(), y2.max()))) + 1):
            y = j + 0.5
            cut = (y1 > y) != (y2 > y)
            at = np.sort(x1[cut] + (y - y1[cut]) * (x2[cut] - x1[cut]) / (y2[cut] - y1[cut]))
            for a, b in zip(at[::2], at[1::2]):
                i = np.arange(np.ceil(a - 0.5), np.ceil(b - 0.5), dtype=np.int64)
                out_i.append(i)
                out_j.append(np.full(len(i), j, dtype=np.int64))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)
