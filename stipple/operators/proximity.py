"""Points near other points, and points in regions, in one tiled pass.

Points and regions meet in square tiles. A region's boundary is cut into horizontal slabs at its vertices
(a trapezoidal decomposition): within a slab its edges have no ends, so they are ordered from left to right, and a
point is located by a binary search among them. Every slab is sent to the tiles it touches, every point to its own
tile and, if it lies within the distance of a border, to the smaller ones of the neighbours as a halo. Both joins then
run on the sorted rows of a tile as array operations.

Scale: one shuffle of the points (about 3 % halo rows at the default tile) and of the slabs. The work in a tile is
bounded by its own output: n points in a tile of side ``tile`` give about ``n * n * 3 * distance**2 / tile**2 / 2``
near pairs. Regions wider than ``MAX_SPAN`` tiles go to a coarser level of tiles. The points of all tiles are counted
first, and a tile of more than ``TILE_POINTS``, at any level, is cut into horizontal strips: points go to their strip
(and, as a halo, to the one below), slabs to the strips they touch. So no task holds a dense spot or the points of a wide
region whole, unless they share one height. The table of cut tiles has at most points / ``TILE_POINTS`` rows; it is
broadcast up to ``MAX_CUT`` of them. To the driver go it and the number of levels, logarithmic in the largest region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.session import spread

#: Tiles that a region may span in one direction before it moves to the next level; the next level's tiles are as much larger.
MAX_SPAN = 64
#: Points of a tile, at any level, from which it is cut into strips; cut tiles that are broadcast.
TILE_POINTS, MAX_CUT = 200_000, 1_000_000
#: Candidate pairs that are expanded at once.
BLOCK = 2_000_000

_ROWS = "lev int, tx long, ty long, kind int, id long, x double, y double, edges binary, ordered boolean"


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _expand(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, first[row] + 0, 1, ... count[row] - 1) for all rows, in blocks."""
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + BLOCK, "right")))
        n = count[at:to]
        row = np.repeat(np.arange(at, to), n)
        yield row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def slab_table(rings: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The slabs of rings, closed or open, in blocks: ring, from y, to y, first edge, number of edges, whether ordered; and the edges.

    Edges are rows (x, y, dx/dy), from left to right within a slab. Vertices that aren't finite are passed over.
    """
    kept = []
    for xs, ys in rings:
        whole = np.isfinite(xs) & np.isfinite(ys)
        kept.append((xs[whole], ys[whole]))
    n = np.array([len(x) for x, _ in kept], dtype=np.int64)
    if not n.sum():
        return
    x1, y1 = np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])
    ring = np.repeat(np.arange(len(n)), n)
    after = np.arange(1, len(x1) + 1)
    after[(np.cumsum(n) - 1)[n > 0]] = (np.cumsum(n) - n)[n > 0]  # the last vertex meets the first
    x2, y2 = x1[after], y1[after]
    ok = y1 != y2
    ring, x1, y1, x2, y2 = ring[ok], x1[ok], y1[ok], x2[ok], y2[ok]
    if not len(ring):
        return
    low, high, slope = np.minimum(y1, y2), np.maximum(y1, y2), (x2 - x1) / (y2 - y1)
    own, count = np.unique(ring, return_counts=True)
    first = np.searchsorted(ring, own)
    at = np.concatenate([y1, y2])
    by = np.concatenate([ring, ring])
    order = np.lexsort((at, by))
    at, by = at[order], by[order]
    new = np.r_[True, (at[1:] != at[:-1]) | (by[1:] != by[:-1])]
    at, by = at[new], by[new]
    s = np.flatnonzero(by[1:] == by[:-1])
    of, y_from, y_to = by[s], at[s], at[s + 1]
    k = np.searchsorted(own, of)
    for slab, e in _expand(first[k], count[k]):
        inside = (low[e] <= y_from[slab]) & (high[e] >= y_to[slab])
        slab, e = slab[inside], e[inside]
        if not len(slab):
            continue
        left = x1[e] + ((y_from[slab] + y_to[slab]) / 2 - y1[e]) * slope[e]
        order = np.lexsort((left, slab))
        slab, e = slab[order], e[order]
        ids, start, size = np.unique(slab, return_index=True, return_counts=True)
        # rings that cross themselves within a slab have no order; shared vertices may differ by rounding
        bad = np.zeros(len(slab), dtype=bool)
        for y in (y_from, y_to):
            x = x1[e] + (y[slab] - y1[e]) * slope[e]
            bad[1:] |= (slab[1:] == slab[:-1]) & (np.diff(x) < -1e-9 * (1 + np.abs(x[1:])))
        held = ~np.logical_or.reduceat(bad, start)
        yield of[ids], y_from[ids], y_to[ids], start, size, held, np.column_stack([x1[e], y1[e], slope[e]])


def slabs(xs: np.ndarray, ys: np.ndarray) -> Iterator[tuple[float, float, np.ndarray, bool]]:
    """The slabs of one ring: from y, to y, edges, and if their order holds throughout."""
    for _, y_from, y_to, start, size, held, edges in slab_table([(xs, ys)]):
        for i in range(len(start)):
            yield y_from[i], y_to[i], edges[start[i] : start[i] + size[i]], bool(held[i])


def _slab_rows(tile: float):
    names = ("lev", "tx", "ty", "kind", "id", "x", "y", "edges", "ordered")
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, lev = batch.column("id").to_numpy(), batch.column("lev").to_numpy()
            lists = [[np.asarray(v, dtype=float) for v in batch.column(c).to_pylist()] for c in ("xs", "ys")]
            for ring, y_from, y_to, start, size, held, edges in slab_table(list(zip(*lists))):
                side = tile * float(MAX_SPAN) ** lev[ring].astype(float)
                of = np.repeat(np.arange(len(ring)), size)
                ends = edges[:, 0] + (np.stack([y_from[of], y_to[of]]) - edges[:, 1]) * edges[:, 2]
                cell = lambda v: np.floor(v / side).astype(np.int64)  # noqa: B023, E731
                i0, i1 = cell(np.minimum.reduceat(ends.min(axis=0), start)), cell(np.maximum.reduceat(ends.max(axis=0), start))
                j0, j1 = cell(y_from), cell(y_to)
                wide, tall = i1 - i0 + 1, j1 - j0 + 1
                packed = pa.Array.from_buffers(pa.binary(), len(ring), [None, pa.py_buffer(np.r_[start, start[-1] + size[-1]].astype(np.int32) * 24), pa.py_buffer(np.ascontiguousarray(edges))])
                for s, k in _expand(np.zeros(len(ring), dtype=np.int64), wide * tall):
                    j, i = np.divmod(k, wide[s])
                    r = ring[s]
                    columns = (lev[r], i0[s] + i, j0[s] + j, np.zeros(len(s), dtype=np.int64), ident[r], y_from[s], y_to[s], None, held[s])
                    yield pa.RecordBatch.from_arrays([packed.take(pa.array(s)) if c is None else pa.array(c).cast(t) for c, t in zip(columns, types)], names=names)

    return run


def _locate(side: float, distance: float, near: bool):
    """Joins the rows of whole tiles; ``pdf`` is sorted by tile."""

    def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = pdf[KEYS].to_numpy()
        tile = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
        lev, kind, ident, x, y = (pdf[c].to_numpy() for c in ("lev", "kind", "id", "x", "y"))
        size = side * float(MAX_SPAN) ** lev.astype(float)
        base = key[:, 2] * size
        span = float(size.max()) + 4 * distance + 1

        def place(rows: np.ndarray, values: np.ndarray, low: float, high: np.ndarray) -> np.ndarray:
            return tile[rows] * span + np.clip(values - base[rows], low, high) + distance

        points = np.flatnonzero(kind > 0)
        at = place(points, y[points], -distance, size[points] + distance)
        order = np.argsort(at, kind="stable")
        points, at = points[order], at[order]
        if near:
            low = lev[points] == 0
            p, pa = points[low], at[low]
            reach = np.searchsorted(pa, pa + distance * (1 + 1e-9) + 1e-9, "right")
            first = np.arange(len(p)) + 1
            for i, j in _expand(first, np.maximum(reach - first, 0)):
                i, j = p[i], p[j]
                dx, dy = x[i] - x[j], y[i] - y[j]
                keep = (dx * dx + dy * dy <= distance * distance) & ((kind[i] == 1) | (kind[j] == 1)) & (tile[i] == tile[j])
                i, j = ident[i[keep]], ident[j[keep]]
                if len(i):
                    yield pd.DataFrame({"kind": "near", "a": np.minimum(i, j), "b": np.maximum(i, j)})
        own = np.flatnonzero(kind == 0)
        if not len(own) or not len(points):
            return
        home = kind[points] == 1
        points, at = points[home], at[home]
        edges = [np.frombuffer(e, dtype=float).reshape(-1, 3) for e in pdf["edges"].to_numpy()[own]]
        n = np.array([len(e) for e in edges])
        start, edges = np.cumsum(n) - n, np.concatenate(edges)
        ordered = pdf["ordered"].to_numpy()[own].astype(bool)
        first = np.searchsorted(at, place(own, x[own], 0.0, size[own]), "left")
        last = np.searchsorted(at, place(own, y[own], 0.0, size[own]), "left")
        for s, q in _expand(first, np.maximum(last - first, 0)):
            q = points[q]
            # the tile's own clipping aside, the slab's exact limits decide
            keep = (y[q] >= x[own[s]]) & (y[q] < y[own[s]]) & (tile[q] == tile[own[s]])
            s, q = s[keep], q[keep]

            def left_of(e: np.ndarray, k: np.ndarray) -> np.ndarray:
                return edges[e, 0] + (y[q[k]] - edges[e, 1]) * edges[e, 2] <= x[q[k]]

            right = np.zeros(len(s), dtype=np.int64)
            k = np.flatnonzero(ordered[s])
            lo, hi = np.zeros(len(k), dtype=np.int64), n[s[k]].astype(np.int64)
            while True:
                active = np.flatnonzero(lo < hi)
                if not len(active):
                    break
                mid = (lo[active] + hi[active]) >> 1
                go = left_of(start[s[k[active]]] + mid, k[active])
                lo[active[go]] = mid[go] + 1
                hi[active[~go]] = mid[~go]
            right[k] = n[s[k]] - lo
            k = np.flatnonzero(~ordered[s])
            for e in range(int(n[s[k]].max()) if len(k) else 0):
                k = k[n[s[k]] > e]
                right[k] += ~left_of(start[s[k]] + e, k)
            inside = (right & 1).astype(bool)
            if inside.any():
                yield pd.DataFrame({"kind": "in", "a": ident[q[inside]], "b": ident[own[s[inside]]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list[pd.DataFrame] = []  # rows of whole groups
        held: list[pd.DataFrame] = []  # rows of the last group, which may go on
        rows, last = 0, None
        for pdf in batches:
            key = pdf[KEYS].to_numpy()
            if not len(key):
                continue
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            to = int(other[-1]) + 1 if len(other) else 0
            if to or (last is not None and (last != key[-1]).any()):
                ready += [*held, pdf.iloc[:to]]
                rows += sum(map(len, held)) + to
                held = []
                if rows >= 200_000:
                    yield from pairs(pd.concat(ready, ignore_index=True))
                    ready, rows = [], 0
            held.append(pdf.iloc[to:])
            last = key[-1]
        ready += held
        if sum(map(len, ready)):
            yield from pairs(pd.concat(ready, ignore_index=True))

    return run


KEYS = ["lev", "tx", "ty", "strip"]


def _strips(rows: DataFrame, counts: DataFrame, tile: float, levels: list[int], r: float) -> DataFrame:
    """Rows with the strip of their tile; those of cut tiles go to each strip they touch, home or as a halo.

    ``counts`` has the points per tile of level 0; those of the coarser levels are sums of them.
    """
    every = None
    for lev in levels:
        up = lambda c: F.floor(F.col(c) / MAX_SPAN**lev) if lev else F.col(c)  # noqa: B023, E731
        one = counts.groupBy(up("tx").alias("tx"), up("ty").alias("ty")).agg(F.sum("n").alias("n")).filter(F.col("n") > TILE_POINTS).withColumn("lev", F.lit(lev))
        every = one if every is None else every.unionByName(one)
    cut = every.select("lev", "tx", "ty", F.ceil(F.col("n") / TILE_POINTS).alias("n_strips")).collect()  # points / TILE_POINTS at most
    if not cut:
        return rows.withColumn("strip", F.lit(0))
    # a strip is not lower than twice the distance
    most = lambda lev: max(1, int(tile * MAX_SPAN**lev / (2 * r))) if r and not lev else 1 << 20
    table = rows.sparkSession.createDataFrame([(t["lev"], t["tx"], t["ty"], min(int(t["n_strips"]), most(t["lev"]))) for t in cut], "lev int, tx long, ty long, n_strips int")
    rows = rows.join(F.broadcast(table) if len(cut) <= MAX_CUT else table, ["lev", "tx", "ty"], "left").withColumn("n_strips", F.coalesce("n_strips", F.lit(1)))
    side = F.lit(tile) * F.pow(F.lit(float(MAX_SPAN)), F.col("lev"))
    height = side / F.col("n_strips")
    strip = lambda y: F.least(F.greatest(F.floor((y - F.col("ty") * side) / height), F.lit(0)), F.col("n_strips") - 1).cast("int")
    # slabs are rows (x: from y, y: to y); of points only level 0 has halos
    reach = F.when(F.col("lev") == 0, F.lit(r * (1 + 1e-9))).otherwise(0.0)
    low = strip(F.when(F.col("kind") == 0, F.col("x")).otherwise(F.col("y") - reach))
    high = strip(F.when(F.col("kind") == 2, F.col("y") + reach).otherwise(F.col("y")))
    rows = rows.withColumn("strip", F.explode(F.when(F.col("n_strips") == 1, F.array(F.lit(0))).otherwise(F.sequence(low, high))))
    home = (F.col("kind") == 1) & (F.col("n_strips") > 1) & (F.col("strip") != strip(F.col("y")))
    return rows.withColumn("kind", F.when(home, 2).otherwise(F.col("kind"))).drop("n_strips")


def near_and_inside(
    points: DataFrame,
    regions: DataFrame | None,
    distance: float | None,
    *,
    point_id: str = "mol_id",
    x: str = "x",
    y: str = "y",
    region_id: str = "poly_id",
    xs: str = "xs",
    ys: str = "ys",
    tile: float = 16.0,
) -> DataFrame:
    """``kind = 'near'``: ids a < b of two points at most ``distance`` apart; ``kind = 'in'``: point a in region b, even-odd.

    Points with a null, NaN or infinite coordinate or a null id take no part. A region takes part if both lists are
    non-null, equally long and have at least 3 vertices; a null, NaN or infinite vertex is passed over. Points with equal
    coordinates are near each other. Empty inputs give no rows; other columns are ignored. ``distance=None`` leaves the
    near pairs out, ``regions=None`` the regions. ``tile`` is in the unit of the coordinates and must be at least twice the
    distance; about a hundred points a tile is a good size.
    """
    r = float(distance or 0.0)
    if tile < 2 * r:
        raise ValueError("tile must be at least twice the distance")
    near = distance is not None
    p = points.select(F.col(point_id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.filter(F.col("id").isNotNull() & finite(F.col("x")) & finite(F.col("y")))
    p = p.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})

    def at(dx: int, dy: int, kind: int, lev: int = 0) -> Column:
        side = tile * MAX_SPAN**lev
        i = F.col("tx") + dx if not lev else F.floor(F.col("x") / side)
        j = F.col("ty") + dy if not lev else F.floor(F.col("y") / side)
        return F.struct(F.lit(lev).alias("lev"), i.alias("tx"), j.alias("ty"), F.lit(kind).alias("kind"))

    copies = [at(0, 0, 1)]
    rings, levels = None, []
    if regions is not None:
        rings = regions.select(F.col(region_id).cast("long").alias("id"), F.col(xs).cast("array<double>").alias("xs"), F.col(ys).cast("array<double>").alias("ys"))
        rings = rings.filter(F.col("id").isNotNull() & (F.size("xs") == F.size("ys")) & (F.size("xs") >= 3))
        # a null vertex becomes NaN; extents are over the finite ones
        rings = rings.select("id", *(F.transform(c, lambda v: F.coalesce(v, F.lit(float("nan")))).alias(c) for c in ("xs", "ys")))

        def extent(c: str) -> Column:
            good = F.filter(c, lambda v: finite(v))
            return F.coalesce(F.array_max(good) - F.array_min(good), F.lit(0.0))

        wide = F.greatest(extent("xs"), extent("ys")) / (tile * MAX_SPAN)
        rings = rings.withColumn("lev", F.when(wide <= 1, 0).otherwise(F.ceil(F.log(wide) / float(np.log(MAX_SPAN)))).cast("int"))
        levels = sorted(row["lev"] for row in rings.select("lev").distinct().collect())
    copies += [at(0, 0, 1, lev) for lev in levels if lev]
    if near:
        left = F.col("x") - F.col("tx") * tile <= r * (1 + 1e-9)
        low = F.col("y") - F.col("ty") * tile <= r * (1 + 1e-9)
        high = (F.col("ty") + 1) * tile - F.col("y") <= r * (1 + 1e-9)
        none = F.lit(None).cast("struct<lev:int,tx:bigint,ty:bigint,kind:int>")
        for cond, dx, dy in ((left, -1, 0), (low, 0, -1), (left & low, -1, -1), (left & high, -1, 1)):
            copies.append(F.when(cond, at(dx, dy, 2)).otherwise(none))
    rows = p.select("id", "x", "y", F.explode(F.array_compact(F.array(*copies))).alias("t")).select(
        "t.lev", "t.tx", "t.ty", "t.kind", "id", "x", "y", F.lit(None).cast("binary").alias("edges"), F.lit(None).cast("boolean").alias("ordered")
    )
    if rings is not None:
        rows = rows.unionByName(spread(rings).mapInArrow(_slab_rows(tile), _ROWS))
    counts = p.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    rows = _strips(rows, counts, tile, sorted({0, *levels}), r if near else 0.0)
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(_locate(tile, r, near), "kind string, a long, b long")
