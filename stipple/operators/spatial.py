"""Nearest-neighbour joins and the assignment of points to regions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.functions import geom
from stipple.operators import proximity


def nearest(
    points: DataFrame, targets: DataFrame, max_distance: float, *, point_id: str, target_id: str, x: str = "x", y: str = "y", tx: str = "x", ty: str = "y", values: Sequence[str] = ()
) -> DataFrame:
    """Every point with its nearest target at most ``max_distance`` away: target_id, d2 and the target's values, else nulls.

    Both sides are put on a grid with cells of the distance; the targets go to the 3 x 3 cells around them and meet the
    points by equality, so a neighbour across any border is found. Ties go to the smaller target id. The candidates are
    reduced to one a point by a partial aggregate before the second shuffle.
    """
    side = float(max_distance)
    cell = lambda c: F.floor(F.col(c) / side)
    p = points.filter(proximity.finite(F.col(x)) & proximity.finite(F.col(y))).select(F.col(point_id), F.col(x).alias("_px"), F.col(y).alias("_py"), cell(x).alias("_i"), cell(y).alias("_j"))
    t = targets.filter(proximity.finite(F.col(tx)) & proximity.finite(F.col(ty))).select(F.col(target_id).alias("_t"), F.col(tx).alias("_tx"), F.col(ty).alias("_ty"), *(F.col(v).alias(f"_v_{v}") for v in values))
    around = lambda c: F.explode(F.array(*(F.floor(F.col(c) / side) + k for k in (-1, 0, 1))))
    t = t.withColumn("_i", around("_tx")).withColumn("_j", around("_ty"))
    dx, dy = F.col("_px") - F.col("_tx"), F.col("_py") - F.col("_ty")
    near = p.join(t, ["_i", "_j"]).withColumn("_d2", dx * dx + dy * dy).filter(F.col("_d2") <= side * side)
    best = near.groupBy(point_id).agg(F.min(F.struct("_d2", "_t", *(f"_v_{v}" for v in values))).alias("_b"))
    out = points.join(best, point_id, "left")
    return out.select(*points.columns, F.col("_b._t").alias(target_id), F.col("_b._d2").alias("d2"), *(F.col(f"_b._v_{v}").alias(v) for v in values))


def band_pairs(left: DataFrame, right: DataFrame, axis: str, width: float, cond, *, left_id: str, right_id: str) -> DataFrame:
    """Pairs whose sort axis differs by at most ``width`` and that meet a condition on columns with the prefixes l_ and r_."""
    l = left.withColumnsRenamed({c: f"l_{c}" for c in left.columns}).withColumn("_b", F.floor(F.col(f"l_{axis}") / width))
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    r = r.withColumn("_b", F.explode(F.array(*(F.floor(F.col(f"r_{axis}") / width) + k for k in (-1, 0, 1)))))
    out = l.join(r, "_b").filter((F.abs(F.col(f"l_{axis}") - F.col(f"r_{axis}")) <= width) & cond)
    return out.select(f"l_{left_id}", f"r_{right_id}")


def assign_regions(
    points: DataFrame, regions: DataFrame, *, point_id: str = "mol_id", x: str = "x", y: str = "y", region_id: str = "poly_id", xs: str = "xs", ys: str = "ys", expand: float = 0.0, name: str = "cell", unassigned: str | None = None
) -> DataFrame:
    """Every point with one region: the one it is in, of several the one with the nearest centroid (ties: smaller id).

    With ``expand``, a point in none gets the region with the nearest edge at most that far away. Containment comes from
    the slab join, the expansion from a grid of the distance over the regions' edges; both are equality joins.
    """
    inside = proximity.near_and_inside(points, regions, None, point_id=point_id, x=x, y=y, region_id=region_id, xs=xs, ys=ys).select(F.col("a").alias(point_id), F.col("b").alias("_r"))
    usable = regions.filter((F.size(xs) == F.size(ys)) & (F.size(xs) >= 3))
    centre = usable.select(F.col(region_id).cast("long").alias("_r"), geom.centroid(F.col(xs), F.col(ys)).alias("_c"))
    p = points.select(F.col(point_id).cast("long").alias(point_id), F.col(x).alias("_px"), F.col(y).alias("_py"))
    dx, dy = F.col("_px") - F.col("_c.x"), F.col("_py") - F.col("_c.y")
    placed = inside.join(centre, "_r").join(p, point_id)
    own = placed.groupBy(point_id).agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "_r"))["_r"].alias(name))
    if expand > 0:
        rest = p.join(own, point_id, "left_anti").filter(proximity.finite(F.col("_px")) & proximity.finite(F.col("_py")))
        e = usable.select(F.col(region_id).cast("long").alias("_r"), F.explode(geom.edges(F.col(xs), F.col(ys))).alias("e")).select("_r", "e.*")
        cells = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - expand) / expand), F.floor((F.greatest(a, b) + expand) / expand)))
        e = e.withColumn("_i", cells("x1", "x2")).withColumn("_j", cells("y1", "y2"))
        rest = rest.withColumns({"_i": F.floor(F.col("_px") / expand), "_j": F.floor(F.col("_py") / expand)})
        d2 = geom.segment_distance2(F.col("_px"), F.col("_py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        near = rest.join(e, ["_i", "_j"]).withColumn("_d2", d2).filter(F.col("_d2") <= expand * expand)
        own = own.unionByName(near.groupBy(point_id).agg(F.min(F.struct("_d2", "_r"))["_r"].alias(name)))
    out = points.join(own, point_id, "left")
    return out if unassigned is None else out.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(unassigned)))


def raster_regions(regions: DataFrame, grid: float, *, region_id: str = "poly_id", xs: str = "xs", ys: str = "ys", xmin: float = 0.0, ymin: float = 0.0) -> DataFrame:
    """gx, gy, region: the grid cells whose centre is in exactly one region."""
    kind = dict(regions.dtypes)[region_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, a, b in zip(pdf["id"], pdf["xs"], pdf["ys"]):
                i, j = geom.scan_fill((np.asarray(a, dtype=float) - xmin) / grid, (np.asarray(b, dtype=float) - ymin) / grid)
                if len(i):
                    yield pd.DataFrame({"gx": i, "gy": j, "region": ident})

    usable = regions.filter((F.size(xs) == F.size(ys)) & (F.size(xs) >= 3)).select(F.col(region_id).alias("id"), F.col(xs).alias("xs"), F.col(ys).alias("ys"))
    filled = usable.mapInPandas(run, f"gx long, gy long, region {kind}")
    return filled.groupBy("gx", "gy").agg(F.min("region").alias("region"), F.max("region").alias("_m")).filter("region = _m").drop("_m")


def assign_by_raster(points: DataFrame, regions: DataFrame, grid: float, *, x: str = "x", y: str = "y", name: str = "cell", unassigned: str = "UNASSIGNED", xmin: float = 0.0, ymin: float = 0.0, **columns: str) -> DataFrame:
    """Every point with the region of its grid cell; cells of several regions or none are unassigned."""
    cells = raster_regions(regions, grid, xmin=xmin, ymin=ymin, **columns)
    p = points.withColumns({"gx": F.floor((F.col(x) - xmin) / grid), "gy": F.floor((F.col(y) - ymin) / grid)})
    out = p.join(cells, ["gx", "gy"], "left")
    return out.select(*points.columns, F.coalesce(F.col("region").cast("string"), F.lit(unassigned)).alias(name))


def nearest_vectors(df: DataFrame, *, ident: str, vector: str, every: int = 50, k: int = 1) -> DataFrame:
    """The k nearest other vectors (L2) of every row whose id is divisible by ``every``, against all rows, exactly.

    The stated query rows go to every task in blocks of bounded size; each task keeps k a query, and a tree of partial
    results is merged by query. Rows with a null or empty vector take no part.
    """
    rows = df.filter(F.size(vector) > 0).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    queries = rows.filter(F.col("id") % every == 0).orderBy("id")
    out = None
    total = queries.count()
    block = 20_000  # query vectors that a task holds
    for at in range(0, max(total, 1), block):
        part = queries.offset(at).limit(block).collect()
        if not part:
            continue
        ids, q = np.array([r["id"] for r in part]), np.array([r["v"] for r in part], dtype=np.float64)

        def run(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            norms = (q * q).sum(axis=1)
            for pdf in batches:
                v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                d2 = np.maximum(norms[:, None] - 2 * q @ v.T + (v * v).sum(axis=1), 0)
                d2[ids[:, None] == pdf["id"].to_numpy()[None, :]] = np.inf
                n = min(k, d2.shape[1])
                top = np.argpartition(d2, n - 1, axis=1)[:, :n]
                row = np.repeat(np.arange(len(ids)), n)
                col = top.ravel()
                # the chosen are measured again without cancellation
                exact = ((q[row] - v[col]) ** 2).sum(axis=1)
                one = pd.DataFrame({"id": ids[row], "other": pdf["id"].to_numpy()[col], "d2": exact})[np.isfinite(d2[row, col])]
                best = one if best is None else pd.concat([best, one]).sort_values(["id", "d2", "other"]).groupby("id").head(k)
            if best is not None:
                yield best

        found = rows.mapInPandas(run, "id long, other long, d2 double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.sparkSession.createDataFrame([], "id long, other long, d2 double, rank int")
    merged = out.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "other"))), 1, k).alias("b"))
    return merged.select("id", F.posexplode("b").alias("rank", "n")).select("id", "n.other", "n.d2", (F.col("rank") + 1).alias("rank"))
