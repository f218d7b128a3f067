"""Unions of samples and matrices, intersections and differences of feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.operators import ordering


def union_samples(samples: Sequence[tuple[str, DataFrame]], *, name: str = "sample_id") -> DataFrame:
    """All rows of samples with the same columns, with the sample's name; other columns are an error."""
    columns = samples[0][1].columns
    out = None
    for label, df in samples:
        if sorted(df.columns) != sorted(columns):
            raise ValueError(f"columns of {label!r} differ")
        one = df.select(F.lit(label).alias(name), *columns)
        out = one if out is None else out.unionByName(one)
    return out


def merged_dictionary(samples: DataFrame, *, sample: str = "sample_id", feature: str = "feature", order: str = "sample_no") -> DataFrame:
    """feature, idx: features of all samples numbered from 0 by the first sample that has them, then in byte order."""
    first = samples.groupBy(feature).agg(F.min(order).alias("_first"))
    return ordering.dense_ids(first, ["_first", feature], name="idx").select(feature, (F.col("idx") - 1).alias("idx"))


def union_grids(parts: Sequence[DataFrame], offsets: Sequence[tuple[float, float]], *, ident: str = "strid", x: str = "px", y: str = "py") -> DataFrame:
    """Barcodes of several grids in one: ids get the prefix 'i_', coordinates move by the grid's offset and not below 0, lane and tile become 1."""
    out = None
    for i, (df, (dx, dy)) in enumerate(zip(parts, offsets, strict=True)):
        at = lambda c, d: F.greatest(F.col(c).cast("double") + d, F.lit(0.0)).alias(c)  # noqa: B023, E731
        rest = [c for c in df.columns if c not in (ident, x, y, "lane", "tile")]
        one = df.select(F.concat(F.lit(f"{i + 1}_"), ident).alias(ident), at(x, dx), at(y, dy), F.lit(1).alias("lane"), F.lit(1).alias("tile"), *rest)
        out = one if out is None else out.unionByName(one)
    return out


def union_distinct(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the first by an order, over all parts, with the multiplicity as ndups."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = [c for c in out.columns if c not in keys]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v"), F.count(F.lit(1)).alias("ndups"))
    return best.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest), "ndups")


def common(parts: Sequence[DataFrame], column: str) -> DataFrame:
    """Values that every part has."""
    out = parts[0].select(column)
    for p in parts[1:]:
        out = out.intersect(p.select(column))
    return out.distinct()


def without(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Distinct values that another table doesn't have."""
    return df.select(column).distinct().join(other.select(column).distinct(), column, "left_anti")


def union_by_layout(barcodes: DataFrame, placed: DataFrame, *, on: str = "tile", ident: str = "strid", x: str = "px", y: str = "py") -> DataFrame:
    """``union_grids`` by tables: barcodes with their grid ``on``, and per grid xmin, ymin, x_offset, y_offset.

    Ids get the grid as prefix, coordinates start at the grid's offset and are not below 0, lane and tile become 1.
    Barcodes of a grid without a place drop out.
    """
    own = barcodes.join(placed.select(on, F.col("xmin").alias("_x0"), F.col("ymin").alias("_y0"), "x_offset", "y_offset"), on)
    at = lambda c, low, off: F.greatest((F.col(c) - F.col(low) + F.col(off)).cast("double"), F.lit(0.0)).alias(c)
    rest = [c for c in barcodes.columns if c not in (ident, x, y, "lane", "tile", on)]
    return own.select(F.concat(F.col(on).cast("string"), F.lit("_"), ident).alias(ident), at(x, "_x0", "x_offset"), at(y, "_y0", "y_offset"), F.lit(1).alias("lane"), F.lit(1).alias("tile"), *rest)
