"""Filters. Cheap predicates come first, so that what can reach the scan does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions import geom, seq

#: Ids that mean none.
NULL_IDS = ("UNASSIGNED", "-1", "0", "NA")


def in_box(df: DataFrame, x: str, y: str, xmin: float = float("-inf"), xmax: float = float("inf"), ymin: float = float("-inf"), ymax: float = float("inf")) -> DataFrame:
    """Rows in an inclusive box; an infinite bound doesn't filter. Null and NaN coordinates pass only where their axis has no bound."""
    cond = F.lit(True)
    for c, low, high in ((x, xmin, xmax), (y, ymin, ymax)):
        if low != float("-inf") and high == float("inf"):
            cond = cond & ~F.isnan(c)  # NaN is above everything, so an upper limit excludes it
        if low != float("-inf"):
            cond = cond & (F.col(c) >= low)
        if high != float("inf"):
            cond = cond & (F.col(c) <= high)
    return df.filter(cond)


def in_polygons(df: DataFrame, x: str, y: str, rings: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """Rows in any of a few given rings, even-odd, after the rings' bounding boxes, which the scan can use.

    For many regions use ``proximity.near_and_inside`` or ``spatial.assign_regions``.
    """
    if not rings:
        return df.limit(0)
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    own = F.lit(False)
    for ring in rings:
        bx, by = [p[0] for p in ring], [p[1] for p in ring]
        box = geom.in_box(F.col(x), F.col(y), min(bx), max(bx), min(by), max(by))
        own = own | (box & geom.contains_constant(list(ring), F.col(x), F.col(y)))
    return df.filter(geom.in_box(F.col(x), F.col(y), min(xs), max(xs), min(ys), max(ys))).filter(own)


def in_list(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose value is in a list; the list may be of any size."""
    return df.join(values.select(F.col(value).alias(column)).distinct(), column, "left_semi").select(*df.columns)


def not_in_list(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose value isn't in a list; a null value is in none."""
    return df.join(values.select(F.col(value).alias(column)).distinct(), column, "left_anti").select(*df.columns)


def text_match(
    c: Column, *, include_regex: str | None = None, include_substr: str | None = None, exclude_regex: str | None = None, exclude_substr: str | None = None, full: bool = False
) -> Column:
    """Include by a regular expression or a substring, exclude likewise; exclusion wins. Expressions match anywhere unless ``full``."""
    if include_regex and include_substr or exclude_regex and exclude_substr:
        raise ValueError("give one way to include and one to exclude")
    rx = lambda p: rf"\A(?:{p})\z" if full else p
    cond = F.lit(True)
    if include_regex:
        cond = cond & c.rlike(rx(include_regex))
    if include_substr:
        cond = cond & c.contains(include_substr)
    if exclude_regex:
        cond = cond & ~c.rlike(rx(exclude_regex))
    if exclude_substr:
        cond = cond & ~c.contains(exclude_substr)
    return cond


def features(
    df: DataFrame, column: str, *, include: DataFrame | None = None, exclude: DataFrame | None = None, value: str = "value", **match: str | None
) -> DataFrame:
    """Rows by lists of features and ``text_match``."""
    out = df.filter(text_match(F.col(column), **match)) if match else df
    if include is not None:
        out = in_list(out, column, include, value)
    return not_in_list(out, column, exclude, value) if exclude is not None else out


def min_totals(df: DataFrame, key: str, measure: str, least: float) -> DataFrame:
    """Rows of keys whose total reaches a minimum. The totals are pre-aggregated; the join is by key."""
    kept = df.groupBy(key).agg(F.sum(measure).alias("_t")).filter(F.col("_t") >= least).select(key)
    return df.join(kept, key, "left_semi").select(*df.columns)


def min_totals_twice(df: DataFrame, first: str, second: str, measure: str, least_first: float, least_second: float) -> DataFrame:
    """Keys of ``first`` by their totals, then keys of ``second`` by their totals over the surviving rows."""
    return min_totals(min_totals(df, first, measure, least_first), second, measure, least_second)


def positive(df: DataFrame, counts: Sequence[str], *, threshold_on: str | None = None, threshold: float = 0) -> DataFrame:
    """Rows whose selected counts sum to more than 0 and, with a threshold, whose one count reaches it."""
    total = sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0))
    out = df.filter(total > 0)
    return out.filter(F.col(threshold_on) >= threshold) if threshold_on else out


def known_ids(df: DataFrame, column: str, ignore: Sequence[str] = NULL_IDS) -> DataFrame:
    """Rows with an id that means something."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).cast("string").isin(*ignore))


def fastq_pattern(df: DataFrame, *, pat1: Sequence[str] = (), pat2: Sequence[str] = (), max_mismatch: int = 0, remove: bool = False) -> DataFrame:
    """Read pairs of which each read fits one of its patterns; ``remove`` keeps the others. No pattern fits any read."""
    cond = F.lit(True)
    for c, patterns in (("seq1", pat1), ("seq2", pat2)):
        if patterns and max_mismatch == 0:
            cond = cond & F.coalesce(F.col(c).rlike(r"\A(?:" + "|".join(seq.iupac_regex(p) for p in patterns) + ")"), F.lit(False))
        elif patterns:
            cond = cond & F.coalesce(seq.best_mismatches(F.col(c), tuple(patterns)) <= max_mismatch, F.lit(False))
    return df.filter(~cond if remove else cond)


def prefix_whitelist(df: DataFrame, column: str, barcodes: DataFrame, barcode: str, *, skip: int = 0, length: int = 27) -> DataFrame:
    """Reads whose first bases are the first bases of a barcode."""
    keys = barcodes.select(F.substring(barcode, 1, length).alias("_k")).distinct()
    return df.withColumn("_k", F.substring(column, skip + 1, length)).join(keys, "_k", "left_semi").select(*df.columns)


def frequency(df: DataFrame, keys: Sequence[str], least: int = 1, most: int | None = None, *, count: str | None = None) -> DataFrame:
    """Rows of groups with from ``least`` to ``most`` rows; ``count`` names a column for the size.

    The sizes are pre-aggregated and joined back, so a hot group is one row on that side and its rows can be split.
    """
    name = count or "_n"
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= least)
    if most is not None:
        sizes = sizes.filter(F.col(name) <= most)
    sizes = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), name)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = df.join(sizes, on).drop(*(f"_k{i}" for i in range(len(keys))))
    return out if count else out.drop(name)


def not_missing(df: DataFrame, columns: Sequence[str], missing: str = "NA") -> DataFrame:
    """Rows with a value in every column."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & (F.col(c) != missing)
    return df.filter(cond)


def in_every_sample(df: DataFrame, feature: str, sample: str, measure: str, least: float) -> DataFrame:
    """Features whose total reaches a minimum in each of all samples."""
    n = df.agg(F.count_distinct(sample).alias("n")).scalar()
    totals = df.groupBy(feature, sample).agg(F.sum(measure).alias("t")).filter(F.col("t") >= least)
    return totals.groupBy(feature).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select(feature)
