"""Aggregations. All reduce on the map side; none collects a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions import stats


def feature_totals(df: DataFrame, *, name: str = "gene", ident: str | None = None, count: str | None = "count", key: str = "gene") -> DataFrame:
    """Total per feature, keyed 'name:id' where both exist, else by the one there is; without ``count`` the number of rows."""
    k = F.col(name) if ident is None else F.coalesce(F.concat(name, F.lit(":"), ident), name, ident)
    return df.groupBy(k.alias(key)).agg((F.sum(count) if count else F.count(F.lit(1))).alias("count"))


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: xmin, xmax, ymin, ymax over numbers; NaN is left out."""
    a, b = F.nanvl(x, F.lit(None).cast("double")), F.nanvl(y, F.lit(None).cast("double"))
    return df.agg(F.min(a).alias("xmin"), F.max(a).alias("xmax"), F.min(b).alias("ymin"), F.max(b).alias("ymax"))


def bin_width(df: DataFrame, column: str, bins: int = 10) -> float:
    """A width for so many bins over the column's range, rounded to two significant digits; one row goes to the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or high == low:
        return 1.0
    return stats.significant_value((float(high) - float(low)) / bins, 2)


def histogram(df: DataFrame, column: str, width: float | None = None, *, bins: int | None = None, fraction: bool = False, cumulative: bool = False, median: bool = False) -> DataFrame:
    """from, to, count of equal bins that aren't empty; a bin's number is value / width truncated towards 0.

    ``width`` or ``bins`` (10 if neither), not both. Null and NaN values are left out. The cumulative columns run over
    the bins, not the rows; bins fit one task as their number is bounded by range / width.
    """
    if width and bins:
        raise ValueError("give a width or a number of bins, not both")
    w = float(width or bin_width(df.filter(~F.isnan(F.col(column).cast("double"))), column, bins or 10))
    v = F.col(column).cast("double")
    own = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy((v / w).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    out = [(F.col("bin") * w).alias("from"), (F.col("bin") * w + w).alias("to")]
    if median:
        out.append((F.col("bin") * w + w / 2).alias("median"))
    out.append(F.col("count"))
    total = own.agg(F.sum("count").alias("t")).scalar()
    run = F.sum("count").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    if fraction:
        out.append((F.col("count") / total).alias("frac"))
    if cumulative:
        out.append(run.alias("cumul"))
        if fraction:
            out.append((run / total).alias("fcumul"))
    return own.select(*out)


def decile_histogram(df: DataFrame, d2: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by bin = floor(10 log10 d2), with min and max; distance 0 has its own bucket, and so has no distance (null)."""
    bucket = F.when(d2.isNull(), "none").when(d2 == 0, "zero").otherwise("log")
    number = F.when(d2 > 0, F.floor(F.log10(d2) * 10))
    own = df.groupBy(*keys, bucket.alias("bucket"), number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return own.withColumns({"min": F.pow(F.lit(10.0), F.col("bin") / 10), "max": F.pow(F.lit(10.0), (F.col("bin") + 1) / 10)})


def count_vectors(df: DataFrame, key: str | Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Sums of several count columns per key: per feature or per barcode."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def array_totals(df: DataFrame, key: str, counts: str) -> DataFrame:
    """Element-wise sums of an array of counts per key, as (key, pos, total)."""
    return df.select(key, F.posexplode(counts).alias("pos", "_c")).groupBy(key, "pos").agg(F.sum("_c").alias("total"))


def levels(df: DataFrame, first: str, second: str, measures: dict[str, Column]) -> DataFrame:
    """Aggregates over all, per ``first`` and per (first, second), with level 'all', 'first' or 'second'."""
    out = df.rollup(first, second).agg(F.grouping_id().alias("_g"), *(c.alias(n) for n, c in measures.items()))
    return out.select(F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "first").otherwise("second").alias("level"), first, second, *measures)


def tile_stats(df: DataFrame, keys: Sequence[str], *, x: str = "px", y: str = "py", mismatches: str = "mismatches") -> DataFrame:
    """Per tile: barcodes, matches (0 mismatches), mismatches, and the extent."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("barcodes"), F.count_if(F.col(mismatches) == 0).alias("matches"), F.count_if(F.col(mismatches) > 0).alias("mismatches"),
        F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"),
    )


def weighted_centroid(df: DataFrame, key: str, x: str, y: str, weight: str) -> DataFrame:
    """Per key the centroid by weight, total weight and rows."""
    w = F.col(weight)
    return df.groupBy(key).agg(F.sum(w * F.col(x)).alias("_x"), F.sum(w * F.col(y)).alias("_y"), F.sum(w).alias("total"), F.count(F.lit(1)).alias("n")).select(
        key, stats.over(F.col("_x"), F.col("total")).alias("cx"), stats.over(F.col("_y"), F.col("total")).alias("cy"), "total", "n"
    )


def cell_by_feature(df: DataFrame, cell: str, feature: str, count: str) -> DataFrame:
    """Sparse cell by feature counts, without zero totals."""
    return df.groupBy(cell, feature).agg(F.sum(count).alias("cnt")).filter("cnt != 0")


def pseudobulk(df: DataFrame, feature: str, count: Column, pairs: Sequence[tuple[Column, Column | None]], *, keys: Sequence[str] = (), n_factors: int = 0) -> DataFrame:
    """feature, factor, cnt: counts fanned out to factors, count * P to each K; without P the first K takes all.

    ``keys`` go before (a cell id, say). Null factors are left out. ``n_factors`` adds the factors 0 .. n - 1 with 0.
    """
    if any(p is None for _, p in pairs):
        pairs = [(pairs[0][0], F.lit(1.0))]
    fan = F.explode(F.array(*(F.struct(k.cast("string").alias("factor"), (count.cast("double") * p).alias("w")) for k, p in pairs)))
    out = df.select(*keys, F.col(feature).alias("feature"), fan.alias("f")).filter("f.factor IS NOT NULL")
    out = out.groupBy(*keys, "feature", "f.factor").agg(F.sum("f.w").alias("cnt"))
    if n_factors and not keys:
        names = df.sparkSession.range(n_factors).select(F.col("id").cast("string").alias("factor"))
        some = out.select(F.min("feature").alias("feature"))  # one feature carries the empty columns
        grid = some.withColumn("factor", F.explode(F.array(*(F.lit(str(i)) for i in range(n_factors))))).withColumn("cnt", F.lit(0.0))
        out = out.unionByName(grid.join(names, "factor", "left_semi").select(out.columns)).groupBy("feature", "factor").agg(F.sum("cnt").alias("cnt"))
    return out


def totals(long: DataFrame, *, feature: str = "feature", factor: str = "factor", cnt: str = "cnt") -> DataFrame:
    """The long matrix with its row, column and grand totals in one row each cell: rowsum, colsum, total."""
    rows = long.groupBy(feature).agg(F.sum(cnt).alias("rowsum"))
    cols = long.groupBy(factor).agg(F.sum(cnt).alias("colsum"))
    grand = cols.agg(F.sum("colsum").alias("t")).scalar()
    return long.join(rows, feature).join(cols, factor).withColumn("total", grand)


def contingency(df: DataFrame, feature: str, f1: str, f2: str, count: str, *, missing: str = "NA") -> tuple[DataFrame, DataFrame]:
    """Counts by (feature, f1, f2) and by (f1, f2), rows with a missing factor left out; each row counts once."""
    ok = df.filter(F.col(f1).isNotNull() & F.col(f2).isNotNull() & (F.col(f1) != missing) & (F.col(f2) != missing))
    three = ok.groupBy(feature, f1, f2).agg(F.sum(count).alias("count"))
    return three, three.groupBy(f1, f2).agg(F.sum("count").alias("count"))


def tag_counts(df: DataFrame, barcode: str = "barcode", tag: str = "tag", umi: str = "umi") -> DataFrame:
    """Per (barcode, tag): reads, distinct UMIs and presence."""
    return df.groupBy(barcode, tag).agg(F.count(F.lit(1)).alias("reads"), F.count_distinct(umi).alias("umis"), F.lit(1).alias("present"))


def duplicate_spread(df: DataFrame, key: Column, *, x: str = "px", y: str = "py", order: Sequence[str] = (), max_dup: int = 1) -> DataFrame:
    """Per key: n, the largest distance between two of its records, and the first record by an order.

    Only keys of 2 to ``max_dup`` records have their records compared; a larger group has distance null, and none of
    its records is gathered: the sizes come from a partial aggregate first.
    """
    columns = [c for c in df.columns]
    own = df.withColumn("key", key).filter(F.col("key").isNotNull())
    first = F.min_by(F.struct(*columns), F.struct(*(order or columns))).alias("first")
    size = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first)
    small = own.join(size.filter((F.col("n") > 1) & (F.col("n") <= max_dup)).select("key"), "key", "left_semi")
    points = small.groupBy("key").agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("p"))  # max_dup at most
    far = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: stats.distance(a["x"], a["y"], b["x"], b["y"])))))
    return size.join(points.select("key", far.alias("max_dist")), "key", "left").withColumn("max_dist", F.when(F.col("n") == 1, 0.0).otherwise(F.col("max_dist")))


def duplicates(df: DataFrame, key: Column, tile: Column) -> DataFrame:
    """Per non-null key: n records and the number of distinct tiles."""
    counts = df.groupBy(key.alias("key"), tile.alias("tile")).agg(F.count(F.lit(1)).alias("n")).filter("key IS NOT NULL")
    return counts.groupBy("key").agg(F.sum("n").alias("n"), F.count("tile").alias("n_tiles"))


def duplicate_multiplicity(df: DataFrame, key: Column, tile: Column) -> DataFrame:
    """How many keys occur n times."""
    return duplicates(df, key, tile).groupBy("n").agg(F.count(F.lit(1)).alias("n_keys"))


def duplicates_by_tile(df: DataFrame, key: Column, tile: Column) -> DataFrame:
    """Per tile: total records, distinct keys, keys that occur once anywhere, keys repeated within the tile and in other tiles."""
    per = df.groupBy(key.alias("key"), tile.alias("tile")).agg(F.count(F.lit(1)).alias("n")).filter("key IS NOT NULL")
    every = per.groupBy("key").agg(F.count(F.lit(1)).alias("n_tiles"))
    joined = per.join(every, "key")
    return joined.groupBy("tile").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("keys"), F.count_if((F.col("n") == 1) & (F.col("n_tiles") == 1)).alias("uniq"),
        F.count_if(F.col("n") > 1).alias("dup_within"), F.count_if(F.col("n_tiles") > 1).alias("dup_between"),
    )


def match_summary(reads: DataFrame, matched: DataFrame, *, key: str = "seq") -> DataFrame:
    """type, reads, fraction for Total, Miss, Match, Unique and Dup of reads against matched reads."""
    total = reads.agg(F.count(F.lit(1)).alias("n"))
    per = matched.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    m = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("match"), F.count(F.lit(1)).alias("unique"))
    row = m.withColumn("total", total.scalar())
    stack = F.explode(F.array(*(F.struct(F.lit(n).alias("type"), c.alias("reads")) for n, c in (
        ("Total", F.col("total")), ("Miss", F.col("total") - F.col("match")), ("Match", F.col("match")), ("Unique", F.col("unique")), ("Dup", F.col("match") - F.col("unique")),
    ))))
    return row.select(stack.alias("s"), "total").select("s.type", "s.reads", F.try_divide("s.reads", "total").alias("fraction"))


def model_matrix(long: DataFrame, clusters: DataFrame, *, unit: str = "cell_id", feature: str = "feature", cnt: str = "cnt", min_count: float = 0) -> DataFrame:
    """feature, cluster, cnt: counts summed by the units' cluster, or split by their probability if ``clusters`` has ``prob``."""
    joined = long.join(clusters, unit)
    w = F.col(cnt).cast("double") * F.col("prob") if "prob" in clusters.columns else F.col(cnt).cast("double")
    out = joined.groupBy(feature, "cluster").agg(F.sum(w).alias("cnt"))
    if min_count:
        kept = out.groupBy(feature).agg(F.sum("cnt").alias("_t")).filter(F.col("_t") >= min_count).select(feature)
        out = out.join(kept, feature, "left_semi")
    return out


def widen(long: DataFrame, names: Sequence[str], *, feature: str = "feature", factor: str = "factor", cnt: str = "cnt", pseudocount: float = 0.0) -> DataFrame:
    """A wide matrix with the given factor columns; zero and absent cells are pseudocount / number of factors."""
    wide = long.groupBy(feature).pivot(factor, list(names)).agg(F.sum(cnt))
    fill = F.lit(pseudocount / len(names) if names else 0.0)
    return wide.select(feature, *(F.when(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) == 0, fill).otherwise(F.col(f"`{n}`")).alias(n) for n in names))


def add_matrices(parts: Sequence[DataFrame], *, feature: str = "feature", factor: str = "factor", cnt: str = "cnt") -> DataFrame:
    """The sum of long matrices over the union of their names."""
    out = parts[0].select(feature, factor, cnt)
    for p in parts[1:]:
        out = out.unionByName(p.select(feature, factor, cnt))
    return out.groupBy(feature, factor).agg(F.sum(cnt).alias(cnt))


def segment_sizes(mask: DataFrame, segment: str = "seg") -> DataFrame:
    """Per segment other than 0: its pixels and extent."""
    return mask.filter(F.col(segment) != 0).groupBy(segment).agg(F.count(F.lit(1)).alias("n_pixels"), F.min("i").alias("imin"), F.max("i").alias("imax"), F.min("j").alias("jmin"), F.max("j").alias("jmax"))


def segment_counts(entries: DataFrame, mask: DataFrame, *, x: str = "px", y: str = "py", units_per_px: float = 1.0, feature: str = "ftr", cnt: str = "cnt") -> DataFrame:
    """Counts by (segment, feature) of entries whose pixel is in a segment: the mask join that segmentation asks for."""
    e = entries.withColumns({"i": F.floor(F.col(y) / units_per_px), "j": F.floor(F.col(x) / units_per_px)})
    return e.join(mask.filter("seg != 0"), ["i", "j"]).groupBy("seg", feature).agg(F.sum(cnt).alias(cnt))


def match_distance(joined: DataFrame, d2: str = "d2") -> DataFrame:
    """One row: rows, matched rows, mean distance of the matches."""
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count(d2).alias("n_matched"), F.avg(F.sqrt(d2)).alias("mean_distance"))


def quantile_disc(df: DataFrame, column: str, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """The discrete quantile per key."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{column}`)").alias("quantile"))


def segment_pixels(mask: DataFrame, segment: str = "seg") -> DataFrame:
    """Per segment other than 0: its pixels (i, j) in order. A list is as long as the segment is large."""
    return mask.filter(F.col(segment) != 0).groupBy(segment).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("pixels"))
