"""Top N items within every group, by descending score bands.

Scores are cut into bands at quantiles, thin ones at the top: their widths follow from N, the number of groups and the
number of rows. The bands of every group are counted, and from the top down it shows in which band a group is filled.
The bands below are left out by an anti-join, and only what is left is ranked, band by band, with ties settled by the
item: bands above the boundary hold fewer than N rows a group, so the exact ranking is that of the boundary bands.

Scale: rows are shuffled to count repeated items once, by (group, item), which no large group skews, and are written
once. Band counts are pre-aggregated by task: at most groups x bands rows. The anti-join is by (group, band), an ordinary
join that adaptive execution may broadcast by measured size or split where skewed. The ranking is by (group, band), and
drops all but N rows a group, band and task before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.session import materialize


def band_shares(n: int, groups: int, rows: int) -> list[float]:
    """Shares of the rows above the lower limits of the bands: doubling, from an eighth of the N rows a group that are wanted."""
    share, out = n * groups / max(rows, 1) / 8, []
    while 0 < share < 1:
        out.append(share)
        share *= 2
    return out


def top_n(df: DataFrame, group: Column, item: Column, score: Column, n: int, *, shares: list[float] | None = None) -> DataFrame:
    """grp, item, score, rank: the n items with the highest score of each group; ties go to the smaller item.

    An item counts once, with its highest score. Rows with a null group, item or score or a NaN score are left out.
    Groups with fewer items give all they have; an empty table gives no rows. ``shares`` replaces ``band_shares``; they
    decide how much work is done, not the result.
    """
    rows = df.select(group.alias("grp"), item.alias("item"), score.cast("double").alias("score"))
    rows = rows.filter(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    rows = materialize(rows.groupBy("grp", "item").agg(F.max("score").alias("score")))
    if shares is None:
        size = rows.agg(F.approx_count_distinct("grp").alias("g"), F.count(F.lit(1)).alias("n")).first()
        shares = band_shares(n, size["g"], size["n"])
    limits = []
    if shares:
        accuracy = int(min(1_000_000, max(1000, 8 / min(shares))))
        limits = rows.agg(F.percentile_approx("score", [1 - s for s in shares], accuracy).alias("q")).first()["q"] or []  # a number a band
    # equal limits leave a band empty, no more
    band = F.lit(len(limits))
    for i in reversed(range(len(limits))):
        band = F.when(F.col("score") >= F.lit(limits[i]), F.lit(i)).otherwise(band)
    rows = rows.withColumn("band", band)
    counts = rows.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("items"))
    above = Window.partitionBy("grp").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("items").over(above), F.lit(0)))
    # the bands of groups that are filled above them, and how many rows stand above the others
    kept = rows.join(counts.filter(F.col("before") >= n).select("grp", "band"), ["grp", "band"], "left_anti")
    place = F.row_number().over(Window.partitionBy("grp", "band").orderBy(F.desc("score"), F.asc("item")))
    kept = kept.withColumn("place", place).filter(F.col("place") <= n)
    ranked = kept.join(counts.filter(F.col("before") < n).select("grp", "band", "before"), ["grp", "band"])
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("place")).cast("int")).filter(F.col("rank") <= n)
    return ranked.select("grp", "item", "score", "rank")
