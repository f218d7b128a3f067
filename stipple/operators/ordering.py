"""Ordinals, running sums, sequential binning, sorting and ranking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions import text as ft
from stipple.session import materialize


def dense_ids(df: DataFrame, order: Sequence[str], *, name: str = "new_id", parts: int | None = None) -> DataFrame:
    """1, 2, 3... in the order of a key that is unique. Range partitions are numbered by themselves; only their sizes meet.

    Null keys come first. The order column decides, never the rows' place in a file. The ranges are written once, so
    that the sizes and the numbers are of the same ranges even if a lost task is run again.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*order)
    own = ranged.withColumn("_rn", F.row_number().over(w))
    sizes = own.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return own.join(before, "_p").withColumn(name, F.col("_rn") + F.col("_before")).drop("_p", "_rn", "_before", "_n")


def first_seen_ids(df: DataFrame, key: str, order: str, *, name: str = "idx") -> DataFrame:
    """key, idx: distinct keys numbered from 0 in the order of their first row."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return dense_ids(first, ["_first", key], name=name).select(key, (F.col(name) - 1).alias(name))


def running_sum(df: DataFrame, value: str, order: Sequence[str], *, keys: Sequence[str] = (), name: str = "cumul") -> DataFrame:
    """The sum up to and with each row, per key."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def ordinal_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, name: str = "ordinal") -> DataFrame:
    """1, 2, 3... within a key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def passing_or_best(df: DataFrame, group: str, passes: Column, eligible: Column, score: Sequence[Column]) -> DataFrame:
    """Rows that pass; in a group without any, its one best eligible row."""
    n = F.sum(F.when(passes, 1).otherwise(0)).over(Window.partitionBy(group))
    rn = F.row_number().over(Window.partitionBy(group).orderBy(F.when(eligible, 0).otherwise(1), *score))
    out = df.withColumns({"_n": n, "_rn": rn})
    return out.filter(passes | ((F.col("_n") == 0) & (F.col("_rn") == 1) & eligible)).drop("_n", "_rn")


def greedy_bins(totals: Iterable[tuple[str, int]], bins: int) -> list[tuple[str, int, int]]:
    """(name, count, bin): names by falling count go to bins 1, 2..., each filled to an even share of what remains.

    A bin takes names until it holds at least (remaining total // remaining bins), at least 1; the last takes the rest.
    Names with no positive count are left out. Ties by name.
    """
    rows = sorted(((n, c) for n, c in totals if c and c > 0), key=lambda r: (-r[1], r[0]))
    left, at, out, k = sum(c for _, c in rows), 0, [], 1
    while at < len(rows):
        share = max(1, left // max(1, bins - k + 1))
        held = 0
        while at < len(rows) and (held < share or k >= bins):
            name, c = rows[at]
            out.append((name, c, k))
            held += c
            at += 1
        left -= held
        k += 1
    return out


def feature_bins(df: DataFrame, feature: str, count: str, bins: int, *, most: int = 5_000_000) -> DataFrame:
    """feature, count, bin by ``greedy_bins``. The state is sequential over distinct features, which go to the driver; more than ``most`` is an error."""
    per = df.filter(F.col(feature).isNotNull()).groupBy(feature).agg(F.sum(count).cast("bigint").alias("n")).filter("n > 0")
    rows = per.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct features")
    out = greedy_bins(((r[feature], r["n"]) for r in rows), bins)
    return df.sparkSession.createDataFrame(out, f"`{feature}` {dict(df.dtypes)[feature]}, count bigint, bin int")


def by_total(df: DataFrame, name: str, count: str) -> DataFrame:
    """Names by falling count, ties by name."""
    return df.orderBy(F.desc(count), F.asc(name))


def numeric_aware_rank(df: DataFrame, column: str, *, name: str = "rank") -> DataFrame:
    """Distinct values with their place from 1: all-digit ones by value before the others by bytes, numbered by ranges."""
    own = df.select(column).distinct().filter(F.col(column).isNotNull())
    own = own.withColumn("_text", F.when(ft.is_digits(F.col(column)), 0).otherwise(1))
    own = own.withColumn("_number", F.when(F.col("_text") == 0, F.col(column).try_cast("decimal(38,0)")))
    return dense_ids(own, ["_text", "_number", column], name=name).select(column, F.col(name).cast("int").alias(name))


def argmax_columns(df: DataFrame, columns: Sequence[str], *, top_k: str = "topK", top_p: str = "topP") -> DataFrame:
    """Adds the name of the largest of several columns, the first of equals, and its value; null if all are null or NaN."""
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    best = F.greatest(*(clean(c) for c in columns)) if len(columns) > 1 else clean(columns[0])
    name = F.coalesce(*(F.when(clean(c) == F.col(top_p), F.lit(c)) for c in columns))
    return df.withColumn(top_p, best).withColumn(top_k, name)


def first_k(df: DataFrame, arrays: Sequence[str], k: int) -> DataFrame:
    """The first k entries of array columns."""
    return df.withColumns({c: F.slice(c, 1, k) for c in arrays})


def sorted_within(df: DataFrame, order: Sequence[str], *, parts: int | None = None) -> DataFrame:
    """A global order by ranges: partition i holds keys before partition i + 1, each sorted."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def is_sorted(df: DataFrame, order: str, ordinal: str) -> DataFrame:
    """One row: whether the column rises with the ordinal, judged between neighbours within hashed ranges of the ordinal."""
    block = 100_000
    lead = F.lag(order).over(Window.partitionBy(F.floor(F.col(ordinal) / block)).orderBy(ordinal))
    inner = df.withColumn("_prev", lead).agg(F.coalesce(F.max(F.col("_prev") > F.col(order)), F.lit(False)).alias("bad"))
    edge = df.groupBy(F.floor(F.col(ordinal) / block).alias("b")).agg(F.min(order).alias("low"), F.max(order).alias("high"))
    across = edge.withColumn("_prev", F.max("high").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    return across.agg(F.coalesce(F.max(F.col("_prev") > F.col("low")), F.lit(False)).alias("bad")).select((~(F.col("bad") | inner.scalar())).alias("sorted"))
