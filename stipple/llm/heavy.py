"""Most frequent items: Space-Saving summaries merged in a tree, then an exact count of the survivors.

A summary keeps ``k`` counters and one bound: each counter is a lower estimate, counter + bound an upper one, and a
value without a counter occurs at most ``bound`` times. (This is Space-Saving with the common minimum kept apart, which
keeps ``bound <= rows / (k + 1)`` through any tree of merges.) Summaries of tasks are merged with a fixed fan-in. Values
whose upper estimate reaches the share survive, so no frequent value is lost; the second pass counts them exactly.

Scale: memory is ``BUFFER * k`` counters a task, whatever the number of distinct values. The shuffles carry k rows a
task. The survivors are at most k rows a field by construction, so they are broadcast to the second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters are pruned to k when there are more than BUFFER * k.
BUFFER = 8
#: Summaries that one merge takes.
FAN_IN = 32

_SUMMARY = "field string, grp long, val string, n long, bound long"


class Summary:
    def __init__(self, k: int) -> None:
        self.k, self.counts, self.rows, self.bound = k, pd.Series(dtype=np.int64), 0, 0

    def add(self, counts: pd.Series, rows: int, bound: int = 0) -> None:
        """Adds counters that count within ``bound``."""
        self.counts = counts.astype(np.int64) if self.counts.empty else self.counts.add(counts, fill_value=0).astype(np.int64)
        self.rows += rows
        self.bound += bound
        if len(self.counts) > BUFFER * self.k:
            self.prune()

    def prune(self) -> None:
        if len(self.counts) > self.k:
            cut = int(np.partition(self.counts.to_numpy(), -self.k - 1)[-self.k - 1])
            self.counts = self.counts[self.counts > cut] - cut
            self.bound += cut

    def table(self, field: str, grp: int) -> pd.DataFrame:
        """Its counters, and a row without a value for its rows and bound."""
        self.prune()
        return pd.DataFrame({"field": field, "grp": grp, "val": [None, *self.counts.index], "n": [self.rows, *self.counts], "bound": self.bound})


def _summarize(sizes: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = {field: Summary(k) for field, k in sizes.items()}
        for pdf in batches:
            for field, s in own.items():
                s.add(pdf[field].value_counts(), len(pdf))
        for field, s in own.items():
            if s.rows:
                yield s.table(field, TaskContext.get().partitionId())

    return run


def _merge(sizes: dict[str, int]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        field, grp = key
        s = Summary(sizes[field])
        for _, one in pdf.groupby("src"):
            head = one["val"].isna()
            s.add(one[~head].set_index("val")["n"], int(one.loc[head, "n"].sum()), int(one.loc[head, "bound"].sum()))
        return s.table(field, grp)

    return run


def candidates(df: DataFrame, shares: dict[str, float], *, slack: int = 8) -> DataFrame:
    """field, val, low, high, total: the values that can reach their share, with bounds on their count, and all rows.

    ``slack / share`` counters a field make the bounds at most share / slack of all rows apart.
    """
    sizes = {field: int(np.ceil(slack / share)) for field, share in shares.items()}
    texts = df.select(*(F.col(field).cast("string").alias(field) for field in shares))
    level = texts.mapInPandas(_summarize(sizes), _SUMMARY)
    for _ in range(3):  # FAN_IN ** 3 tasks, and the rest in the last merge
        last = _ == 2
        level = level.withColumn("src", F.col("grp")).withColumn("grp", F.lit(0).cast("long") if last else F.floor(F.col("grp") / FAN_IN))
        level = level.groupBy("field", "grp").applyInPandas(_merge(sizes), _SUMMARY)

    def survivors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["val"].isna()
        total, bound = int(pdf.loc[head, "n"].iloc[0]), int(pdf.loc[head, "bound"].iloc[0])
        kept = pdf[~head & (pdf["n"] + bound >= shares[key[0]] * total)]
        return pd.DataFrame({"field": key[0], "val": kept["val"], "low": kept["n"], "high": kept["n"] + bound, "total": total})

    return level.groupBy("field").applyInPandas(survivors, "field string, val string, low long, high long, total long")


def heavy_hitters(df: DataFrame, shares: dict[str, float], *, slack: int = 8) -> DataFrame:
    """field, val, low, high, n, total: the non-null values of each field in at least its share of all rows.

    ``low <= n <= high`` are the first pass's bounds, n the exact count of the second. Rows with a null count in the
    total. Values compare as text, byte by byte; an empty text is a value. An empty table gives no rows.
    """
    few = candidates(df, shares, slack=slack)
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("val")) for f in shares)))
    rows = df.select(pairs.alias("p")).select("p.field", "p.val").filter(F.col("val").isNotNull())
    counted = rows.join(F.broadcast(few), ["field", "val"]).groupBy("field", "val", "low", "high", "total").agg(F.count(F.lit(1)).alias("n"))
    share = F.create_map(*(F.lit(x) for f, s in shares.items() for x in (f, s)))
    return counted.filter(F.col("n") >= share[F.col("field")] * F.col("total")).select("field", "val", "low", "high", "n", "total")
