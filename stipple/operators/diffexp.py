"""Differential expression on long matrices (feature, factor, cnt): 2x2 tests against the rest, between factors, between matrices.

The matrix is already aggregated: its rows are features times factors, whatever the number of molecules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions import stats
from stipple.operators import aggregates, joins, ordering


def _with_tests(df: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(k) for k in "abcd")
    return df.withColumns({"chi2": stats.chi2(a, b, c, d), "fc": stats.fold_change(a, b, c, d)})


def marginal(long: DataFrame, *, pseudocount: float = 0.5) -> DataFrame:
    """feature, factor, a, b, c, d, chi2, fc, gene_total: each cell against the rest; every margin gets one pseudocount."""
    t = aggregates.totals(long)
    pc = F.lit(pseudocount)
    own = t.select(
        "feature", "factor", (F.col("cnt") + pc).alias("a"), (F.col("colsum") - F.col("cnt") + pc).alias("b"), (F.col("rowsum") - F.col("cnt") + pc).alias("c"),
        (F.col("total") - F.col("colsum") - F.col("rowsum") + F.col("cnt") + pc).alias("d"), F.col("rowsum").alias("gene_total"),
    )
    return _with_tests(own)


def pairwise(long: DataFrame, *, pseudocount: float = 0.5) -> DataFrame:
    """feature, f1 < f2, a, b, c, d, chi2, fc: each two factors that a feature has, against their other features."""
    cols = long.groupBy("factor").agg(F.sum("cnt").alias("colsum"))
    t = long.join(cols, "factor")
    x = t.select("feature", F.col("factor").alias("f1"), F.col("cnt").alias("x"), F.col("colsum").alias("xs"))
    y = t.select("feature", F.col("factor").alias("f2"), F.col("cnt").alias("y"), F.col("colsum").alias("ys"))
    pc = F.lit(pseudocount)
    own = x.join(y, "feature").filter("f1 < f2").select(
        "feature", "f1", "f2", (F.col("x") + pc).alias("a"), (F.col("y") + pc).alias("b"), (F.col("xs") - F.col("x") + pc).alias("c"), (F.col("ys") - F.col("y") + pc).alias("d")
    )
    return _with_tests(own)


def between(first: DataFrame, second: DataFrame, *, level: str = "conditional", pseudocount: float = 0.5, min_count: float = 10.0, ignore_mismatch: bool = False) -> DataFrame:
    """Two matrices: 'factor' and 'feature' compare marginal totals, 'conditional' every cell within its factor.

    Count1, Count2, Frac1, Frac2, log2FC, chi2, log10p; both raw counts must reach ``min_count``.
    """
    both = joins.align_matrices(first, second, ignore_mismatch=ignore_mismatch)
    keys = {"factor": ["factor"], "feature": ["feature"], "conditional": ["feature", "factor"]}[level]
    cells = both.groupBy(*keys).agg(F.sum("cnt1").alias("count1"), F.sum("cnt2").alias("count2"))
    if level == "conditional":
        total = both.groupBy("factor").agg(F.sum("cnt1").alias("t1"), F.sum("cnt2").alias("t2"))
        cells = cells.join(total, "factor")
    else:
        total = both.agg(F.sum("cnt1").alias("t1"))
        cells = cells.withColumn("t1", total.scalar()).withColumn("t2", both.agg(F.sum("cnt2").alias("t2")).scalar())
    pc = F.lit(pseudocount)
    cells = cells.filter((F.col("count1") >= min_count) & (F.col("count2") >= min_count))
    own = cells.withColumns({"a": F.col("count1") + pc, "b": F.col("count2") + pc, "c": F.col("t1") - F.col("count1") + pc, "d": F.col("t2") - F.col("count2") + pc})
    out = _with_tests(own)
    return out.select(
        *keys, "count1", "count2", stats.over(F.col("count1"), F.col("t1")).alias("frac1"), stats.over(F.col("count2"), F.col("t2")).alias("frac2"),
        F.log2("fc").alias("log2fc"), "chi2", stats.chi2_log10p("chi2").alias("log10p"), stats.fold_change_low(*(F.col(k) for k in "abcd")).alias("fc_low"),
    )


def report(tested: DataFrame, *, max_pval: float = 0.001, min_fc: float = 1.5, min_count: float = 10.0, alpha: float = 0.001, inflation: float = 1.0, fallback: bool = True) -> DataFrame:
    """Rows that pass by count, fold change and p-value, with log10p and fc_low; a factor without any keeps its best with fc >= 1."""
    import math

    rows = tested.withColumn("log10p", stats.chi2_log10p("chi2")).withColumn("fc_low", stats.fold_change_low(*(F.col(k) for k in "abcd"), alpha=alpha, inflation=inflation))
    passes: Column = (F.col("a") >= min_count) & (F.col("fc") >= min_fc) & (F.col("log10p") >= -math.log10(max_pval))
    passes = F.coalesce(passes, F.lit(False))
    if not fallback:
        return rows.filter(passes)
    return ordering.passing_or_best(rows, "factor", passes, F.coalesce(F.col("fc") >= 1, F.lit(False)), [F.desc("log10p"), F.asc("feature")])
