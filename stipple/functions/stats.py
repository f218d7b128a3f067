"""Statistics as column expressions; functions of one value end in _value."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this z on the tail is taken from its asymptotic series.
FAR_TAIL = 10.0


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def chi2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The statistic of a 2x2 table, without correction; null where a margin is zero."""
    det = a * d - b * c
    return over(det * det * (a + b + c + d), (a + b) * (c + d) * (a + c) * (b + d))


def chi2_log10p_value(x: float) -> float:
    """-log10 of the upper tail of a chi-square with one degree of freedom."""
    if x is None or x != x:
        return math.nan
    if x <= 0:
        return 0.0
    z = math.sqrt(x)
    if z < FAR_TAIL:
        return -math.log10(math.erfc(z / math.sqrt(2)))
    # erfc(t) ~ exp(-t*t) / (t * sqrt(pi)) * (1 - 1 / (2 t^2))
    t2 = x / 2
    return (t2 + math.log(math.sqrt(t2 * math.pi)) - math.log1p(-1 / (2 * t2))) / math.log(10)


#: Terms of the error function's series and continued fraction, and where the one takes over from the other.
TERMS, JOINT = 60, 2.0


def chi2_log10p(x: Column | str) -> Column:
    """-log10 of the p-value of a statistic with one degree of freedom, of any size; null for a null or NaN statistic.

    The p-value is erfc(z) with z = sqrt(x / 2): below ``JOINT`` by the power series of the error function, above by the
    continued fraction of its complement, whose logarithm never underflows. Expressions throughout.
    """
    x = F.col(x) if isinstance(x, str) else x
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    first = F.struct(z.alias("t"), z.alias("s"))
    step = lambda a, k: a["t"] * 2 * z * z / (k * 2 + 1)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, lambda a, k: F.struct(step(a, k).alias("t"), (a["s"] + step(a, k)).alias("s")), lambda a: a["s"])
    near = -F.log10(1 - F.exp(-z * z) * series * 2 / math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), z, lambda t, k: z + k / 2 / t)
    far = (z * z + F.log(fraction * math.sqrt(math.pi))) / math.log(10)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(z < JOINT, near).otherwise(far))


def fold_change(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a/b) / (c/d) as a*d / (b*c)."""
    return over(a * d, b * c)


def fold_change_low(a: Column, b: Column, c: Column, d: Column, alpha: float = 0.001, inflation: float = 1.0) -> Column:
    """The lower bound of the fold change at level alpha, by the delta method on its logarithm."""
    se = F.sqrt(F.lit(inflation) * (over(F.lit(1.0), a) + over(F.lit(1.0), b) + over(F.lit(1.0), c) + over(F.lit(1.0), d)))
    return F.exp(F.log(fold_change(a, b, c, d)) - F.lit(normal_quantile(1 - alpha)) * se)


def normal_quantile(p: float) -> float:
    """The quantile of the standard normal distribution."""
    return NormalDist().inv_cdf(p)


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_sub(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)) for a > b, null otherwise."""
    return F.when(a > b, a + F.log1p(-F.exp(b - a)))


def cauchy_combination_value(log10p: list[float]) -> float:
    """-log10 of the combined p-value of -log10 p-values, by the Cauchy combination test with equal weights."""
    kept = [v for v in log10p if v is not None and v == v]
    if not kept:
        return math.nan
    # tan((1/2 - p) pi) is 1 / tan(p pi); below 1e-15 it is 1 / (p pi), whose logarithm is added up
    logs, small = [], 0.0
    for v in kept:
        p = 10.0**-v
        if p < 1e-15:
            logs.append(v * math.log(10) - math.log(math.pi))
        else:
            small += math.tan((0.5 - p) * math.pi)
    if logs:
        top = max(logs)
        log_t = top + math.log(sum(math.exp(x - top) for x in logs))
        log_t += math.log1p(small * math.exp(-log_t))
        return (log_t - math.log(len(kept)) + math.log(math.pi)) / math.log(10)
    t = small / len(kept)
    p = 0.5 - math.atan(t) / math.pi if t < 1e8 else 1 / (t * math.pi)
    return -math.log10(p)


#: -log10 p from which tan((1/2 - p) pi) is 1 / (p pi) in double precision.
TINY = 15.0


def cauchy_combination(log10p: Column, weights: Column | None = None) -> Column:
    """-log10 of the combined p-value of an array of -log10 p-values, by the Cauchy combination test.

    ``weights`` is an array of the same length, else all weigh alike. Null and NaN values, and those of null, NaN or no
    positive weight, are left out; null if none is left. The statistic is the weighted mean of tan((1/2 - p) pi); terms of
    tiny p-values are added as logarithms, and the others, negative ones too, are added to their sum.
    """
    pairs = F.transform(log10p, lambda v: F.struct(v.alias("v"), F.lit(1.0).alias("w"))) if weights is None else F.zip_with(log10p, weights, lambda v, w: F.struct(v.cast("double").alias("v"), w.cast("double").alias("w")))
    kept = F.filter(pairs, lambda z: z["v"].isNotNull() & ~F.isnan(z["v"]) & (z["w"] > 0) & ~F.isnan(z["w"]))
    add = lambda a, v: a + v
    total = F.aggregate(kept, F.lit(0.0), lambda a, z: a + z["w"])
    mean = F.aggregate(F.transform(F.filter(kept, lambda z: z["v"] < TINY), lambda z: z["w"] * F.tan((0.5 - F.pow(F.lit(10.0), -z["v"])) * math.pi)), F.lit(0.0), add) / total
    logs = F.transform(F.filter(kept, lambda z: z["v"] >= TINY), lambda z: F.log(z["w"] / total) + z["v"] * math.log(10) - math.log(math.pi))
    top = F.array_max(logs)
    # log of the tiny terms' sum; beside it the others are a factor 1 + mean / sum
    log_sum = top + F.log(F.aggregate(F.transform(logs, lambda v: F.exp(v - top)), F.lit(0.0), add))
    log_t = log_sum + F.log1p(mean * F.exp(-log_sum))
    tail = F.when(mean > 1e8, 1 / (mean * math.pi)).otherwise(0.5 - F.atan(mean) / math.pi)
    return F.when(F.size(kept) > 0, F.when(F.size(logs) > 0, (log_t + math.log(math.pi)) / math.log(10)).otherwise(-F.log10(tail)))


def significant(c: Column, digits: int) -> Column:
    """A number rounded to so many significant digits; 0 stays 0."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.nullif(F.abs(c), F.lit(0.0)))) - (digits - 1))
    return F.coalesce(F.floor(over(c, unit) + 0.5) * unit, c)


def significant_value(x: float, digits: int) -> float:
    """``significant`` of one number."""
    return float(f"{x:.{digits - 1}e}") if x else 0.0


def renormalize(p: Column, *, off: float = 1e-5, floor: float = 1e-20) -> Column:
    """Probabilities scaled to the sum 1 where their sum is further from it than ``off``; each gets a floor first."""
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    fixed = F.transform(p, lambda v: (v + floor) / (total + F.size(p) * floor))
    return F.when(F.abs(total - 1) > off, fixed).otherwise(p)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
