"""Per-key results when a few keys hold most rows: eager aggregation through a join.

Both inputs are first reduced to one compact state per join key, on the map side, so that a hot key reaches the shuffle
as one row per task. The compact states are joined, and counts and sums of the join's rows follow algebraically: a
left row meets ``right_rows`` partners, so pairs = left_rows * right_rows, and a sum over the joined rows is the sum
over the left rows times right_rows. No task ever holds the rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eager_aggregate_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, measure: str, *, how: str = "left", key_as: str = "key"
) -> DataFrame:
    """Per key of ``left JOIN right``: left_rows, left_sum, right_rows, joined_rows and joined_sum.

    joined_rows and joined_sum are those of the full inner join, which is never built. A null key is a key of its own
    on the left and meets nothing on the right. A null measure counts as a row and adds nothing; a key without
    measures has the sum null. ``how`` is 'left' (all left keys) or 'inner'. Sums of integers are bigint.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    a = left.groupBy(F.col(left_key).alias(key_as)).agg(F.count(F.lit(1)).alias("left_rows"), F.sum(measure).alias("left_sum"))
    b = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_key")).agg(F.count(F.lit(1)).alias("right_rows"))
    joined = a.join(b, a[key_as] == b["_key"], how).drop("_key")
    n = F.coalesce("right_rows", F.lit(0))
    return joined.select(key_as, "left_rows", "left_sum", n.alias("right_rows"), (F.col("left_rows") * n).alias("joined_rows"), (F.col("left_sum") * n).alias("joined_sum"))


def hot_keys(per_key: DataFrame, share: float, *, key: str = "key", rows: str = "left_rows") -> DataFrame:
    """The non-null keys with at least ``share`` of all rows, null keys' rows included in the total.

    Works on the compact states alone. The total is a scalar subquery over them, not a cross join.
    """
    total = per_key.agg(F.sum(rows).alias("total")).scalar()
    return per_key.filter(F.col(key).isNotNull() & (F.col(rows) >= F.lit(share) * total))
