"""Filling fixed-capacity containers: exact complements first, best fit for what is left.

How full containers get depends only on how many items there are of each length, and lengths are at most the capacity:
the plan is made from a histogram of at most ``capacity`` counts, whatever the number of items. The plan is a list of
patterns (which lengths share a container, and how often). Items then find their container by their rank among the
items of equal length.

Scale: one pass sizes the texts, and the sizes are written once. The driver holds the histogram, ``capacity`` numbers,
and the counts by (length, salt), of which there are at most ``capacity + items / SALT_ROWS``. A length that many items
share is ranked in salted parts, by one shuffle of (id, length). Places are one row a length, with sorted ranks; an item
joins its length's row by equality and finds its place there by binary search.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipple.session import materialize, spread

#: Items of a length that are ranked in one task.
SALT_ROWS = 500_000
#: A public byte-level vocabulary; its place is a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that this vocabulary was made with (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """A public byte-level vocabulary of rank lines; one a worker process."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for a null one. Text that looks like a special token is ordinary text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(path)
        for texts in batches:
            yield pd.Series([len(own.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


class Sums:
    """How many ordered singles, pairs and triples of the lengths that are left have each sum: the index of exact complements.

    A length that is used up is taken out of all three by shifted differences, so the index is never computed again.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.one = (left > 0).astype(np.int64)
        size = len(left)
        self.two = np.convolve(self.one, self.one)[:size]
        self.three = np.convolve(self.two, self.one)[:size]

    def remove(self, k: int) -> None:
        """Length k has no items left."""
        size, one, two, three = len(self.one), self.one, self.two, self.three
        # (p - e)^3 = p^3 - 3 p^2 e + 3 p e^2 - e^3, and the same for the square, where e shifts by k
        three[k:] -= 3 * two[: size - k]
        if 2 * k < size:
            three[2 * k :] += 3 * one[: size - 2 * k]
        if 3 * k < size:
            three[3 * k] -= 1
        two[k:] -= 2 * one[: size - k]
        if 2 * k < size:
            two[2 * k] += 1
        one[k] = 0


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of containers for counts[length] items of each length; the capacity is len(counts) - 1.

    From the longest length down, its gap is filled exactly by one, by two or by three other lengths while they last;
    else the longest length that fits goes in, and its gap is tried again. A step repeats its container until a length
    of it runs short, which at least halves what is left of that length: O(capacity * log(items)) steps.
    """
    left, room = counts.astype(np.int64).copy(), len(counts) - 1
    left[0] = 0
    sums = Sums(left)
    out: list[tuple[int, list[int]]] = []

    def complement(gap: int, rest: np.ndarray) -> list[int] | None:
        """One, two or three lengths with the sum gap among the items in ``rest``; the longest first."""
        if rest[gap] > 0:
            return [gap]
        if sums.two[gap]:
            a = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
            a = a[(rest[a] > 0) & (rest[gap - a] > 0) & ((2 * a != gap) | (rest[a] > 1))]
            if len(a):
                return [int(a[0]), gap - int(a[0])]
        if sums.three[gap]:
            for k in np.flatnonzero(rest[:gap])[::-1]:
                k = int(k)
                if 3 * k < gap:  # k is the longest of the three
                    break
                if not sums.two[gap - k]:
                    continue
                rest[k] -= 1
                a = np.arange(min(k, gap - k - 1), (gap - k + 1) // 2 - 1, -1)
                a = a[(rest[a] > 0) & (rest[gap - k - a] > 0) & ((2 * a != gap - k) | (rest[a] > 1))]
                rest[k] += 1
                if len(a):
                    return [k, int(a[0]), gap - k - int(a[0])]
        return None

    for length in range(room, 0, -1):
        while left[length]:
            rest, own, gap = left.copy(), [length], room - length
            rest[length] -= 1
            while gap:
                exact = complement(gap, rest)
                if exact is not None:
                    own += exact
                    break
                have = np.flatnonzero(rest[: gap + 1])
                if not len(have):
                    break
                pick = int(have[-1])  # best fit
                rest[pick] -= 1
                own.append(pick)
                gap -= pick
            lengths, need = np.unique(own, return_counts=True)
            times = int((left[lengths] // need).min())
            left[lengths] -= times * need
            for k in lengths[left[lengths] == 0]:
                sums.remove(int(k))
            out.append((times, own))
    return out


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[int, list[tuple[int, int, int]]]:
    """Per length, by rising rank: (from rank, first container, items of the length in each container)."""
    at: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for times, lengths in patterns:
        own, each = np.unique(lengths, return_counts=True)
        for length, n in zip(own.tolist(), each.tolist()):
            begin = at.get(length, 0)
            out.setdefault(length, []).append((begin, first, n))
            at[length] = begin + times * n
        first += times
    return out


def _last_at_most(values: Column, x: Column, size: int) -> Column:
    """The 0-based place of the last of up to ``size`` rising values that is at most x; the first always is. A binary search."""
    steps = [1 << k for k in reversed(range(max(1, size - 1).bit_length()))]
    further = lambda at, step: F.coalesce(F.get(values, at + step) <= x, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def pack(items: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """item_id, piece, n_tokens, container: every piece of every item in a container of ``capacity``.

    Only an item larger than the capacity is split: into full pieces, each a container of its own, and the remainder,
    which is packed like an item. Pieces are numbered from 0. An item of null or no size takes no room; it goes to
    container 0. ``item_id`` must be unique and not null. An empty table gives no rows; other columns are ignored.
    """
    spark = items.sparkSession
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    sized = materialize(items.select(F.col(item_id).alias("id"), n.alias("n")))
    full = F.floor(F.col("n") / capacity)
    rest = F.col("n") - full * capacity
    parts = sized.select("id", "n", full.alias("full"), rest.alias("length"))
    tails = parts.filter((F.col("length") > 0) | (F.col("n") == 0)).select("id", F.col("full").alias("piece"), "length")
    some = tails.filter("length > 0")
    lengths = some.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # fewer rows than the capacity
    ways = {r["length"]: -(-r["n"] // SALT_ROWS) for r in lengths}
    # one row a length, fewer than the capacity: small whatever the items are
    way = spark.createDataFrame(sorted(ways.items()), "length long, ways long")
    salted = some.join(F.broadcast(way), "length").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("ways"))).drop("ways")
    if any(n > 1 for n in ways.values()):
        counts = [tuple(r) for r in salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "salt").collect()]
    else:
        counts = sorted((r["length"], 0, r["n"]) for r in lengths)
    offsets, seen, histogram = [], {}, np.zeros(capacity + 1, dtype=np.int64)
    for length, salt, n in counts:
        offsets.append((length, salt, seen.get(length, 0)))
        seen[length] = seen.get(length, 0) + n
        histogram[length] += n
    patterns = plan(histogram)
    slots = _slots(patterns)
    used, most = sum(times for times, _ in patterns), max(map(len, slots.values()), default=1)
    offset = spark.createDataFrame(offsets, "length long, salt long, offset long")
    # one row a length again, with its places by rising rank
    slot = spark.createDataFrame([(k, *map(list, zip(*v))) for k, v in slots.items()], "length long, low array<long>, first array<long>, each array<long>")
    order = Window.partitionBy("length", "salt").orderBy("id")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(offset, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    found = ranked.join(F.broadcast(slot), "length").withColumn("at", _last_at_most(F.col("low"), F.col("rank"), most))
    container = F.get("first", F.col("at")) + F.floor((F.col("rank") - F.get("low", F.col("at"))) / F.get("each", F.col("at")))
    packed = found.select("id", "piece", F.col("length").alias("n_tokens"), container.alias("container"))
    none = tails.filter("length = 0").select("id", F.lit(0).cast("long").alias("piece"), F.col("length").alias("n_tokens"), F.lit(0).cast("long").alias("container"))
    # full pieces: their containers follow those of the plan, numbered by the item's place among the large items
    large = _running(parts.filter("full > 0"), used)
    whole = large.select("id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece", "_k"), "begin").select(
        "id", F.col("piece").cast("long").alias("piece"), F.lit(capacity).cast("long").alias("n_tokens"), (F.col("begin") + F.col("piece")).alias("container")
    )
    return packed.unionByName(none).unionByName(whole).withColumnRenamed("id", item_id)


def _running(large: DataFrame, first: int) -> DataFrame:
    """Adds ``begin``: first, first + full, ... in order within hashed parts, whose sums the driver adds up."""
    spark = large.sparkSession
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    large = large.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    sums = large.groupBy("part").agg(F.sum("full").alias("n")).orderBy("part").collect()  # one row a part
    begins, at = [], first
    for r in sums:
        begins.append((r["part"], at))
        at += r["n"]
    order = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    start = spark.createDataFrame(begins, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType())]))
    return large.withColumn("before", F.coalesce(F.sum("full").over(order), F.lit(0))).join(start, "part").withColumn("begin", F.col("start") + F.col("before"))


def pack_texts(docs: DataFrame, doc_id: str, text: str, capacity: int, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` of texts by their number of tokens."""
    return pack(spread(docs.select(F.col(doc_id), F.col(text))).select(F.col(doc_id), count_tokens(F.col(text), vocabulary).alias("_n")), doc_id, "_n", capacity)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens and the share of their room that is used."""
    own = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return own.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens")).withColumn("used", F.col("tokens") / (F.col("containers") * capacity))
