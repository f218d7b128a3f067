"""The aggregations that also make sense while rows arrive. The same expressions as in batch, with watermarks that bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_counts(stream: DataFrame, *, time: str = "read_at", keys: tuple[str, ...] = ("lane", "tile"), window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Barcodes and exact matches per tile and window; rows later than ``late`` drop out and their state goes."""
    own = stream.withWatermark(time, late)
    out = own.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("barcodes"), F.count_if(F.col("mismatches") == 0).alias("matches"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "barcodes", "matches")


def feature_counts(stream: DataFrame, *, gene: str = "gene", count: str = "count") -> DataFrame:
    """Running totals per feature: for the output modes 'update' and 'complete'; the state is one row a feature."""
    return stream.groupBy(gene).agg(F.sum(count).alias("count"), F.count(F.lit(1)).alias("rows"))


def without_redelivered(stream: DataFrame, key: tuple[str, ...], *, time: str = "loaded_at", late: str = "1 hour") -> DataFrame:
    """Rows delivered again under the same key within ``late`` drop out."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def to_memory(stream: DataFrame, name: str, *, mode: str = "append"):
    """Runs a stream over what there is into a table in memory, for tests; the driver holds its rows."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
