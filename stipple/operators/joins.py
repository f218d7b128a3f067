"""Equality joins of the domain, and the joins on barcodes, tags and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions import seq


def required(left: DataFrame, right: DataFrame, on: str | Sequence[str], *, marker: str, what: str = "row") -> DataFrame:
    """Every left row with its right row; a left row without one is an error when it is met.

    ``marker`` is a column of the right side that is never null.
    """
    out = left.join(right, on, "left")
    keys = [on] if isinstance(on, str) else list(on)
    message = F.concat_ws(" ", F.lit(f"no {what} for"), *(F.col(k).cast("string") for k in keys))
    # the check is a value of the column itself, so that the optimizer can't drop it with an unused column
    return out.withColumn(marker, F.when(F.col(marker).isNull(), F.raise_error(message).cast(dict(out.dtypes)[marker])).otherwise(F.col(marker)))


def matrix_entries(mtx: DataFrame, barcodes: DataFrame, features: DataFrame, *, strict: bool = True) -> DataFrame:
    """Matrix entries (ftr, bcd, counts) with their barcode (by nid) and feature (by nid) rows; feature columns get the prefix ftr_.

    An entry without a barcode is an error, one without a feature too if ``strict``; else it drops out, as with chosen
    features.
    """
    ftr = features.withColumnsRenamed({c: f"ftr_{c}" for c in features.columns}).withColumnRenamed("ftr_nid", "ftr")
    bcd = barcodes.withColumnRenamed("nid", "bcd").withColumn("_b", F.lit(True))
    out = required(mtx, bcd, "bcd", marker="_b", what="barcode").filter("_b").drop("_b")
    if not strict:
        return out.join(ftr, "ftr")
    return required(out, ftr.withColumn("_f", F.lit(True)), "ftr", marker="_f", what="feature").filter("_f").drop("_f")


def positions(df: DataFrame, pos: DataFrame, *, barcode: str = "barcode") -> DataFrame:
    """Barcodes with x and y from a side table, each required."""
    return required(df, pos.select(barcode, "x", "y"), barcode, marker="x", what="position")


def merge_matrices(parts: Sequence[DataFrame], *, keys: Sequence[str] = ("bcd", "ftr"), count: str = "cnt") -> DataFrame:
    """A full outer merge of matrices: counts c1, c2, ... of each source, 0 where it has none; entries of zeros alone drop out.

    One union and one aggregation, whatever the number of sources.
    """
    tagged = None
    for i, part in enumerate(parts):
        one = part.select(*keys, F.lit(i).alias("_src"), F.col(count).alias("_c"))
        tagged = one if tagged is None else tagged.unionByName(one)
    sums = [F.coalesce(F.sum(F.when(F.col("_src") == i, F.col("_c"))), F.lit(0)).alias(f"c{i + 1}") for i in range(len(parts))]
    out = tagged.groupBy(*keys).agg(*sums)
    return out.filter(" OR ".join(f"c{i + 1} != 0" for i in range(len(parts))))


def first_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, order: Sequence[Column], values: Sequence[str], *, default: int | None = None) -> DataFrame:
    """Every left row with the values of the first right row of its key, by an order; ``default`` where there is none.

    The right side is reduced to one row a key before the join, so the join never multiplies rows.
    """
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("_v")
    dictionary = right.groupBy(right_key.alias("_k")).agg(best)
    out = left.withColumn("_k", left_key).join(dictionary, "_k", "left").drop("_k")
    fill = lambda v: F.col(f"_v.{v}") if default is None else F.coalesce(F.col(f"_v.{v}"), F.lit(default))
    return out.select(*left.columns, *(fill(v).alias(v) for v in values))


def match_barcodes(reads: DataFrame, dictionary: DataFrame, *, read: str = "seq", barcode: str = "strid", tile: Sequence[str] = ("lane", "tile"), order: Sequence[str] = ("px",), length: int = 27, skip: int = 0) -> DataFrame:
    """Reads matched to the first record of each tile with the same first bases; a read may match in several tiles.

    Dictionary columns that the reads have too are left out.
    """
    rest = [c for c in dictionary.columns if c not in tile]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")
    best = dictionary.filter(F.col(barcode).isNotNull()).groupBy(*tile, F.substring(barcode, 1, length).alias("_k")).agg(first)
    out = reads.withColumn("_k", F.substring(read, skip + 1, length)).join(best, "_k")
    return out.select(*reads.columns, *tile, *(F.col(f"_v.{c}").alias(c) for c in rest if c not in reads.columns))


def match_unique(reads: DataFrame, dictionary: DataFrame, *, read: str = "seq", barcode: str = "strid", length: int = 27, skip: int = 0) -> DataFrame:
    """Distinct read keys that occur once in the whole dictionary, with their record: ambiguous keys match nothing."""
    key = F.substring(barcode, 1, length)
    once = dictionary.filter(F.col(barcode).isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*dictionary.columns)).alias("_v")).filter("_n = 1")
    keys = reads.select(F.substring(read, skip + 1, length).alias("key")).distinct()
    return keys.join(once, "key").select("key", "_v.*")


def match_tags(reads: DataFrame, tags: DataFrame, *, bcd_pos: str = "1-32", tag_pos: str = "1-15", umi_pos: str | None = None, whitelist: DataFrame | None = None, whitelist_len: int = 27) -> DataFrame:
    """barcode, tag, umi of read pairs whose tag bases equal a tag's sequence exactly.

    ``reads`` has seq1 (barcode, UMI) and seq2 (tag); ``tags`` has tag_id and tag_seq. The UMI is '.' if no place is given.
    """
    rows = reads.select(seq.intervals(F.col("seq1"), bcd_pos).alias("barcode"), seq.intervals(F.col("seq2"), tag_pos).alias("tag_seq"), (seq.intervals(F.col("seq1"), umi_pos) if umi_pos else F.lit(".")).alias("umi"))
    if whitelist is not None:
        keys = whitelist.select(F.substring("barcode", 1, whitelist_len).alias("_k")).distinct()
        rows = rows.withColumn("_k", F.substring("barcode", 1, whitelist_len)).join(keys, "_k", "left_semi").drop("_k")
    return rows.join(tags.select(F.col("tag_id").alias("tag"), "tag_seq"), "tag_seq").select("barcode", "tag", "umi")


def search_tags(reads: DataFrame, tags: DataFrame, *, read_id: str = "read_id", text: str = "seq2", tag: str = "tag_id", pattern: str = "tag_seq") -> DataFrame:
    """read_id, tag, pos (from 0) of reads that hold exactly one distinct tag as a substring.

    Tags of equal length are found by an equality join on the read's substrings of that length, so neither side is
    broadcast and no read meets every tag.
    """
    lengths = sorted(r["n"] for r in tags.select(F.length(pattern).alias("n")).filter("n > 0").distinct().collect())  # one row a tag length
    hits = None
    for n in lengths:
        grams = reads.filter(F.length(text) >= n).select(read_id, F.posexplode(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.substring(F.col(text), k, F.lit(n)))).alias("pos", pattern))
        own = grams.join(tags.filter(F.length(pattern) == n).select(tag, pattern), pattern).select(read_id, tag, "pos")
        hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        return reads.select(read_id, F.lit(None).cast(dict(tags.dtypes)[tag]).alias(tag), F.lit(0).alias("pos")).limit(0)
    one = hits.groupBy(read_id).agg(F.min(tag).alias(tag), F.max(tag).alias("_last"), F.min("pos").alias("pos"))
    return one.filter(F.col(tag) == F.col("_last")).drop("_last")


def demultiplex(reads: DataFrame, samples: DataFrame, *, max_mismatch: int = 2, min_diff: int = 2, count_n: bool = False, ambiguous: str = "ambiguous") -> DataFrame:
    """Adds ``sample``: the sample whose index reads are nearest, if near enough and clearly nearer than the next.

    ``samples`` (sample, i1[, i2]) is a sample sheet in its order; it is read by the driver and unrolled into
    expressions over distinct index pairs, which are far fewer than reads and joined back.
    """
    sheet = samples.collect()
    if not sheet:
        return reads.withColumn("sample", F.lit(ambiguous))
    if len(sheet) > 10_000:
        raise ValueError("a sample sheet of at most 10000 rows is expected")
    pair = "i2" in samples.columns
    keys = ["i1", "i2"] if pair else ["i1"]
    own = reads.select(*keys).distinct()

    def dist(row) -> Column:
        d = seq.hamming(F.col("i1"), F.lit(row["i1"]), len(row["i1"]), count_n=count_n)
        return d + seq.hamming(F.col("i2"), F.lit(row["i2"]), len(row["i2"]), count_n=count_n) if pair else d

    ranked = F.array_sort(F.array(*(F.struct(dist(r).alias("d"), F.lit(k).alias("k"), F.lit(r["sample"]).alias("s")) for k, r in enumerate(sheet))))
    own = own.withColumn("_r", F.slice(ranked, 1, 2))
    best, second = F.col("_r")[0], F.get("_r", F.lit(1))
    clear = second.isNull() | (second["d"] - best["d"] >= min_diff)
    own = own.withColumn("sample", F.when((best["d"] <= max_mismatch) & clear, best["s"]).otherwise(ambiguous)).drop("_r")
    return reads.join(own, keys, "left").withColumn("sample", F.coalesce("sample", F.lit(ambiguous)))


def zip_by_position(parts: Sequence[tuple[str, DataFrame]], *, ordinal: str, x: str = "x", y: str = "y") -> DataFrame:
    """Tables side by side by their row number; coordinates that differ are an error. Columns get each part's prefix."""
    out = None
    for k, (prefix, df) in enumerate(parts):
        if out is None:
            out = df.select(ordinal, x, y, *(F.col(c).alias(prefix + c) for c in df.columns if c not in (ordinal, x, y)))
            continue
        side = df.select(ordinal, F.col(x).alias("_x"), F.col(y).alias("_y"), *(F.col(c).alias(prefix + c) for c in df.columns if c not in (ordinal, x, y)))
        out = out.join(side, ordinal, "full")
        differs = ~(F.col(x).eqNullSafe(F.col("_x")) & F.col(y).eqNullSafe(F.col("_y")))
        out = out.withColumn(x, F.when(differs, F.raise_error(F.concat(F.lit("coordinates differ in row "), F.col(ordinal).cast("string"))).cast("double")).otherwise(F.col(x))).drop("_x", "_y")
    return out


def manifest_layout(manifest: DataFrame, layout: DataFrame, *, on: Sequence[str] = ("id",), exact: bool = False) -> DataFrame:
    """Tiles of a manifest with their place; with ``exact`` a tile on one side only is an error."""
    if not exact:
        return manifest.join(layout, list(on))
    out = manifest.withColumn("_m", F.lit(True)).join(layout.withColumn("_l", F.lit(True)), list(on), "full")
    lone = F.col("_m").isNull() | F.col("_l").isNull()
    name = F.concat_ws("_", *(F.col(c).cast("string") for c in on))
    return out.withColumn(on[0], F.when(lone, F.raise_error(F.concat(F.lit("tile on one side only: "), name)).cast(dict(out.dtypes)[on[0]])).otherwise(F.col(on[0]))).drop("_m", "_l")


def lookup(df: DataFrame, table: DataFrame, on: str, *, keep_missing: bool = True) -> DataFrame:
    """Adds a small or large lookup's columns: gene to bin, unit to cluster, unit to probabilities."""
    return df.join(table, on, "left" if keep_missing else "inner")


def color_units(df: DataFrame, gene: str, units: Sequence[dict]) -> DataFrame:
    """One row for each color unit that a gene belongs to: {'color': .., 'genes': [..] | 'regex': .. | 'all': True}.

    A regular expression must match the whole name. Adds unit (from 0) and color.
    """
    hit = []
    for k, u in enumerate(units):
        cond = F.lit(True) if u.get("all") else F.col(gene).rlike(rf"\A(?:{u['regex']})\z") if "regex" in u else F.col(gene).isin(*u["genes"])
        hit.append(F.when(cond, F.struct(F.lit(k).alias("unit"), F.lit(u["color"]).alias("color"))))
    return df.withColumn("_u", F.explode(F.array_compact(F.array(*hit)))).select(*df.columns, "_u.unit", "_u.color")


def align_matrices(a: DataFrame, b: DataFrame, *, ignore_mismatch: bool = False, keys: Sequence[str] = ("feature", "factor")) -> DataFrame:
    """Two long matrices (feature, factor, cnt) side by side as cnt1, cnt2, absent cells of common names as 0.

    Names on one side only drop out with ``ignore_mismatch`` and are an error otherwise.
    """
    joined = a.withColumnRenamed("cnt", "cnt1").join(b.withColumnRenamed("cnt", "cnt2"), list(keys), "full")
    for k in keys:
        left, right = a.select(k).distinct().withColumn("_a", F.lit(1)), b.select(k).distinct().withColumn("_b", F.lit(1))
        both = left.join(right, k, "full")
        if ignore_mismatch:
            joined = joined.join(both.filter("_a IS NOT NULL AND _b IS NOT NULL").select(k), k, "left_semi")
        else:
            lone = F.col("_a").isNull() | F.col("_b").isNull()
            checked = both.select(F.when(lone, F.raise_error(F.concat(F.lit(f"{k} on one side only: "), F.col(k).cast("string"))).cast(dict(both.dtypes)[k])).otherwise(F.col(k)).alias(k))
            joined = joined.join(checked, k, "left_semi")
    return joined.select(*keys, F.coalesce("cnt1", F.lit(0.0)).alias("cnt1"), F.coalesce("cnt2", F.lit(0.0)).alias("cnt2"))


def best_and_second(df: DataFrame, group: Sequence[str], score: Column, tie: Sequence[Column], value: Sequence[str]) -> DataFrame:
    """Per group the best row's values, its score and the gap to the second best (null for a single row)."""
    w = Window.partitionBy(*group).orderBy(score.asc(), *tie)
    ranked = df.withColumns({"_s": score, "_rn": F.row_number().over(w)}).filter("_rn <= 2")
    out = ranked.groupBy(*group).agg(*(F.min_by(v, "_rn").alias(v) for v in value), F.min_by("_s", "_rn").alias("best"), F.max(F.when(F.col("_rn") == 2, F.col("_s"))).alias("_second"))
    return out.withColumn("gap", F.col("_second") - F.col("best")).drop("_second")
