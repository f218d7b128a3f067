"""Sparse matrices: barcodes, features and entries as three tables; sparse rows with a dictionary; wide matrices."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.functions import text as ft
from stipple.operators import ordering, project
from stipple.sources import text_tables as tt


def read_entries(spark: SparkSession, path: str, *, counts: int | None = None) -> DataFrame:
    """ftr, bcd, c1..cn of a coordinate matrix, one file or a folder of its parts; comment lines and the line of dimensions drop out.

    Parts follow each other in the order of their names, and only the first line that is no comment has the dimensions.
    """
    start = tt.head(spark, path, 1000)
    dims = next((k for k, v in enumerate(start) if not v.startswith("%")), None)
    if dims is None:
        raise ValueError(f"{path} has no dimensions")
    sample = [v for v in start[dims + 1 :] if not v.startswith("%")][:1]
    n = counts or (len(sample[0].split()) - 2 if sample else 1)
    # the dimensions are the first line; an entry with the same text is told apart by its place
    lines = tt.numbered(spark, path).filter((F.col("ordinal") > dims) & ~F.col("value").startswith("%"))
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f"))
    at = lambda i: F.get("f", F.lit(i)).cast("bigint")
    return f.select(at(0).alias("ftr"), at(1).alias("bcd"), *(at(k + 2).alias(f"c{k + 1}") for k in range(n)))


def read_dimensions(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """features, barcodes, entries as the file states them."""
    return tuple(int(v) for v in next(v for v in tt.head(spark, path, 1000) if not v.startswith("%")).split()[:3])


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """strid, nid, gid, lane, tile, px, py, counts array<bigint> of a spatial barcode table without header."""
    df = tt.read_table(spark, path, header=False, names=("strid", "nid", "gid", "lane", "tile", "px", "py", "counts"))
    kinds = {"nid": "bigint", "gid": "bigint", "lane": "int", "tile": "int", "px": "bigint", "py": "bigint"}
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()}).withColumn("counts", ft.comma_ints(F.col("counts")))


def read_plain_barcodes(spark: SparkSession, path: str, *, sep: str = "\t", icol_barcode: int = 0, icol_x: int | None = None, icol_y: int | None = None) -> DataFrame:
    """nid from 1 in the file's order, strid, and x, y if their columns are given."""
    lines = tt.numbered(spark, path)
    f = lines.select((F.col("ordinal") + 1).alias("nid"), F.split("value", "\\Q" + sep + "\\E").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    xy = [at(i).try_cast("double").alias(n) for i, n in ((icol_x, "x"), (icol_y, "y")) if i is not None]
    return f.select("nid", at(icol_barcode).alias("strid"), *xy)


def read_features(spark: SparkSession, path: str, *, numbered: bool = False) -> DataFrame:
    """id, name, nid[, counts]: with ``numbered`` from the file (id, name, nid, counts), else nid is the row's place from 1."""
    if numbered:
        df = tt.read_table(spark, path, header=False, names=("id", "name", "nid", "counts"))
        return df.withColumn("nid", F.col("nid").try_cast("bigint")).withColumn("counts", ft.comma_ints(F.col("counts")))
    f = tt.numbered(spark, path).select((F.col("ordinal") + 1).alias("nid"), F.split("value", "\t").alias("f"))
    return f.select(F.get("f", F.lit(0)).alias("id"), F.coalesce(F.get("f", F.lit(1)), F.get("f", F.lit(0))).alias("name"), "nid")


def read_positions(spark: SparkSession, path: str, *, barcode: str = "barcode", x: str = "pxl_row_in_fullres", y: str = "pxl_col_in_fullres", sep: str = ",") -> DataFrame:
    """barcode, x, y of a position table."""
    df = tt.read_table(spark, path, sep=sep)
    return df.select(F.col(barcode).alias("barcode"), F.col(x).try_cast("double").alias("x"), F.col(y).try_cast("double").alias("y"))


def compact(entries: DataFrame, barcodes: DataFrame, features: DataFrame, counts: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, barcodes and features renumbered from 1 in their old order; entries of zeros and rows without entries drop out."""
    own = entries.filter(" OR ".join(f"{c} != 0" for c in counts))
    own = own.join(barcodes.select(F.col("nid").alias("bcd")), "bcd", "left_semi").join(features.select(F.col("nid").alias("ftr")), "ftr", "left_semi")
    b = ordering.dense_ids(barcodes.join(own.select(F.col("bcd").alias("nid")).distinct(), "nid", "left_semi"), ["nid"])
    f = ordering.dense_ids(features.join(own.select(F.col("ftr").alias("nid")).distinct(), "nid", "left_semi"), ["nid"])
    e = own.join(b.select(F.col("nid").alias("bcd"), F.col("new_id").alias("_b")), "bcd").join(f.select(F.col("nid").alias("ftr"), F.col("new_id").alias("_f")), "ftr")
    e = e.select(F.col("_f").alias("ftr"), F.col("_b").alias("bcd"), *counts)
    renumber = lambda df: df.drop("nid").withColumnRenamed("new_id", "nid")
    return e, renumber(b), renumber(f)


def totals(entries: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """key, counts array<bigint>: the totals written beside features and barcodes."""
    return entries.groupBy(key).agg(F.array(*(F.sum(c) for c in counts)).alias("counts"))


def matrix_lines(entries: DataFrame, counts: Sequence[str]) -> DataFrame:
    """value: the body of a coordinate matrix, by barcode and feature."""
    return entries.orderBy("bcd", "ftr").select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("ftr", "bcd", *counts))).alias("value"))


def matrix_header(entries: DataFrame, features: DataFrame, barcodes: DataFrame, kind: str = "integer") -> list[str]:
    """The two header lines, with true counts."""
    return [f"%%MatrixMarket matrix coordinate {kind} general", f"{features.count()} {barcodes.count()} {entries.count()}"]


def write_matrix(folder: str, entries: DataFrame, barcodes: DataFrame, features: DataFrame, counts: Sequence[str], *, kind: str = "integer") -> None:
    """matrix.mtx, barcodes.tsv and features.tsv as folders of part files in order; barcode and feature rows get their totals."""
    spark = entries.sparkSession
    head = spark.createDataFrame([(v,) for v in matrix_header(entries, features, barcodes, kind)], "value string").coalesce(1)
    head.unionByName(matrix_lines(entries, counts)).write.option("compression", "gzip").text(f"{folder}/matrix.mtx.gz")
    for name, df, key in (("barcodes", barcodes, "bcd"), ("features", features, "ftr")):
        own = df.drop("counts").join(totals(entries, key, counts).withColumnRenamed(key, "nid"), "nid", "left").orderBy("nid")
        rest = [c for c in df.columns if c not in ("nid", "counts")]
        tt.write_table(own.select(*rest[:1], *(["nid"] if name == "barcodes" else []), *rest[1:], *([] if name == "barcodes" else ["nid"]), ft.ints_comma(F.col("counts")).alias("counts")), f"{folder}/{name}.tsv.gz", header=False)


def sparse_rows(long: DataFrame, dictionary: DataFrame, unit: Sequence[str], *, feature: str = "feature", cnt: str = "cnt", seed: int = 0) -> DataFrame:
    """random_key, unit columns, n_genes, n_mols, idx array<int>, cnt array<bigint>: a sparse row a unit, by index.

    A unit's entries are at most the number of features.
    """
    own = long.filter(F.col(cnt) > 0).join(dictionary, feature)
    own = own.groupBy(*unit, "idx").agg(F.sum(cnt).alias("_c"))
    rows = own.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("idx", "_c"))).alias("_e"), F.sum("_c").alias("n_mols"))
    rows = rows.select(*unit, F.size("_e").alias("n_genes"), "n_mols", F.col("_e.idx").alias("idx"), F.col("_e._c").alias("cnt"))
    return project.random_key(rows, list(unit), seed=seed).select("random_key", *unit, "n_genes", "n_mols", "idx", "cnt")


def sparse_lines(rows: DataFrame, unit: Sequence[str]) -> DataFrame:
    """value: the text rows of sparse rows."""
    pairs = F.array_join(F.zip_with("idx", "cnt", lambda i, c: F.concat_ws(" ", i.cast("string"), c.cast("string"))), "\t")
    return rows.select(F.concat_ws("\t", "random_key", *(F.col(u).cast("string") for u in unit), F.col("n_genes").cast("string"), F.col("n_mols").cast("string"), pairs).alias("value"))


def sparse_meta(dictionary: DataFrame, unit: Sequence[str], n_units: int, *, feature: str = "feature", n_modalities: int = 1) -> str:
    """The JSON beside sparse rows."""
    names = {r[feature]: r["idx"] for r in dictionary.collect()}  # one entry a feature
    return json.dumps({"dictionary": names, "header_info": ["random_key", *unit], "n_features": len(names), "n_units": n_units, "n_modalities": n_modalities, "offset_data": 1 + len(unit)})


def read_sparse(spark: SparkSession, path: str, meta: dict | str) -> tuple[DataFrame, DataFrame]:
    """(rows, dictionary) of a sparse text table: header columns, n_genes, n_mols, idx, cnt; feature, idx.

    A row whose number of fields isn't 2 * n_genes + header + 2, or whose counts don't sum to n_mols, is an error.
    """
    info = json.loads(meta) if isinstance(meta, str) else meta
    header, off = info["header_info"], int(info["offset_data"])
    if len(set(info["dictionary"].values())) < len(info["dictionary"]):
        raise ValueError("two features have one index")
    f = spark.read.text(path).filter("value != ''").select(F.split(F.trim("value"), r"\s+").alias("f"))
    n = F.get("f", F.lit(off)).cast("int")
    rest = F.slice("f", F.lit(off + 3), F.greatest(F.size("f") - (off + 2), F.lit(0)))
    own = f.select(*(F.get("f", F.lit(i)).alias(h) for i, h in enumerate(header[:off])), n.alias("n_genes"), F.get("f", F.lit(off + 1)).cast("bigint").alias("n_mols"), rest.alias("_r"))
    own = own.withColumns({
        "idx": F.transform(F.filter("_r", lambda v, i: i % 2 == 0), lambda v: v.cast("int")),
        "cnt": F.transform(F.filter("_r", lambda v, i: i % 2 == 1), lambda v: v.cast("bigint")),
    })
    bad = (F.size("_r") != 2 * F.col("n_genes")) | (F.aggregate("cnt", F.lit(0).cast("bigint"), lambda a, v: a + v) != F.col("n_mols"))
    own = own.withColumn("n_genes", F.when(bad, F.raise_error(F.concat(F.lit("ragged sparse row: "), F.col(header[0]))).cast("int")).otherwise(F.col("n_genes")))
    names = spark.createDataFrame(sorted(info["dictionary"].items(), key=lambda x: x[1]), "feature string, idx int")
    return own.drop("_r"), names


def sparse_to_long(rows: DataFrame, dictionary: DataFrame, unit: Sequence[str]) -> DataFrame:
    """unit columns, feature, cnt."""
    e = rows.select(*unit, F.explode(F.arrays_zip("idx", "cnt")).alias("e")).select(*unit, "e.idx", "e.cnt")
    return e.join(dictionary, "idx").select(*unit, "feature", "cnt")


def read_pseudobulk(spark: SparkSession, path: str) -> DataFrame:
    """feature, factor, cnt of a wide matrix whose first column is the feature; ragged rows and unreadable cells are an error."""
    df = tt.read_table(spark, path, strict=True)
    first, rest = df.columns[0], [c for c in df.columns[1:] if c != ""]
    return df.select(F.col(f"`{first}`").alias("feature"), *(F.col(f"`{c}`").cast("double").alias(c) for c in rest)).unpivot("feature", rest, "factor", "cnt")


def write_pseudobulk(long: DataFrame, path: str, *, digits: int = 4) -> None:
    """A wide matrix: features by falling total, factors in numeric-aware order, fixed-point cells."""
    names = [r["factor"] for r in ordering.numeric_aware_rank(long, "factor").orderBy("rank").collect()]  # one row a factor
    total = long.groupBy("feature").agg(F.sum("cnt").alias("_t"))
    wide = long.groupBy("feature").pivot("factor", names).agg(F.sum("cnt")).na.fill(0.0).join(total, "feature").orderBy(F.desc("_t"), "feature")
    tt.write_table(wide.select(F.col("feature").alias("Feature"), *(F.format_string(f"%.{digits}f", F.col(f"`{n}`")).alias(n) for n in names)), path)
