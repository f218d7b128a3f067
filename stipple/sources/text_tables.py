"""Delimited tables, their headers, and small side tables.

Files are read as text by Spark; only headers and small side files are read on the driver, through the same file system.
Rows get their place in the file as an ordinal only where an operator asks for one.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.functions import text as ft


def head(spark: SparkSession, path: str, lines: int) -> list[str]:
    """The first lines of a file, or of a folder's files in the order of their names; a scan alone begins with the largest."""
    files = sorted(r["file_path"] for r in spark.read.format("binaryFile").load(path).select("_metadata.file_path").collect())  # one row a file
    scan, out = spark.read.text(path), []
    for file in files:
        if len(out) == lines:
            break
        out += [r["value"] for r in scan.filter(F.col("_metadata.file_path") == file).limit(lines - len(out)).collect()]
    return out


def read_all(spark: SparkSession, path: str) -> str:
    """The text of one small file, or of the part files of a small folder."""
    data = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).orderBy("path").select("content").collect()]
    return b"".join(gzip.decompress(d) if d[:2] == b"\x1f\x8b" else d for d in data).decode()


#: Rows of the table of file splits (some 100 bytes each) up to which it is sent to all tasks.
MAX_SPLITS = 500_000


def numbered(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, file, in_file, ordinal, split_from, split_to: the lines of files with their places from 0, in their file and in all files.

    Files follow each other in the order of ``path`` and, within one of its entries, of their names. A scan numbers the
    rows of each split as they come; a first pass counts them, and where a split begins follows from the sums over the
    splits before it. So nothing is shuffled, sorted or sent through Python. ``split_from`` and ``split_to`` are the
    places in the file of the first and the last line of a line's split.
    """
    parts = None
    for k, one in enumerate([path] if isinstance(path, str) else path):
        scan = spark.read.text(one).select("value", F.lit(k).alias("_k"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m"))
        parts = scan if parts is None else parts.unionByName(scan)
    splits = parts.groupBy("_k", "file", "_at").agg(F.min("_m").alias("_base"), F.count(F.lit(1)).alias("_n")).collect()  # one row a split
    rows, ordinal, held, in_file = [], 0, None, 0
    for r in sorted(splits, key=lambda r: (r["_k"], r["file"], r["_at"])):
        in_file = in_file if held == (r["_k"], r["file"]) else 0
        held = (r["_k"], r["file"])
        rows.append((*held, r["_at"], ordinal - r["_base"], in_file - r["_base"], in_file, in_file + r["_n"] - 1))
        ordinal, in_file = ordinal + r["_n"], in_file + r["_n"]
    begins = spark.createDataFrame(rows, "_k int, file string, _at long, _o long, _f long, split_from long, split_to long")
    joined = parts.join(F.broadcast(begins) if len(rows) <= MAX_SPLITS else begins, ["_k", "file", "_at"])
    return joined.select("value", "file", (F.col("_m") + F.col("_f")).alias("in_file"), (F.col("_m") + F.col("_o")).alias("ordinal"), "split_from", "split_to")


def read_lines(spark: SparkSession, path: str | Sequence[str], *, skip: int = 0, comment: str | None = None) -> DataFrame:
    """value: lines without the first ``skip`` of every file and without comment lines."""
    if skip:
        lines = numbered(spark, path).filter(F.col("in_file") >= skip).select("value")
    else:
        lines = spark.read.text(path if isinstance(path, str) else list(path))
    return lines.filter(~F.col("value").startswith(comment)) if comment else lines


def read_table(
    spark: SparkSession, path: str | Sequence[str], *, sep: str = "\t", header: bool = True, names: Sequence[str] | None = None, skip: int = 0, comment: str | None = None, strip: str | None = None, unquote: bool = False, strict: bool = False
) -> DataFrame:
    """All columns as strings, by header or by ``names``. Header names lose a leading ``strip`` character.

    ``sep=None`` splits at any white space. Duplicate names are an error. An empty field is an empty string; a short
    row's missing fields are null. Every file has the header at the same line, which is checked; a later row that equals
    it is data.
    """
    first = path if isinstance(path, str) else path[0]
    if header and names is None:
        start = head(spark, first, skip + 200)
        at = next((k for k, v in enumerate(start) if k >= skip and not (comment and comment != strip and v.startswith(comment))), None)
        if at is None:
            raise ValueError(f"{first} has no header")
        line = start[at]
        names = line.split(sep) if sep else line.split()
        names = [n.lstrip(strip) if strip else n for n in names]
        names = [ft.unquote_value(n) for n in names] if unquote else names
        lines = numbered(spark, path).filter(F.col("in_file") >= at)
        other = (F.col("in_file") == at) & (F.col("value") != line)
        lines = lines.filter(F.when(other, F.raise_error(F.concat(F.lit("another header in "), "file")).cast("boolean")).otherwise(F.col("in_file") > at)).select("value")
    else:
        names = list(names or [])
        lines = read_lines(spark, path, skip=skip)
    if len(set(names)) < len(names):
        raise ValueError(f"duplicate column names in {first}")
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    fields = F.split("value", "\\Q" + sep + "\\E") if sep else F.split(F.trim("value"), r"\s+")
    if strict:  # a row with more or fewer fields is an error
        ragged = F.raise_error(F.concat(F.lit("ragged row: "), F.substring("value", 1, 80))).cast("array<string>")
        fields = F.when(F.size(fields) == len(names), fields).otherwise(ragged)
    out = lines.select(fields.alias("f"))
    value = lambda i: F.get("f", F.lit(i))
    return out.select(*((ft.unquote(value(i)) if unquote else value(i)).alias(n) for i, n in enumerate(names)))


@dataclass(frozen=True)
class TableSpec:
    """Which column plays a role and its type: role -> (name or 0-based position, type)."""

    roles: dict[str, tuple[str | int, str]]
    optional: tuple[str, ...] = ()

    def apply(self, df: DataFrame, *, rest: bool = False) -> DataFrame:
        """The roles as typed columns (unreadable values are null), then the other columns if ``rest``; an absent optional role is left out."""
        out, used = [], set()
        for role, (where, kind) in self.roles.items():
            name = df.columns[where] if isinstance(where, int) else where
            if name not in df.columns:
                if role in self.optional:
                    continue
                raise ValueError(f"no column {name!r} for {role}")
            used.add(name)
            out.append(F.col(f"`{name}`").try_cast(kind).alias(role))
        return df.select(*out, *((F.col(f"`{c}`") for c in df.columns if c not in used) if rest else ()))


MOLECULES = TableSpec({"x": ("X", "double"), "y": ("Y", "double"), "gene": ("gene", "string"), "gene_id": ("gene_id", "string"), "count": ("count", "bigint")}, ("gene_id",))


def read_minmax(spark: SparkSession, path: str) -> dict[str, float]:
    """xmin, xmax, ymin, ymax of a small file: key and value lines, a header with one row, or four numbers alone."""
    rows = [line.split() for line in read_all(spark, path).splitlines() if line.strip()]
    keys = ("xmin", "xmax", "ymin", "ymax")
    if len(rows) == 1 and len(rows[0]) == 4:
        return dict(zip(keys, map(float, rows[0])))
    if len(rows) == 2 and set(keys) <= set(rows[0]):
        return {k: float(rows[1][rows[0].index(k)]) for k in keys}
    tall = {r[0]: float(r[1]) for r in rows if len(r) == 2}
    if set(keys) <= set(tall):
        return {k: tall[k] for k in keys}
    raise ValueError(f"{path} has no bounds")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """value: the first field of each row of a list file."""
    return spark.read.text(path).select(F.split("value", r"\s+")[0].alias("value")).filter("value != ''").distinct()


def read_many(spark: SparkSession, listing: str) -> list[list[str]]:
    """The rows of a list file: paths, or sample and paths. A list without rows, or with rows of different lengths, is an error."""
    rows = [line.split() for line in read_all(spark, listing).splitlines() if line.strip() and not line.startswith("#")]
    if not rows or len({len(r) for r in rows}) > 1:
        raise ValueError(f"{listing} is no list of files")
    return rows


def read_tables(spark: SparkSession, listing: str, *, sample: str = "sample", **options) -> DataFrame:
    """The tables of a list file of (sample, path) one below the other, with the sample as a column; an empty or absent table, or another header, is an error."""
    out, first = None, None
    for name, path in ((r[0], r[-1]) for r in read_many(spark, listing)):
        one = read_table(spark, path, **options)
        first = first or one.columns
        if one.columns != first:
            raise ValueError(f"{path} has other columns: {one.columns}")
        if one.isEmpty():
            raise ValueError(f"{path} has no rows")
        one = one.withColumn(sample, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """tag_id, tag_name, tag_seq of exactly three columns; ids and sequences must be unique."""
    rows = [line.split("\t") for line in read_all(spark, path).splitlines() if line]
    if any(len(r) != 3 for r in rows):
        raise ValueError("a tag dictionary has three columns")
    for i, what in ((0, "id"), (2, "sequence")):
        if len({r[i] for r in rows}) < len(rows):
            raise ValueError(f"a tag {what} occurs twice")
    return spark.createDataFrame([tuple(r) for r in rows], "tag_id string, tag_name string, tag_seq string")


def read_colors(spark: SparkSession, path: str) -> DataFrame:
    """gene, hex of a color map: columns gene and hex, or Name and R, G, B from 0 to 1."""
    df = read_table(spark, path)
    if {"R", "G", "B"} <= set(df.columns):
        part = lambda c: F.lpad(F.hex(F.round(F.col(c).cast("double") * 255).cast("int")), 2, "0")
        return df.select(F.col("Name" if "Name" in df.columns else df.columns[0]).alias("gene"), F.concat(part("R"), part("G"), part("B")).alias("hex"))
    return df.select(F.col("gene"), F.col("hex"))


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """gene, count, bin of a JSON array; bin 0 means unassigned, negative bins are an error."""
    rows = json.loads(read_all(spark, path))
    out = [(r["gene"], int(r["count"]), int(r["bin"])) for r in rows]
    if any(b < 0 for _, _, b in out):
        raise ValueError("bins start at 0")
    return spark.createDataFrame(out, "gene string, count bigint, bin int")


def read_pixel_meta(spark: SparkSession, path: str) -> dict[str, str]:
    """The K=V pairs of the leading '##' lines; data before them is an error."""
    meta: dict[str, str] = {}
    for line in head(spark, path, 1000):
        if line.startswith("##"):
            meta |= dict(p.split("=", 1) for p in line[2:].strip().split(";") if "=" in p)
        elif line.startswith("#"):
            return meta
        else:
            raise ValueError(f"{path} has data before its header")
    return meta


def read_pixel_decode(spark: SparkSession, path: str) -> DataFrame:
    """x, y, k array<int>, p array<double> of a decoded pixel file, in its units: raw / SCALE + OFFSET."""
    meta = read_pixel_meta(spark, path)
    if missing := [k for k in ("TOPK", "SCALE", "OFFSET_X", "OFFSET_Y") if k not in meta]:
        raise ValueError(f"{path} lacks {missing}")
    top = int(meta["TOPK"])
    header = next(line for line in head(spark, path, 1000) if line.startswith("#") and not line.startswith("##"))
    names = header[1:].split("\t")
    f = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    at = lambda n, kind: F.get("f", F.lit(names.index(n))).try_cast(kind)
    s = float(meta["SCALE"])
    return f.select(
        (at("x", "double") / s + float(meta["OFFSET_X"])).alias("x"), (at("y", "double") / s + float(meta["OFFSET_Y"])).alias("y"),
        F.array(*(at(f"K{i + 1}", "int") for i in range(top))).alias("k"), F.array(*(at(f"P{i + 1}", "double") for i in range(top))).alias("p"),
    )


def write_table(df: DataFrame, path: str, *, sep: str = "\t", header: bool = True, compress: bool = True, single: bool = False, partition_by: Sequence[str] = (), max_records: int = 0) -> None:
    """A delimited table as a folder of part files; nulls are empty, nothing is quoted.

    ``single`` makes one file, for small tables; ``partition_by`` one folder a value; ``max_records`` caps each file.
    """
    w = (df.coalesce(1) if single else df).write.option("sep", sep).option("header", header).option("quote", "").option("emptyValue", "").option("nullValue", "")
    w = w.option("compression", "gzip" if compress else "none")
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def bins_json(bins: DataFrame) -> str:
    """The JSON array of (gene, count, bin) in byte order of the genes; one entry a feature."""
    rows = bins.select("gene", "count", "bin").orderBy("gene").collect()
    return json.dumps([r.asDict() for r in rows])


def write_tiles(df: DataFrame, folder: str, *, lane: str = "lane", tile: str = "tile", levels: Sequence[str] = ("all", "lane", "tile"), **options) -> None:
    """A table at three levels: folder/all, folder/lane/lane=..., folder/tile/lane=.../tile=...; one file a task and folder."""
    for level, keys in (("all", ()), ("lane", (lane,)), ("tile", (lane, tile))):
        if level in levels:
            write_table(df, f"{folder}/{level}", partition_by=keys, **options)


def write_bins(molecules: DataFrame, index: DataFrame, folder: str, *, columns: Sequence[str] | None = None, rename: dict[str, str] | None = None, skip_original: bool = False, **options) -> None:
    """Molecules with their ``bin``: folder/all (every row), folder/bins/bin=..., and folder/index.

    ``columns`` makes the tables of the bins compact, ``rename`` renames their columns, ``skip_original`` leaves all out.
    Rows without a bin, or of bin 0, are in folder/all only.
    """
    rename = rename or {}
    own = molecules.select("bin", *(F.col(c).alias(rename.get(c, c)) for c in (columns or [c for c in molecules.columns if c != "bin"])))
    if not skip_original:
        write_table(molecules, f"{folder}/all", **options)
    write_table(own.filter("bin > 0"), f"{folder}/bins", partition_by=["bin"], **options)
    write_table(index, f"{folder}/index", single=True, compress=False)


def write_batches(df: DataFrame, folder: str, *, most: int, **options) -> DataFrame:
    """Files of at most ``most`` rows in folder/batches and their list: file, rows, which is also written to folder/manifest."""
    write_table(df, f"{folder}/batches", max_records=most, header=False, **options)
    spark = df.sparkSession
    made = spark.read.text(f"{folder}/batches").select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    write_table(made.orderBy("file"), f"{folder}/manifest", single=True, compress=False)
    return made


def write_bounds(df: DataFrame, path: str, x: str, y: str) -> None:
    """The bounds of two columns as key and value lines, as ``read_minmax`` reads them."""
    one = df.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))
    tall = one.select(F.explode(F.array(*(F.concat_ws("\t", F.lit(k), F.col(k).cast("string")) for k in ("xmin", "xmax", "ymin", "ymax")))).alias("value"))
    tall.coalesce(1).write.text(path)
