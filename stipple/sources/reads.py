"""Sequencing reads: four-line records, alone, in pairs or in fours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.sources import text_tables as tt


_RECORDS = "read_id long, line long, n string, s string, p string, q string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four lines in a row as one record, by array operations; lines whose record another split holds a part of stay lines (``line``, ``n``)."""
    schema = pa.schema([("read_id", pa.int64()), ("line", pa.int64()), *((c, pa.string()) for c in "nspq")])

    def rows(ids: pa.Array | None, lines: pa.Array | None, texts: list[pa.Array]) -> pa.RecordBatch:
        size = len(texts[0])
        columns = [pa.nulls(size, pa.int64()) if c is None else c for c in (ids, lines)] + texts + [pa.nulls(size, pa.string())] * (4 - len(texts))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def whole(table: pa.Table, final: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        at, text = table.column("ordinal").to_numpy(), table.column("value").combine_chunks()
        begin = np.flatnonzero(at % 4 == 0)
        begin = begin[begin + 3 < len(at)]
        begin = begin[at[begin + 3] == at[begin] + 3]
        used = np.zeros(len(at), dtype=bool)
        for k in range(4):
            used[begin + k] = True
        rest = np.flatnonzero(~used)
        # the last lines may go on in the next batch
        keep = rest[rest > (begin[-1] if len(begin) else -1)] if not final else rest[:0]
        keep = keep[-3:] if len(keep) else keep
        lone = np.setdiff1d(rest, keep)
        out = [rows(pa.array(at[begin] // 4), None, [text.take(pa.array(begin + k)) for k in range(4)])] if len(begin) else []
        if len(lone):
            out.append(rows(None, pa.array(at[lone]), [text.take(pa.array(lone))]))
        return out, table.take(pa.array(keep))

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        out, held = whole(table if held is None else pa.concat_tables([held, table]), False)
        yield from out
    if held is not None and held.num_rows:
        yield from whole(held, True)[0]


def read_fastq(spark: SparkSession, path: str | Sequence[str], *, suffix: str = "") -> DataFrame:
    """read_id from 0 in the files' order, name, seq, qual; a record whose third line isn't '+...' is an error.

    Lines are numbered by their place in all files. Records inside a split are put together where they are; only the
    lines of records that a split boundary cuts are shuffled, at most six a split (found by reading the files once more),
    and any splitting gives the same.
    """
    lines = tt.numbered(spark, path)
    made = lines.select("ordinal", "value").mapInArrow(_records, _RECORDS)
    rows = made.filter("line IS NULL").select("read_id", "n", "s", "p", "q")
    cut, part = made.filter("line IS NOT NULL"), F.col("line") % 4
    at = lambda k: F.max(F.when(part == k, F.col("n")))
    rows = rows.unionByName(cut.groupBy(F.floor(F.col("line") / 4).alias("read_id")).agg(at(0).alias("n"), at(1).alias("s"), at(2).alias("p"), at(3).alias("q")))
    bad = ~F.coalesce(F.col("p").startswith("+") & F.col("n").startswith("@") & F.col("q").isNotNull(), F.lit(False))
    name = F.when(bad, F.raise_error(F.concat(F.lit("broken record "), F.col("read_id").cast("string")))).otherwise(F.regexp_replace("n", "^@", ""))
    return rows.select("read_id", name.alias(f"name{suffix}"), F.col("s").alias(f"seq{suffix}"), F.col("q").alias(f"qual{suffix}"))


def read_mates(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files in lock step: suffix -> path, such as {'1': r1, '2': r2}. Files of different lengths are an error."""
    out = None
    for suffix, path in paths.items():
        one = read_fastq(spark, path, suffix=suffix)
        out = one if out is None else out.join(one, "read_id", "full")
    first = next(iter(paths))
    lone = F.lit(False)
    for suffix in paths:
        lone = lone | F.col(f"seq{suffix}").isNull()
    return out.withColumn(f"seq{first}", F.when(lone, F.raise_error("the files have different numbers of reads")).otherwise(F.col(f"seq{first}")))


def fastq_lines(df: DataFrame, *, suffix: str = "") -> DataFrame:
    """value: records as text of four lines, in the order of read_id."""
    return df.select("read_id", F.concat_ws("\n", F.concat(F.lit("@"), f"name{suffix}"), f"seq{suffix}", F.lit("+"), f"qual{suffix}").alias("value"))


def write_fastq(df: DataFrame, path: str, *, suffix: str = "", partition_by: Sequence[str] = (), compress: bool = True) -> None:
    """Records in order within part files, which follow each other by range; with ``partition_by`` one folder a sample."""
    keys = [F.col(c) for c in partition_by]
    text = F.concat_ws("\n", F.concat(F.lit("@"), f"name{suffix}"), f"seq{suffix}", F.lit("+"), f"qual{suffix}")
    own = df.repartitionByRange(*keys, "read_id").sortWithinPartitions(*keys, "read_id").select(*keys, text.alias("value"))
    w = own.write.option("compression", "gzip" if compress else "none")
    (w.partitionBy(*partition_by) if partition_by else w).text(path)
