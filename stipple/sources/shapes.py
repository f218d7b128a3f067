"""Region boundaries from GeoJSON and vertex tables, label masks, and pictures."""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.sources import text_tables as tt

_REGION = "region string, part int, xs array<double>, ys array<double>"


def _values(text: str) -> Iterator[Any]:
    """JSON values one after another."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text):
            return
        value, at = decoder.raw_decode(text, at)
        yield value


def rings(value: Any, attr: str, *, holes: str = "ignore", prefix: Any = None) -> Iterator[tuple[str | None, list[float], list[float]]]:
    """(id, xs, ys) of the outer rings of a Feature, FeatureCollection or bare geometry.

    ``holes`` is 'ignore' or 'error'. Rings of fewer than 3 points are dropped. An id may be text or a number.
    """
    if isinstance(value, list):
        for v in value:
            yield from rings(v, attr, holes=holes)
        return
    kind = value.get("type")
    if kind == "FeatureCollection":
        for v in value.get("features") or ():
            yield from rings(v, attr, holes=holes)
        return
    geometry = value.get("geometry", value) if kind in (None, "Feature") else value
    ident = (value.get("properties") or {}).get(attr, prefix)
    if ident is not None and not isinstance(ident, str):
        ident = json.dumps(ident)
    polygons = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get((geometry or {}).get("type"))
    if polygons is None:
        return
    for poly in polygons(geometry["coordinates"]):
        if holes == "error" and len(poly) > 1:
            raise ValueError("a polygon has holes")
        if poly and len(poly[0]) >= 3:
            yield ident, [float(p[0]) for p in poly[0]], [float(p[1]) for p in poly[0]]


def read_geojson(spark: SparkSession, path: str, *, attr: str = "cell_id", holes: str = "ignore", by_line: bool = False) -> DataFrame:
    """region, part, xs, ys of GeoJSON: a collection, a feature, or values one after another.

    ``by_line`` reads files of one value a line, split like any text; other files are parsed whole, each in a task.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                for value in _values(text):
                    out += [(r[0], k, r[1], r[2]) for k, r in enumerate(rings(value, attr, holes=holes))]
            yield pd.DataFrame(out, columns=["region", "part", "xs", "ys"])

    return spark.read.option("wholetext", not by_line).text(path).mapInPandas(parse, _REGION)


def read_vertex_table(spark: SparkSession, path: str, *, sep: str = ",", region: str = "cell_id", x: str = "vertex_x", y: str = "vertex_y") -> DataFrame:
    """region, xs, ys of a table of vertices: a region's vertices in the file's order, even if regions alternate."""
    names = [n.strip().strip("\"'") for n in tt.head(spark, path, 1)[0].split(sep)]
    lines = tt.numbered(spark, path).filter("in_file > 0").select("ordinal", F.split("value", "\\Q" + sep + "\\E").alias("f"))
    at = lambda n: F.regexp_replace(F.get("f", F.lit(names.index(n))), "^[\"']|[\"']$", "")
    v = lines.select(at(region).alias("region"), F.struct("ordinal", at(x).try_cast("double").alias("x"), at(y).try_cast("double").alias("y")).alias("v"))
    own = v.groupBy("region").agg(F.array_sort(F.collect_list("v")).alias("v"))  # the vertices of one region
    return own.select("region", F.col("v.x").alias("xs"), F.col("v.y").alias("ys"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """i, j, seg of a two-dimensional integer array file (.npy), without the background 0."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                a = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                i, j = np.nonzero(a)
                yield pd.DataFrame({"i": i.astype(np.int64), "j": j.astype(np.int64), "seg": a[i, j].astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "i long, j long, seg long")


def png(image: np.ndarray) -> bytes:
    """An 8-bit gray (h, w), RGB (h, w, 3) or RGBA (h, w, 4) array as PNG."""
    a = np.ascontiguousarray(image, dtype=np.uint8)
    if a.ndim == 3 and a.shape[2] == 1:
        a = a[..., 0]
    color = 0 if a.ndim == 2 else {3: 2, 4: 6}[a.shape[2]]
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), a.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def read_gray_png(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit PNG with one channel, not interlaced; any other is an error."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, w = 8, b"", 0
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, laced = struct.unpack(">IIBBBBB", part)
            if depth != 8 or color != 0 or laced:
                raise ValueError("an 8-bit gray picture is expected")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, w + 1)
    out = np.zeros((h, w), dtype=np.int64)
    up = np.zeros(w, dtype=np.int64)
    for j in range(h):
        how, line = int(raw[j, 0]), raw[j, 1:].astype(np.int64)
        if how == 2:
            line = (line + up) & 255
        elif how:  # left, average and Paeth depend on the pixel before
            left = corner = 0
            for i in range(w):
                above = int(up[i])
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((left, above, corner), key=lambda v: abs(p - v))
                left = int(line[i] + guess) & 255
                corner, line[i] = above, left
        out[j] = up = line
    return out.astype(np.uint8)


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """file, px, py, value: the pixels that aren't black of 8-bit gray pictures, each read in a task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                image = read_gray_png(bytes(content))
                y, x = np.nonzero(image)
                yield pd.DataFrame({"file": name, "px": x.astype(np.int64), "py": y.astype(np.int64), "value": image[y, x].astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, px long, py long, value int")
