"""Rendering: pixels are aggregated as rows; only the finished pixel grid goes to the driver.

A picture has width x height pixels whatever the number of points, and ``to_image`` refuses one beyond ``MAX_PIXELS``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions import geom
from stipple.functions import text as ft

MAX_PIXELS = 64_000_000


def pixels(df: DataFrame, x: str, y: str, per_pixel: float, *, xmin: float = 0.0, ymin: float = 0.0) -> DataFrame:
    """Adds px and py: the pixel of a coordinate."""
    return df.withColumns({"px": F.floor((F.col(x) - xmin) / per_pixel), "py": F.floor((F.col(y) - ymin) / per_pixel)})


def intensity(df: DataFrame, x: str, y: str, per_pixel: float, *, count: str | None = None, per_obs: int = 1, most: int = 255, xmin: float = 0.0, ymin: float = 0.0) -> DataFrame:
    """px, py, value: observations or counts per pixel times a weight, saturated. Adding up is order-free since nothing is negative."""
    own = pixels(df, x, y, per_pixel, xmin=xmin, ymin=ymin).filter("px IS NOT NULL AND py IS NOT NULL")
    total = F.sum(count) if count else F.count(F.lit(1))
    return own.groupBy("px", "py").agg(F.least(F.lit(most).cast("double"), (total * per_obs).cast("double")).cast("int").alias("value"))


def stretch(image: DataFrame, q: float = 0.99, *, most: int = 255) -> DataFrame:
    """Contrast: values at or above the discrete quantile become ``most``, the others in proportion."""
    top = image.filter("value > 0").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = top.agg(F.sum("n").alias("t")).scalar()
    cut = top.withColumn("run", run).filter(F.col("run") >= q * total).agg(F.min("value").alias("v")).scalar()
    return image.withColumn("value", F.least(F.lit(most), F.floor(F.col("value") * most / F.greatest(cut, F.lit(1))).cast("int")))


def invert(image: DataFrame, *, most: int = 255) -> DataFrame:
    """Dark for bright."""
    return image.withColumn("value", F.lit(most) - F.col("value"))


def colored_points(df: DataFrame, x: str, y: str, per_pixel: float, color: Column, *, count: Column | None = None, per_count: float = 1.0, xmin: float = 0.0, ymin: float = 0.0) -> DataFrame:
    """px, py, r, g, b: colors added up per pixel, weighted by count, each channel saturated. ``color`` is a struct r, g, b."""
    w = (count if count is not None else F.lit(1)) * F.lit(float(per_count))
    own = pixels(df, x, y, per_pixel, xmin=xmin, ymin=ymin).filter("px IS NOT NULL AND py IS NOT NULL").withColumn("_c", color).filter("_c IS NOT NULL")
    sums = [F.least(F.lit(255.0), F.sum(F.col(f"_c.{k}") * w)).cast("int").alias(k) for k in "rgb"]
    return own.groupBy("px", "py").agg(*sums)


def layers(parts: Sequence[tuple[DataFrame, str]], x: str, y: str, per_pixel: float) -> DataFrame:
    """px, py, r, g, b of several point tables, each with its hex color."""
    out = None
    for df, color in parts:
        one = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), ft.hex_color(F.lit(color)).alias("c"))
        out = one if out is None else out.unionByName(one)
    return colored_points(out, "x", "y", per_pixel, F.col("c"))


def by_gene(df: DataFrame, colors: DataFrame, per_pixel: float, *, x: str = "x", y: str = "y", gene: str = "gene", count: str = "count", per_count: float = 1.0) -> DataFrame:
    """Molecules in the color of their gene (gene, hex); genes without a color aren't drawn."""
    own = df.join(colors.select(F.col("gene").alias(gene), ft.hex_color(F.col("hex")).alias("_rgb")), gene)
    return colored_points(own, x, y, per_pixel, F.col("_rgb"), count=F.col(count), per_count=per_count)


def fill_polygons(rings: Sequence[tuple[Sequence[float], Sequence[float], str]], width: int, height: int, *, opacity: float = 0.5, scale: float = 1.0, xmin: float = 0.0, ymin: float = 0.0) -> np.ndarray:
    """An RGB array of rings (xs, ys, hex) blended over black in their order, which decides where they overlap.

    Blending depends on order, so this renders on the driver; the rings are what a picture shows.
    """
    if width * height > MAX_PIXELS:
        raise ValueError("the picture is too large")
    image = np.zeros((height, width, 3))
    for xs, ys, color in rings:
        i, j = geom.scan_fill((np.asarray(xs, dtype=float) - xmin) / scale, (np.asarray(ys, dtype=float) - ymin) / scale)
        ok = (i >= 0) & (i < width) & (j >= 0) & (j < height)
        rgb = np.array(ft.hex_color_value(color)[:3], dtype=float)
        image[j[ok], i[ok]] = image[j[ok], i[ok]] * (1 - opacity) + rgb * opacity
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def gray_to_rgba(
    gray: np.ndarray, *, rgb: str = "FFFFFF", below: int = 0, above: int = 255, how: str = "constant", alpha_max: int = 255, linear: float = 1.0, root: float = 16.0, invert_alpha: bool = False
) -> np.ndarray:
    """A gray picture as one color with transparency by brightness: 'constant', 'linear' or 'sqrt' alpha.

    Pixels darker than ``below`` or brighter than ``above`` are transparent; ``invert_alpha`` takes 255 - alpha.
    """
    g = gray.astype(float)
    alpha = {"constant": np.full_like(g, alpha_max), "linear": g * linear, "sqrt": np.sqrt(g) * root}[how]
    alpha = np.clip(np.rint(alpha), 0, 255)
    if invert_alpha:
        alpha = 255 - alpha
    alpha = np.where((gray < below) | (gray > above), 0, alpha)
    out = np.empty((*gray.shape, 4), dtype=np.uint8)
    out[..., :3] = ft.hex_color_value(rgb)[:3]
    out[..., 3] = alpha
    return out


def to_image(df: DataFrame, width: int, height: int, channels: Sequence[str] = ("r", "g", "b")) -> np.ndarray:
    """The pixel rows as an array height x width x channels; pixels outside are cut off, absent ones are 0."""
    if width * height > MAX_PIXELS:
        raise ValueError("the picture is too large")
    inside = df.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).select("px", "py", *channels)
    table = inside.toPandas()  # at most one row a pixel
    image = np.zeros((height, width, len(channels)), dtype=np.uint8)
    image[table["py"].to_numpy(), table["px"].to_numpy()] = table[list(channels)].to_numpy()
    return image


def unit_picture(df: DataFrame, per_pixel: float, *, x: str = "x", y: str = "y", unit: str = "unit", color: str = "color", count: str = "count", q: float | None = 0.99, xmin: float = 0.0, ymin: float = 0.0) -> DataFrame:
    """px, py, r, g, b: units in their hex colors, each scaled so that the quantile of its sums per pixel is full color.

    With ``q=None`` a count is full color. Channels are added over the units and saturated. Rows without a unit, a
    readable color or a positive count are passed over.
    """
    own = pixels(df, x, y, per_pixel, xmin=xmin, ymin=ymin).filter(F.col("px").isNotNull() & F.col("py").isNotNull() & F.col(unit).isNotNull() & (F.col(count) > 0))
    sums = own.groupBy(unit, color, "px", "py").agg(F.sum(count).alias("s"))
    if q is None:
        sums = sums.withColumn("level", F.lit(1.0))
    else:
        sums = sums.join(sums.groupBy(unit).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY s)").alias("level")), unit)
    rgb = ft.hex_color(F.col(color))
    own = sums.withColumn("_c", rgb).filter("_c IS NOT NULL").withColumn("_f", F.least(F.lit(1.0), F.col("s") / F.col("level")))
    channels = [F.least(F.lit(255), F.sum(F.floor(F.col(f"_c.{k}") * F.col("_f")))).cast("int").alias(k) for k in "rgb"]
    return own.groupBy("px", "py").agg(*channels)


def filled_regions(regions: DataFrame, *, order: str, color: str = "color", xs: str = "xs", ys: str = "ys", opacity: float = 0.5, scale: float = 1.0, xmin: float = 0.0, ymin: float = 0.0) -> DataFrame:
    """px, py, r, g, b: regions filled in their hex colors and blended over black in an order, pixel by pixel.

    ``fill_polygons`` over a table: every region is filled where it is, and what covers a pixel meets there alone.
    """
    kind = dict(regions.dtypes)[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, c, a, b in zip(pdf["at"], pdf["c"], pdf["xs"], pdf["ys"]):
                i, j = geom.scan_fill((np.asarray(a, dtype=float) - xmin) / scale, (np.asarray(b, dtype=float) - ymin) / scale)
                if len(i):
                    yield pd.DataFrame({"px": i, "py": j, "at": at, "c": c})

    usable = regions.filter((F.size(xs) == F.size(ys)) & (F.size(xs) >= 3)).select(F.col(order).alias("at"), F.col(color).alias("c"), F.col(xs).alias("xs"), F.col(ys).alias("ys"))
    own = usable.mapInPandas(run, f"px long, py long, at {kind}, c string").withColumn("c", ft.hex_color(F.col("c"))).filter("c IS NOT NULL")
    stack = own.groupBy("px", "py").agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("_s"))
    blend = lambda k: F.aggregate("_s", F.lit(0.0), lambda v, z: v * (1 - opacity) + z["c"][k] * opacity)
    return stack.select("px", "py", *(F.floor(blend(k) + 0.5).cast("int").alias(k) for k in "rgb"))


def rgba(image: DataFrame, *, rgb: str = "FFFFFF", below: int = 0, above: int = 255, how: str = "constant", alpha_max: int = 255, linear: float = 1.0, root: float = 16.0, invert_alpha: bool = False) -> DataFrame:
    """px, py, r, g, b, a of gray pixels (px, py, value): ``gray_to_rgba`` as expressions."""
    if how not in ("constant", "linear", "sqrt"):
        raise ValueError("how must be 'constant', 'linear' or 'sqrt'")
    g = F.col("value").cast("double")
    alpha = {"constant": F.lit(float(alpha_max)), "linear": g * linear, "sqrt": F.sqrt(g) * root}[how]
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(alpha)))
    alpha = 255 - alpha if invert_alpha else alpha
    shown = F.when((F.col("value") < below) | (F.col("value") > above), 0).otherwise(alpha).cast("int").alias("a")
    return image.select("px", "py", *(F.lit(v).alias(k) for k, v in zip("rgb", ft.hex_color_value(rgb))), shown)
