"""Text helpers as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unquote(c: Column) -> Column:
    """A value without the matching single or double quotes around it; a lone quote stays."""
    return F.when(c.rlike("(?s)\\A(\".*\"|'.*')\\z") & (F.length(c) >= 2), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def unquote_value(v: str) -> str:
    """``unquote`` of one value, for header names."""
    return v[1:-1] if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'" else v


def number_format(c: Column, scale: float = 1.0, style: str | None = None, precision: int | None = None) -> Column:
    """c * scale as text: style 'f' fixed, 'e' scientific, 'g' shortest, None the default text of the number.

    Fixed output is formatted in the JVM; 'e' and 'g' follow C, which Java's formatter doesn't, and are pandas UDFs.
    """
    value = c.cast("double") * F.lit(float(scale))
    if style is None:
        return value.cast("string")
    digits = 6 if precision is None or precision < 0 else precision
    if style == "f":
        return F.format_string(f"%.{digits}f", value)
    if style not in ("e", "g"):
        raise ValueError("style must be 'f', 'e' or 'g'")
    spec = f"%.{digits}{style}"

    @F.pandas_udf("string")
    def fmt(v: pd.Series) -> pd.Series:
        return v.map(lambda x: spec % x, na_action="ignore").astype("object").where(v.notna(), None)

    return fmt(value)


def comma_ints(c: Column) -> Column:
    """A comma list of counts as array<bigint>; unreadable entries are null."""
    return F.transform(F.split(c, ","), lambda v: F.trim(v).try_cast("bigint"))


def ints_comma(c: Column) -> Column:
    """The comma list of an array."""
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def subfield(c: Column, index: int, sep: str = ",") -> Column:
    """The entry of a list at a position from 0; null beyond its end."""
    return F.get(F.split(c, re.escape(sep)), F.lit(index))


def hex_color(c: Column) -> Column:
    """struct<r, g, b, a> of '#RRGGBB' or '#RRGGBBAA', with or without '#'; null for anything else."""
    h = F.regexp_replace(F.trim(c), r"\A#", "")
    part = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("int")
    ok = h.rlike(r"\A[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?\z")
    return F.when(ok, F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.when(F.length(h) == 8, part(7)).otherwise(255).alias("a")))


def hex_color_value(v: str) -> tuple[int, int, int, int]:
    """``hex_color`` of one value."""
    h = v.strip().lstrip("#")
    if not re.fullmatch(r"[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?", h):
        raise ValueError(f"not a color: {v!r}")
    p = [int(h[i : i + 2], 16) for i in range(0, len(h), 2)]
    return (*p[:3], p[3] if len(p) > 3 else 255)


def is_digits(c: Column) -> Column:
    """Whether a text is ASCII digits alone."""
    return c.rlike(r"\A[0-9]+\z")


def coordinate(c: Column, digits: int = 2) -> Column:
    """A coordinate as text: an integer without decimals, any other with a fixed number of them."""
    value = c.cast("double")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string(f"%.{digits}f", value))
