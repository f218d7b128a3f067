"""Projections: choosing, renaming, scaling, composing and moving columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions import text as ft


def choose(df: DataFrame, spec: str | Sequence[str], *, include_rest: bool = False, unquote: bool = False) -> DataFrame:
    """Columns by a list of 'name', 'old:new' or ':new:constant', then with ``include_rest`` the others in their order.

    A column may be chosen once; a name that is missing or would occur twice in the output is an error.
    """
    parts = spec.split(",") if isinstance(spec, str) else list(spec)
    chosen: list[tuple[str, Column]] = []
    used: set[str] = set()
    for part in parts:
        if part.startswith(":"):
            _, name, value = part.split(":", 2)
            chosen.append((name, F.lit(value)))
            continue
        old, _, new = part.partition(":")
        if old not in df.columns:
            raise ValueError(f"no column {old!r}")
        if old in used:
            raise ValueError(f"column {old!r} is chosen twice")
        used.add(old)
        c = F.col(f"`{old}`")
        chosen.append((new or old, ft.unquote(c) if unquote and dict(df.dtypes)[old] == "string" else c))
    if include_rest:
        chosen += [(c, F.col(f"`{c}`")) for c in df.columns if c not in used]
    names = [n for n, _ in chosen]
    if len(set(names)) < len(names):
        raise ValueError(f"names occur twice: {sorted({n for n in names if names.count(n) > 1})}")
    return df.select(*(c.alias(n) for n, c in chosen))


def keep_or_drop(df: DataFrame, *, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """The named columns in their order in the table, or all but the named; naming both or a missing one is an error."""
    if include and exclude:
        raise ValueError("include and exclude exclude each other")
    names = list(include or exclude or ())
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    if not names:
        return df
    return df.select(*(c for c in df.columns if (c in names) == bool(include)))


def prefix(df: DataFrame, columns: Sequence[str], with_: str) -> DataFrame:
    """Puts a prefix before the named columns."""
    return df.withColumnsRenamed({c: f"{with_}{c}" for c in columns})


def scaled(df: DataFrame, formats: dict[str, tuple[float, str | None, int | None]]) -> DataFrame:
    """Columns times a factor, as text in a number format (see ``functions.text.number_format``)."""
    return df.withColumns({c: ft.number_format(F.col(c), *f) for c, f in formats.items()})


def to_units(df: DataFrame, columns: Sequence[str], units_per_um: float, precision: int | None = None) -> DataFrame:
    """Coordinates in micrometres; with a precision as fixed-point text."""
    value = lambda c: F.col(c) / F.lit(float(units_per_um))
    return df.withColumns({c: value(c) if precision is None else F.format_string(f"%.{precision}f", value(c)) for c in columns})


def jitter(df: DataFrame, columns: Sequence[str], by: float, *, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Moves coordinates by up to ``by`` either way, by a hash of the row's key: the same at every run and partitioning."""
    unit = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.withColumns({c: F.col(c) + (unit(c) * 2 - 1) * by for c in columns})


def affine(df: DataFrame, columns: dict[str, tuple[float, float]]) -> DataFrame:
    """raw / scale + offset for column -> (scale, offset)."""
    return df.withColumns({c: F.col(c) / F.lit(float(s)) + F.lit(float(o)) for c, (s, o) in columns.items()})


def shift_to_origin(df: DataFrame, moves: dict[str, tuple[float, float]]) -> DataFrame:
    """c + offset - minimum, not below 0, for column -> (offset, minimum)."""
    return df.withColumns({c: F.greatest(F.col(c) + F.lit(o) - F.lit(m), F.lit(0).cast("double")) for c, (o, m) in moves.items()})


def layout_offsets(layout: DataFrame, extents: DataFrame, *, row_gap: float = 0.0, col_gap: float = 0.0) -> DataFrame:
    """Adds x_offset and y_offset to a layout of (row, col[, rowshift, colshift]) by the largest tile of ``extents``.

    ``extents`` has one row per tile with xmin, xmax, ymin, ymax; its largest extents are a scalar subquery.
    """
    dx = extents.agg(F.max(F.col("xmax") - F.col("xmin")).alias("v")).scalar()
    dy = extents.agg(F.max(F.col("ymax") - F.col("ymin")).alias("v")).scalar()
    at = lambda n, gap: (gap + 1) * (F.col(n) - 1) + (F.coalesce(f"{n}shift", F.lit(0.0)) if f"{n}shift" in layout.columns else F.lit(0.0))
    return layout.withColumn("x_offset", dx * at("row", row_gap)).withColumn("y_offset", dy * at("col", col_gap))


def global_nm(df: DataFrame, *, nm: float = 34.78) -> DataFrame:
    """Tile-local px, py to global nanometres: x mirrored in its tile, then the axes swapped, truncated to bigint.

    Needs px, py, x_offset, y_offset, xmax and ymin.
    """
    gx = (F.col("x_offset") + F.col("xmax") - F.col("px")) * nm
    gy = (F.col("py") + F.col("y_offset") - F.col("ymin")) * nm
    return df.withColumns({"px": gy.cast("bigint"), "py": gx.cast("bigint")})


def compose_id(df: DataFrame, columns: Sequence[str], *, name: str = "cell_id", delim: str = ":") -> DataFrame:
    """One id of several columns."""
    return df.withColumn(name, F.concat_ws(delim, *(F.col(c).cast("string") for c in columns)))


def random_key(df: DataFrame, key: Sequence[str], *, name: str = "random_key", seed: int = 0) -> DataFrame:
    """An eight-digit hexadecimal key by a hash of the row's key: shuffles like a random one, but is the same at every run."""
    return df.withColumn(name, F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), *key).bitwiseAND(0xFFFFFFFF))), 8, "0"))


def unique_names(features: DataFrame, *, name: str = "name", ident: str = "id", order: str = "nid", how: str = "version") -> DataFrame:
    """Features with names that occur once: 'version' appends _v1, _v2... in order, 'id' appends the id; 'error' raises at run time."""
    w = Window.partitionBy(name)
    n = F.count(F.lit(1)).over(w)
    if how == "version":
        new = F.concat_ws("_v", F.col(name), F.row_number().over(w.orderBy(order, ident)).cast("string"))
    elif how == "id":
        new = F.concat_ws("_", name, ident)
    elif how == "error":
        new = F.raise_error(F.concat(F.lit("duplicate name: "), F.col(name)))
    else:
        raise ValueError("how must be 'version', 'id' or 'error'")
    return features.withColumn(name, F.when(n > 1, new).otherwise(F.col(name)))


def drop_random_key(df: DataFrame, *, name: str = "random_key", keep: bool = False) -> DataFrame:
    """Without the random key, unless it is to be kept."""
    return df if keep else df.drop(name)


def order_by_total(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns, the largest total first and ties by the later column, behind the others. One row goes to the driver."""
    totals = df.agg(*(F.sum(c).alias(f"c{i}") for i, c in enumerate(columns))).first()
    order = sorted(range(len(columns)), key=lambda i: (totals[i] or 0, i), reverse=True)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *(columns[i] for i in order))


def relay_fastq(df: DataFrame, *, skip: int = 0, len_bcd: int = 30, len_umi: int = 9, len_r2: int = 101, revcomp_r1: bool = False, revcomp_r2: bool = False) -> DataFrame:
    """New read pairs: R1 is its barcode followed by R2's first bases (the UMI), R2 is cut to length; qualities alike.

    Reverse complementing applies to the barcode part of R1 and to R2; qualities are reversed with it.
    Columns seq1, qual1, seq2, qual2 are replaced.
    """
    from stipple.functions import seq

    b, q = F.substring("seq1", skip + 1, len_bcd), F.substring("qual1", skip + 1, len_bcd)
    s2, q2 = F.substring("seq2", 1, len_r2), F.substring("qual2", 1, len_r2)
    umi, umi_q = F.substring("seq2", 1, len_umi), F.substring("qual2", 1, len_umi)
    if revcomp_r1:
        b, q = seq.revcomp(b), seq.rev(q)
    if revcomp_r2:
        s2, q2 = seq.revcomp(s2), seq.rev(q2)
    return df.withColumns({"seq1": F.concat(b, umi), "qual1": F.concat(q, umi_q), "seq2": s2, "qual2": q2})


def grid_offsets(layout: DataFrame, extents: DataFrame, *, on: str = "tile") -> DataFrame:
    """Adds x_offset and y_offset to a layout of (on, row, col): the heights of all rows and widths of all columns before.

    A row is as high as its highest tile (xmax - xmin + 1), a column as wide as its widest (ymax - ymin + 1); rows and
    columns without tiles take no room. ``extents`` has on, xmin, xmax, ymin, ymax. Rows and columns below 1 are an error.
    The running sums are over one row a grid row or column.
    """
    own = layout.join(extents.select(on, (F.col("xmax") - F.col("xmin") + 1).alias("_h"), (F.col("ymax") - F.col("ymin") + 1).alias("_w")), on)
    bad = (F.col("row") < 1) | (F.col("col") < 1)
    own = own.withColumn("row", F.when(bad, F.raise_error("rows and columns start at 1").cast(dict(own.dtypes)["row"])).otherwise(F.col("row")))
    for key, size, name in (("row", "_h", "x_offset"), ("col", "_w", "y_offset")):
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        sums = own.groupBy(key).agg(F.max(size).alias("_s")).select(key, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(name))
        own = own.join(sums, key)
    return own.select(*layout.columns, "x_offset", "y_offset")
