"""Rows that fail to parse, separated with the reason while the valid rows load.

Every field is first nullable text; cast and constraint rules then fill an array of errors, one entry a broken rule with
the field's name and text, and rows are split by whether that array is empty. All of it is column expressions in one pass over the lines, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field in quotes or without any; possessive, so that long fields need no stack.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)|[^\t"]*+)'
#: A finite decimal: optional minus, digits, optional fraction, optional exponent.
_DECIMAL = r"\A-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
INT_MAX, LONG_MAX = 2**31 - 1, 2**63 - 1


@dataclass(frozen=True)
class Layout:
    """The fields of one kind of line: name -> 'decimal', 'text', 'int' or 'long'."""

    fields: dict[str, str] = field(default_factory=dict)


MOLECULE = Layout({"x": "decimal", "y": "decimal", "gene": "text", "gene_id": "text", "count": "int"})
BARCODE = Layout({"strid": "text", "lane": "int", "tile": "int", "px": "long", "py": "long", "mismatches": "int"})


def _up_to(c: Column, most: int) -> Column:
    """ASCII digits alone, of a value up to ``most``; leading zeros don't count."""
    digits, bare = len(str(most)), F.regexp_replace(c, r"\A0+", "")
    return c.rlike(r"\A[0-9]+\z") & ((F.length(bare) < digits) | ((F.length(bare) == digits) & (bare <= str(most))))


def _valid(c: Column, kind: str) -> Column:
    if kind == "decimal":
        return c.rlike(_DECIMAL) & (F.abs(c.try_cast("double")) < float("inf"))
    if kind == "text":
        return F.length(c) > 0
    return _up_to(c, INT_MAX if kind == "int" else LONG_MAX)


def parse_lines(df: DataFrame, layouts: dict[str, Layout], *, kind: str = "kind", line: str = "line") -> DataFrame:
    """Adds ``errors array<struct<reason, field, value>>`` and ``fields array<string>`` (unquoted text) to every row.

    One carriage return at the end and one byte-order mark at the start are dropped. There is one error a broken rule, in
    this order: 'quoting' (a quote that neither opens, closes nor is doubled in a quoted field; the line has no fields
    then, so no other rule applies), 'columns' (not as many fields as the layout has; the value is their number), 'value'
    (a field breaks its type; with its name and text), in the layout's order, and for the fields that there are. A null
    line is an empty one; a null or unknown kind fits no number of columns. Existing columns stay, except ones named
    errors or fields.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    text = F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    out = df.withColumn("_clean", F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text))
    plain = F.instr("_clean", '"') == 0  # most lines have no quote and need no pattern
    out = out.withColumn("_good", plain | F.col("_clean").rlike(rf"\A{_FIELD}(?:\t{_FIELD})*+\z"))
    # a tab before every field makes each match non-empty
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), F.col("_clean")), F.lit(rf"\t({_FIELD})"), F.lit(1))
    unquoted = F.transform(raw, lambda v: F.when(v.startswith('"'), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))
    out = out.withColumn("fields", F.when(plain, F.split("_clean", "\t")).when(F.col("_good"), unquoted))
    error = lambda reason, name, value: F.struct(F.lit(reason).alias("reason"), F.lit(name).cast("string").alias("field"), value.cast("string").alias("value"))
    none = F.lit(None).cast("struct<reason:string,field:string,value:string>")
    wanted = F.lit(None).cast("int")
    for name, layout in layouts.items():
        wanted = F.when(F.col(kind) == name, len(layout.fields)).otherwise(wanted)
    errors = F.when(F.col(kind).isin(list(layouts)), F.lit(None)).otherwise(F.array(none))
    for name, layout in layouts.items():
        rules = []
        for i, (field_name, how) in enumerate(layout.fields.items()):
            value = F.get("fields", F.lit(i))
            rules.append(F.when(value.isNotNull() & ~F.coalesce(_valid(value, how), F.lit(False)), error("value", field_name, value)))
        errors = F.when(F.col(kind) == name, F.array(*rules)).otherwise(errors)
    first = F.when(~F.col("_good"), error("quoting", None, F.lit(None))).when(~F.coalesce(F.size("fields") == wanted, F.lit(False)), error("columns", None, F.size("fields")))
    return out.withColumn("errors", F.array_compact(F.concat(F.array(first), F.coalesce(errors, F.array(none))))).drop("_clean", "_good")


def rejected(parsed: DataFrame) -> DataFrame:
    """The failing rows with the reason of their first error."""
    # taken out by a generator, which evaluates the rules once and drops rows with an empty array
    rest = [c for c in parsed.columns if c not in ("errors", "fields", "reason")]
    return parsed.select(*rest, F.explode(F.slice("errors", 1, 1)).alias("_e")).select(*rest, F.col("_e.reason").alias("reason"))


def broken_rules(parsed: DataFrame, *, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """One row an error: the columns in ``keep``, rank from 1, reason, field and value."""
    return parsed.select(*keep, F.posexplode("errors").alias("_p", "_e")).select(*keep, (F.col("_p") + 1).alias("rank"), "_e.reason", "_e.field", "_e.value")


def accepted(parsed: DataFrame, name: str, layout: Layout, *, keep: tuple[str, ...] = ("line_id",), kind: str = "kind") -> DataFrame:
    """The valid rows of one kind as typed columns, behind the columns in ``keep``."""
    types = {"decimal": "double", "text": "string", "int": "int", "long": "bigint"}
    rows = parsed.filter((F.col(kind) == name) & (F.size("errors") == 0))
    return rows.select(*keep, *(F.get("fields", F.lit(i)).try_cast(types[how]).alias(c) for i, (c, how) in enumerate(layout.fields.items())))
