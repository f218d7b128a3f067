"""Sequence functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nucleotide ambiguity codes, the bases each stands for, and their complements.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "R": "Y", "Y": "R", "S": "S", "W": "W", "K": "M", "M": "K", "B": "V", "V": "B", "D": "H", "H": "D", "N": "N"}
#: Base-5 digits in this order keep the order of the letters A C G N T.
BASE5 = "ACGNT"
#: The longest sequences whose code fits a bigint.
MAX_NT5, MAX_BITS = 27, 31


def revcomp(c: Column) -> Column:
    """Reverse complement; ambiguity codes are complemented, case is kept, other characters stay."""
    src, dst = "".join(COMPLEMENT), "".join(COMPLEMENT.values())
    return F.translate(F.reverse(c), src + src.lower(), dst + dst.lower())


def rev(c: Column) -> Column:
    """The sequence or quality string backwards."""
    return F.reverse(c)


def piece(c: Column, start: int, length: int) -> Column:
    """``length`` characters from the 1-based position."""
    return F.substring(c, start, length)


def intervals(c: Column, spec: str) -> Column:
    """The characters at 1-based inclusive intervals such as '1-10,15-20', joined."""
    parts = []
    for part in spec.split(","):
        low, _, high = part.partition("-")
        a, b = int(low), int(high or low)
        if a < 1 or b < a:
            raise ValueError(f"bad interval {part!r}")
        parts.append(piece(c, a, b - a + 1))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def iupac_mismatches(c: Column, pattern: str) -> Column:
    """Positions of the pattern at which the read has a base outside of the code's set; the pattern's N matches anything.

    A read shorter than the pattern mismatches where it has ended. Null for a null read.
    """
    total = F.lit(0)
    for i, code in enumerate(pattern.upper()):
        if code == "N":
            continue
        base = F.upper(F.substring(c, i + 1, 1))
        total = total + F.when(base.isin(*IUPAC[code]), 0).otherwise(1)
    return F.when(c.isNotNull(), total)


def iupac_regex(pattern: str) -> str:
    """The regular expression of the sequences that a pattern matches without a mismatch."""
    return "".join("." if p == "N" else f"[{IUPAC[p]}]" for p in pattern.upper())


def nt5(c: Column, length: int = MAX_NT5) -> Column:
    """The first ``length`` bases as an order-preserving base-5 bigint; other characters and missing ones are N."""
    if not 1 <= length <= MAX_NT5:
        raise ValueError(f"length must be from 1 to {MAX_NT5}")
    digits = F.rpad(F.translate(F.upper(F.substring(c, 1, length)), "ACGNTBDEFHIJKLMOPQRSUVWXYZ.-*", "01234" + "3" * 24), length, "3")
    return F.conv(digits, 5, 10).cast("bigint")


def from_nt5(c: Column, length: int = MAX_NT5) -> Column:
    """The sequence of a base-5 code."""
    return F.translate(F.lpad(F.conv(c.cast("string"), 10, 5), length, "0"), "01234", BASE5)


def nt5_chunks(c: Column, length: int, unit: int = MAX_NT5) -> Column:
    """A long sequence as an array of base-5 codes of ``unit`` bases each, the last one shorter."""
    parts = [nt5(F.substring(c, at + 1, min(unit, length - at)), min(unit, length - at)) for at in range(0, length, unit)]
    return F.array(*parts)


def bits2(c: Column, length: int, other: int = 3) -> Column:
    """The first ``length`` bases with two bits each in a bigint; other characters get the given code."""
    if not 1 <= length <= MAX_BITS:
        raise ValueError(f"length must be from 1 to {MAX_BITS}")
    known = F.translate(F.upper(F.substring(c, 1, length)), "ACGT", "0123")
    return F.conv(F.rpad(F.regexp_replace(known, "[^0-3]", str(other)), length, str(other)), 4, 10).cast("bigint")


def hamming(a: Column, b: Column, length: int, *, count_n: bool = False) -> Column:
    """Differing positions of the first ``length``; an N of the read ``a`` is free unless ``count_n``."""
    pairs = F.zip_with(F.split(F.substring(a, 1, length), ""), F.split(F.substring(b, 1, length), ""), lambda x, y: (~x.eqNullSafe(y) & (F.lit(True) if count_n else ~x.eqNullSafe(F.lit("N")))).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda n, v: n + v)


def spaced_keys(c: Column, masks: list[str]) -> Column:
    """Blocking keys: for each mask of 0 and 1 its number and the bases at the ones."""
    keys = []
    for k, mask in enumerate(masks):
        keys.append(F.concat(F.lit(f"{k}:"), *(F.substring(c, i + 1, 1) for i, m in enumerate(mask) if m == "1")))
    return F.array(*keys)


def spaced_matches(queries: DataFrame, sequences: DataFrame, masks: list[str], *, query_id: str, query: str, seq_id: str, sequence: str) -> DataFrame:
    """query_id, seq_id, n_masks: sequences that have the query's bases at all ones of at least one mask, and of how many."""
    keys = lambda df, ident, c: df.filter(F.col(c).isNotNull()).select(F.col(ident), F.explode(spaced_keys(F.col(c), masks)).alias("_k"))
    met = keys(queries, query_id, query).join(keys(sequences, seq_id, sequence), "_k")
    return met.groupBy(query_id, seq_id).agg(F.count(F.lit(1)).alias("n_masks"))


@dataclass(frozen=True)
class BarcodeFormat:
    """How a read's barcode is laid out: ambiguity patterns it must fit, and whether it is stored backwards."""

    patterns: tuple[str, ...]
    revcomp: bool = True

    @property
    def length(self) -> int:
        return len(self.patterns[0])


#: The named barcode layouts.
FORMATS = {
    "DraI32": BarcodeFormat(("NNNNNBNNBNNBNNBNNBNNBNNBNNBVNBNN",)),
    "DraI31": BarcodeFormat(("NNNNNBNNBNNBNNBNNBNNBNNBNNBVNBN",)),
    "T7-30": BarcodeFormat(("NNNNNNNNNNNNNNNNNNNNNNNNNNNNNN",), revcomp=False),
    "HDMI30": BarcodeFormat(("NNNNNBNNBNNBNNBNNBNNBNNBNNBNNB",)),
    "DraI20": BarcodeFormat(("NNNNNBNNBNNBNNBNNBNN",)),
    "HDMI20": BarcodeFormat(("NNHNVNNVNVNVNVNVNVNN",)),
    "DMix32": BarcodeFormat(("NNNNNBNNBNNBNNBNNBNNBNNBNNBNNSNN", "NNNBNNBNNBNNBNNBNNBNNBNNBNNBNNBN", "NNNNBNNBNNBNNBNNBNNBNNBNNBNNBNNB")),
    "XGMix32": BarcodeFormat(("NNHHNNHHNNHHNNHHNNHHNNHHNNHHNNHH", "DDNNDDNNDDNNDDNNDDNNDDNNDDNNDDNN")),
    "DPAGE32": BarcodeFormat(("NNNNNBNNBNNBNNBNNBNNBNNBNNBVNBNN", "NNNNBNNBNNBNNBNNBNNBNNBNNBNNBNNB")),
    "XG3": BarcodeFormat(("DDNNDDNNDDNNDDNNDDNNDDNNDDNNDDNN", "NNHHNNHHNNHHNNHHNNHHNNHHNNHHNNHH")),
}


def best_mismatches(c: Column, patterns: tuple[str, ...]) -> Column:
    """The least mismatches to any of the patterns."""
    each = [iupac_mismatches(c, p) for p in patterns]
    return each[0] if len(each) == 1 else F.least(*each)


def illumina_name(c: Column) -> Column:
    """lane, tile, x, y of a colon-separated read name; null if it has fewer than seven fields."""
    f = F.split(F.split(c, "[ \t]")[0], ":")
    return F.when(F.size(f) >= 7, F.struct(*(F.get(f, F.lit(i)).try_cast(t).alias(n) for i, n, t in ((3, "lane", "int"), (4, "tile", "int"), (5, "x", "bigint"), (6, "y", "bigint")))))


def grid_name(c: Column, *, one_tile: bool = False, lane: int = 1) -> Column:
    """lane, tile, x, y of an underscore-separated read name: the sixth field from the end is R###C###, the last two are coordinates.

    The tile is 1000000 + row * 1000 + column, or 1 for names with global coordinates (``one_tile``); coordinates are
    thousandths, truncated. Null if the name has fewer than six fields or another form.
    """
    f = F.split(F.split(c, "[ \t]")[0], "_")
    last = lambda k: F.try_element_at(f, F.lit(-k))
    place = last(6)
    tile = F.lit(1) if one_tile else F.lit(1_000_000) + F.regexp_extract(place, r"\AR(\d{3})C(\d+)", 1).try_cast("int") * 1000 + F.regexp_extract(place, r"\AR(\d{3})C(\d+)", 2).try_cast("int")
    x, y = ((last(k).try_cast("double") * 1000).cast("bigint") for k in (2, 1))
    ok = (F.size(f) >= 6) & tile.isNotNull() & x.isNotNull() & y.isNotNull()
    return F.when(ok, F.struct(F.lit(lane).alias("lane"), tile.alias("tile"), x.alias("x"), y.alias("y")))
