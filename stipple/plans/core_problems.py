"""The queries of problems 1, 4 and 5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stipple.operators import proximity, quarantine, skew
from stipple.session import load, materialize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Molecules at most 0.305 apart, and molecules in polygons."""
    return proximity.near_and_inside(load(spark, d, "molecules"), load(spark, d, "cell_polygons"), 0.305)


def _per_gene(spark: SparkSession, d: str) -> DataFrame:
    return skew.eager_aggregate_join(load(spark, d, "molecules"), load(spark, d, "features"), "gene", "name", "count", key_as="gene")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The genes that hold at least 2.5 % of all rows."""
    # the states are written once: their total and the hot ones among them are read from there
    return skew.hot_keys(materialize(_per_gene(spark, d)), 0.025, key="gene").select("gene")


def p4_per_gene(spark: SparkSession, d: str) -> DataFrame:
    """Rows and sums of count per gene, and those of the join with the features of that name."""
    return _per_gene(spark, d)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.parse_lines(load(spark, d, "raw_lines"), {"mol": quarantine.MOLECULE, "sbcd": quarantine.BARCODE})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The failing lines with their first reason."""
    return quarantine.rejected(_parsed(spark, d)).select("line_id", "reason")


def p5_broken_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every broken rule of every failing line, with its field and text."""
    return quarantine.broken_rules(_parsed(spark, d))


def p5_molecules(spark: SparkSession, d: str) -> DataFrame:
    """The valid molecule lines, typed."""
    return quarantine.accepted(_parsed(spark, d), "mol", quarantine.MOLECULE)


def p5_barcodes(spark: SparkSession, d: str) -> DataFrame:
    """The valid barcode lines, typed."""
    return quarantine.accepted(_parsed(spark, d), "sbcd", quarantine.BARCODE)


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_per_gene, p5_found, p5_broken_rules, p5_molecules, p5_barcodes)}

_P4 = """
WITH a AS (SELECT gene, count(*) AS left_rows, sum(count) AS left_sum FROM molecules GROUP BY gene),
b AS (SELECT name, count(*) AS n FROM features WHERE name IS NOT NULL GROUP BY name)
SELECT gene, left_rows, CAST(left_sum AS BIGINT) AS left_sum, coalesce(n, 0) AS right_rows, left_rows * coalesce(n, 0) AS joined_rows,
  CAST(left_sum * coalesce(n, 0) AS BIGINT) AS joined_sum FROM a LEFT JOIN b ON a.gene = b.name"""

#: The lines with their fields by a plain state machine in SQL would be slow; fields come from the same public grammar in RE2 form.
_F = r"""("([^"]|"")*"|[^\t"]*)"""
_P5 = rf"""
WITH c AS (SELECT line_id, kind, regexp_replace(regexp_replace(coalesce(line, ''), '\r$', ''), '^' || chr(65279), '') AS s FROM raw_lines),
g AS (SELECT *, regexp_full_match(s, '{_F}(\t{_F})*') AS good FROM c),
f AS (SELECT *, CASE WHEN good THEN list_transform(regexp_extract_all(chr(9) || s, '\t{_F}', 1),
   lambda v: CASE WHEN starts_with(v, '"') THEN replace(v[2:-2], '""', '"') ELSE v END) END AS f FROM g),
e AS (SELECT *, CASE kind WHEN 'mol' THEN 5 WHEN 'sbcd' THEN 6 END AS n,
  CASE WHEN kind = 'mol' THEN regexp_full_match(f[1], '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND abs(TRY_CAST(f[1] AS DOUBLE)) < 'inf'::DOUBLE
      AND regexp_full_match(f[2], '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND abs(TRY_CAST(f[2] AS DOUBLE)) < 'inf'::DOUBLE
      AND f[3] <> '' AND f[4] <> '' AND regexp_full_match(f[5], '[0-9]+') AND TRY_CAST(f[5] AS HUGEINT) <= 2147483647
    WHEN kind = 'sbcd' THEN f[1] <> '' AND regexp_full_match(f[2], '[0-9]+') AND TRY_CAST(f[2] AS HUGEINT) <= 2147483647
      AND regexp_full_match(f[3], '[0-9]+') AND TRY_CAST(f[3] AS HUGEINT) <= 2147483647
      AND regexp_full_match(f[4], '[0-9]+') AND TRY_CAST(f[4] AS HUGEINT) <= 9223372036854775807
      AND regexp_full_match(f[5], '[0-9]+') AND TRY_CAST(f[5] AS HUGEINT) <= 9223372036854775807
      AND regexp_full_match(f[6], '[0-9]+') AND TRY_CAST(f[6] AS HUGEINT) <= 2147483647 END AS ok FROM f),
r AS (SELECT *, CASE WHEN NOT good THEN 'quoting' WHEN n IS NULL OR len(f) <> n THEN 'columns' WHEN NOT coalesce(ok, false) THEN 'value' END AS reason FROM e)
"""

ORACLES = {
    "p4_found": "SELECT gene FROM molecules WHERE gene IS NOT NULL GROUP BY gene HAVING count(*) >= 0.025 * (SELECT count(*) FROM molecules)",
    "p4_per_gene": _P4,
    "p5_found": _P5 + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p5_broken_rules": _P5.rstrip() + rf""",
v AS (SELECT r.line_id, i, f[i] AS value, CASE WHEN kind = 'mol' THEN ['x', 'y', 'gene', 'gene_id', 'count'][i] ELSE ['strid', 'lane', 'tile', 'px', 'py', 'mismatches'][i] END AS field
  FROM r, range(1, 7) t(i) WHERE good AND n IS NOT NULL AND i <= n AND i <= len(f)),
b AS (SELECT line_id, i, field, value, CASE
    WHEN field IN ('x', 'y') THEN regexp_full_match(value, '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND coalesce(abs(TRY_CAST(value AS DOUBLE)) < 'inf'::DOUBLE, false)
    WHEN field IN ('gene', 'gene_id', 'strid') THEN value <> ''
    ELSE regexp_full_match(value, '[0-9]+') AND coalesce(TRY_CAST(value AS HUGEINT) <= CASE WHEN field IN ('px', 'py') THEN 9223372036854775807 ELSE 2147483647 END, false) END AS ok FROM v),
u AS (SELECT line_id, 0 AS i, 'quoting' AS reason, NULL AS field, NULL AS value FROM r WHERE NOT good
  UNION ALL SELECT line_id, 0, 'columns', NULL, CAST(len(f) AS VARCHAR) FROM r WHERE good AND (n IS NULL OR len(f) <> n)
  UNION ALL SELECT line_id, i, 'value', field, value FROM b WHERE NOT ok)
SELECT line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY i) AS INTEGER) AS rank, reason, field, value FROM u""",
    "p5_molecules": _P5 + """SELECT line_id, f[1]::DOUBLE AS x, f[2]::DOUBLE AS y, f[3] AS gene, f[4] AS gene_id, f[5]::INTEGER AS count
FROM r WHERE reason IS NULL AND kind = 'mol'""",
    "p5_barcodes": _P5 + """SELECT line_id, f[1] AS strid, f[2]::INTEGER AS lane, f[3]::INTEGER AS tile, f[4]::BIGINT AS px, f[5]::BIGINT AS py,
f[6]::INTEGER AS mismatches FROM r WHERE reason IS NULL AND kind = 'sbcd'""",
}

ORACLES["p1_found"] = """
WITH p AS (SELECT mol_id AS id, x, y, floor(x / 0.305) AS i, floor(y / 0.305) AS j FROM molecules WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
q AS (SELECT id, x, y, i + di AS i, j + dj AS j FROM p, (VALUES (-1), (0), (1)) AS a(di), (VALUES (-1), (0), (1)) AS b(dj)),
r AS (SELECT poly_id, xs, ys FROM cell_polygons WHERE len(xs) = len(ys) AND len(xs) >= 3),
e AS (SELECT poly_id, xs[k] AS x1, ys[k] AS y1, xs[k % len(xs) + 1] AS x2, ys[k % len(xs) + 1] AS y2 FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM r)),
b AS (SELECT poly_id, list_min(xs) AS x1, list_max(xs) AS x2, list_min(ys) AS y1, list_max(ys) AS y2 FROM r),
c AS (SELECT p.id, p.x, p.y, b.poly_id FROM p JOIN b ON p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2)
SELECT 'near' AS kind, p.id AS a, q.id AS b FROM p JOIN q ON p.i = q.i AND p.j = q.j AND p.id < q.id
  AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.305 * 0.305
UNION ALL
SELECT 'in', c.id, c.poly_id FROM c JOIN e ON c.poly_id = e.poly_id AND (e.y1 > c.y) <> (e.y2 > c.y)
  AND c.x < (e.x2 - e.x1) * (c.y - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1
GROUP BY c.id, c.poly_id HAVING count(*) % 2 = 1"""
