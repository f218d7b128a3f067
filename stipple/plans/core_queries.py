"""One query an operator of the core, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.functions import seq, stats
from stipple.functions import text as ft
from stipple.operators import aggregates as agg
from stipple.operators import diffexp, filters, joins, ordering, project, raster, sets, spatial
from stipple.session import load
from stipple.sources import matrices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def fixed(c: Column, digits: int = 4) -> Column:
    """A double cut to so many decimals the same way as ``floor(x * 1e4 + 0.5) / 1e4`` in SQL."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def _mol(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "molecules")


def _good(spark: SparkSession, d: str) -> DataFrame:
    """Molecules with coordinates and an ordinary count."""
    return _mol(spark, d).filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & F.col("count").between(1, 1000))


_GOOD = "(SELECT * FROM molecules WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND count BETWEEN 1 AND 1000)"
_RING = [(100.0, 100.0), (420.5, 80.25), (500.0, 400.0), (300.0, 250.0), (120.0, 430.0)]


# --- projections -----------------------------------------------------------------------------------------------------
# NaN passes through the operators; results state it as null and a column that tells, since NaN equals nothing
def plain(c: str) -> tuple[Column, Column]:
    return F.when(~F.isnan(c), F.col(c)).alias(c), F.isnan(c).alias(f"{c}_nan")


_PLAIN = "CASE WHEN NOT isnan({0}) THEN {0} END AS {0}, coalesce(isnan({0}), false) AS {0}_nan"


@query(f"SELECT mol_id AS id, gene AS feature, 'a' AS sample, {_PLAIN.format('x')}, {_PLAIN.format('y')}, gene_id, count, loaded_at FROM molecules")
def choose_columns(spark, d):
    out = project.choose(_mol(spark, d), "mol_id:id,gene:feature,:sample:a", include_rest=True)
    return out.select("id", "feature", "sample", *plain("x"), *plain("y"), "gene_id", "count", "loaded_at")


@query("SELECT mol_id, gene, count FROM molecules")
def keep_columns(spark, d):
    return project.keep_or_drop(_mol(spark, d), include=["gene", "count", "mol_id"])


@query("SELECT mol_id, printf('%.3f', x * 2.0) AS x FROM molecules WHERE x IS NOT NULL AND NOT isnan(x)")
def scaled_text(spark, d):
    rows = _mol(spark, d).filter(F.col("x").isNotNull() & ~F.isnan("x")).select("mol_id", "x")
    return project.scaled(rows, {"x": (2.0, "f", 3)})


@query("SELECT rec_id, px / 1000.0::DOUBLE AS px, py / 1000.0::DOUBLE AS py FROM sbcd_recs")
def units_um(spark, d):
    return project.to_units(load(spark, d, "sbcd_recs").select("rec_id", "px", "py"), ["px", "py"], 1000.0)


@query("SELECT pix_id, x / 100.0::DOUBLE + 7.5::DOUBLE AS x, y / 100.0::DOUBLE - 2.0::DOUBLE AS y FROM pixel_factors")
def affine_coordinates(spark, d):
    return project.affine(load(spark, d, "pixel_factors").select("pix_id", "x", "y"), {"x": (100.0, 7.5), "y": (100.0, -2.0)})


@query("SELECT mol_id, CASE WHEN NOT isnan(x) THEN greatest(x + 10.0::DOUBLE - 50.0::DOUBLE, 0) END AS x FROM molecules")
def shifted_coordinates(spark, d):
    out = project.shift_to_origin(_mol(spark, d).filter("x IS NOT NULL AND NOT isnan(x)").select("mol_id", "x"), {"x": (10.0, 50.0)})
    rest = _mol(spark, d).filter("x IS NULL OR isnan(x)").select("mol_id", F.lit(None).cast("double").alias("x"))
    return out.unionByName(rest)


_TILES = "SELECT lane, tile, min(px) AS xmin, max(px) AS xmax, min(py) AS ymin, max(py) AS ymax FROM sbcd_recs WHERE tile IS NOT NULL GROUP BY ALL"


def _tiles(spark, d) -> DataFrame:
    rows = load(spark, d, "sbcd_recs").filter("tile IS NOT NULL")
    return rows.groupBy("lane", "tile").agg(F.min("px").alias("xmin"), F.max("px").alias("xmax"), F.min("py").alias("ymin"), F.max("py").alias("ymax"))


@query(
    f"WITH t AS ({_TILES}), l AS (SELECT lane, tile, lane AS row, tile % 100 AS col FROM t) "
    "SELECT lane, tile, row, col, (SELECT max(xmax - xmin) FROM t) * (1.1::DOUBLE * (row - 1)) AS x_offset, (SELECT max(ymax - ymin) FROM t) * (1.0::DOUBLE * (col - 1)) AS y_offset FROM l"
)
def layout_to_offsets(spark, d):
    t = _tiles(spark, d)
    layout = t.select("lane", "tile", F.col("lane").alias("row"), (F.col("tile") % 100).alias("col"))
    return project.layout_offsets(layout, t, row_gap=0.1)


@query(
    f"WITH t AS ({_TILES}) SELECT rec_id, CAST(trunc((py + 500 - ymin) * 34.78::DOUBLE) AS BIGINT) AS px, CAST(trunc((1000 + xmax - px) * 34.78::DOUBLE) AS BIGINT) AS py "
    "FROM sbcd_recs JOIN t USING (lane, tile)"
)
def global_nanometres(spark, d):
    rows = load(spark, d, "sbcd_recs").select("rec_id", "px", "py", "lane", "tile").join(_tiles(spark, d), ["lane", "tile"])
    rows = rows.withColumns({"x_offset": F.lit(1000), "y_offset": F.lit(500)})
    return project.global_nm(rows).select("rec_id", "px", "py")


@query("SELECT rec_id, concat_ws(':', CAST(lane AS VARCHAR), CAST(tile AS VARCHAR), CAST(rec_id AS VARCHAR)) AS cell_id FROM sbcd_recs")
def composed_id(spark, d):
    return project.compose_id(load(spark, d, "sbcd_recs"), ["lane", "tile", "rec_id"]).select("rec_id", "cell_id")


@query(
    "SELECT id, nid, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN concat_ws('_v', name, CAST(row_number() OVER (PARTITION BY name ORDER BY nid, id) AS VARCHAR)) ELSE name END AS name FROM features"
)
def unique_feature_names(spark, d):
    return project.unique_names(load(spark, d, "features").select("id", "nid", "name"))


@query("SELECT f1.id, f1.nid, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN concat_ws('_', name, id) ELSE name END AS name FROM features f1")
def unique_feature_ids(spark, d):
    return project.unique_names(load(spark, d, "features").select("id", "nid", "name"), how="id")


# --- filters ---------------------------------------------------------------------------------------------------------
@query("SELECT mol_id, x, y FROM molecules WHERE x BETWEEN 10 AND 200.5 AND y >= -20 AND y <= 300 AND NOT isnan(x) AND NOT isnan(y)")
def filter_bbox(spark, d):
    return filters.in_box(_mol(spark, d), "x", "y", 10, 200.5, -20, 300).select("mol_id", "x", "y")


_EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(_RING, _RING[1:] + _RING[:1]))


@query(
    f"WITH e(x1, y1, x2, y2) AS (VALUES {_EDGES}) SELECT mol_id FROM molecules JOIN e ON (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) "
    "WHERE NOT isnan(x) AND NOT isnan(y) GROUP BY mol_id HAVING count(*) % 2 = 1"
)
def filter_polygon(spark, d):
    return filters.in_polygons(_mol(spark, d), "x", "y", [_RING]).select("mol_id")


@query("SELECT id, name FROM features WHERE regexp_matches(name, '^[QV].*[0-9]$') AND NOT contains(name, '43')")
def feature_regex(spark, d):
    return filters.features(load(spark, d, "features"), "name", include_regex="^[QV].*[0-9]$", exclude_substr="43").select("id", "name")


@query("SELECT mol_id FROM molecules WHERE gene_id IN (SELECT id FROM features)")
def semi_whitelist(spark, d):
    return filters.in_list(_mol(spark, d), "gene_id", load(spark, d, "features"), "id").select("mol_id")


@query("SELECT mol_id FROM molecules m WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.id = m.gene_id)")
def anti_list(spark, d):
    return filters.not_in_list(_mol(spark, d), "gene_id", load(spark, d, "features"), "id").select("mol_id")


@query("SELECT mol_id FROM molecules WHERE gene IN (SELECT gene FROM molecules GROUP BY gene HAVING sum(count) >= 20)")
def min_total(spark, d):
    return filters.min_totals(_mol(spark, d), "gene", "count", 20).select("mol_id")


@query(
    "WITH a AS (SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 700)) "
    "SELECT l_orderkey, l_linenumber FROM a WHERE l_orderkey IN (SELECT l_orderkey FROM a GROUP BY 1 HAVING sum(l_quantity) >= 60)"
)
def min_count_two_stage(spark, d):
    return filters.min_totals_twice(load(spark, d, "lineitem"), "l_partkey", "l_orderkey", "l_quantity", 700, 60).select("l_orderkey", "l_linenumber")


@query("SELECT mol_id FROM molecules WHERE coalesce(count, 0) > 0 AND count >= 3")
def positive_counts(spark, d):
    return filters.positive(_mol(spark, d), ["count"], threshold_on="count", threshold=3).select("mol_id")


@query("SELECT mol_id FROM molecules WHERE gene IS NOT NULL AND gene NOT IN ('UNASSIGNED', '-1', '0', 'NA')")
def known_ids(spark, d):
    return filters.known_ids(_mol(spark, d), "gene").select("mol_id")


@query("SELECT rec_id FROM sbcd_recs WHERE regexp_matches(strid, '^[AG].[CT]T')")
def pattern_reads(spark, d):
    reads = load(spark, d, "sbcd_recs").withColumn("seq1", F.col("strid"))
    return filters.fastq_pattern(reads, pat1=["RNYT"]).select("rec_id")


@query("SELECT rec_id FROM sbcd_recs WHERE strid[1:12] IN (SELECT strid[1:12] FROM seen_strids)")
def prefix_whitelist(spark, d):
    return filters.prefix_whitelist(load(spark, d, "sbcd_recs"), "strid", load(spark, d, "seen_strids"), "strid", length=12).select("rec_id")


@query("SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n BETWEEN 2 AND 3")
def freq_window(spark, d):
    return filters.frequency(load(spark, d, "events"), ["user_id", "event_type"], 2, 3).select("event_id")


@query("SELECT mol_id FROM molecules WHERE gene IS NOT NULL AND gene <> 'NA' AND gene_id IS NOT NULL AND gene_id <> 'NA'")
def not_missing(spark, d):
    return filters.not_missing(_mol(spark, d), ["gene", "gene_id"]).select("mol_id")


@query(
    "WITH t AS (SELECT substr(strid, 1, 3) AS k, lane, count(*) AS n FROM sbcd_recs WHERE strid IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) "
    "SELECT k FROM t GROUP BY k HAVING count(*) = (SELECT count(DISTINCT lane) FROM sbcd_recs)"
)
def all_sample_intersect(spark, d):
    rows = load(spark, d, "sbcd_recs").filter("strid IS NOT NULL").select(F.substring("strid", 1, 3).alias("k"), "lane", F.lit(1).alias("n"))
    return filters.in_every_sample(rows, "k", "lane", "n", 5)


# --- joins -----------------------------------------------------------------------------------------------------------
@query("SELECT m.mol_id, f.nid FROM molecules m JOIN features f ON m.gene_id = f.id")
def feature_lookup(spark, d):
    f = load(spark, d, "features").select(F.col("id").alias("gene_id"), "nid")
    return joins.lookup(_mol(spark, d).select("mol_id", "gene_id"), f, "gene_id", keep_missing=False).select("mol_id", "nid")


@query(
    "SELECT l_suppkey AS bcd, l_partkey AS ftr, " + ", ".join(f"CAST(sum(CASE WHEN l_linenumber = {k} THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS c{k}" for k in range(1, 8)) + " FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 0"
)
def full_outer_zero_fill(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("bcd"), F.col("l_partkey").alias("ftr"), F.col("l_quantity").cast("bigint").alias("cnt"), "l_linenumber")
    return joins.merge_matrices([rows.filter(F.col("l_linenumber") == k) for k in range(1, 8)])


@query(
    "SELECT n_nationkey, n_name, coalesce(s_suppkey, 0) AS s_suppkey FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey"
)
def left_first_match(spark, d):
    n, s = load(spark, d, "nation").select("n_nationkey", "n_name"), load(spark, d, "supplier")
    return joins.first_match(n, s, F.col("n_nationkey"), F.col("s_nationkey"), [F.col("s_suppkey")], ["s_suppkey"], default=0)


@query(
    "WITH b AS (SELECT lane, tile, substr(strid, 1, 27) AS k, px, py, rec_id FROM sbcd_recs WHERE strid IS NOT NULL AND tile IS NOT NULL AND px IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY lane, tile, k ORDER BY px, rec_id) = 1) "
    "SELECT s.strid, s.run_no, b.lane, b.tile, b.px, b.rec_id FROM seen_strids s JOIN b ON substr(s.strid, 1, 27) = b.k"
)
def match_by_tile(spark, d):
    recs = load(spark, d, "sbcd_recs").filter("tile IS NOT NULL AND px IS NOT NULL").select("lane", "tile", F.col("strid").alias("barcode"), "px", "rec_id")
    out = joins.match_barcodes(load(spark, d, "seen_strids"), recs.select("lane", "tile", "barcode", "px", "rec_id"), read="strid", barcode="barcode", order=["px", "rec_id"])
    return out.select("strid", "run_no", "lane", "tile", "px", "rec_id")


@query(
    "WITH b AS (SELECT substr(strid, 1, 27) AS key, min(rec_id) AS rec_id FROM sbcd_recs WHERE strid IS NOT NULL GROUP BY 1 HAVING count(*) = 1) "
    "SELECT key, rec_id FROM b WHERE key IN (SELECT substr(strid, 1, 27) FROM seen_strids)"
)
def dict_unique_match(spark, d):
    return joins.match_unique(load(spark, d, "seen_strids"), load(spark, d, "sbcd_recs"), read="strid").select("key", "rec_id")


_TAGS = [("t1", "ACGTA"), ("t2", "GGGTT"), ("t3", "CATCAT")]


@query(
    "WITH t(tag_id, s) AS (VALUES ('t1', 'ACGTA'), ('t2', 'GGGTT'), ('t3', 'CATCAT')), h AS (SELECT rec_id, tag_id, instr(strid, s) - 1 AS pos FROM sbcd_recs, t WHERE contains(strid, s)) "
    "SELECT rec_id, min(tag_id) AS tag_id, CAST(min(pos) AS INTEGER) AS pos FROM h GROUP BY 1 HAVING min(tag_id) = max(tag_id)"
)
def contains_join(spark, d):
    tags = spark.createDataFrame(_TAGS, "tag_id string, tag_seq string")
    return joins.search_tags(load(spark, d, "sbcd_recs").filter("strid IS NOT NULL").select("rec_id", F.col("strid").alias("seq2")), tags, read_id="rec_id")


@query(
    "WITH t(tag, s) AS (VALUES ('t1', 'ACGT'), ('t2', 'GGGG')) SELECT substr(strid, 5, 20) AS barcode, tag, substr(strid, 25, 6) AS umi FROM sbcd_recs JOIN t ON substr(strid, 1, 4) = s"
)
def tag_match(spark, d):
    tags = spark.createDataFrame([("t1", "ACGT"), ("t2", "GGGG")], "tag_id string, tag_seq string")
    reads = load(spark, d, "sbcd_recs").select(F.col("strid").alias("seq1"), F.col("strid").alias("seq2"))
    return joins.match_tags(reads, tags, bcd_pos="5-24", tag_pos="1-4", umi_pos="25-30")


@query(
    "WITH s(sample, i1, k) AS (VALUES ('a', 'ACGTACGT', 0), ('b', 'GGGGTTTT', 1), ('c', 'TTTTCCCC', 2)), "
    "r AS (SELECT rec_id, substr(strid, 1, 8) AS q FROM sbcd_recs WHERE strid IS NOT NULL), "
    "x AS (SELECT rec_id, sample, k, len(list_filter(range(1, 9), lambda i: q[i] <> i1[i] AND q[i] <> 'N')) AS dist FROM r, s), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY dist, k) AS rn, lead(dist) OVER (PARTITION BY rec_id ORDER BY dist, k) AS nxt FROM x) "
    "SELECT rec_id, CASE WHEN dist <= 2 AND nxt - dist >= 2 THEN sample ELSE 'ambiguous' END AS sample FROM y WHERE rn = 1"
)
def demultiplex(spark, d):
    sheet = spark.createDataFrame([("a", "ACGTACGT"), ("b", "GGGGTTTT"), ("c", "TTTTCCCC")], "sample string, i1 string")
    reads = load(spark, d, "sbcd_recs").filter("strid IS NOT NULL").select("rec_id", F.substring("strid", 1, 8).alias("i1"))
    return joins.demultiplex(reads, sheet).select("rec_id", "sample")


@query(
    "WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS rn, lead(value) OVER w AS nxt FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)) "
    "SELECT user_id, event_id, value AS best, nxt - value AS gap FROM r WHERE rn = 1"
)
def best_second_gap(spark, d):
    rows = load(spark, d, "events").filter("value IS NOT NULL")
    return joins.best_and_second(rows, ["user_id"], F.col("value"), [F.col("event_id")], ["event_id"])


@query("SELECT p_partkey, p_size AS x, p_retailprice AS y, p_brand AS a_brand, p_name AS b_name FROM part")
def positional_zip(spark, d):
    p = load(spark, d, "part").withColumns({"x": F.col("p_size").cast("double"), "y": F.col("p_retailprice")})
    out = joins.zip_by_position([("a_", p.select("p_partkey", "x", "y", F.col("p_brand").alias("brand"))), ("b_", p.select("p_partkey", "x", "y", F.col("p_name").alias("name")))], ordinal="p_partkey")
    return out.withColumn("x", F.col("x").cast("int"))


@query("SELECT t.lane, t.tile, l.row, t.n FROM (SELECT lane, tile, count(*) AS n FROM sbcd_recs WHERE tile IS NOT NULL GROUP BY ALL) t JOIN (VALUES (1205, 1), (2109, 2), (9999, 3)) l(tile, row) ON t.tile = l.tile")
def manifest_layout(spark, d):
    m = load(spark, d, "sbcd_recs").filter("tile IS NOT NULL").groupBy("lane", "tile").agg(F.count(F.lit(1)).alias("n"))
    layout = spark.createDataFrame([(1205, 1), (2109, 2), (9999, 3)], "tile int, row int")
    return joins.manifest_layout(m, layout, on=["tile"]).select("lane", "tile", "row", "n")


@query(
    "SELECT mol_id, 0 AS unit, '#ff0000' AS color FROM molecules WHERE regexp_full_match(gene, 'Qam.*') UNION ALL "
    "SELECT mol_id, 1, '#00ff00' FROM molecules WHERE gene IN ('Yev462', 'Qam430k') UNION ALL SELECT mol_id, 2, '#0000ff' FROM molecules"
)
def color_units(spark, d):
    units = [{"color": "#ff0000", "regex": "Qam.*"}, {"color": "#00ff00", "genes": ["Yev462", "Qam430k"]}, {"color": "#0000ff", "all": True}]
    return joins.color_units(_mol(spark, d).select("mol_id", "gene"), "gene", units).select("mol_id", "unit", "color")


_BULK = """WITH a AS (SELECT p_brand AS feature, l_returnflag AS factor, sum(l_quantity) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
t AS (SELECT feature, factor, cnt, sum(cnt) OVER (PARTITION BY feature) AS rowsum, sum(cnt) OVER (PARTITION BY factor) AS colsum, sum(cnt) OVER () AS total FROM a)"""


def _bulk(spark, d, only: str | None = None) -> DataFrame:
    li = load(spark, d, "lineitem")
    li = li.filter(only) if only else li
    rows = li.join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return agg.pseudobulk(rows, "p_brand", F.col("l_quantity"), [(F.col("l_returnflag"), None)])


@query(
    "WITH l AS (SELECT p_brand AS feature, l_returnflag AS factor, l_linestatus AS s, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "a AS (SELECT feature, factor, sum(q) AS cnt1 FROM l WHERE s = 'O' GROUP BY ALL), b AS (SELECT feature, factor, sum(q) AS cnt2 FROM l WHERE s = 'F' GROUP BY ALL) "
    "SELECT feature, factor, coalesce(cnt1, 0) AS cnt1, coalesce(cnt2, 0) AS cnt2 FROM a FULL JOIN b USING (feature, factor) "
    "WHERE feature IN (SELECT feature FROM a) AND feature IN (SELECT feature FROM b) AND factor IN (SELECT factor FROM a) AND factor IN (SELECT factor FROM b)"
)
def align_two_matrices(spark, d):
    return joins.align_matrices(_bulk(spark, d, "l_linestatus = 'O'"), _bulk(spark, d, "l_linestatus = 'F'"), ignore_mismatch=True)


# --- spatial ---------------------------------------------------------------------------------------------------------
@query(
    "WITH m AS (SELECT mol_id, x, y, floor(x / 2) AS i, floor(y / 2) AS j FROM molecules WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)), "
    "t AS (SELECT pix_id, x, y, floor(x / 2) + a AS i, floor(y / 2) + b AS j FROM pixel_factors, (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(b)), "
    "c AS (SELECT m.mol_id, t.pix_id, (m.x - t.x) * (m.x - t.x) + (m.y - t.y) * (m.y - t.y) AS d2 FROM m JOIN t ON m.i = t.i AND m.j = t.j), "
    "b AS (SELECT * FROM c WHERE d2 <= 4 QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY d2, pix_id) = 1) "
    "SELECT mol_id, pix_id, d2 FROM (SELECT mol_id FROM molecules) LEFT JOIN b USING (mol_id)"
)
def nn_grid_join(spark, d):
    return spatial.nearest(_mol(spark, d).select("mol_id", "x", "y"), load(spark, d, "pixel_factors"), 2.0, point_id="mol_id", target_id="pix_id").select("mol_id", "pix_id", "d2")


@query(
    "SELECT l.s_suppkey AS l_s_suppkey, r.s_suppkey AS r_s_suppkey FROM supplier l JOIN supplier r ON abs(l.s_acctbal - r.s_acctbal) <= 150.0::DOUBLE AND l.s_nationkey = r.s_nationkey AND l.s_suppkey < r.s_suppkey"
)
def band_join(spark, d):
    s = load(spark, d, "supplier")
    cond = (F.col("l_s_nationkey") == F.col("r_s_nationkey")) & (F.col("l_s_suppkey") < F.col("r_s_suppkey"))
    return spatial.band_pairs(s, s, "s_acctbal", 150.0, cond, left_id="s_suppkey", right_id="s_suppkey")


_PIP = """WITH p AS (SELECT mol_id AS id, x, y FROM molecules WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
r AS (SELECT poly_id, xs, ys FROM cell_polygons WHERE len(xs) = len(ys) AND len(xs) >= 3),
e AS (SELECT poly_id, xs[k] AS x1, ys[k] AS y1, xs[k % len(xs) + 1] AS x2, ys[k % len(xs) + 1] AS y2 FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM r)),
o AS (SELECT poly_id, CASE WHEN xs[1] = xs[-1] AND ys[1] = ys[-1] THEN xs[1:len(xs) - 1] ELSE xs END AS xs, CASE WHEN xs[1] = xs[-1] AND ys[1] = ys[-1] THEN ys[1:len(ys) - 1] ELSE ys END AS ys FROM r),
b AS (SELECT poly_id, list_min(xs) AS x1, list_max(xs) AS x2, list_min(ys) AS y1, list_max(ys) AS y2 FROM r),
c AS (SELECT p.id, p.x, p.y, b.poly_id FROM p JOIN b ON p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2),
i AS (SELECT c.id, c.x, c.y, c.poly_id FROM c JOIN e ON c.poly_id = e.poly_id AND (e.y1 > c.y) <> (e.y2 > c.y)
  AND c.x < (e.x2 - e.x1) * (c.y - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(
    _PIP + ", z AS (SELECT i.id, i.poly_id, (x - list_sum(xs) / len(xs)) * (x - list_sum(xs) / len(xs)) + (y - list_sum(ys) / len(ys)) * (y - list_sum(ys) / len(ys)) AS d FROM i JOIN o USING (poly_id)) "
    "SELECT mol_id, cell FROM (SELECT mol_id FROM molecules) LEFT JOIN (SELECT id, arg_min(poly_id, (d, poly_id)) AS cell FROM z GROUP BY id) ON mol_id = id"
)
def pip_join(spark, d):
    return spatial.assign_regions(_mol(spark, d).select("mol_id", "x", "y"), load(spark, d, "cell_polygons")).select("mol_id", "cell")


@query()
def pip_join_expanded(spark, d):
    """With regions grown by 1."""
    return spatial.assign_regions(_mol(spark, d).select("mol_id", "x", "y"), load(spark, d, "cell_polygons"), expand=1.0, unassigned="UNASSIGNED").select("mol_id", "cell")


@query()
def raster_join(spark, d):
    """By a grid of cells that are in exactly one region."""
    return spatial.assign_by_raster(_mol(spark, d).select("mol_id", "x", "y"), load(spark, d, "cell_polygons"), 1.0).select("mol_id", "cell")


@query(
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) > 0) "
    "SELECT a.vec_id AS id, b.vec_id AS other FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) = 1"
)
def embedding_nn(spark, d):
    return spatial.nearest_vectors(load(spark, d, "embeddings"), ident="vec_id", vector="embedding").select("id", "other")


# --- aggregates ------------------------------------------------------------------------------------------------------
@query("SELECT coalesce(gene || ':' || gene_id, gene, gene_id) AS gene, CAST(sum(count) AS BIGINT) AS count FROM molecules GROUP BY 1")
def feature_totals(spark, d):
    return agg.feature_totals(_mol(spark, d), ident="gene_id")


@query("SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM (SELECT CASE WHEN isnan(x) THEN NULL ELSE x END AS x, CASE WHEN isnan(y) THEN NULL ELSE y END AS y FROM molecules)")
def extent(spark, d):
    return agg.extent(_mol(spark, d))


@query(
    "WITH h AS (SELECT CAST(trunc(x / 50) AS BIGINT) AS b, count(*) AS count FROM molecules WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1) "
    'SELECT b * 50.0::DOUBLE AS "from", b * 50.0::DOUBLE + 50.0::DOUBLE AS "to", b * 50.0::DOUBLE + 25.0::DOUBLE AS median, count, count / (SELECT sum(count) FROM h) AS frac, '
    "CAST(sum(count) OVER w AS BIGINT) AS cumul, sum(count) OVER w / (SELECT sum(count) FROM h) AS fcumul FROM h WINDOW w AS (ORDER BY b)"
)
def hist_width(spark, d):
    return agg.histogram(_mol(spark, d), "x", 50.0, fraction=True, cumulative=True, median=True)


@query(
    "WITH v AS (SELECT (max(o_totalprice) - min(o_totalprice)) / 10 AS v FROM orders), w AS (SELECT round(v / 10 ** (floor(log10(v)) - 1)) * 10 ** (floor(log10(v)) - 1) AS w FROM v), "
    "h AS (SELECT CAST(trunc(o_totalprice / w) AS BIGINT) AS b, any_value(w) AS w, count(*) AS count FROM orders, w GROUP BY 1) SELECT b * w AS \"from\", b * w + w AS \"to\", count FROM h"
)
def hist_auto(spark, d):
    return agg.histogram(load(spark, d, "orders"), "o_totalprice", bins=10)


@query(
    "SELECT CASE WHEN s_acctbal * s_acctbal = 0 THEN 'zero' ELSE 'log' END AS bucket, CAST(floor(log10(s_acctbal * s_acctbal) * 10) AS BIGINT) AS bin, count(*) AS count FROM supplier GROUP BY ALL"
)
def log_decile_hist(spark, d):
    s = load(spark, d, "supplier")
    return agg.decile_histogram(s, F.col("s_acctbal") * F.col("s_acctbal")).select("bucket", "bin", "count")


@query(
    "SELECT CASE grouping(lane) + grouping(tile) WHEN 2 THEN 'all' WHEN 1 THEN 'first' ELSE 'second' END AS level, lane, tile, count(*) AS n, CAST(sum(mismatches) AS BIGINT) AS mism FROM sbcd_recs GROUP BY ROLLUP (lane, tile)"
)
def grouping_sets_counts(spark, d):
    return agg.levels(load(spark, d, "sbcd_recs"), "lane", "tile", {"n": F.count(F.lit(1)), "mism": F.sum("mismatches")})


@query(
    "SELECT lane, tile, count(*) AS barcodes, CAST(count_if(mismatches = 0) AS BIGINT) AS matches, CAST(count_if(mismatches > 0) AS BIGINT) AS mismatches, "
    "min(px) AS xmin, max(px) AS xmax, min(py) AS ymin, max(py) AS ymax FROM sbcd_recs GROUP BY lane, tile"
)
def tile_stats(spark, d):
    return agg.tile_stats(load(spark, d, "sbcd_recs"), ["lane", "tile"])


@query(
    f"SELECT gene, floor(sum(count * x) / sum(count) * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS cx, floor(sum(count * y) / sum(count) * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS cy, CAST(sum(count) AS BIGINT) AS total, count(*) AS n FROM {_GOOD} GROUP BY gene"
)
def weighted_centroid(spark, d):
    out = agg.weighted_centroid(_good(spark, d), "gene", "x", "y", "count")
    return out.select("gene", fixed(F.col("cx")).alias("cx"), fixed(F.col("cy")).alias("cy"), "total", "n")


@query(
    "WITH f AS (SELECT p_brand AS feature, l_returnflag AS k, l_quantity * (1 - l_tax) AS w FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL "
    "SELECT p_brand, l_linestatus, l_quantity * l_tax FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT feature, k AS factor, floor(sum(w) * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS cnt FROM f GROUP BY ALL"
)
def pseudobulk_soft(spark, d):
    rows = load(spark, d, "lineitem").join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    out = agg.pseudobulk(rows, "p_brand", F.col("l_quantity"), [(F.col("l_returnflag"), 1 - F.col("l_tax")), (F.col("l_linestatus"), F.col("l_tax"))])
    return out.withColumn("cnt", fixed(F.col("cnt")))


@query(_BULK + " SELECT feature, factor, cnt, rowsum, colsum, total FROM t")
def matrix_totals(spark, d):
    return agg.totals(_bulk(spark, d))


@query("SELECT p_brand AS feature, l_returnflag AS f1, l_linestatus AS f2, sum(l_quantity) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def contingency3(spark, d):
    rows = load(spark, d, "lineitem").join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature")), "l_partkey")
    return agg.contingency(rows.withColumnsRenamed({"l_returnflag": "f1", "l_linestatus": "f2"}), "feature", "f1", "f2", "l_quantity")[0]


@query("SELECT l_returnflag AS f1, l_linestatus AS f2, sum(l_quantity) AS count FROM lineitem GROUP BY ALL")
def contingency2(spark, d):
    rows = load(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "f1", "l_linestatus": "f2"})
    return agg.contingency(rows, "l_partkey", "f1", "f2", "l_quantity")[1]


@query("SELECT user_id AS barcode, event_type AS tag, count(*) AS reads, count(DISTINCT value) AS umis, 1 AS present FROM events GROUP BY ALL")
def count_distinct_umi(spark, d):
    return agg.tag_counts(load(spark, d, "events").select(F.col("user_id").alias("barcode"), F.col("event_type").alias("tag"), F.col("value").alias("umi")))


def _sbcd_key() -> tuple[Column, Column]:
    return F.substring("strid", 1, 27), F.concat_ws("_", F.col("lane").cast("string"), F.col("tile").cast("string"))


_DUP = "WITH s AS (SELECT substr(strid, 1, 27) AS key, concat_ws('_', CAST(lane AS VARCHAR), CAST(tile AS VARCHAR)) AS tile FROM sbcd_recs WHERE strid IS NOT NULL)"


@query(_DUP + " SELECT key, count(*) AS n, count(DISTINCT tile) AS n_tiles FROM s GROUP BY key")
def duplicate_keys(spark, d):
    return agg.duplicates(load(spark, d, "sbcd_recs"), *_sbcd_key()).withColumn("n", F.col("n").cast("bigint"))


@query(_DUP + " SELECT n, count(*) AS n_keys FROM (SELECT key, count(*) AS n FROM s GROUP BY key) GROUP BY n")
def duplicate_multiplicity(spark, d):
    return agg.duplicate_multiplicity(load(spark, d, "sbcd_recs"), *_sbcd_key())


@query(
    _DUP + ", p AS (SELECT key, tile, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT *, count(*) OVER (PARTITION BY key) AS t FROM p) "
    "SELECT tile, CAST(sum(n) AS BIGINT) AS total, count(*) AS keys, CAST(count_if(n = 1 AND t = 1) AS BIGINT) AS uniq, CAST(count_if(n > 1) AS BIGINT) AS dup_within, CAST(count_if(t > 1) AS BIGINT) AS dup_between FROM q GROUP BY tile"
)
def dup_within_between(spark, d):
    return agg.duplicates_by_tile(load(spark, d, "sbcd_recs"), *_sbcd_key())


@query(
    "WITH s AS (SELECT rec_id, substr(strid, 1, 27) AS key, px, py FROM sbcd_recs WHERE strid IS NOT NULL AND px IS NOT NULL AND py IS NOT NULL), g AS (SELECT key, count(*) AS n, min(rec_id) AS rec_id FROM s GROUP BY key), "
    "f AS (SELECT a.key, max(sqrt((a.px - b.px)::DOUBLE * (a.px - b.px)::DOUBLE + (a.py - b.py)::DOUBLE * (a.py - b.py)::DOUBLE)) AS m FROM s a JOIN s b USING (key) JOIN g USING (key) WHERE n BETWEEN 2 AND 3 GROUP BY a.key) "
    "SELECT key, n, rec_id, CASE WHEN n = 1 THEN 0 ELSE m END AS max_dist FROM g LEFT JOIN f USING (key)"
)
def duplicate_spread(spark, d):
    rows = load(spark, d, "sbcd_recs").filter("px IS NOT NULL AND py IS NOT NULL").select("rec_id", "strid", "px", "py")
    return agg.duplicate_spread(rows, F.substring("strid", 1, 27), order=["rec_id"], max_dup=3).select("key", "n", "first.rec_id", "max_dist")


@query(
    "WITH r AS (SELECT count(*) AS total FROM seen_strids), m AS (SELECT s.strid, count(*) AS n FROM seen_strids s JOIN (SELECT DISTINCT strid, tile FROM sbcd_recs) b USING (strid) GROUP BY 1), "
    "t AS (SELECT total, CAST(coalesce(sum(n), 0) AS BIGINT) AS mt, count(n) AS u FROM r LEFT JOIN m ON true GROUP BY total) "
    "SELECT unnest(['Total', 'Miss', 'Match', 'Unique', 'Dup']) AS type, unnest([total, total - mt, mt, u, mt - u]) AS reads, unnest([total, total - mt, mt, u, mt - u]) / total AS fraction FROM t"
)
def match_summary(spark, d):
    reads = load(spark, d, "seen_strids")
    return agg.match_summary(reads, reads.join(load(spark, d, "sbcd_recs").select("strid", "tile").distinct(), "strid"), key="strid")


@query(
    "WITH m AS (SELECT c_mktsegment AS s, l_partkey % 50 AS feature, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) "
    "SELECT feature, " + ", ".join(f"CASE WHEN coalesce(sum(q) FILTER (s = '{s}'), 0) = 0 THEN 0.5::DOUBLE ELSE sum(q) FILTER (s = '{s}') END AS \"{s}\"" for s in ("BUILDING", "MACHINERY")) + " FROM m GROUP BY feature"
)
def model_matrix_pivot(spark, d):
    long = load(spark, d, "lineitem").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    long = long.select(F.col("o_custkey").alias("cell_id"), (F.col("l_partkey") % 50).alias("feature"), F.col("l_quantity").alias("cnt"))
    clusters = load(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cluster"))
    return agg.widen(agg.model_matrix(long, clusters), ["BUILDING", "MACHINERY"], factor="cluster", pseudocount=1.0)


@query("SELECT p_brand AS feature, l_returnflag AS factor, sum(l_quantity) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def matrix_add(spark, d):
    return agg.add_matrices([_bulk(spark, d, "l_linenumber <= 3"), _bulk(spark, d, "l_linenumber > 3")])


@query("SELECT id, CAST(pos AS INTEGER) AS pos, CAST(c AS BIGINT) AS total FROM (SELECT id, unnest(string_split(counts, ',')) AS c, generate_subscripts(string_split(counts, ','), 1) - 1 AS pos FROM features WHERE counts IS NOT NULL)")
def count_arrays(spark, d):
    return agg.array_totals(load(spark, d, "features").select("id", ft.comma_ints(F.col("counts")).alias("counts")), "id", "counts")


@query("SELECT gene, CAST(sum(count) AS BIGINT) AS count FROM molecules GROUP BY gene")
def feature_count_sums(spark, d):
    return agg.count_vectors(_mol(spark, d), "gene", ["count"])


@query(f"SELECT gene, quantile_disc(x, 0.9) AS quantile FROM {_GOOD} GROUP BY gene")
def quantile_disc(spark, d):
    return agg.quantile_disc(_good(spark, d), "x", 0.9, ["gene"])


# --- sequences and ranks ---------------------------------------------------------------------------------------------
@query("SELECT id, row_number() OVER (ORDER BY name, id) AS new_id FROM features")
def rownum_dense(spark, d):
    return ordering.dense_ids(load(spark, d, "features").select("id", "name"), ["name", "id"]).select("id", "new_id")


@query("SELECT gene, row_number() OVER (ORDER BY min(mol_id)) - 1 AS idx FROM molecules WHERE gene IS NOT NULL GROUP BY gene")
def rownum_first_seen(spark, d):
    return ordering.first_seen_ids(_mol(spark, d).filter("gene IS NOT NULL"), "gene", "mol_id")


@query("SELECT o_orderkey, floor(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS cumul FROM orders")
def running_total(spark, d):
    return ordering.running_sum(load(spark, d, "orders"), "o_totalprice", ["o_orderkey"], keys=["o_custkey"]).select("o_orderkey", fixed(F.col("cumul")).alias("cumul"))


@query("SELECT id, row_number() OVER (PARTITION BY name ORDER BY nid, id) AS ordinal FROM features")
def ordinal_within_name(spark, d):
    return ordering.ordinal_within(load(spark, d, "features").select("id", "name", "nid"), ["name"], ["nid", "id"]).select("id", "ordinal")


@query(
    """WITH RECURSIVE t AS (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS n FROM part GROUP BY 1), o AS (SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS rn FROM t),
z AS (SELECT 0::BIGINT AS rn, 1 AS bin, 0::BIGINT AS held, (SELECT CAST(sum(n) AS BIGINT) FROM t) AS lft UNION ALL
SELECT o.rn, CASE WHEN z.held > 0 AND z.held >= greatest(1, z.lft // greatest(1, 6 - z.bin)) AND z.bin < 5 THEN z.bin + 1 ELSE z.bin END,
 CASE WHEN z.held > 0 AND z.held >= greatest(1, z.lft // greatest(1, 6 - z.bin)) AND z.bin < 5 THEN o.n ELSE z.held + o.n END,
 CASE WHEN z.held > 0 AND z.held >= greatest(1, z.lft // greatest(1, 6 - z.bin)) AND z.bin < 5 THEN z.lft - z.held ELSE z.lft END FROM z JOIN o ON o.rn = z.rn + 1)
SELECT o.p_brand, o.n AS count, z.bin FROM o JOIN z USING (rn)"""
)
def greedy_bins(spark, d):
    return ordering.feature_bins(load(spark, d, "part"), "p_brand", "p_size", 5)


@query(
    "WITH v AS (SELECT DISTINCT factor FROM (SELECT CAST(mismatches AS VARCHAR) AS factor FROM sbcd_recs UNION ALL SELECT CAST(tile AS VARCHAR) FROM sbcd_recs UNION ALL SELECT gene FROM molecules) WHERE factor IS NOT NULL) "
    "SELECT factor, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_full_match(factor, '[0-9]+') THEN TRY_CAST(factor AS HUGEINT) END NULLS LAST, factor) AS INTEGER) AS rank FROM (SELECT factor FROM v)"
)
def numeric_aware_sort(spark, d):
    s = load(spark, d, "sbcd_recs")
    v = s.select(F.col("mismatches").cast("string").alias("factor")).unionByName(s.select(F.col("tile").cast("string").alias("factor"))).unionByName(_mol(spark, d).select(F.col("gene").alias("factor")))
    return ordering.numeric_aware_rank(v, "factor")


@query(
    "WITH c AS (SELECT entry_id, CASE WHEN isnan(chi2) THEN NULL ELSE chi2 END AS chi2, CASE WHEN isnan(fc) THEN NULL ELSE fc END AS fc, CASE WHEN isnan(log10p) THEN NULL ELSE log10p END AS log10p FROM de_entries) "
    'SELECT entry_id, greatest(chi2, fc, log10p) AS "topP", CASE greatest(chi2, fc, log10p) WHEN chi2 THEN \'chi2\' WHEN fc THEN \'fc\' WHEN log10p THEN \'log10p\' END AS "topK" FROM c'
)
def topk_argmax(spark, d):
    return ordering.argmax_columns(load(spark, d, "de_entries"), ["chi2", "fc", "log10p"]).select("entry_id", "topP", "topK")


@query(f"SELECT pix_id, pos, factor, {_PLAIN.format('prob')} FROM (SELECT pix_id, CAST(k - 1 AS INTEGER) AS pos, factors[k] AS factor, probs[k] AS prob FROM pixel_factors, (VALUES (1), (2)) t(k) WHERE k <= len(factors))")
def first_k_entries(spark, d):
    rows = ordering.first_k(load(spark, d, "pixel_factors").select("pix_id", "factors", "probs"), ["factors", "probs"], 2)
    rows = rows.select("pix_id", F.posexplode(F.arrays_zip("factors", "probs")).alias("pos", "z")).select("pix_id", "pos", F.col("z.factors").alias("factor"), F.col("z.probs").alias("prob"))
    return rows.select("pix_id", "pos", "factor", *plain("prob"))


@query("SELECT count(*) = 0 AS sorted FROM (SELECT lag(read_at) OVER (ORDER BY rec_id) AS p, read_at FROM sbcd_recs) WHERE p > read_at")
def sortedness(spark, d):
    return ordering.is_sorted(load(spark, d, "sbcd_recs"), "read_at", "rec_id")


# --- sets ------------------------------------------------------------------------------------------------------------
@query("SELECT 'a' AS sample_id, gene, count FROM molecules WHERE mol_id % 2 = 0 UNION ALL SELECT 'b', gene, count FROM molecules WHERE mol_id % 2 = 1")
def union_samples(spark, d):
    m = _mol(spark, d)
    return sets.union_samples([("a", m.filter("mol_id % 2 = 0").select("gene", "count")), ("b", m.filter("mol_id % 2 = 1").select("gene", "count"))])


@query(
    "WITH f AS (SELECT gene AS feature, min(CASE WHEN x < 100 THEN 0 ELSE 1 END) AS s FROM molecules WHERE gene IS NOT NULL GROUP BY 1) SELECT feature, row_number() OVER (ORDER BY s, feature) - 1 AS idx FROM f"
)
def merged_dictionary(spark, d):
    rows = _mol(spark, d).filter("gene IS NOT NULL").select(F.col("gene").alias("feature"), F.when(F.col("x") < 100, 0).otherwise(1).alias("sample_no"))
    return sets.merged_dictionary(rows)


@query(
    "SELECT (lane + 1) || '_' || strid AS strid, greatest(px::DOUBLE + (lane - 2) * 500, 0) AS px, greatest(py::DOUBLE + lane * 250, 0) AS py, 1 AS lane, 1 AS tile FROM sbcd_recs WHERE lane BETWEEN 0 AND 4"
)
def union_grids(spark, d):
    s = load(spark, d, "sbcd_recs").select("strid", "px", "py", "lane", "tile")
    return sets.union_grids([s.filter(F.col("lane") == k) for k in range(5)], [((k - 2) * 500.0, k * 250.0) for k in range(5)])


@query("SELECT strid, arg_min(rec_id, rec_id) AS rec_id, count(*) AS ndups FROM sbcd_recs WHERE strid IS NOT NULL GROUP BY strid")
def union_distinct(spark, d):
    s = load(spark, d, "sbcd_recs").filter("strid IS NOT NULL").select("strid", "rec_id")
    return sets.union_distinct([s.filter("rec_id % 2 = 0"), s.filter("rec_id % 2 = 1")], ["strid"], ["rec_id"])


@query("SELECT DISTINCT gene_id FROM molecules WHERE gene_id IN (SELECT id FROM features)")
def common_features(spark, d):
    return sets.common([_mol(spark, d), load(spark, d, "features").select(F.col("id").alias("gene_id"))], "gene_id")


@query("SELECT DISTINCT id FROM features WHERE id NOT IN (SELECT gene_id FROM molecules WHERE gene_id IS NOT NULL)")
def features_without_rows(spark, d):
    return sets.without(load(spark, d, "features"), _mol(spark, d).select(F.col("gene_id").alias("id")), "id")


# --- statistics ------------------------------------------------------------------------------------------------------
_X2 = "(a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d)) * (a + b + c + d)"
_ABCD = _BULK + ", q AS (SELECT feature, factor, cnt + 0.5 AS a, colsum - cnt + 0.5 AS b, rowsum - cnt + 0.5 AS c, total - rowsum - colsum + cnt + 0.5 AS d FROM t)"
_CUT = "floor(({}) * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE"


@query(_ABCD + f" SELECT feature, factor, {_CUT.format(_X2)} AS chi2, {_CUT.format('a * d / (b * c)')} AS fc FROM q")
def chi2_marginal(spark, d):
    out = diffexp.marginal(_bulk(spark, d))
    return out.select("feature", "factor", fixed(F.col("chi2")).alias("chi2"), fixed(F.col("fc")).alias("fc"))


@query(
    _BULK + ", q AS (SELECT x.feature, x.factor AS f1, y.factor AS f2, x.cnt + 0.5 AS a, y.cnt + 0.5 AS b, x.colsum - x.cnt + 0.5 AS c, y.colsum - y.cnt + 0.5 AS d FROM t x JOIN t y ON x.feature = y.feature AND x.factor < y.factor) "
    f"SELECT feature, f1, f2, {_CUT.format(_X2)} AS chi2, {_CUT.format('a * d / (b * c)')} AS fc FROM q"
)
def chi2_pairwise(spark, d):
    out = diffexp.pairwise(_bulk(spark, d))
    return out.select("feature", "f1", "f2", fixed(F.col("chi2")).alias("chi2"), fixed(F.col("fc")).alias("fc"))


@query(
    _ABCD + f", r AS (SELECT feature, factor, {_CUT.format(_X2)} AS chi2, {_CUT.format('a * d / (b * c)')} AS fc FROM q), s AS (SELECT *, chi2 >= 6 AND fc >= 1.02 AS ok, "
    "row_number() OVER (PARTITION BY factor ORDER BY CASE WHEN fc >= 1 THEN 0 ELSE 1 END, chi2 DESC, feature) AS rn, count_if(chi2 >= 6 AND fc >= 1.02) OVER (PARTITION BY factor) AS n FROM r) "
    "SELECT feature, factor, chi2, fc FROM s WHERE ok OR (n = 0 AND rn = 1 AND fc >= 1)"
)
def de_fallback(spark, d):
    rows = chi2_marginal(spark, d)
    return ordering.passing_or_best(rows, "factor", (F.col("chi2") >= 6) & (F.col("fc") >= 1.02), F.col("fc") >= 1, [F.desc("chi2"), F.asc("feature")])


_Z = "sqrt(chi2 / 2)"
_LOG10P = (
    f"CASE WHEN {_Z} < 2 THEN -log10(1 - exp(-chi2 / 2) * 2 / sqrt(pi()) * list_sum(list_transform(range(0, 61), lambda k: pow({_Z}, 2 * k + 1) * list_reduce(range(1, k + 1), lambda p, i: p * 2 / (2 * i + 1), 1.0::DOUBLE)))) "
    f"ELSE (chi2 / 2 + ln(sqrt(pi()) * list_reduce(range(60, 0, -1), lambda t, k: {_Z} + k / 2.0 / t, {_Z}))) / ln(10.0) END"
)


@query(
    _ABCD + f", r AS (SELECT feature, factor, a, b, c, d, {_X2} AS chi2, a * d / (b * c) AS fc FROM q), l AS (SELECT *, {_LOG10P} AS log10p, "
    "exp(ln(fc) - 3.090232306167813::DOUBLE * sqrt(1 / a + 1 / b + 1 / c + 1 / d)) AS fc_low FROM r), k AS (SELECT *, a >= 10 AND fc >= 1.01 AND log10p >= -log10(0.05) AS ok FROM l), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY CASE WHEN fc >= 1 THEN 0 ELSE 1 END, log10p DESC, feature) AS rn, count_if(ok) OVER (PARTITION BY factor) AS n FROM k) "
    f"SELECT feature, factor, {_CUT.format('log10p')} AS log10p, {_CUT.format('fc_low')} AS fc_low FROM s WHERE ok OR (n = 0 AND rn = 1 AND fc >= 1)"
)
def de_p_values(spark, d):
    """The same with -log10 p and the bound of the fold change."""
    out = diffexp.report(diffexp.marginal(_bulk(spark, d)), max_pval=0.05, min_fc=1.01, min_count=10)
    return out.select("feature", "factor", fixed(F.col("log10p")).alias("log10p"), fixed(F.col("fc_low")).alias("fc_low"))


@query(f"SELECT entry_id, {_CUT.format('greatest(a, b) + ln(1 + exp(-abs(a - b)))')} AS s FROM (SELECT entry_id, log10p AS a, fc AS b FROM de_entries WHERE abs(log10p) < 1e9 AND abs(fc) < 1e9)")
def log_sums(spark, d):
    # all finite values; NaN is above everything
    rows = load(spark, d, "de_entries").filter("abs(log10p) < 1e9 AND abs(fc) < 1e9")
    return rows.select("entry_id", fixed(stats.log_add(F.col("log10p"), F.col("fc"))).alias("s"))


@query(
    "WITH p AS (SELECT pix_id, probs, list_sum(probs) AS s FROM pixel_factors WHERE probs IS NOT NULL AND list_count(probs) = len(probs) AND len(list_filter(probs, lambda v: isnan(v))) = 0 AND len(probs) > 0) "
    f", v AS (SELECT pix_id, probs, s, unnest(range(1, len(probs) + 1)) AS k FROM p) SELECT pix_id, CAST(k - 1 AS INTEGER) AS pos, {_CUT.format('CASE WHEN abs(s - 1) > 1e-5 THEN (probs[k] + 1e-20::DOUBLE) / (s + len(probs) * 1e-20::DOUBLE) ELSE probs[k] END')} AS prob FROM v"
)
def renormalized(spark, d):
    rows = load(spark, d, "pixel_factors").filter("probs IS NOT NULL AND size(probs) > 0 AND NOT exists(probs, v -> v IS NULL OR isnan(v))")
    return rows.select("pix_id", F.posexplode(stats.renormalize(F.col("probs"))).alias("pos", "p")).select("pix_id", "pos", fixed(F.col("p")).alias("prob"))


# --- sequence functions ----------------------------------------------------------------------------------------------
@query("SELECT rec_id, translate(reverse(strid), 'ACGTacgt', 'TGCAtgca') AS rc FROM sbcd_recs")
def revcomp(spark, d):
    return load(spark, d, "sbcd_recs").select("rec_id", seq.revcomp(F.col("strid")).alias("rc"))


@query("SELECT rec_id, CAST(list_reduce(list_transform(string_split(substr(upper(strid), 1, 20), ''), lambda c: CAST(instr('ACGNT', c) - 1 AS BIGINT)), lambda a, b: a * 5 + b) AS BIGINT) AS code FROM sbcd_recs WHERE strid IS NOT NULL")
def nt5_codes(spark, d):
    return load(spark, d, "sbcd_recs").filter("strid IS NOT NULL").select("rec_id", seq.nt5(F.col("strid"), 20).alias("code"))


@query(
    "SELECT rec_id, CAST((instr('AG', upper(strid[1])) = 0)::INTEGER + (instr('CT', upper(strid[3])) = 0)::INTEGER + (instr('CGT', upper(strid[4])) = 0)::INTEGER AS INTEGER) AS n FROM sbcd_recs WHERE strid IS NOT NULL"
)
def iupac_mismatch(spark, d):
    return load(spark, d, "sbcd_recs").filter("strid IS NOT NULL").select("rec_id", seq.iupac_mismatches(F.col("strid"), "RNYB").alias("n"))


@query("SELECT rec_id, CAST(len(list_filter(range(1, 9), lambda i: strid[i] <> 'ACGTACGT'[i] AND strid[i] <> 'N')) AS INTEGER) AS n FROM sbcd_recs WHERE strid IS NOT NULL")
def hamming_n(spark, d):
    return load(spark, d, "sbcd_recs").filter("strid IS NOT NULL").select("rec_id", seq.hamming(F.col("strid"), F.lit("ACGTACGT"), 8).alias("n"))


# --- pictures and sparse rows ----------------------------------------------------------------------------------------
@query(f"SELECT CAST(floor(x / 10) AS BIGINT) AS px, CAST(floor(y / 10) AS BIGINT) AS py, CAST(least(255, sum(count)) AS INTEGER) AS value FROM {_GOOD} GROUP BY 1, 2")
def pixel_saturate(spark, d):
    return raster.intensity(_good(spark, d), "x", "y", 10.0, count="count")


@query(
    f"WITH i AS (SELECT CAST(floor(x / 10) AS BIGINT) AS px, CAST(floor(y / 10) AS BIGINT) AS py, CAST(least(255, sum(count)) AS INTEGER) AS v FROM {_GOOD} GROUP BY 1, 2), "
    "h AS (SELECT v, sum(count(*)) OVER (ORDER BY v) AS run, sum(count(*)) OVER () AS t FROM i WHERE v > 0 GROUP BY v), q AS (SELECT min(v) AS q FROM h WHERE run >= 0.9::DOUBLE * t) "
    "SELECT px, py, CAST(least(255, floor(v * 255 / greatest(q, 1))) AS INTEGER) AS value FROM i, q"
)
def contrast_stretch(spark, d):
    return raster.stretch(pixel_saturate(spark, d), 0.9)


@query(
    f"SELECT CAST(floor(x / 20) AS BIGINT) AS px, CAST(floor(y / 20) AS BIGINT) AS py, CAST(floor(least(255, sum(255 * (count * 0.5::DOUBLE)))) AS INTEGER) AS r, "
    f"CAST(floor(least(255, sum(128 * (count * 0.5::DOUBLE)))) AS INTEGER) AS g, 0 AS b FROM {_GOOD} WHERE gene = 'Yev462' GROUP BY 1, 2"
)
def gene_colors(spark, d):
    colors = spark.createDataFrame([("Yev462", "#FF8000")], "gene string, hex string")
    return raster.by_gene(_good(spark, d), colors, 20.0, per_count=0.5)


@query(
    "WITH c AS (SELECT gene AS feature, CAST(floor(x / 50) AS BIGINT) AS cell_id, sum(count) AS cnt FROM " + _GOOD + " WHERE gene IS NOT NULL GROUP BY ALL), "
    "f AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM c)) "
    "SELECT cell_id, CAST(count(*) AS INTEGER) AS n_genes, CAST(sum(cnt) AS BIGINT) AS n_mols, string_agg(CAST(idx AS VARCHAR) || ' ' || CAST(CAST(cnt AS BIGINT) AS VARCHAR), chr(9) ORDER BY idx) AS pairs FROM c JOIN f USING (feature) GROUP BY cell_id"
)
def sparse_rows(spark, d):
    long = _good(spark, d).filter("gene IS NOT NULL").select(F.col("gene").alias("feature"), F.floor(F.col("x") / 50).alias("cell_id"), F.col("count").alias("cnt"))
    names = ordering.dense_ids(long.select("feature").distinct(), ["feature"], name="idx").withColumn("idx", F.col("idx") - 1)
    rows = matrices.sparse_rows(long, names, ["cell_id"])
    pairs = F.array_join(F.zip_with("idx", "cnt", lambda i, c: F.concat_ws(" ", i.cast("string"), c.cast("string"))), "\t")
    return rows.select("cell_id", "n_genes", "n_mols", pairs.alias("pairs"))


_SHAPES = """r AS (SELECT poly_id, xs, ys FROM cell_polygons WHERE len(xs) = len(ys) AND len(xs) >= 3),
e AS (SELECT poly_id, xs[k] AS x1, ys[k] AS y1, xs[k % len(xs) + 1] AS x2, ys[k % len(xs) + 1] AS y2 FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM r)),
b AS (SELECT poly_id, list_min(xs) AS x1, list_max(xs) AS x2, list_min(ys) AS y1, list_max(ys) AS y2 FROM r)"""

ORACLES["raster_join"] = f"""WITH {_SHAPES},
h AS (SELECT poly_id, x1, x2, unnest(range(CAST(floor(y1) AS BIGINT), CAST(floor(y2) AS BIGINT) + 1)) AS j FROM b),
g AS (SELECT poly_id, j, unnest(range(CAST(floor(x1) AS BIGINT), CAST(floor(x2) AS BIGINT) + 1)) AS i FROM h),
o AS (SELECT g.poly_id, i, j FROM g JOIN e ON g.poly_id = e.poly_id AND (e.y1 > j + 0.5::DOUBLE) <> (e.y2 > j + 0.5::DOUBLE)
  AND i + 0.5::DOUBLE < (e.x2 - e.x1) * (j + 0.5::DOUBLE - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1),
c AS (SELECT i, j, min(poly_id) AS cell FROM o GROUP BY i, j HAVING count(*) = 1)
SELECT mol_id, coalesce(CAST(cell AS VARCHAR), 'UNASSIGNED') AS cell
FROM (SELECT mol_id, CASE WHEN NOT isnan(x) THEN floor(x) END AS i, CASE WHEN NOT isnan(y) THEN floor(y) END AS j FROM molecules) LEFT JOIN c USING (i, j)"""

ORACLES["pip_join_expanded"] = (
    _PIP
    + """, z AS (SELECT i.id, i.poly_id, (x - list_sum(xs) / len(xs)) * (x - list_sum(xs) / len(xs)) + (y - list_sum(ys) / len(ys)) * (y - list_sum(ys) / len(ys)) AS d FROM i JOIN o USING (poly_id)),
a AS (SELECT id, arg_min(poly_id, (d, poly_id)) AS cell FROM z GROUP BY id),
n AS (SELECT p.id, p.x, p.y, b.poly_id FROM p JOIN b ON p.x BETWEEN b.x1 - 1 AND b.x2 + 1 AND p.y BETWEEN b.y1 - 1 AND b.y2 + 1 WHERE p.id NOT IN (SELECT id FROM a)),
t AS (SELECT n.id, n.poly_id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy,
  greatest(0::DOUBLE, least(1::DOUBLE, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0))) AS t FROM n JOIN e USING (poly_id)),
s AS (SELECT id, poly_id, (x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy)) AS d FROM t),
u AS (SELECT id, arg_min(poly_id, (d, poly_id)) AS cell FROM s WHERE d <= 1 GROUP BY id)
SELECT mol_id, coalesce(CAST(a.cell AS VARCHAR), CAST(u.cell AS VARCHAR), 'UNASSIGNED') AS cell FROM molecules LEFT JOIN a ON mol_id = a.id LEFT JOIN u ON mol_id = u.id"""
)
