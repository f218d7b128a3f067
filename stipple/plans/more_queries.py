"""Queries of scalar functions, orders, layouts and pictures, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.functions import geom, seq, stats
from stipple.functions import text as ft
from stipple.operators import aggregates as agg
from stipple.operators import filters, ordering, project, raster, sets, spatial
from stipple.plans import commands
from stipple.plans.core_queries import _CUT, _TILES, _tiles, duplicate_spread, fixed
from stipple.plans.core_queries import ORACLES as _CORE
from stipple.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _recs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sbcd_recs")


# --- projections -----------------------------------------------------------------------------------------------------
@query("SELECT mol_id, gene AS quoted FROM molecules")
def unquoted_choice(spark, d):
    rows = load(spark, d, "molecules").select("mol_id", F.concat(F.lit('"'), "gene", F.lit('"')).alias("gene"))
    return project.choose(rows, "mol_id,gene:quoted", unquote=True)


@query("SELECT n_nationkey AS in_key, n_name AS in_name FROM nation")
def prefixed_columns(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return project.prefix(n, ["key", "name"], "in_")


@query("SELECT pix_id, true AS near, x IS NOT NULL AS known FROM pixel_factors")
def jittered_coordinates(spark, d):
    """Jitter is a hash of the key: what holds is that it stays within its bound and is the same again."""
    p = load(spark, d, "pixel_factors").select("pix_id", "x")
    moved = project.jitter(p, ["x"], 0.5, key=["pix_id"]).select("pix_id", F.col("x").alias("m"))
    again = project.jitter(p.repartition(3), ["x"], 0.5, key=["pix_id"]).select("pix_id", F.col("x").alias("n"))
    both = p.join(moved, "pix_id").join(again, "pix_id")
    return both.select("pix_id", F.coalesce((F.abs(F.col("m") - F.col("x")) <= 0.5) & (F.col("m") == F.col("n")), F.lit(True)).alias("near"), F.col("m").isNotNull().alias("known"))


@query("SELECT rec_id, true AS formed FROM sbcd_recs")
def random_keys(spark, d):
    return project.random_key(_recs(spark, d).select("rec_id"), ["rec_id"]).select("rec_id", F.col("random_key").rlike(r"\A[0-9a-f]{8}\z").alias("formed"))


@query("SELECT rec_id, lane FROM sbcd_recs")
def dropped_random_key(spark, d):
    return project.drop_random_key(project.random_key(_recs(spark, d).select("rec_id", "lane"), ["rec_id"]))


@query(
    "WITH c AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name, unnest([sum(l_quantity), sum(l_extendedprice), sum(l_discount), sum(l_tax)]) AS total, unnest([0, 1, 2, 3]) AS i FROM lineitem) "
    "SELECT name, CAST(row_number() OVER (ORDER BY total DESC, i DESC) AS INTEGER) AS place FROM c"
)
def columns_by_total(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = project.order_by_total(load(spark, d, "lineitem").select("l_orderkey", *names), names)
    return spark.createDataFrame([(c, k + 1) for k, c in enumerate(out.columns[1:])], "name string, place int")


@query("SELECT rec_id, substr(strid, 3, 10) || substr(strid, 1, 5) AS seq1, substr(strid, 1, 20) AS seq2 FROM sbcd_recs")
def relaid_reads(spark, d):
    r = _recs(spark, d).select("rec_id", *(F.col("strid").alias(c) for c in ("seq1", "qual1", "seq2", "qual2")))
    return project.relay_fastq(r, skip=2, len_bcd=10, len_umi=5, len_r2=20).select("rec_id", "seq1", "seq2")


_GRID = (
    f"t AS ({_TILES}), a AS (SELECT tile, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM t GROUP BY tile), "
    "l AS (SELECT tile, tile // 1000 + 1 AS row, tile % 10 + 1 AS col, xmin, ymin, xmax - xmin + 1 AS h, ymax - ymin + 1 AS w FROM a), r AS (SELECT row, max(h) AS s FROM l GROUP BY row), c AS (SELECT col, max(w) AS s FROM l GROUP BY col), "
    "p AS (SELECT tile, row, col, xmin, ymin, CAST(coalesce((SELECT sum(s) FROM r WHERE r.row < l.row), 0) AS BIGINT) AS x_offset, CAST(coalesce((SELECT sum(s) FROM c WHERE c.col < l.col), 0) AS BIGINT) AS y_offset FROM l)"
)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    a = _tiles(spark, d).groupBy("tile").agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
    layout = a.select("tile", (F.floor(F.col("tile") / 1000) + 1).cast("int").alias("row"), (F.col("tile") % 10 + 1).alias("col"))
    return project.grid_offsets(layout, a).join(a.select("tile", "xmin", "ymin"), "tile")


@query(f"WITH {_GRID} SELECT tile, row, col, x_offset, y_offset FROM p")
def grid_layout(spark, d):
    return _grid(spark, d).select("tile", "row", "col", "x_offset", "y_offset")


@query(f"WITH {_GRID} SELECT rec_id, tile || '_' || strid AS strid, greatest((px - xmin + x_offset)::DOUBLE, 0) AS px, greatest((py - ymin + y_offset)::DOUBLE, 0) AS py FROM sbcd_recs JOIN p USING (tile)")
def grids_by_layout(spark, d):
    return sets.union_by_layout(_recs(spark, d).select("rec_id", "strid", "px", "py", "lane", "tile"), _grid(spark, d)).select("rec_id", "strid", "px", "py")


# --- filters, joins, sums --------------------------------------------------------------------------------------------
@query("SELECT key, n, rec_id FROM (" + _CORE["duplicate_spread"] + ") WHERE n <= 3 AND max_dist <= 1000")
def duplicate_filter(spark, d):
    return duplicate_spread(spark, d).filter("n <= 3 AND max_dist <= 1000").select("key", "n", "rec_id")


@query(
    "WITH s AS (SELECT CASE WHEN lane < 2 THEN 'a' ELSE 'b' END AS sample, CAST(tile AS VARCHAR) AS cell, substr(strid, 1, 2) AS feature FROM sbcd_recs WHERE strid IS NOT NULL AND tile IS NOT NULL), "
    "k AS (SELECT feature FROM (SELECT sample, feature FROM s GROUP BY ALL HAVING count(*) >= 20) GROUP BY feature HAVING count(*) = 2) "
    "SELECT feature, CAST(count(*) AS BIGINT) AS total FROM s WHERE feature IN (SELECT feature FROM k) GROUP BY feature"
)
def merged_sample_totals(spark, d):
    rows = _recs(spark, d).filter("strid IS NOT NULL AND tile IS NOT NULL").select("lane", F.col("tile").cast("string").alias("cell_id"), F.substring("strid", 1, 2).alias("feature"))
    rows = rows.groupBy("lane", "cell_id", "feature").agg(F.count(F.lit(1)).alias("cnt"))
    out = commands.merge_sparse([("a", rows.filter("lane < 2").drop("lane")), ("b", rows.filter("lane >= 2").drop("lane"))], least=20)["features"]
    return out.select(F.col("feature"), F.col("count").alias("total"))


@query(
    "WITH n AS (" + _CORE["nn_grid_join"] + f") SELECT count(*) AS n, count(d2) AS n_matched, {_CUT.format('avg(sqrt(d2))')} AS mean_distance FROM n"
)
def match_distance(spark, d):
    near = spatial.nearest(load(spark, d, "molecules").select("mol_id", "x", "y"), load(spark, d, "pixel_factors"), 2.0, point_id="mol_id", target_id="pix_id")
    return agg.match_distance(near).withColumn("mean_distance", fixed(F.col("mean_distance")))


# --- orders ----------------------------------------------------------------------------------------------------------
def _ranges(df: DataFrame, key: str, kind: str) -> DataFrame:
    """One row: whether the values of a range-partitioned table rise within and over its ranges, and their number."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = last = None
        n, ok = 0, True
        for pdf in batches:
            v = pdf[key].tolist()
            if not v:
                continue
            ok = ok and all(a <= b for a, b in zip(v, v[1:])) and (last is None or last <= v[0])
            first, last, n = v[0] if first is None else first, v[-1], n + len(v)
        if n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "n": [n], "ok": [ok]})

    parts = df.select(key).mapInPandas(ends, f"part int, first {kind}, last {kind}, n long, ok boolean")
    in_order = F.array_sort(F.collect_list(F.struct("part", "first", "last", "n", "ok"))).alias("r")  # one row a partition
    rows = parts.agg(in_order)
    rising = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size("r"), F.lit(2))), F.lit(True), lambda a, i: a & F.coalesce(F.get("r", i - 2)["last"] <= F.get("r", i - 1)["first"], F.lit(True)))
    return rows.select((F.forall("r", lambda z: z["ok"]) & rising).alias("sorted"), F.aggregate("r", F.lit(0).cast("long"), lambda a, z: a + z["n"]).alias("n"))


@query("SELECT true AS sorted, count(*) AS n FROM sbcd_recs WHERE strid IS NOT NULL")
def sorted_ranges(spark, d):
    return _ranges(ordering.sorted_within(_recs(spark, d).filter("strid IS NOT NULL"), ["strid"]), "strid", "string")


@query("SELECT true AS sorted, count(DISTINCT gene) AS n FROM molecules WHERE gene IS NOT NULL")
def names_by_total(spark, d):
    totals = load(spark, d, "molecules").filter("gene IS NOT NULL").groupBy("gene").agg(F.sum(F.coalesce("count", F.lit(0))).alias("total"))
    # the order as one text: falling totals as rising complements, then the name
    key = F.concat(F.lpad((F.lit(10**18) - F.col("total")).cast("string"), 20, "0"), F.lit(" "), "gene")
    return _ranges(ordering.by_total(totals, "gene", "total").select(key.alias("k")), "k", "string")


@query("SELECT factor, feature, entry_id, CAST(row_number() OVER (PARTITION BY factor ORDER BY log10p DESC, feature, entry_id) AS INTEGER) AS place FROM de_entries WHERE factor IS NOT NULL AND feature IS NOT NULL AND log10p IS NOT NULL AND NOT isnan(log10p)")
def entries_by_p(spark, d):
    from pyspark.sql import Window

    rows = load(spark, d, "de_entries").filter("factor IS NOT NULL AND feature IS NOT NULL AND log10p IS NOT NULL AND NOT isnan(log10p)")
    order = Window.partitionBy("factor").orderBy(F.desc("log10p"), "feature", "entry_id")
    return rows.select("factor", "feature", "entry_id", F.row_number().over(order).alias("place"))


# --- sequences -------------------------------------------------------------------------------------------------------
@query("SELECT rec_id, reverse(strid) AS r FROM sbcd_recs")
def reversed_sequences(spark, d):
    return _recs(spark, d).select("rec_id", seq.rev(F.col("strid")).alias("r"))


_DIGITS = "translate(regexp_replace(translate(upper(substr(strid, 1, {0})), 'ACGT', '0123'), '[^0-3]', '3', 'g'), '', '')"
_CODE = "CAST(list_reduce(list_transform(string_split(rpad({0}, {1}, '3'), ''), lambda c: CAST(c AS BIGINT)), lambda a, c: a * {2} + c, 0::BIGINT) AS BIGINT)"


@query(f"SELECT rec_id, {_CODE.format(_DIGITS.format(20), 20, 4)} AS code FROM sbcd_recs WHERE strid IS NOT NULL")
def two_bit_codes(spark, d):
    return _recs(spark, d).filter("strid IS NOT NULL").select("rec_id", seq.bits2(F.col("strid"), 20).alias("code"))


_FIVE = "translate(regexp_replace(upper(substr(strid, {0}, {1})), '[^ACGT]', 'N', 'g'), 'ACGNT', '01234')"


@query("SELECT rec_id, [" + ", ".join(_CODE.format(_FIVE.format(at, n), n, 5) for at, n in ((1, 12), (13, 12), (25, 6))) + "] AS codes FROM sbcd_recs WHERE strid IS NOT NULL")
def base5_chunks(spark, d):
    return _recs(spark, d).filter("strid IS NOT NULL").select("rec_id", seq.nt5_chunks(F.col("strid"), 30, 12).alias("codes"))


@query("SELECT rec_id, rpad(regexp_replace(upper(substr(strid, 1, 24)), '[^ACGT]', 'N', 'g'), 24, 'N') AS s FROM sbcd_recs WHERE strid IS NOT NULL")
def base5_decoded(spark, d):
    return _recs(spark, d).filter("strid IS NOT NULL").select("rec_id", seq.from_nt5(seq.nt5(F.col("strid"), 24), 24).alias("s"))


@query(
    "WITH k AS (SELECT rec_id, strid[1:4] || strid[9:12] AS a, strid[5:12] AS b FROM sbcd_recs WHERE strid IS NOT NULL), s AS (SELECT strid AS seen, strid[1:4] || strid[9:12] AS a, strid[5:12] AS b FROM seen_strids) "
    "SELECT rec_id, seen, count(*) AS n_masks FROM (SELECT rec_id, seen FROM k JOIN s USING (a) UNION ALL SELECT rec_id, seen FROM k JOIN s USING (b)) GROUP BY ALL"
)
def spaced_mask_matches(spark, d):
    masks = ["1" * 4 + "0" * 4 + "1" * 4, "0" * 4 + "1" * 8]
    return seq.spaced_matches(_recs(spark, d), load(spark, d, "seen_strids").select(F.col("strid").alias("seen")), masks, query_id="rec_id", query="strid", seq_id="seen", sequence="seen")


@query("SELECT rec_id, lane, tile, px AS x, py AS y FROM sbcd_recs")
def read_name_places(spark, d):
    name = F.concat_ws(":", F.lit("M"), F.lit("1"), F.lit("F"), *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("lane", "tile", "px", "py")))
    return _recs(spark, d).select("rec_id", seq.illumina_name(F.concat(name, F.lit(" 1:N:0"))).alias("p")).select("rec_id", "p.*")


_SAY = " + ".join(f"CASE WHEN upper(strid[{i + 1}]) IN ({', '.join(repr(b) for b in {'N': 'ACGTN', 'H': 'ACT', 'V': 'ACG'}[p])}) THEN 0 ELSE 1 END" for i, p in enumerate("NNHNVNNVNVNVNVNVNVNN") if p != "N")


@query(f"SELECT rec_id, {_SAY} AS mismatches FROM sbcd_recs WHERE strid IS NOT NULL AND length(strid) >= 20")
def layout_mismatches(spark, d):
    rows = _recs(spark, d).filter("strid IS NOT NULL AND length(strid) >= 20")
    return rows.select("rec_id", seq.best_mismatches(F.col("strid"), seq.FORMATS["HDMI20"].patterns).alias("mismatches"))


@query("SELECT id, TRY_CAST(string_split(counts, ',')[2] AS BIGINT) AS second FROM features")
def list_entry(spark, d):
    return load(spark, d, "features").select("id", ft.subfield(F.col("counts"), 1).try_cast("bigint").alias("second"))


@query("SELECT pix_id, CASE WHEN x = floor(x) THEN CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', x) END AS x FROM pixel_factors WHERE x IS NOT NULL")
def coordinate_texts(spark, d):
    return load(spark, d, "pixel_factors").filter("x IS NOT NULL").select("pix_id", ft.coordinate(F.col("x")).alias("x"))


# --- statistics and geometry -----------------------------------------------------------------------------------------
_P = "list_transform(list_filter([log10p, fc], lambda v: v IS NOT NULL AND NOT isnan(v) AND v >= 0.001 AND v <= 12), lambda v: tan((0.5 - pow(10.0::DOUBLE, -v)) * pi()))"


@query(f"WITH t AS (SELECT entry_id, list_avg({_P}) AS t, len({_P}) AS n FROM de_entries) SELECT entry_id, {_CUT.format('-log10(0.5 - atan(t) / pi())')} AS log10p FROM t WHERE n > 0 AND t < 1e6")
def combined_p(spark, d):
    own = F.filter(F.array("log10p", "fc"), lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0.001) & (v <= 12))
    rows = load(spark, d, "de_entries").select("entry_id", own.alias("v")).filter(F.size("v") > 0)
    mean = F.aggregate(F.transform("v", lambda v: F.tan((0.5 - F.pow(F.lit(10.0), -v)) * 3.141592653589793)), F.lit(0.0), lambda a, b: a + b) / F.size("v")
    return rows.filter(mean < 1e6).select("entry_id", fixed(stats.cauchy_combination(F.col("v"))).alias("log10p"))


@query(f"SELECT entry_id, CASE WHEN a > b THEN {_CUT.format('a + ln(1 - exp(b - a))')} END AS s FROM (SELECT entry_id, log10p AS a, fc AS b FROM de_entries WHERE abs(log10p) < 1e9 AND abs(fc) < 1e9) WHERE a <= b OR a - b > 0.01")
def log_differences(spark, d):
    rows = load(spark, d, "de_entries").filter("abs(log10p) < 1e9 AND abs(fc) < 1e9 AND (log10p <= fc OR log10p - fc > 0.01)")
    return rows.select("entry_id", fixed(stats.log_sub(F.col("log10p"), F.col("fc"))).alias("s"))


@query(
    "WITH b AS (SELECT poly_id, list_min(xs) AS x1, list_max(xs) AS x2, list_min(ys) AS y1, list_max(ys) AS y2 FROM cell_polygons WHERE len(xs) >= 3 AND len(ys) >= 3) "
    "SELECT poly_id, x1 AS xmin, x2 AS xmax, y1 AS ymin, y2 AS ymax, x1 <= 500 AND x2 >= 100 AND y1 <= 400 AND y2 >= 50 AS meets FROM b WHERE NOT isnan(x2) AND NOT isnan(y2)"
)
def bounding_boxes(spark, d):
    rows = load(spark, d, "cell_polygons").filter("size(xs) >= 3 AND size(ys) >= 3").select("poly_id", geom.bbox(F.col("xs"), F.col("ys")).alias("b"))
    fixed_box = F.struct(F.lit(100.0).alias("xmin"), F.lit(500.0).alias("xmax"), F.lit(50.0).alias("ymin"), F.lit(400.0).alias("ymax"))
    return rows.filter("NOT isnan(b.xmax) AND NOT isnan(b.ymax)").select("poly_id", "b.*", geom.boxes_overlap(F.col("b"), fixed_box).alias("meets"))


@query("SELECT poly_id, xs[1] + 2.5 AS x FROM cell_polygons WHERE xs[1] IS NOT NULL AND NOT isnan(xs[1])")
def moved_regions(spark, d):
    rows = load(spark, d, "cell_polygons").select("poly_id", F.get(geom.translate(F.col("xs"), 2.5), F.lit(0)).alias("x"))
    return rows.filter("x IS NOT NULL AND NOT isnan(x)")


# --- pictures --------------------------------------------------------------------------------------------------------
@query(
    "WITH p AS (SELECT x, y, 255 AS r, 0 AS g FROM pixel_factors UNION ALL SELECT x, y, 0, 100 FROM molecules WHERE NOT isnan(x) AND NOT isnan(y)) "
    "SELECT CAST(floor(x / 20) AS BIGINT) AS px, CAST(floor(y / 20) AS BIGINT) AS py, CAST(least(255, sum(r)) AS INTEGER) AS r, CAST(least(255, sum(g)) AS INTEGER) AS g, 0 AS b FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2"
)
def layered_picture(spark, d):
    m = load(spark, d, "molecules").filter("NOT isnan(x) AND NOT isnan(y)")
    return raster.layers([(load(spark, d, "pixel_factors"), "#FF0000"), (m, "006400")], "x", "y", 20.0)


@query(
    "WITH m AS (SELECT CAST(floor(x / 20) AS BIGINT) AS px, CAST(floor(y / 20) AS BIGINT) AS py, CASE WHEN gene < 'M' THEN 0 ELSE 1 END AS unit, count FROM molecules WHERE gene IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND count > 0), "
    "s AS (SELECT unit, px, py, sum(count) AS s FROM m WHERE px IS NOT NULL AND py IS NOT NULL GROUP BY ALL), l AS (SELECT unit, quantile_disc(s, 0.9) AS level FROM s GROUP BY unit), "
    "f AS (SELECT px, py, CASE unit WHEN 0 THEN 255 ELSE 16 END AS r, CASE unit WHEN 0 THEN 0 ELSE 200 END AS g, least(1.0::DOUBLE, s::DOUBLE / level::DOUBLE) AS f FROM s JOIN l USING (unit)) "
    "SELECT px, py, CAST(least(255, sum(floor(r * f))) AS INTEGER) AS r, CAST(least(255, sum(floor(g * f))) AS INTEGER) AS g, 0 AS b FROM f GROUP BY px, py"
)
def unit_picture(spark, d):
    m = load(spark, d, "molecules").filter("gene IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    unit = F.when(F.col("gene") < "M", 0).otherwise(1)
    own = m.select("x", "y", unit.alias("unit"), F.when(unit == 0, "#FF0000").otherwise("#10C800").alias("color"), "count")
    return raster.unit_picture(own, 20.0, q=0.9)


@query(
    "WITH r AS (SELECT s_suppkey AS k, s_suppkey * 3.0 AS x, s_nationkey * 5.0 AS y FROM supplier), g AS (SELECT k, px, py FROM r, range(0, 700) a(px), range(0, 150) b(py) WHERE px + 0.5 > x AND px + 0.5 < x + 7 AND py + 0.5 > y AND py + 0.5 < y + 6) "
    "SELECT px, py, CAST(floor(list_reduce(list(CASE WHEN k % 2 = 0 THEN 200.0::DOUBLE ELSE 40.0::DOUBLE END ORDER BY k), lambda v, c: v * 0.5 + c * 0.5, 0.0::DOUBLE) + 0.5) AS INTEGER) AS r, 0 AS g, "
    "CAST(floor(list_reduce(list(80.0::DOUBLE ORDER BY k), lambda v, c: v * 0.5 + c * 0.5, 0.0::DOUBLE) + 0.5) AS INTEGER) AS b FROM g WHERE k <= 200 GROUP BY px, py"
)
def filled_regions(spark, d):
    s = load(spark, d, "supplier").filter("s_suppkey <= 200")
    x, y = F.col("s_suppkey") * 3.0, F.col("s_nationkey") * 5.0
    boxes = s.select("s_suppkey", F.array(x, x + 7, x + 7, x).alias("xs"), F.array(y, y, y + 6, y + 6).alias("ys"), F.when(F.col("s_suppkey") % 2 == 0, "C80050").otherwise("280050").alias("color"))
    return raster.filled_regions(boxes, order="s_suppkey")


@query(
    "WITH g AS (SELECT CAST(floor(x / 16) AS BIGINT) AS px, CAST(floor(y / 16) AS BIGINT) AS py, CAST(least(255, count(*)) AS INTEGER) AS value FROM pixel_factors WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2) "
    "SELECT px, py, 255 AS r, 128 AS g, 0 AS b, CASE WHEN value < 2 OR value > 200 THEN 0 ELSE CAST(255 - least(255, value * 3.0) AS INTEGER) END AS a FROM g"
)
def gray_to_alpha(spark, d):
    image = raster.intensity(load(spark, d, "pixel_factors"), "x", "y", 16.0)
    return raster.rgba(image, rgb="FF8000", below=2, above=200, how="linear", linear=3.0, invert_alpha=True)
