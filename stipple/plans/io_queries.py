"""One query a reader or writer: a whole table is written to the shared folder, read back, and compared with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.operators import aggregates as agg
from stipple.operators import joins, ordering, raster
from stipple.plans.core_queries import _BULK, _bulk
from stipple.session import load, scratch, write_bytes
from stipple.sources import matrices, reads, shapes
from stipple.sources import text_tables as tt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def plain(c: str) -> tuple[Column, Column]:
    """A double without NaN, and whether it was NaN."""
    return F.when(~F.isnan(c), F.col(c)).alias(c), F.isnan(c).alias(f"{c}_nan")


_PLAIN = "CASE WHEN NOT isnan({0}) THEN {0} END AS {0}, coalesce(isnan({0}), false) AS {0}_nan"


def text_file(spark: SparkSession, lines: DataFrame, order: str) -> str:
    """A small text file of the column value, in order."""
    path = scratch(spark)
    lines.repartition(1).sortWithinPartitions(order).select("value").write.text(path)
    return path


# --- delimited tables ------------------------------------------------------------------------------------------------
@query(f"SELECT mol_id, {_PLAIN.format('x')}, {_PLAIN.format('y')}, coalesce(gene, '') AS gene, coalesce(gene_id, '') AS gene_id, CAST(count AS BIGINT) AS count FROM molecules")
def molecule_file(spark, d):
    path = scratch(spark)
    rows = load(spark, d, "molecules")
    tt.write_table(rows.select(F.col("x").alias("X"), F.col("y").alias("Y"), "gene", "gene_id", "count", "mol_id"), path)
    own = tt.MOLECULES.apply(tt.read_table(spark, path), rest=True)
    return own.select(F.col("mol_id").cast("bigint").alias("mol_id"), *plain("x"), *plain("y"), "gene", "gene_id", "count")


@query("SELECT id, name, nid FROM features")
def skipped_preamble(spark, d):
    f = load(spark, d, "features").select(F.col("nid").alias("k"), F.concat_ws("\t", "id", "name", F.col("nid").cast("string")).alias("value"))
    extra = spark.createDataFrame([(-3, "made by hand"), (-2, "id\tname\tnid"), (-1, "#id\tname\tnid"), (5, "#a remark")], "k long, value string")
    df = tt.read_table(spark, text_file(spark, f.unionByName(extra), "k"), skip=2, comment="#", strip="#")
    return df.select("id", "name", F.col("nid").cast("bigint").alias("nid"))


@query("SELECT id FROM features WHERE id IN (SELECT gene_id FROM molecules)")
def value_list_file(spark, d):
    path = scratch(spark)
    load(spark, d, "molecules").filter("gene_id IS NOT NULL AND trim(gene_id) <> ''").select(F.concat_ws(" ", "gene_id", F.lit("more")).alias("value")).write.text(path)
    return load(spark, d, "features").join(tt.read_values(spark, path).withColumnRenamed("value", "id"), "id", "left_semi").select("id")


@query("SELECT 'nations' AS sample, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'regions', r_regionkey, r_name FROM region")
def listed_files(spark, d):
    paths = []
    for name, key, label in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        paths.append((f"{name}s", scratch(spark)))
        tt.write_table(load(spark, d, name).select(F.col(key).alias("key"), F.col(label).alias("name")), paths[-1][1], single=True)
    listing = text_file(spark, spark.createDataFrame([(k, f"{n}\t{p}") for k, (n, p) in enumerate(paths)], "k int, value string"), "k")
    return tt.read_tables(spark, listing).select("sample", F.col("key").cast("int").alias("key"), "name")


@query("SELECT pix_id, round(x * 1000) / 1000 AS x, round(y * 1000) / 1000 AS y, list_resize(coalesce(factors, []), 2) AS k FROM pixel_factors")
def pixel_decode_file(spark, d):
    rows = load(spark, d, "pixel_factors")
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)).cast("string"), F.lit(""))
    # coordinates in thousandths behind the origin 100, 200, and the id in place of the second probability
    line = F.concat_ws("\t", *(F.coalesce(F.round((F.col(c) - o) * 1000).cast("bigint").cast("string"), F.lit("")) for c, o in (("x", 100.0), ("y", 200.0))), at("factors", 0), at("factors", 1), at("probs", 0), F.col("pix_id").cast("string"))
    head = spark.createDataFrame([(-2, "##TOPK=2;SCALE=1000;OFFSET_X=100;OFFSET_Y=200"), (-1, "#x\ty\tK1\tK2\tP1\tP2")], "k long, value string")
    df = tt.read_pixel_decode(spark, text_file(spark, rows.select(F.col("pix_id").alias("k"), line.alias("value")).unionByName(head), "k"))
    back = lambda c: (F.round(F.col(c) * 1000) / 1000).alias(c)
    return df.select(F.get("p", F.lit(1)).cast("bigint").alias("pix_id"), back("x"), back("y"), "k")


@query("SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM pixel_factors")
def bounds_file(spark, d):
    path = scratch(spark)
    tt.write_bounds(load(spark, d, "pixel_factors"), path, "x", "y")
    return spark.createDataFrame([tt.read_minmax(spark, path)], "xmin double, xmax double, ymin double, ymax double")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS tag_id, n_name AS tag_name, repeat('A', n_nationkey) || 'CG' AS tag_seq FROM nation")
def tag_file(spark, d):
    n = load(spark, d, "nation")
    line = F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.concat(F.repeat(F.lit("A"), F.col("n_nationkey").cast("int")), F.lit("CG")))
    return tt.read_tags(spark, text_file(spark, n.select("n_nationkey", line.alias("value")), "n_nationkey"))


@query("SELECT n_name AS gene, printf('%02X', CAST(round(n_nationkey / 25.0 * 255) AS INTEGER)) || '00FF' AS hex FROM nation")
def color_file(spark, d):
    path = scratch(spark)
    tt.write_table(load(spark, d, "nation").select(F.col("n_name").alias("Name"), (F.col("n_nationkey") / 25.0).alias("R"), F.lit(0).alias("G"), F.lit(1).alias("B")), path, single=True)
    return tt.read_colors(spark, path)


@query("SELECT p_brand AS gene, count(*) AS count, CAST(count(*) % 5 AS INTEGER) AS bin FROM part GROUP BY p_brand")
def bin_file(spark, d):
    bins = load(spark, d, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.count(F.lit(1)).alias("count")).withColumn("bin", (F.col("count") % 5).cast("int"))
    path = scratch(spark)
    write_bytes(spark, path, tt.bins_json(bins).encode())
    return tt.read_bins(spark, path)


# --- partitioned writers ---------------------------------------------------------------------------------------------
@query(
    "SELECT level, lane, tile, count(*) AS n FROM (SELECT 'all' AS level, NULL::INTEGER AS lane, NULL::INTEGER AS tile FROM sbcd_recs WHERE tile IS NOT NULL UNION ALL "
    "SELECT 'lane', lane, NULL FROM sbcd_recs WHERE tile IS NOT NULL UNION ALL SELECT 'tile', lane, tile FROM sbcd_recs WHERE tile IS NOT NULL) GROUP BY ALL"
)
def tile_files(spark, d):
    folder = scratch(spark)
    rows = load(spark, d, "sbcd_recs").filter("tile IS NOT NULL")
    tt.write_tiles(rows.select("strid", "lane", "tile", "px", "py", "mismatches"), folder)
    out = None
    for level in ("all", "lane", "tile"):
        df = spark.read.option("sep", "\t").option("header", True).csv(f"{folder}/{level}")
        keys = {"all": (), "lane": ("lane",), "tile": ("lane", "tile")}[level]
        one = df.select(F.lit(level).alias("level"), *((F.col(c) if c in keys else F.lit(None)).cast("int").alias(c) for c in ("lane", "tile")))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("level", "lane", "tile").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH b AS (SELECT name AS feature, min(nid) % 7 AS bin FROM features GROUP BY name), m AS (SELECT gene, count, bin FROM molecules LEFT JOIN b ON gene = feature) "
    "SELECT 'all' AS part, NULL::INTEGER AS bin, count(*) AS n, CAST(sum(count) AS BIGINT) AS total FROM m UNION ALL SELECT 'bin', bin, count(*), CAST(sum(count) AS BIGINT) FROM m WHERE bin > 0 GROUP BY bin"
)
def bin_files(spark, d):
    bins = load(spark, d, "features").groupBy(F.col("name").alias("gene")).agg((F.min("nid") % 7).cast("int").alias("bin"))
    own = joins.lookup(load(spark, d, "molecules").select("mol_id", "gene", "count"), bins, "gene")
    index = own.filter("bin > 0").groupBy(F.col("bin").alias("bin_id")).agg(F.count(F.lit(1)).alias("rows"))
    folder = scratch(spark)
    tt.write_bins(own, index, folder, columns=["gene", "count"], rename={"count": "n_umi"})
    read = lambda part: spark.read.option("sep", "\t").option("header", True).csv(f"{folder}/{part}")
    every = read("all").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("count").cast("bigint")).alias("total")).select(F.lit("all").alias("part"), F.lit(None).cast("int").alias("bin"), "n", "total")
    each = read("bins").groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_umi").cast("bigint")).alias("total"))
    return every.unionByName(each.select(F.lit("bin").alias("part"), "bin", "n", "total"))


@query("SELECT count(*) AS n, true AS kept FROM sbcd_recs")
def batch_files(spark, d):
    made = tt.write_batches(load(spark, d, "sbcd_recs").select("rec_id", "strid", "lane"), scratch(spark), most=5000)
    return made.agg(F.sum("rows").alias("n"), (F.max("rows") <= 5000).alias("kept"))


# --- matrices --------------------------------------------------------------------------------------------------------
_ENTRIES = """e AS (SELECT l_partkey AS ftr, l_suppkey AS bcd, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS c1,
CAST(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS c2 FROM lineitem GROUP BY ALL)"""


def _matrix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li, new = load(spark, d, "lineitem"), F.col("l_returnflag") == "N"
    sums = [F.sum(F.when(c, F.col("l_quantity")).otherwise(0)).cast("bigint").alias(n) for c, n in ((new, "c1"), (~new, "c2"))]
    e = li.groupBy(F.col("l_partkey").cast("bigint").alias("ftr"), F.col("l_suppkey").cast("bigint").alias("bcd")).agg(*sums)
    b = load(spark, d, "supplier").select(F.col("s_name").alias("strid"), F.col("s_suppkey").cast("bigint").alias("nid"))
    f = load(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("nid"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    return e, b, f


@query(f"WITH {_ENTRIES}, r AS (SELECT *, dense_rank() OVER (ORDER BY bcd) AS b, dense_rank() OVER (ORDER BY ftr) AS f FROM e) SELECT b AS bcd, f AS ftr, c1, c2 FROM r")
def matrix_file(spark, d):
    folder = scratch(spark)
    matrices.write_matrix(folder, *matrices.compact(*_matrix(spark, d), ["c1", "c2"]), ["c1", "c2"])
    path = f"{folder}/matrix.mtx.gz"
    out = matrices.read_entries(spark, path)
    if matrices.read_dimensions(spark, path)[2] != out.count():
        raise ValueError("the header has another number of entries")
    return out


@query(f"WITH {_ENTRIES}, s AS (SELECT ftr, CAST(sum(c1) AS BIGINT) AS c1, CAST(sum(c2) AS BIGINT) AS c2 FROM e GROUP BY ftr) SELECT 'P' || ftr AS id, p_name AS name, dense_rank() OVER (ORDER BY ftr) AS nid, c1, c2 FROM s JOIN part ON ftr = p_partkey")
def matrix_feature_file(spark, d):
    folder = scratch(spark)
    e, b, f = matrices.compact(*_matrix(spark, d), ["c1", "c2"])
    matrices.write_matrix(folder, e, b, f.select("id", "name", "nid"), ["c1", "c2"])
    df = matrices.read_features(spark, f"{folder}/features.tsv.gz", numbered=True)
    return df.select("id", "name", "nid", *(F.get("counts", F.lit(i)).alias(f"c{i + 1}") for i in range(2)))


@query("SELECT coalesce(strid, '') AS strid, rec_id AS nid, lane, tile, px, py, 1::BIGINT AS c1, CAST(coalesce(mismatches, 0) AS BIGINT) AS c2 FROM sbcd_recs")
def barcode_file(spark, d):
    r = load(spark, d, "sbcd_recs")
    path = scratch(spark)
    counts = F.concat_ws(",", F.lit("1"), F.coalesce("mismatches", F.lit(0)).cast("string"))
    tt.write_table(r.select("strid", F.col("rec_id").alias("nid"), F.col("rec_id").alias("gid"), "lane", "tile", "px", "py", counts.alias("counts")), path, header=False)
    df = matrices.read_barcodes(spark, path)
    return df.select("strid", "nid", "lane", "tile", "px", "py", *(F.get("counts", F.lit(i)).alias(f"c{i + 1}") for i in range(2)))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS nid, s_name AS strid, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def plain_barcode_file(spark, d):
    s = load(spark, d, "supplier")
    path = text_file(spark, s.select("s_suppkey", F.concat_ws("\t", F.col("s_acctbal").cast("string"), "s_name", F.col("s_nationkey").cast("string")).alias("value")), "s_suppkey")
    return matrices.read_plain_barcodes(spark, path, icol_barcode=1, icol_x=0, icol_y=2)


@query("SELECT CAST(p_partkey AS VARCHAR) AS barcode, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part")
def position_file(spark, d):
    p = load(spark, d, "part")
    path = scratch(spark)
    tt.write_table(p.select(F.col("p_partkey").alias("barcode"), F.col("p_size").alias("pxl_row_in_fullres"), F.col("p_retailprice").alias("pxl_col_in_fullres")), path, sep=",")
    return joins.positions(p.select(F.col("p_partkey").cast("string").alias("barcode")), matrices.read_positions(spark, path))


@query(f"WITH {_ENTRIES} SELECT ftr, bcd, s_name AS strid, 'P' || ftr AS ftr_id, p_name AS ftr_name, c1, c2 FROM e JOIN supplier ON bcd = s_suppkey JOIN part ON ftr = p_partkey")
def matrix_joined(spark, d):
    e, b, f = _matrix(spark, d)
    return joins.matrix_entries(e, b, f).select("ftr", "bcd", "strid", "ftr_id", "ftr_name", "c1", "c2")


@query(f"WITH {_ENTRIES} SELECT CAST(bcd AS VARCHAR) AS unit, CAST(ftr AS VARCHAR) AS feature, c1 + c2 AS cnt FROM e WHERE c1 + c2 > 0")
def sparse_file(spark, d):
    e = _matrix(spark, d)[0]
    long = e.select(F.col("bcd").cast("string").alias("unit"), F.col("ftr").cast("string").alias("feature"), (F.col("c1") + F.col("c2")).alias("cnt"))
    names = ordering.dense_ids(long.select("feature").distinct(), ["feature"], name="idx").select("feature", (F.col("idx") - 1).cast("int").alias("idx"))
    rows, path = matrices.sparse_rows(long, names, ["unit"]), scratch(spark)
    matrices.sparse_lines(rows, ["unit"]).write.text(path)
    back, own = matrices.read_sparse(spark, path, matrices.sparse_meta(names, ["unit"], rows.count()))
    return matrices.sparse_to_long(back, own, ["unit"])


@query(
    _BULK + " SELECT f.feature, g.factor, coalesce(t.cnt, 0)::DOUBLE AS cnt FROM (SELECT DISTINCT feature FROM t) f, (SELECT DISTINCT factor FROM t) g LEFT JOIN t ON t.feature = f.feature AND t.factor = g.factor"
)
def pseudobulk_file(spark, d):
    path = scratch(spark)
    matrices.write_pseudobulk(_bulk(spark, d), path)
    return matrices.read_pseudobulk(spark, path)


# --- reads -----------------------------------------------------------------------------------------------------------
_READ = "SELECT row_number() OVER (ORDER BY rec_id) - 1 AS read_id, 'r' || rec_id AS name{0}, coalesce(strid, '') AS seq{0}, repeat('I', length(coalesce(strid, ''))) AS qual{0} FROM sbcd_recs"


def _reads(spark: SparkSession, d: str, suffix: str = "") -> DataFrame:
    seq = F.coalesce("strid", F.lit(""))
    return load(spark, d, "sbcd_recs").select(F.col("rec_id").alias("read_id"), F.concat(F.lit("r"), F.col("rec_id").cast("string")).alias(f"name{suffix}"), seq.alias(f"seq{suffix}"), F.repeat(F.lit("I"), F.length(seq)).alias(f"qual{suffix}"))


@query(_READ.format(""))
def read_file(spark, d):
    path = scratch(spark)
    reads.write_fastq(_reads(spark, d), path, compress=False)
    return reads.read_fastq(spark, path)


@query(f"SELECT a.*, name2, seq2, qual2 FROM ({_READ.format('1')}) a JOIN ({_READ.format('2')}) b USING (read_id)")
def mate_files(spark, d):
    paths = {s: scratch(spark) for s in ("1", "2")}
    for s, path in paths.items():
        reads.write_fastq(_reads(spark, d, s), path, suffix=s)
    return reads.read_mates(spark, paths)


@query("SELECT lane AS sample, count(*) AS n, CAST(sum(length(strid)) AS BIGINT) AS bases FROM sbcd_recs GROUP BY lane")
def sample_read_files(spark, d):
    path = scratch(spark)
    reads.write_fastq(_reads(spark, d).join(load(spark, d, "sbcd_recs").select(F.col("rec_id").alias("read_id"), F.col("lane").alias("sample")), "read_id"), path, partition_by=["sample"])
    out = None
    for lane in [r["lane"] for r in load(spark, d, "sbcd_recs").select("lane").distinct().collect()]:  # one folder a sample
        one = reads.read_fastq(spark, f"{path}/sample={lane}").select(F.lit(lane).alias("sample"), F.length("seq").alias("l"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("bases"))


# --- regions and pictures --------------------------------------------------------------------------------------------
_RINGS = "(SELECT * FROM cell_polygons WHERE len(xs) = len(ys) AND len(xs) >= 3 AND list_count(xs) = len(xs) AND list_count(ys) = len(ys) AND len(list_filter(xs, lambda v: isnan(v))) = 0 AND len(list_filter(ys, lambda v: isnan(v))) = 0)"
_VERTICES = "SELECT CAST(poly_id AS VARCHAR) AS region, CAST(len(xs) AS INTEGER) AS n, xs[1] AS x, ys[-1] AS y FROM " + _RINGS


def _rings(spark: SparkSession, d: str) -> DataFrame:
    bad = lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v))
    return load(spark, d, "cell_polygons").filter((F.size("xs") == F.size("ys")) & (F.size("xs") >= 3) & ~bad("xs") & ~bad("ys"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("region", F.size("xs").alias("n"), F.get("xs", F.lit(0)).alias("x"), F.element_at("ys", -1).alias("y"))


def _geojson(spark: SparkSession, d: str) -> str:
    rings = F.array(F.zip_with("xs", "ys", lambda a, b: F.array(a, b)))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("poly_id").alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    path = scratch(spark)
    _rings(spark, d).select(F.to_json(feature).alias("value")).write.text(path)
    return path


@query(_VERTICES)
def geojson_lines(spark, d):
    return _shown(shapes.read_geojson(spark, _geojson(spark, d), attr="poly_id", by_line=True))


@query(_VERTICES)
def geojson_values(spark, d):
    return _shown(shapes.read_geojson(spark, _geojson(spark, d), attr="poly_id", holes="error"))


@query(_VERTICES)
def vertex_file(spark, d):
    path = scratch(spark)
    v = _rings(spark, d).select(F.col("poly_id").alias("cell_id"), F.posexplode(F.arrays_zip("xs", "ys")).alias("k", "v"))
    tt.write_table(v.repartitionByRange("k", "cell_id").sortWithinPartitions("k", "cell_id").select("cell_id", F.col("v.xs").alias("vertex_x"), F.col("v.ys").alias("vertex_y")).coalesce(1), path, sep=",", compress=False)
    return _shown(shapes.read_vertex_table(spark, path))


_MASK = "m AS (SELECT i, j, (i // 7 * 5 + j // 9) % 6 AS seg FROM range(64) a(i), range(48) b(j))"


def _mask(spark: SparkSession) -> DataFrame:
    import io

    i, j = np.indices((64, 48))
    data, path = io.BytesIO(), scratch(spark)
    np.save(data, (i // 7 * 5 + j // 9) % 6)
    write_bytes(spark, path, data.getvalue())
    return shapes.read_mask(spark, path)


@query(f"WITH {_MASK} SELECT seg, count(*) AS n_pixels, min(i) AS imin, max(i) AS imax, min(j) AS jmin, max(j) AS jmax FROM m WHERE seg <> 0 GROUP BY seg")
def mask_file(spark, d):
    return agg.segment_sizes(_mask(spark))


@query(f"WITH {_MASK}, p AS (SELECT seg, i, j, row_number() OVER (PARTITION BY seg ORDER BY i, j) - 1 AS k FROM m WHERE seg <> 0) SELECT seg, CAST(k AS INTEGER) AS k, i, j FROM p")
def segment_pixels(spark, d):
    return agg.segment_pixels(_mask(spark)).select("seg", F.posexplode("pixels").alias("k", "p")).select("seg", "k", "p.i", "p.j")


_GRAY = "g AS (SELECT CAST(floor(x / 16) AS BIGINT) AS px, CAST(floor(y / 16) AS BIGINT) AS py, CAST(least(255, count(*)) AS INTEGER) AS value FROM pixel_factors GROUP BY 1, 2)"


@query(f"WITH {_GRAY} SELECT px, py, value FROM g WHERE px BETWEEN 0 AND 255 AND py BETWEEN 0 AND 255")
def picture_file(spark, d):
    image = raster.to_image(raster.intensity(load(spark, d, "pixel_factors"), "x", "y", 16.0), 256, 256, ["value"])
    path = scratch(spark)
    write_bytes(spark, path, shapes.png(image))
    return shapes.read_pictures(spark, path).select("px", "py", "value")
