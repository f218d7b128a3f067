import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.operators import aggregates, raster
from stipple.sources import matrices, reads, shapes
from stipple.sources import text_tables as tt


def put(path, text):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)
    return str(path)


def test_tables(spark, tmp_path, rows):
    p = put(tmp_path / "t.tsv.gz", "## made by hand\n#X\tY\tgene\n1.5\t2\ta\n-1\t\t\"q\"\n#gone\t1\t2\n3\n")
    df = tt.read_table(spark, p, skip=1, comment="#", strip="#", unquote=True)
    assert df.columns == ["X", "Y", "gene"]
    assert rows(df) == sorted([("1.5", "2", "a"), ("-1", "", "q"), ("3", None, None)], key=repr)
    typed = tt.TableSpec({"x": ("X", "double"), "n": (1, "int"), "z": ("absent", "int")}, ("z",)).apply(df, rest=True)
    assert typed.columns == ["x", "n", "gene"] and (1.5, 2, "a") in rows(typed)
    with pytest.raises(ValueError):
        tt.TableSpec({"z": ("absent", "int")}).apply(df)
    with pytest.raises(ValueError):
        tt.read_table(spark, put(tmp_path / "d.tsv", "a\ta\n1\t2\n"))
    tt.write_table(typed, str(tmp_path / "out"), single=True)
    assert rows(tt.read_table(spark, str(tmp_path / "out") + "/*.gz"))[0] == ("-1.0", "", "q")
    ordered = tt.numbered(spark, put(tmp_path / "o.txt", "b\na\nc\n"))
    assert [(r.ordinal, r.value) for r in ordered.orderBy("ordinal").collect()] == [(0, "b"), (1, "a"), (2, "c")]


def test_small_files(spark, tmp_path):
    want = {"xmin": -1.0, "xmax": 2.5, "ymin": 0.0, "ymax": 9.0}
    for k, text in enumerate(["xmin\t-1\nxmax\t2.5\nymin\t0\nymax\t9\n", "xmin\txmax\tymin\tymax\n-1\t2.5\t0\t9\n", "-1 2.5 0 9\n"]):
        assert tt.read_minmax(spark, put(tmp_path / f"m{k}.tsv", text)) == want
    with pytest.raises(ValueError):
        tt.read_minmax(spark, put(tmp_path / "bad.tsv", "a b\n"))
    assert tt.read_tags(spark, put(tmp_path / "tags.tsv", "1\tA\tACGT\n2\tB\tGGGG\n")).count() == 2
    with pytest.raises(ValueError):
        tt.read_tags(spark, put(tmp_path / "tags2.tsv", "1\tA\tACGT\n2\tB\tACGT\n"))
    colors = tt.read_colors(spark, put(tmp_path / "c.tsv", "Name\tR\tG\tB\nk\t1\t0.5\t0\n")).first()
    assert (colors.gene, colors.hex) == ("k", "FF8000")
    bins = tt.read_bins(spark, put(tmp_path / "b.json", '[{"gene":"GeneA","count":100,"bin":1},{"gene":"GeneB","count":80,"bin":2}]'))
    assert json.loads(tt.bins_json(bins))[0] == {"gene": "GeneA", "count": 100, "bin": 1}
    assert sorted(r.value for r in tt.read_values(spark, put(tmp_path / "v.txt", "a x\nb\na\n\n")).collect()) == ["a", "b"]
    p = put(tmp_path / "pix.tsv", "##TOPK=2;SCALE=100;OFFSET_X=10;OFFSET_Y=0\n#x\ty\tK1\tK2\tP1\tP2\n150\t200\t3\t1\t0.75\t0.25\n")
    r = tt.read_pixel_decode(spark, p).first()
    assert (r.x, r.y, r.k, r.p) == (11.5, 2.0, [3, 1], [0.75, 0.25])
    with pytest.raises(ValueError):
        tt.read_pixel_meta(spark, put(tmp_path / "pix2.tsv", "1\t2\n#x\ty\n"))


def test_matrices_round_trip(spark, tmp_path, rows):
    body = "%%MatrixMarket matrix coordinate integer general\n%\n3 4 5\n1 1 2 0\n3 1 1 1\n1 3 0 0\n2 4 5 1\n3 4 1 0\n"
    e = matrices.read_entries(spark, put(tmp_path / "m.mtx", body))
    assert rows(e)[0] == (1, 1, 2, 0) and e.count() == 5 and matrices.read_dimensions(spark, str(tmp_path / "m.mtx")) == (3, 4, 5)
    b = matrices.read_plain_barcodes(spark, put(tmp_path / "b.tsv", "AA\t1\t2\nCC\t3\t4\nGG\t5\t6\nTT\t7\t8\n"), icol_x=1, icol_y=2)
    f = matrices.read_features(spark, put(tmp_path / "f.tsv", "id1\tn1\nid2\tn2\nid3\n"))
    assert [r.name for r in f.orderBy("nid").collect()] == ["n1", "n2", "id3"]
    e2, b2, f2 = matrices.compact(e, b, f, ["c1", "c2"])
    assert [r.strid for r in b2.orderBy("nid").collect()] == ["AA", "TT"] and sorted(r.nid for r in b2.collect()) == [1, 2]
    assert rows(e2.select("ftr", "bcd", "c1", "c2")) == [(1, 1, 2, 0), (2, 2, 5, 1), (3, 1, 1, 1), (3, 2, 1, 0)]
    assert matrices.matrix_header(e2, f2, b2)[1] == "3 2 4"
    matrices.write_matrix(str(tmp_path / "out"), e2, b2, f2, ["c1", "c2"])
    back = [r.value for r in spark.read.text(str(tmp_path / "out/matrix.mtx.gz")).collect()]
    assert "3 2 4" in back and "2 2 5 1" in back and len(back) == 6
    v1 = matrices.read_barcodes(spark, put(tmp_path / "b1.tsv", "ACG\t1\t9\t2\t1101\t7124822\t2906042\t1,2,3\n")).first()
    assert (v1.px / 1000, v1.counts) == (7124.822, [1, 2, 3])
    pos = matrices.read_positions(spark, put(tmp_path / "p.csv", "barcode,in_tissue,pxl_row_in_fullres,pxl_col_in_fullres\nAA,1,5.5,6\n")).first()
    assert (pos.barcode, pos.x, pos.y) == ("AA", 5.5, 6.0)


def test_matrix_of_several_parts(spark, tmp_path, rows):
    entries = [(f, b, f, b) for b in range(1, 41) for f in range(1, 31)]
    folder = tmp_path / "a b%20c" / "matrix.mtx.gz"
    folder.mkdir(parents=True)
    put(folder / "part-00000.gz", "%%MatrixMarket matrix coordinate integer general\n")  # the smallest files are the first
    put(folder / "part-00001.gz", "%\n30 40 1200\n")
    for k, part in enumerate([entries[:3], entries[3:900], [], entries[900:]], 2):
        put(folder / f"part-0000{k}.gz", "".join(" ".join(map(str, e)) + "\n" for e in part))
    assert tt.head(spark, str(folder), 4) == ["%%MatrixMarket matrix coordinate integer general", "%", "30 40 1200", "1 1 1 1"]
    assert matrices.read_dimensions(spark, str(folder)) == (30, 40, 1200)
    assert rows(matrices.read_entries(spark, str(folder))) == sorted(entries, key=repr)


def test_sparse_rows(spark, tmp_path, rows):
    long = spark.createDataFrame([("c1", "g1", 2), ("c1", "g2", 1), ("c2", "g2", 4), ("c3", "g1", 0)], "cell_id string, feature string, cnt long")
    names = spark.createDataFrame([("g1", 0), ("g2", 1)], "feature string, idx int")
    sparse = matrices.sparse_rows(long, names, ["cell_id"])
    matrices.sparse_lines(sparse, ["cell_id"]).write.text(str(tmp_path / "s"))
    meta = matrices.sparse_meta(names, ["cell_id"], 2)
    back, dictionary = matrices.read_sparse(spark, str(tmp_path / "s"), meta)
    assert rows(matrices.sparse_to_long(back, dictionary, ["cell_id"])) == [("c1", "g1", 2), ("c1", "g2", 1), ("c2", "g2", 4)]
    ragged = put(tmp_path / "r.tsv", "k\tc\t2\t3\t0 1\n")
    with pytest.raises(Exception, match="ragged"):
        matrices.read_sparse(spark, ragged, meta)[0].collect()
    with pytest.raises(ValueError):
        matrices.read_sparse(spark, ragged, {"header_info": ["k", "c"], "offset_data": 2, "dictionary": {"a": 1, "b": 1}})


def test_pseudobulk(spark, tmp_path, rows):
    long = matrices.read_pseudobulk(spark, put(tmp_path / "p.tsv", "Feature\t2\t10\na\t1\t0.5\nb\t3\t0\n"))
    both = aggregates.add_matrices([long, spark.createDataFrame([("c", "x", 7.0)], "feature string, factor string, cnt double")])
    matrices.write_pseudobulk(both, str(tmp_path / "o"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert lines[0] == "Feature\t2\t10\tx" and lines[1] == "c\t0.0000\t0.0000\t7.0000"


def test_reads(spark, tmp_path):
    text = "".join(f"@r{i} x\n{'ACGT' * (i + 1)}\n+\n{'IIII' * (i + 1)}\n" for i in range(7))
    r = reads.read_fastq(spark, put(tmp_path / "a.fastq.gz", text))
    assert [(x.read_id, x.name, len(x.seq)) for x in r.orderBy("read_id").collect()] == [(i, f"r{i} x", 4 * (i + 1)) for i in range(7)]
    two = reads.read_mates(spark, {"1": str(tmp_path / "a.fastq.gz"), "2": str(tmp_path / "a.fastq.gz")})
    assert two.filter("seq1 = seq2").count() == 7
    short = put(tmp_path / "b.fastq", text[: text.index("@r6")])
    with pytest.raises(Exception, match="different numbers"):
        reads.read_mates(spark, {"1": str(tmp_path / "a.fastq.gz"), "2": short}).collect()
    with pytest.raises(Exception, match="broken record"):
        reads.read_fastq(spark, put(tmp_path / "c.fastq", "@a\nACGT\nIIII\nACGT\n")).collect()
    reads.write_fastq(r, str(tmp_path / "o"), compress=False)
    again = "\n".join(x.value for x in spark.read.text(str(tmp_path / "o")).collect()) + "\n"
    assert again == text


def test_shapes(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2]]]
    feature = {"type": "Feature", "properties": {"cell_id": 7}, "geometry": {"type": "Polygon", "coordinates": square}}
    multi = {"type": "Feature", "properties": {"cell_id": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [square[:1], [[[9, 9], [8, 9]]]]}}
    p = put(tmp_path / "a.json", json.dumps({"type": "FeatureCollection", "features": [feature, multi]}) + json.dumps(feature))
    got = shapes.read_geojson(spark, p).collect()
    assert [r.region for r in got] == ["7", "m", "7"] and got[0].xs == [0.0, 4.0, 4.0, 0.0, 0.0]
    with pytest.raises(Exception, match="holes"):
        shapes.read_geojson(spark, p, holes="error").collect()
    v = shapes.read_vertex_table(spark, put(tmp_path / "v.csv", 'cell_id,vertex_x,vertex_y\n"a",0,0\nb,9,9\n"a",1,0\na,1,1\n')).filter("region = 'a'").first()
    assert (v.xs, v.ys) == ([0.0, 1.0, 1.0], [0.0, 0.0, 1.0])
    np.save(tmp_path / "m.npy", np.array([[0, 1], [2, 1]]))
    mask = shapes.read_mask(spark, str(tmp_path / "m.npy"))
    assert sorted(tuple(r) for r in mask.collect()) == [(0, 1, 1), (1, 0, 2), (1, 1, 1)]
    assert {r.seg: r.n_pixels for r in aggregates.segment_sizes(mask).collect()} == {1: 2, 2: 1}
    entries = spark.createDataFrame([(1, 10.0, 5.0, 3), (1, 15.0, 19.0, 2), (2, 0.0, 0.0, 9)], "ftr int, px double, py double, cnt int")
    assert sorted(tuple(r) for r in aggregates.segment_counts(entries, mask, units_per_px=10.0).collect()) == [(1, 1, 5)]


def test_pictures(spark):
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    assert (shapes.read_gray_png(shapes.png(gray)) == gray).all()
    with pytest.raises(ValueError):
        shapes.read_gray_png(shapes.png(np.zeros((2, 2, 3))))
    rgba = raster.gray_to_rgba(gray, rgb="102030", below=20, above=200, how="sqrt")
    assert rgba[0, 0, 3] == 0 and rgba[2, 3, 3] == 0 and rgba[1, 1, :3].tolist() == [16, 32, 48] and rgba[1, 1, 3] == round(10 * 16)
    pts = spark.createDataFrame([(0.5, 0.5)] * 300 + [(1.5, 0.2), (9.0, 9.0), (None, 1.0)], "x double, y double")
    image = raster.to_image(raster.intensity(pts, "x", "y", 1.0), 3, 2, ["value"])[..., 0]
    assert image.tolist() == [[255, 1, 0], [0, 0, 0]]
    red = raster.to_image(raster.layers([(pts, "#640000")], "x", "y", 1.0), 3, 2)
    assert red[0, 0].tolist() == [255, 0, 0] and red[0, 1].tolist() == [100, 0, 0]
    filled = raster.fill_polygons([([0, 2, 2, 0], [0, 0, 2, 2], "#FFFFFF"), ([1, 3, 3, 1], [0, 0, 2, 2], "#FF0000")], 3, 2, opacity=0.5)
    assert filled[0, 0].tolist() == [128, 128, 128] and filled[0, 2].tolist() == [128, 0, 0]
    levels = raster.unit_levels(pts.filter("x < 5").select("x", "y", F.lit(0).alias("u"), F.lit(1).alias("n")), 1.0, x="x", y="y", unit="u", count="n", q=0.9).first()
    assert levels.level == 300
    with pytest.raises(ValueError):
        raster.to_image(pts, 10**5, 10**5)


def test_places_over_splits_and_files(spark, tmp_path):
    """Small splits: lines, headers and reads come out alike however the files are cut."""
    reads_of = lambda n, tag: "".join(f"@{tag}{k}\n{'ACGT' * (1 + k % 5)}\n+\n{'@III' * (1 + k % 5)}\n" for k in range(n))
    a, b = put(tmp_path / "a.fastq", reads_of(300, "a")), put(tmp_path / "b.fastq.gz", reads_of(7, "b"))
    c = put(tmp_path / "c.tsv", "# made\nk\tv\n" + "".join(f"{k}\t{k % 3}\n" for k in range(400)) + "k\tv\n")
    d = put(tmp_path / "d.tsv", "# made\nk\tv\n9\t9\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert spark.read.text(a).rdd.getNumPartitions() > 10
        got = reads.read_fastq(spark, [b, a]).orderBy("read_id").collect()
        assert [(r.read_id, r.name) for r in got] == list(enumerate([f"b{k}" for k in range(7)] + [f"a{k}" for k in range(300)]))
        assert all(r.seq == "ACGT" * (1 + int(r.name[1:]) % 5) and r.qual == "@III" * (1 + int(r.name[1:]) % 5) for r in got)
        t = tt.read_table(spark, [c, d], skip=1)
        assert t.count() == 402 and t.filter("k = 'k'").count() == 1
        assert tt.read_lines(spark, [c, d], skip=2).count() == 402
        with pytest.raises(Exception, match="another header"):
            tt.read_table(spark, [c, put(tmp_path / "e.tsv", "# made\nk\tw\n1\t2\n")], skip=1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    listing = put(tmp_path / "list.tsv", f"s1\t{c}\ns2\t{d}\n")
    assert {(r["sample"], r["count"]) for r in tt.read_tables(spark, listing, skip=1).groupBy("sample").count().collect()} == {("s1", 401), ("s2", 1)}
    with pytest.raises(ValueError):
        tt.read_tables(spark, put(tmp_path / "list2.tsv", f"s1\t{put(tmp_path / 'f.tsv', '# made' + chr(10) + 'k' + chr(9) + 'v' + chr(10))}\n"), skip=1)
