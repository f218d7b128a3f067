import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stipple.functions import seq
from stipple.operators import aggregates, diffexp, filters, joins, ordering, project, sets
from stipple.plans import commands
from stipple.streaming import rollups


def test_greedy_bins():
    rng = random.Random(1)
    for bins in (1, 3, 10, 400):
        own = [(f"g{i}", rng.choice([0, 1, 5, 100, 1000])) for i in range(200)]
        out = ordering.greedy_bins(own, bins)
        assert sum(c for _, c, _ in out) == sum(c for _, c in own) and [c for _, c, _ in out] == sorted((c for _, c in own if c), reverse=True)
        ks = [k for *_, k in out]
        assert ks == sorted(ks) and set(ks) == set(range(1, max(ks) + 1)) and max(ks) <= bins
    assert ordering.greedy_bins([], 3) == []


def test_projection_errors(spark):
    df = spark.createDataFrame([("'a'", 1)], "s string, n int")
    for bad in ("x", "s,s", "s:n,n"):
        with pytest.raises(ValueError):
            project.choose(df, bad)
    assert tuple(project.choose(df, "n:k,:c:v,s", unquote=True).first()) == (1, "v", "a")
    with pytest.raises(ValueError):
        project.keep_or_drop(df, include=["s"], exclude=["n"])
    assert project.keep_or_drop(df, exclude=["s"]).columns == ["n"] and project.prefix(df, ["n"], "p_").columns == ["s", "p_n"]
    both = project.random_key(df, ["s"]).unionByName(project.random_key(df, ["s"])).collect()
    assert both[0].random_key == both[1].random_key and len(both[0].random_key) == 8
    moved = project.jitter(df.withColumn("x", F.lit(5.0)), ["x"], 0.5, key=["n"]).first()
    assert 4.5 <= moved.x <= 5.5
    wide = spark.createDataFrame([(1.0, 5.0, 5.0, "k")], "a double, b double, c double, key string")
    assert project.order_by_total(wide, ["a", "b", "c"]).columns == ["key", "c", "b", "a"]
    with pytest.raises(Exception, match="duplicate name"):
        project.unique_names(spark.createDataFrame([("1", "g", 1), ("2", "g", 2)], "id string, name string, nid int"), how="error").collect()


def test_relay_and_common_barcodes(spark):
    pairs = spark.createDataFrame([(0, "AACCGGTT", "12345678", "TTGCAAGG", "abcdefgh"), (1, "AACCGGTA", "12345678", "TTGCA", "abcde")], "read_id int, seq1 string, qual1 string, seq2 string, qual2 string")
    r = project.relay_fastq(pairs, skip=1, len_bcd=4, len_umi=3, len_r2=5, revcomp_r1=True).orderBy("read_id").first()
    assert (r.seq1, r.qual1, r.seq2, r.qual2) == ("CGGTTTG", "5432abc", "TTGCA", "abcde")
    got = commands.common_barcodes(pairs, bcd="1-7", umi="1-2", umi_read="seq2", least=2)
    assert sorted((x.read_id, x.n) for x in got.collect()) == [(0, 2), (1, 2)]
    kept = commands.reformat_pairs(pairs, whitelist=spark.createDataFrame([("AACCGGTTxx",)], "barcode string"), match_len=8, len_bcd=4)
    assert [x.read_id for x in kept.collect()] == [0]


def test_required_and_zip(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 2.0)], "id int, x double")
    with pytest.raises(Exception, match="no row for 2"):
        joins.required(a, b, "id", marker="x").collect()
    l = spark.createDataFrame([(0, 1.0, 1.0, 5), (1, 2.0, 2.0, 6)], "i int, x double, y double, v int")
    r = spark.createDataFrame([(0, 1.0, 1.0, 7), (1, 2.5, 2.0, 8)], "i int, x double, y double, v int")
    with pytest.raises(Exception, match="row 1"):
        joins.zip_by_position([("a", l), ("b", r)], ordinal="i").collect()
    with pytest.raises(Exception, match="one side only"):
        joins.manifest_layout(a.withColumnRenamed("id", "tile"), b.withColumnRenamed("id", "tile"), on=["tile"], exact=True).collect()
    with pytest.raises(Exception, match="one side only"):
        m = spark.createDataFrame([("f", "1", 1.0)], "feature string, factor string, cnt double")
        joins.align_matrices(m, m.withColumn("feature", F.lit("g"))).collect()


def test_search_tags_with_nulls_and_none(spark):
    reads = spark.createDataFrame([(1, "xxACGTyy"), (2, "ACGTGGTT"), (3, None), (4, ""), (5, "ACGTACGT")], "read_id int, seq2 string")
    tags = spark.createDataFrame([("t1", "ACGT"), ("t2", "GGTT"), ("t3", "CCCCCCCCCC")], "tag_id string, tag_seq string")
    assert sorted(tuple(r) for r in joins.search_tags(reads, tags).collect()) == [(1, "t1", 2), (5, "t1", 0)]
    assert joins.search_tags(reads, tags.limit(0)).collect() == []


def test_demultiplex_by_two_indexes(spark):
    sheet = spark.createDataFrame([("a", "AAAA", "CCCC"), ("b", "AAAT", "CCCC"), ("c", "GGGG", "TTTT")], "sample string, i1 string, i2 string")
    reads = spark.createDataFrame([(1, "GGGG", "TTTA"), (2, "AAAA", "CCCC"), (3, "GNGG", "TTNT"), (4, "ACAC", "GGGG"), (5, None, None)], "read_id int, i1 string, i2 string")
    got = {r.read_id: r["sample"] for r in joins.demultiplex(reads, sheet).collect()}
    assert got == {1: "c", 2: "ambiguous", 3: "c", 4: "ambiguous", 5: "ambiguous"}


def test_numeric_order_and_ids(spark):
    df = spark.createDataFrame([(v,) for v in ("10", "2", "a", "B", None, "010", "2")], "f string")
    assert [r.f for r in ordering.numeric_aware_rank(df, "f").orderBy("rank").collect()] == ["2", "010", "10", "B", "a"]
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k + 1 == r.new_id for r in ordering.dense_ids(many, ["k"]).collect())
    assert ordering.dense_ids(many.limit(0), ["k"]).collect() == []
    assert ordering.is_sorted(many.select("k", F.col("k").alias("o")), "k", "o").first().sorted


def test_expression_report_falls_back(spark):
    long = spark.createDataFrame([("g1", "a", 50.0), ("g2", "a", 50.0), ("g1", "b", 400.0), ("g2", "b", 30.0)], "feature string, factor string, cnt double")
    out = diffexp.report(diffexp.marginal(long), max_pval=1e-300, min_fc=1.0)
    assert sorted((r.factor, r.feature) for r in out.collect()) == [("a", "g2"), ("b", "g1")]
    both = diffexp.between(long, long.withColumn("cnt", F.col("cnt") * F.when(F.col("feature") == "g1", 3).otherwise(1)), min_count=1)
    assert {(r.feature, r.factor): round(r.log2fc, 3) < 0 for r in both.collect()}[("g1", "b")]
    for level in ("factor", "feature"):
        assert diffexp.between(long, long, level=level).count() == 2


def test_workflows_on_cells(spark):
    mol = spark.createDataFrame(
        [("c1", "g1", 2, 0.0, 0.0), ("c1", "g2", 1, 3.0, 3.0), ("c2", "g1", 1, 1.0, 1.0), ("c2", "rare", 1, 1.0, 1.0), ("UNASSIGNED", "g1", 9, 0.0, 0.0), (None, "g1", 9, 0.0, 0.0)], "cell_id string, gene string, count int, X double, Y double"
    )
    out = commands.cells_to_sparse(mol, min_feature=1)
    assert {r.cell_id: (r.genes, r.counts, r.cx) for r in out["cells"].collect()} == {"c1": (2, 3, 1.0), "c2": (2, 2, 1.0)}
    back = commands.sparse_to_matrix(out["rows"], out["dictionary"], ["cell_id"])
    assert back["entries"].agg(F.sum("c1")).first()[0] == 5 and back["barcodes"].count() == 2
    long = aggregates.cell_by_feature(filters.known_ids(mol, "cell_id"), "cell_id", "gene", "count").withColumnRenamed("gene", "feature")
    merged = commands.merge_sparse([("s1", long), ("s2", long.filter("feature != 'rare'"))], least=1)
    assert sorted(r.feature for r in merged["dictionary"].collect()) == ["g1", "g2"]
    clusters = spark.createDataFrame([("c1", "k1", 0.25), ("c1", "k2", 0.75), ("c2", "k1", 1.0)], "cell_id string, cluster string, prob double")
    model = {(r.feature, r.cluster): r.cnt for r in commands.cluster_model(long, clusters).collect()}
    assert model[("g1", "k1")] == 1.5 and model[("g1", "k2")] == 1.5
    bins = spark.createDataFrame([("g1", 1), ("g2", 2), ("rare", 0)], "gene string, bin int")
    index = {r.bin_id: (r.molecule_count, r.features_count) for r in commands.split_by_bin(mol, bins)["index"].collect()}
    assert index == {1: (21, 1), 2: (1, 1)}
    pix = spark.createDataFrame([(1, 0.1, 0.0, [4, 2], [0.75, 0.25])], "pix_id int, x double, y double, k array<int>, p array<double>")
    joined = commands.join_pixels(mol.withColumn("mol_id", F.monotonically_increasing_id()).select("mol_id", F.col("X").alias("x"), F.col("Y").alias("y")), [("p_", pix)], 0.5)
    got = sorted((r.x, r.p_K1, r.p_P1) for r in joined["molecules"].collect())
    assert got[0] == (0.0, "4", "0.75") and got[-1] == (3.0, "NA", "NA")
    assert {r.bucket for r in joined["histogram"].collect()} == {"log", "none"}
    top = commands.top_factor(spark.createDataFrame([("k", 0.25, 0.5, 0.5)], "random_key string, a double, b double, c double"), ["a", "b", "c"])
    assert tuple(top.select("topK", "topP").first()) == ("b", 0.5)


def test_workflows_on_barcodes(spark):
    form = seq.BarcodeFormat(("NNRA",))
    r = commands.build_barcodes(spark.createDataFrame([("M:1:F:2:1101:15:27", "CCGAT"), ("M:1:F:2:1101:16:20", "CCTAT")], "name string, seq string"), form)
    assert sorted((x.seq, x.mismatches) for x in r["barcodes"].collect()) == [("TAGG", 1), ("TCGG", 0)]
    m = r["manifest"].first()
    assert (m.id, m.barcodes, m.matches, m.mismatches, m.xmin, m.ymax) == ("2_1101", 2, 1, 1, 15, 27)
    with pytest.raises(Exception, match="unreadable name"):
        commands.build_barcodes(spark.createDataFrame([("x", "CCGAT")], "name string, seq string"), form)["barcodes"].collect()
    bc = spark.createDataFrame([("AAAA", 1, 1, 0, 0, 0), ("CCCC", 1, 1, 10, 20, 0), ("CCCC", 1, 2, 10, 20, 0), ("GGGG", 1, 2, 0, 0, 1)], "strid string, lane int, tile int, px long, py long, mismatches int")
    layout = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 2)], "lane int, tile int, row int, col int")
    out = commands.combine_barcodes(bc, layout, max_dup=2, max_dist=1e9)
    assert sorted(x.strid for x in out["barcodes"].collect()) == ["AAAA", "CCCC", "GGGG"]
    dup = {x.key: (x.ndups, x.max_dist_nm) for x in out["duplicates"].collect()}
    assert dup["AAAA"] == (1, 0.0) and dup["CCCC"][0] == 2 and dup["CCCC"][1] == pytest.approx(20 * 34.78, abs=2)
    ev = commands.evaluate_duplicates(bc)
    assert {x.n: x.n_keys for x in ev["histogram"].collect()} == {1: 2, 2: 1}
    reads = spark.createDataFrame([("CCCCx",), ("CCCCy",), ("TTTT",), ("AAAA",)], "seq string")
    got = commands.match_barcodes(reads, bc, length=4, unique=True)
    assert [x.seq for x in got["matched"].collect()] == ["AAAA"]
    assert {x.type: x.reads for x in got["summary"].collect()} == {"Total": 4, "Miss": 3, "Match": 1, "Unique": 1, "Dup": 0}
    tags = spark.createDataFrame([("t1", "n1")], "tag_id string, tag_name string")
    merged = commands.merge_tags([spark.createDataFrame([("B", "t1", "u"), ("B", "t1", "u")], "barcode string, tag string, umi string")] * 2, tags)
    assert tuple(merged["entries"].first()) == (1, 1, 4, 1, 1)


def test_workflows_on_grids(spark):
    e = spark.createDataFrame([(1, 1, 3), (2, 1, 0), (2, 2, 4), (1, 3, 1)], "ftr long, bcd long, c1 long")
    b = spark.createDataFrame([("A", 1, 10.0, 10.0), ("B", 2, 20.0, 20.0), ("C", 3, 99.0, 99.0)], "strid string, nid long, px double, py double")
    f = spark.createDataFrame([("i1", "n1", 1), ("i2", "n2", 2)], "id string, name string, nid long")
    sub = commands.subset_grid(e, b, f, ["c1"], box=(5.0, 50.0, 5.0, 50.0))
    assert sorted((r.strid, r.px) for r in sub["barcodes"].collect()) == [("A", 5.0), ("B", 15.0)] and sub["entries"].count() == 2
    less = commands.subset_matrix(e, b, f, ["c1"], include=spark.createDataFrame([("n1",)], "value string"), min_barcode=2)
    assert [tuple(r) for r in less["entries"].select("ftr", "bcd", "c1").collect()] == [(1, 1, 3)]
    mols = commands.molecules_of(e, b.withColumnsRenamed({"px": "x", "py": "y"}), f, ["c1"], units_per_um=10.0, include_regex="n1")
    assert sorted((r.X, r.gene, r.c1) for r in mols["molecules"].collect()) == [(1.0, "n1", 3), (9.9, "n1", 1)]
    assert mols["extent"].first().xmax == 9.9
    part = e.withColumnRenamed("c1", "cnt")
    places = spark.createDataFrame([("A", 1, 1101, 5, 6)], "strid string, lane int, tile int, px int, py int")
    got = commands.spatial_counts([part, part], b.select("strid", "nid"), places)
    assert {(r.level, r.lane, r.tile): (r.c1, r.c2, r.barcodes) for r in got["levels"].collect()}[("second", 1, 1101)] == (3, 3, 1)
    grids = sets.union_grids([b.select("strid", "px", "py"), b.select("strid", "px", "py")], [(0.0, 0.0), (-50.0, 5.0)])
    assert ("2_A", 0.0, 15.0) in {(r.strid, r.px, r.py) for r in grids.collect()}


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([], "gene string, count int, x double, y double, bin long, n long")
    assert aggregates.histogram(df, "x", 1.0, fraction=True, cumulative=True).collect() == []
    assert aggregates.feature_totals(df).collect() == [] and aggregates.extent(df).first().xmin is None
    assert ordering.feature_bins(df, "gene", "count", 3).collect() == []
    assert filters.frequency(df, ["gene"], 1).columns == df.columns
    some = spark.createDataFrame([("g", 1, 0.5, 0.5, 7, 8), (None, None, None, None, None, None)], df.schema)
    assert aggregates.histogram(some, "x", 1.0).select("from", "count").first()[1] == 1
    assert filters.frequency(some, ["gene"], 1).count() == 2
    with pytest.raises(ValueError):
        aggregates.histogram(some, "x", 1.0, bins=3)


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    recs = [(1, 1101, 0, t), (1, 1101, 2, t + dt.timedelta(minutes=3)), (1, 1102, 0, t + dt.timedelta(minutes=12)), (9, 9, 9, t + dt.timedelta(hours=5))]
    spark.createDataFrame(recs, "lane int, tile int, mismatches int, read_at timestamp").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("lane int, tile int, mismatches int, read_at timestamp").parquet(str(tmp_path / "s"))
    q = rollups.to_memory(rollups.tile_counts(stream), "tiles")
    q.awaitTermination(120)
    assert sorted((r.lane, r.tile, r.barcodes, r.matches) for r in spark.table("tiles").collect()) == [(1, 1101, 2, 1), (1, 1102, 1, 1)]
    rollups.to_memory(rollups.feature_counts(stream, gene="tile", count="mismatches"), "totals", mode="complete").awaitTermination(120)
    assert {r.tile: r["count"] for r in spark.table("totals").collect()} == {1101: 2, 1102: 0, 9: 9}
    rollups.to_memory(rollups.without_redelivered(stream, ("lane",), time="read_at"), "once").awaitTermination(120)
    assert sorted(r.lane for r in spark.table("once").collect()) == [1, 9]


def test_entries_without_a_barcode_or_feature_are_errors(spark):
    mtx = spark.createDataFrame([(1, 1, 5), (2, 1, 3)], "ftr long, bcd long, c1 long")
    bcd, ftr = spark.createDataFrame([(1, "A")], "nid long, strid string"), spark.createDataFrame([(1, "f1")], "nid long, id string")
    with pytest.raises(Exception, match="no feature for 2"):
        joins.matrix_entries(mtx, bcd, ftr).collect()
    assert [r.ftr_id for r in joins.matrix_entries(mtx, bcd, ftr, strict=False).collect()] == ["f1"]
    with pytest.raises(Exception, match="no barcode for 1"):
        joins.matrix_entries(mtx, bcd.limit(0), ftr, strict=False).collect()


def test_grid_offsets(spark):
    layout = spark.createDataFrame([("a", 1, 1), ("b", 1, 3), ("c", 3, 1)], "tile string, row int, col int")
    extents = spark.createDataFrame([("a", 0, 9, 5, 24), ("b", 0, 19, 0, 0), ("c", -5, 4, 0, 29)], "tile string, xmin long, xmax long, ymin long, ymax long")
    got = {r.tile: (r.x_offset, r.y_offset) for r in project.grid_offsets(layout, extents).collect()}
    assert got == {"a": (0, 0), "b": (0, 30), "c": (20, 0)}
    with pytest.raises(Exception, match="start at 1"):
        project.grid_offsets(layout.withColumn("row", F.col("row") - 1), extents).collect()


def test_weighted_combination_of_p_values(spark):
    from stipple.functions import stats

    def one(values, weights=None):
        df = spark.createDataFrame([(values, weights)], "v array<double>, w array<double>")
        return df.select(stats.cauchy_combination(F.col("v"), F.col("w") if weights else None).alias("p")).first().p

    assert one([3.0]) == pytest.approx(3.0, abs=1e-6) and one([200.0, 200.0]) == pytest.approx(200.0, abs=1e-6)
    assert one([300.0, 0.3]) == pytest.approx(stats.cauchy_combination_value([300.0, 0.3]), abs=1e-6)
    assert one([2.0, 5.0], [1.0, 0.0]) == pytest.approx(2.0, abs=1e-6) and one([2.0, float("nan"), None], [1.0, 1.0, 1.0]) == pytest.approx(2.0, abs=1e-6)
    assert one([1.0, 4.0], [3.0, 3.0]) == pytest.approx(one([1.0, 4.0]), abs=1e-9) and one([4.0, 1.0], [9.0, 1.0]) > one([4.0, 1.0])
    assert one([]) is None
    # a p-value near 1 lowers the sum beside a tiny one
    assert one([16.0, 1e-16]) < one([16.0, 0.301])


def test_intermediate_tables_are_removed(spark):
    import os

    from stipple import session

    df = session.materialize(spark.range(5).toDF("a"))
    path = session._made[-1][1]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    session.release()
    assert not session._made and not os.path.exists(path.removeprefix("file:"))
