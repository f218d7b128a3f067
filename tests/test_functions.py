import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stipple.functions import geom, seq, stats
from stipple.functions import text as ft


def value(spark, c, v="x", kind="string"):
    return spark.createDataFrame([(v,)], f"c {kind}").select(c(F.col("c")).alias("r")).first().r


def test_sequences(spark):
    assert value(spark, seq.revcomp, "ACGTNacgtRYKM") == "KMRYacgtNACGT"
    assert value(spark, lambda c: seq.revcomp(seq.revcomp(c)), "AGGTCNRYSWKMBDHV") == "AGGTCNRYSWKMBDHV"
    assert value(spark, seq.rev, "ABC") == "CBA"
    assert value(spark, lambda c: seq.intervals(c, "1-2,4,6-7"), "abcdefgh") == "abdfg"
    with pytest.raises(ValueError):
        seq.intervals(F.lit(""), "3-2")
    assert value(spark, lambda c: seq.iupac_mismatches(c, "NRYA"), "CATG") == 1
    assert value(spark, lambda c: seq.iupac_mismatches(c, "ACGT"), "AC") == 2
    assert value(spark, lambda c: seq.iupac_mismatches(c, "A"), None) is None
    assert value(spark, lambda c: c.rlike("^" + seq.iupac_regex("NRB") + "$"), "TAC")
    assert value(spark, lambda c: seq.hamming(c, F.lit("ACGT"), 4), "ANGA") == 1
    assert value(spark, lambda c: seq.hamming(c, F.lit("ACGT"), 4, count_n=True), "ANGA") == 2
    assert value(spark, lambda c: seq.spaced_keys(c, ["101", "011"]), "ACG") == ["0:AG", "1:CG"]
    assert value(spark, lambda c: seq.best_mismatches(c, ("AAAA", "CCCC")), "ACCC") == 1
    assert value(spark, lambda c: seq.bits2(c, 4), "ACGT") == 0b00011011
    assert value(spark, lambda c: seq.nt5_chunks(c, 4, 3), "ACGT") == [0 * 25 + 1 * 5 + 2, 4]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ACGNT", min_size=27, max_size=27), min_size=1, max_size=5))
def test_nt5_round_trip_and_order(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", seq.nt5(F.col("t"))).withColumn("back", seq.from_nt5(F.col("n")))
    got = df.collect()
    assert all(r.t == r.back for r in got)
    assert [r.t for r in sorted(got, key=lambda r: r.n)] == sorted(texts)


def test_read_names(spark):
    assert tuple(value(spark, seq.illumina_name, "M:1:F:2:1101:15:27 1:N:0")) == (2, 1101, 15, 27)
    assert value(spark, seq.illumina_name, "M:1:F") is None
    assert tuple(value(spark, seq.grid_name, "run_R012C034_f_g_h_1.5_2.25")) == (1, 1012034, 1500, 2250)
    assert tuple(value(spark, lambda c: seq.grid_name(c, one_tile=True), "a_b_c_d_1.5_2.25")) == (1, 1, 1500, 2250)
    assert value(spark, seq.grid_name, "run_X012C034_f_g_h_1.5_2.25") is None
    assert all(len(p) == f.length for f in seq.FORMATS.values() for p in f.patterns)
    assert value(spark, seq.grid_name, "nothing") is None


@pytest.mark.parametrize("x", [0.0, 0.5, 3.84, 10.83, 50.0, 99.9, 100.5, 400.0, 1e4])
def test_p_values(spark, x):
    got = value(spark, stats.chi2_log10p, x, "double")
    if x < 1000:
        assert got == pytest.approx(-math.log10(math.erfc(math.sqrt(x / 2))), rel=2e-3, abs=1e-12)
    assert stats.chi2_log10p_value(x) <= stats.chi2_log10p_value(x * 1.01 + 0.01)


def test_statistics(spark):
    one = spark.createDataFrame([(12.0, 5.0, 3.0, 20.0)], "a double, b double, c double, d double")
    a, b, c, d = (F.col(k) for k in "abcd")
    r = one.select(stats.chi2(a, b, c, d).alias("x"), stats.fold_change(a, b, c, d).alias("f"), stats.fold_change_low(a, b, c, d, 0.05).alias("low"), stats.chi2(a * 0, b * 0, c, d).alias("none"), stats.log_sub(a, b).alias("s")).first()
    assert r.x == pytest.approx((12 * 20 - 15) ** 2 * 40 / (17 * 23 * 15 * 25)) and r.f == pytest.approx(16) and r.none is None
    assert r.low == pytest.approx(math.exp(math.log(16) - 1.6448536 * math.sqrt(1 / 12 + 1 / 5 + 1 / 3 + 1 / 20)))
    assert r.s == pytest.approx(math.log(math.exp(12) - math.exp(5)))
    assert stats.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert stats.significant_value(45678.0, 2) == 46000.0 and stats.significant_value(0.0, 2) == 0.0
    assert value(spark, lambda v: stats.significant(v, 2), 0.012345, "double") == pytest.approx(0.012)
    assert value(spark, lambda v: stats.significant(v, 2), 0.0, "double") == 0.0
    assert stats.cauchy_combination_value([3.0]) == pytest.approx(3.0, abs=1e-6)
    assert stats.cauchy_combination_value([200.0, 200.0]) == pytest.approx(200.0, abs=1e-6)
    assert stats.cauchy_combination_value([300.0, 0.3]) == pytest.approx(300 - math.log10(2), abs=1e-3)
    assert math.isnan(stats.cauchy_combination_value([]))
    p = value(spark, stats.renormalize, [0.2, 0.2], "array<double>")
    assert p == pytest.approx([0.5, 0.5]) and value(spark, stats.renormalize, [0.25, 0.75], "array<double>") == [0.25, 0.75]


def test_geometry(spark):
    ring = spark.createDataFrame([([0.0, 4.0, 4.0, 0.0, 0.0], [0.0, 0.0, 2.0, 2.0, 0.0])], "xs array<double>, ys array<double>")
    xs, ys = F.col("xs"), F.col("ys")
    r = ring.select(
        geom.contains(xs, ys, F.lit(1.0), F.lit(1.0)).alias("i"), geom.contains(xs, ys, F.lit(5.0), F.lit(1.0)).alias("o"), geom.centroid(xs, ys).alias("c"), geom.bbox(xs, ys).alias("b"),
        geom.boundary_distance2(xs, ys, F.lit(6.0), F.lit(1.0)).alias("d"), geom.translate(xs, 1.5).alias("t"),
    ).first()
    assert r.i and not r.o and tuple(r.c) == (2.0, 1.0) and tuple(r.b) == (0.0, 4.0, 0.0, 2.0) and r.d == 4.0 and r.t[1] == 5.5
    i, j = geom.scan_fill(np.array([0.0, 4.0, 4.0, 0.0]), np.array([0.0, 0.0, 2.0, 2.0]))
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(4) for b in range(2)]
    assert geom.scan_fill(np.array([np.nan, 1.0]), np.array([0.0, 1.0]))[0].size == 0
    boxes = spark.createDataFrame([((-9.0, -5.0, -9.0, -5.0), (-6.0, -1.0, -6.0, -1.0))], "a struct<xmin:double,xmax:double,ymin:double,ymax:double>, b struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    assert boxes.select(geom.boxes_overlap(F.col("a"), F.col("b")).alias("r")).first().r


def test_texts(spark):
    for v, want in (('"a"', "a"), ("'b'", "b"), ('"', '"'), ("'x\"", "'x\""), ("", ""), ('""', "")):
        assert value(spark, ft.unquote, v) == want == ft.unquote_value(v)
    assert value(spark, lambda c: ft.number_format(c, 2.0, "f", 2), 1.234, "double") == "2.47"
    assert value(spark, lambda c: ft.number_format(c, 1.0, "g", 3), 1234567.0, "double") == "1.23e+06"
    assert value(spark, lambda c: ft.number_format(c, 1.0, "e", 2), 0.000123, "double") == "1.23e-04"
    assert value(spark, ft.comma_ints, "1,2,x") == [1, 2, None]
    assert value(spark, lambda c: ft.subfield(c, 1), "a,b") == "b" and value(spark, lambda c: ft.subfield(c, 5), "a,b") is None
    assert tuple(value(spark, ft.hex_color, "#FF800a")) == (255, 128, 10, 255) and tuple(value(spark, ft.hex_color, "FF800a7f"))[3] == 127
    assert value(spark, ft.hex_color, "zz") is None and ft.hex_color_value("#010203") == (1, 2, 3, 255)
