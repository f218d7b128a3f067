import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stipple.llm import heavy, seen, topn

RECS = "rec_id long, strid string, key string, part long"


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=60))
def test_elias_fano_round_trip_and_successor(values, probes):
    own = np.array(sorted(values), dtype=np.uint64)
    ef = seen.EliasFano(own)
    assert (ef.decode() == own).all()
    p = np.array(probes + sorted(values)[:20], dtype=np.uint64)
    at, found = ef.successor(p)
    assert (found == np.isin(p, own)).all()
    if len(own):
        assert (at == np.searchsorted(own, p)).all()


@pytest.mark.parametrize("bits", [8, 20, 33, 63, 64])
def test_elias_fano_dense_and_small(bits):
    rng = np.random.default_rng(bits)
    top = (1 << bits) - 1
    own = np.unique(rng.integers(0, top, size=min(200, top // 2), dtype=np.uint64, endpoint=True))
    ef = seen.EliasFano(own, bits)
    assert (ef.decode() == own).all() and ef.successor(own)[1].all()
    others = np.setdiff1d(rng.integers(0, top, size=500, dtype=np.uint64, endpoint=True), own)
    assert not ef.successor(others)[1].any()


def test_elias_fano_is_small():
    own = np.unique(np.random.default_rng(0).integers(0, 2**64, size=200_000, dtype=np.uint64))
    assert seen.EliasFano(own).nbytes * 8 / len(own) < 64 - 17 + 2 + 2.5


def test_seen_set_merges():
    rng = np.random.default_rng(3)
    s, held = seen.SeenSet(), set()
    for _ in range(40):
        batch = np.unique(rng.integers(0, 5000, size=100, dtype=np.uint64))
        new = batch[~s.contains(batch)]
        assert set(new.tolist()) == set(batch.tolist()) - held
        s.add(new)
        held |= set(new.tolist())
    assert sum(r.n for r in s.runs) == len(held) and len(s.runs) <= 12


def test_seen_before_against_brute_force(spark, rows):
    rng = random.Random(1)
    keys = ["hot"] * 400 + [f"k{i}" for i in range(300)] + [None, "", "HOT", "é", "x" * 5000] * 6
    recs = [(i, rng.choice(keys), "clash", 1) for i in range(1500)]
    rng.shuffle(recs)
    old = [("k3", 1), ("k4", 2), (None, 3), ("absent", 4)]
    df, earlier = spark.createDataFrame(recs, RECS).repartition(5), spark.createDataFrame(old, "strid string, run_no int")
    known, want = {k for k, _ in old if k is not None}, set()
    for i, k, *_ in sorted(recs, key=lambda r: r[0]):
        if k is not None:
            if k in known:
                want.add(i)
            known.add(k)
    got = [r.rec_id for r in seen.seen_before(df, earlier, key="strid", record_id="rec_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {}
    for i, k, *_ in recs:
        if k is not None:
            first[k] = min(first.get(k, i), i)
    alone = {r.rec_id for r in seen.seen_before(df, None, key="strid", record_id="rec_id").collect()}
    assert alone == {i for i, k, *_ in recs if k is not None and i > first[k]}
    assert seen.seen_before(df.limit(0), earlier, key="strid", record_id="rec_id").collect() == []


def test_short_fingerprints_err_to_one_side_and_are_measured(spark):
    recs = [(i, f"key{i % 900}") for i in range(1200)]
    df, earlier = spark.createDataFrame(recs, "rec_id long, strid string"), spark.createDataFrame([("key1",)], "strid string")
    exact = {r.rec_id for r in seen.seen_before(df, earlier, key="strid", record_id="rec_id").collect()}
    rough = {r.rec_id for r in seen.seen_before(df, earlier, key="strid", record_id="rec_id", bits=12).collect()}
    assert exact == {i for i in range(1200) if i >= 900 or i == 1} and exact < rough
    row = seen.wrong_answers(df, earlier, key="strid", record_id="rec_id", bits=12).first()
    assert (row.records, row.new_keys, row.wrong) == (1200, 899, len(rough - exact))
    assert row.wrong_rate == pytest.approx(len(rough - exact) / 1200)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=120), min_size=1, max_size=6), st.integers(2, 12))
def test_summary_bounds_through_merges(parts, k):
    whole = heavy.Summary(k)
    for p in parts:
        one = heavy.Summary(k)
        for at in range(0, len(p), 7):
            one.add(pd.Series(p[at : at + 7]).value_counts(), len(p[at : at + 7]))
        one.prune()
        whole.add(one.counts, one.rows, one.bound)
    whole.prune()
    true = Counter(v for p in parts for v in p)
    total = sum(map(len, parts))
    assert whole.rows == total and whole.bound <= total / (k + 1) and len(whole.counts) <= k
    for v, n in true.items():
        low = int(whole.counts.get(v, 0))
        assert low <= n <= low + whole.bound


def test_heavy_hitters_against_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 30 + ["b"] * 10 + ["", None] + [f"r{i}" for i in range(200)]), rng.choice([1, 1, 1, 2, None, *range(3, 90)])) for _ in range(4000)]
    df = spark.createDataFrame([(s, t, "x") for s, t in rows], "strid string, tile int, val string").repartition(7)
    got = {(r.field, r.val): r for r in heavy.heavy_hitters(df, {"strid": 0.02, "tile": 0.03}, slack=2).collect()}
    want = {("strid", v): n for v, n in Counter(s for s, _ in rows).items() if v is not None and n >= 80}
    want |= {("tile", str(v)): n for v, n in Counter(t for _, t in rows).items() if v is not None and n >= 120}
    assert {k: r.n for k, r in got.items()} == want
    assert all(r.low <= r.n <= r.high and r.total == 4000 for r in got.values())
    assert heavy.heavy_hitters(df.limit(0), {"strid": 0.1}).collect() == []


def top_brute(rows, n):
    best = defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = max(s, best[g].get(i, s))
    return {(g, i, k + 1) for g, own in best.items() for k, (i, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[:n])}


def test_top_n_with_ties_and_large_groups(spark):
    rng = random.Random(3)
    rows = [("big", f"f{rng.randint(0, 3000)}", float(rng.randint(0, 30))) for _ in range(5000)]
    rows += [(f"g{rng.randint(0, 60)}", f"f{rng.randint(0, 9)}", rng.choice([1.0, 2.0, 2.0, rng.random()])) for _ in range(700)]
    rows += [("one", "é", 1.0), ("one", "z", 1.0), (None, "a", 9.0), ("n", None, 9.0), ("n", "a", None), ("n", "b", float("nan")), ("flat", "b", 0.0), ("flat", "a", 0.0), ("", "e", 5.0)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "factor string, feature string, chi2 double, grp int, rank string").repartition(6)
    for n in (1, 5):
        got = topn.top_n(df, F.col("factor"), F.col("feature"), F.col("chi2"), n).collect()
        assert len(got) == len({(r.grp, r.item) for r in got})
        assert {(r.grp, r.item, r.rank) for r in got} == top_brute(rows, n)
    assert topn.top_n(df.limit(0), F.col("factor"), F.col("feature"), F.col("chi2"), 3).collect() == []


def test_wrong_answers_are_measured_as_p2_found_runs(spark, tmp_path):
    from stipple.llm import queries

    spark.createDataFrame([(i, f"k{i % 7}") for i in range(20)], "rec_id long, strid string").write.parquet(str(tmp_path / "sbcd_recs.parquet"))
    spark.createDataFrame([("k0",)], "strid string").write.parquet(str(tmp_path / "seen_strids.parquet"))
    rows = {r.bits: (r.records, r.new_keys, r.wrong) for r in queries.p2_wrong_answers(spark, str(tmp_path)).collect()}
    assert rows == {32: (20, 6, 0), queries.FINGERPRINT_BITS: (20, 6, 0)}


@pytest.mark.parametrize("bits", [12, 64])
def test_a_kept_index_answers_like_one_run(spark, tmp_path, bits):
    rng = random.Random(5)
    keys = ["hot"] * 200 + [f"k{i}" for i in range(400)] + [None, ""]
    recs = spark.createDataFrame([(i, rng.choice(keys), "clash") for i in range(1200)], "rec_id long, strid string, part string")
    want = {r.rec_id for r in seen.seen_before(recs, None, key="strid", record_id="rec_id", bits=bits).collect()}
    index, got = seen.SeenIndex(spark, bits=bits, parts=5), set()
    for k, (a, b) in enumerate([(0, 300), (300, 301), (301, 301), (301, 1200)]):
        batch = recs.filter((F.col("rec_id") >= a) & (F.col("rec_id") < b))
        got |= {r.rec_id for r in index.probe(batch, key="strid", record_id="rec_id").collect()}
        if k == 1:  # closed and opened again, without the earlier records
            index.save(str(tmp_path / "index"))
            index = seen.SeenIndex(spark, bits=bits, parts=5, folder=str(tmp_path / "index"))
    assert got == want
    if bits == 64:
        size = index.size().first()
        assert size.n_keys == recs.filter("strid IS NOT NULL").select("strid").distinct().count() and 0 < size.wrong_rate < 1e-15


def test_bands_do_not_change_the_result(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a"] * 30 + ["b", "c"]), f"f{rng.randint(0, 60)}", rng.choice([1.0, 2.0, rng.random() * 9])) for _ in range(900)]
    df = spark.createDataFrame(data, "g string, i string, s double")
    found = [sorted(tuple(r) for r in topn.top_n(df, F.col("g"), F.col("i"), F.col("s"), 4, shares=x).collect()) for x in (None, [], [0.01, 0.02, 0.5], [0.999])]
    assert len(found[0]) == 12 and all(f == found[0] for f in found)
    assert topn.band_shares(2, 10, 10) == [0.25, 0.5] and topn.band_shares(5, 3, 0) == []
