import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stipple.operators import proximity, spatial

POINT, REGION = "mol_id long, x double, y double, kind string", "poly_id long, xs array<double>, ys array<double>, a string"


def inside(xs, ys, x, y):
    odd = False
    kept = [(a, b) for a, b in zip(xs, ys) if a is not None and b is not None]
    xs, ys = [a for a, _ in kept], [b for _, b in kept]
    for x1, y1, x2, y2 in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def brute(points, regions, r):
    ok = [(i, x, y) for i, x, y, _ in points if x is not None and y is not None and math.isfinite(x) and math.isfinite(y)]
    out = set()
    for k, (i, x, y) in enumerate(ok):
        for j, u, v in ok[k + 1 :]:
            if (x - u) * (x - u) + (y - v) * (y - v) <= r * r:
                out.add(("near", min(i, j), max(i, j)))
        for p, xs, ys, _ in regions:
            if xs is not None and ys is not None and len(xs) == len(ys) >= 3 and inside(xs, ys, x, y):
                out.add(("in", i, p))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    points = [(i, round(rng.uniform(-40, 60), 2), round(rng.uniform(-40, 60), 2), "k") for i in range(700)]
    points += [(700 + i, *points[i][1:3], "copy") for i in range(30)]  # the same places again
    points += [(800, None, 1.0, "k"), (801, 1.0, float("nan"), "k"), (802, float("inf"), 0.0, None), (803, 1e300, 1e300, "k"), (804, 1e300, 1e300, "k")]
    regions = []
    for p in range(40):
        cx, cy, n, size = rng.uniform(-40, 60), rng.uniform(-40, 60), rng.randint(3, 14), rng.choice([2, 8, 30])
        ang = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        rad = [size * rng.uniform(0.3, 1) for _ in ang]
        xs, ys = [cx + r * math.cos(a) + 0.0013 for r, a in zip(rad, ang)], [cy + r * math.sin(a) + 0.0017 for r, a in zip(rad, ang)]
        if p % 3 == 0:
            xs, ys = xs + xs[:1], ys + ys[:1]
        if p % 2:
            xs, ys = xs[::-1], ys[::-1]
        regions.append((p, xs, ys, None))
    # a ring that crosses itself, a star, unusable ones, a repeated one, a null vertex
    regions.append((50, [0.01, 20.01, 0.01, 20.01], [0.013, 20.017, 20.013, 0.017], "bow"))
    star = [(10 + 9 * math.cos(k * 4 * math.pi / 5), 9 * math.sin(k * 4 * math.pi / 5)) for k in range(5)]
    regions.append((51, [a for a, _ in star], [b for _, b in star], "star"))
    regions += [(52, None, [1.0], ""), (53, [1.0, 2.0], [1.0, 2.0], ""), (54, [1.0, 2.0, 3.0], [1.0, 2.0], ""), (55, *regions[0][1:3], "again"), (56, [0.0, 10.0, None, 0.003], [0.0, 0.001, 10.0, 10.005], "")]
    got = proximity.near_and_inside(spark.createDataFrame(points, POINT), spark.createDataFrame(regions, REGION), 1.7, tile=4.0)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    want = brute(points, regions, 1.7)
    assert set(rows) - want == set() and want - set(rows) == set()


def test_regions_wider_than_a_level(spark):
    points = [(i, i * 37.7 - 900, (i * 91.3) % 1500 - 700, "") for i in range(60)]
    regions = [(1, [-800.5, 900.25, 850.0, -700.125], [-650.5, -600.25, 700.0, 650.125], "large"), (2, [0.5, 3.5, 2.0], [0.5, 0.75, 4.0], "small")]
    got = proximity.near_and_inside(spark.createDataFrame(points, POINT), spark.createDataFrame(regions, REGION), 0.5, tile=2.0)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(points, regions, 0.5)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], POINT), spark.createDataFrame([(1, 1.0, 1.0, "")], POINT)
    no_region = spark.createDataFrame([], REGION)
    assert proximity.near_and_inside(none, no_region, 1.0).collect() == []
    assert proximity.near_and_inside(some, no_region, 1.0).collect() == []
    assert proximity.near_and_inside(some, None, 1.0).collect() == []
    with pytest.raises(ValueError):
        proximity.near_and_inside(some, None, 10.0, tile=4.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=9), st.integers(-20, 20), st.integers(-20, 20))
def test_slabs_locate_like_even_odd(ring, x, y):
    xs, ys = [a + 0.5 for a, _ in ring], [b + 0.5 for _, b in ring]
    x, y = x + 0.1234567, y + 0.2345678
    odd = False
    for y0, y1, edges, held in proximity.slabs(np.array(xs), np.array(ys)):
        if y0 <= y < y1:
            at = edges[:, 0] + (y - edges[:, 1]) * edges[:, 2]
            if held:
                assert (np.diff(at) >= -1e-6).all()
            odd = bool((at > x).sum() & 1)
    assert odd == inside(xs, ys, x, y)


def test_nearest(spark):
    rng = random.Random(2)
    p = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(120)] + [(200, None, 1.0), (201, float("nan"), 0.0)]
    t = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9), f"v{i}") for i in range(90)]
    t += [(500 + i, *t[i][1:3], "tie") for i in range(20)]
    got = spatial.nearest(spark.createDataFrame(p, "pid long, x double, y double"), spark.createDataFrame(t, "tid long, x double, y double, v string"), 0.9, point_id="pid", target_id="tid", values=["v"])
    for r in got.collect():
        near = []
        if r.x is not None and not math.isnan(r.x):
            near = sorted(((r.x - x) ** 2 + (r.y - y) ** 2, i) for i, x, y, _ in t if (r.x - x) ** 2 + (r.y - y) ** 2 <= 0.81)
        assert (r.tid, r.d2) == ((near[0][1], near[0][0]) if near else (None, None))
    assert got.count() == len(p)


def test_assign_regions_expanded_and_raster(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-5, 25), rng.uniform(-5, 25), "") for i in range(250)]
    regions = [(1, [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0], ""), (2, [8.0, 20.0, 20.0, 8.0], [8.0, 8.0, 20.0, 20.0], ""), (3, [8.0, 20.0, 20.0, 8.0], [8.0, 8.0, 20.0, 20.0], "")]

    def edge(xs, ys, x, y):
        best = math.inf
        for x1, y1, x2, y2 in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1]):
            dx, dy = x2 - x1, y2 - y1
            t = max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            best = min(best, (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)
        return best

    df, rg = spark.createDataFrame(points, POINT), spark.createDataFrame(regions, REGION)
    got = {r.mol_id: r.cell for r in spatial.assign_regions(df, rg, expand=1.5).collect()}
    raster = {r.mol_id: r.cell for r in spatial.assign_by_raster(df, rg, 1.0).collect()}
    for i, x, y, _ in points:
        own = [p for p, xs, ys, _ in regions if inside(xs, ys, x, y)]
        if own:
            want = min(own, key=lambda p: ((x - sum(regions[p - 1][1]) / 4) ** 2 + (y - sum(regions[p - 1][2]) / 4) ** 2, p))
        else:
            near = sorted((edge(xs, ys, x, y), p) for p, xs, ys, _ in regions if edge(xs, ys, x, y) <= 2.25)
            want = near[0][1] if near else None
        assert got[i] == want
        centre = [p for p, xs, ys, _ in regions if inside(xs, ys, math.floor(x) + 0.5, math.floor(y) + 0.5)]
        assert raster[i] == (str(centre[0]) if len(centre) == 1 else "UNASSIGNED")


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(230, 6)).astype("float32")
    df = spark.createDataFrame([(i, v[i].tolist(), "x") for i in range(230)] + [(900, None, ""), (950, [], "")], "vec_id long, embedding array<float>, other string")
    got = {(r.id, r.rank): r.other for r in spatial.nearest_vectors(df, ident="vec_id", vector="embedding", k=2).collect()}
    for q in range(0, 230, 50):
        d = ((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1)
        d[q] = math.inf
        assert [got[q, 1], got[q, 2]] == np.argsort(d)[:2].tolist()
    assert len(got) == 10
    assert spatial.nearest_vectors(df.limit(0), ident="vec_id", vector="embedding").collect() == []


def test_dense_tiles_and_wide_regions_are_cut(spark, monkeypatch):
    """A dense tile, one region over everything and small ones: strips give the same rows, and no group holds a tile whole."""
    rng = np.random.default_rng(11)
    xy = np.round(np.concatenate([rng.uniform(0, 15.9, (3000, 2)), rng.uniform(-40, 60, (1500, 2))]), 2)
    points = spark.createDataFrame([(i, float(a), float(b), "c") for i, (a, b) in enumerate(xy)], "mol_id long, x double, y double, strip string")
    wide = [(1, [-3000.0, 3000.0, 3000.0, -3000.0], [-3000.0, -2900.0, 3000.0, 2800.0]), (2, [1.003, 9.007, 12.003], [2.007, 14.001, 3.003]), (3, [-35.001, 55.003, 10.007], [-30.003, -20.001, 50.003])]
    regions = spark.createDataFrame(wide, "poly_id long, xs array<double>, ys array<double>")
    found = []
    for most in (10**9, 150):
        monkeypatch.setattr(proximity, "TILE_POINTS", most)
        found.append(sorted(tuple(r) for r in proximity.near_and_inside(points, regions, 0.305).collect()))
    assert found[0] == found[1] and len(set(found[1])) == len(found[1])
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
    near = {("near", int(i), int(j)) for i, j in zip(*np.nonzero(d2 <= 0.305**2)) if i < j}
    assert {r for r in found[1] if r[0] == "near"} == near
    assert sum(r[0] == "in" and r[2] == 1 for r in found[1]) == len(xy)

