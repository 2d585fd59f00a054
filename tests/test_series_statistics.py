"""Trends without pairs, curves of groups, correlations by blocks, neighbours where stations are dense: each against the plain form."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.operators import curves, pairs, spatial, trends


def plain_trend(points):
    both = [(a, b) if a[0] < b[0] else (b, a) for a, b in itertools.combinations([p for p in points if None not in p], 2) if a[0] != b[0]]
    if not both:
        return None, None
    return float(np.mean([np.sign(b[1] - a[1]) for a, b in both])), float(np.median([(b[1] - a[1]) / (b[0] - a[0]) for a, b in both]))


def series(n, seed, ties):
    rnd = random.Random(seed)
    out = [(rnd.randint(0, n // 2) if ties else i * 3 + rnd.randint(0, 2), float(rnd.randint(-3, 3)) if ties else 0.02 * i + rnd.gauss(0, 2)) for i in range(n)]
    return [*out, (None, 1.0), (5, None)]


@pytest.mark.parametrize(("n", "ties", "few"), [(60, False, 1000), (60, True, 1000), (90, False, 0), (91, True, 0), (7, True, 0)])
def test_trend(spark, monkeypatch, n, ties, few):
    monkeypatch.setattr(trends, "RANGES", 5)
    points = series(n, n, ties)
    got = trends.trend(spark.createDataFrame(points, "t int, v double"), "t", "v", few).first()
    want = plain_trend(points)
    assert abs(got.tau - want[0]) < 1e-6 and abs(got.slope - want[1]) < 2e-6


def test_trend_without_pairs(spark):
    for rows in ([], [(1, 2.0)], [(1, 2.0), (1, 3.0)]):
        for few in (0, 10):
            assert tuple(trends.trend(spark.createDataFrame(rows, "t int, v double"), "t", "v", few).first()) == (None, None)


def test_rises():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 50, 257):
        a, b = rnd.integers(0, 9, n), rnd.integers(0, 9, n).astype(float)
        assert trends.rises(a, b) == sum(int(a[i] < a[j] and b[i] < b[j]) for i in range(n) for j in range(n))


def test_a_long_series_is_counted_quickly(spark):
    """200,000 points have 2 * 10^10 pairs."""
    df = spark.range(200_000).select("id", (F.col("id") * 0.5 + F.pmod(F.col("id") * 7919, F.lit(1000))).alias("v"))
    points = trends._ranged(df, "id", "v")
    (up, down), = trends.counts(points, [0.0])
    v = np.arange(200_000) * 0.5 + np.arange(200_000) * 7919 % 1000
    assert up == trends.rises(np.arange(200_000), v) and down == trends.rises(np.arange(200_000), -v)


def test_curves_of_groups(spark):
    rnd = random.Random(6)
    true = {"a": (0.9, 12.0), "b": (0.4, 150.0), "c": (1.0, 1000.0)}
    rows = [(g, x, c * math.exp(-x / length) + rnd.gauss(0, 0.05)) for g, (c, length) in true.items() for x in (rnd.uniform(0, 60) for _ in range(400))]
    rows += [("none", x, -0.5) for x in (1.0, 2.0)] + [("a", None, 0.1), (None, 1.0, 1.0)]
    got = {r.g: r for r in curves.e_folding(spark.createDataFrame(rows, "g string, km double, r double"), "g", "km", "r").collect()}
    assert got["none"].c0 == 0 and {g: r.n for g, r in got.items()} == {"a": 400, "b": 400, "c": 400, "none": 2}
    for g in true:
        x, y = (np.array([r[i] for r in rows if r[0] == g and r[1] is not None]) for i in (1, 2))
        best = (np.inf, None)
        lengths = 0.1 * 10000 ** np.linspace(0, 1, 40_001)
        for part in np.array_split(lengths, 40):
            e = np.exp(-x[None, :] / part[:, None])
            c = np.clip((e * y).sum(1) / (e * e).sum(1), 0, 1)
            err = ((y - c[:, None] * e) ** 2).sum(1)
            i = int(err.argmin())
            best = min(best, (err[i], (c[i], part[i])))
        error = float(((y - got[g].c0 * np.exp(-x / got[g].efold_km)) ** 2).sum())
        assert error <= best[0] * (1 + 1e-9) and abs(got[g].c0 - best[1][0]) < 1e-3 and abs(got[g].efold_km / best[1][1] - 1) < 1e-3


def test_correlations_by_blocks(spark):
    rnd = random.Random(9)
    rows = [(f"S{i}", t * 600, t % 2, 5.0 if i == 3 else rnd.randint(0, 30) / 10) for i in range(11) for t in range(40) if rnd.random() < 0.7 and not (i == 4 and t > 0)]
    df = spark.createDataFrame([*rows, ("S1", 999_600, 0, None)], "station_id string, slot long, half int, y double")
    at = {(s, h): {t: y for s2, t, h2, y in rows if (s2, h2) == (s, h)} for s in {r[0] for r in rows} for h in (0, 1)}
    want = {}
    for (a, h), (b, h2) in itertools.product(at, at):
        if a < b and h == h2 and (both := at[a, h].keys() & at[b, h].keys()):
            x, y = (np.array([at[s, h][t] for t in sorted(both)]) for s in (a, b))
            want[a, b, h] = (len(both), None if x.std() < 1e-9 or y.std() < 1e-9 else np.corrcoef(x, y)[0, 1])
    for block, span in ((4, 16), (256, 256)):
        got = {(r.a, r.b, r.half): (r.n, r.r) for r in pairs.correlations(df, "half", 600, block, span).collect()}
        assert got.keys() == want.keys()
        for k, (n, r) in want.items():
            assert got[k][0] == n and ((r is None) == (got[k][1] is None)) and (r is None or abs(r - got[k][1]) < 1e-9)
    assert pairs.correlations(df.where("false"), "half", 600).collect() == []


def test_nearest_of_clustered_stations(spark, monkeypatch):
    rnd = random.Random(12)
    town = [(1.3 + rnd.gauss(0, 0.002), 103.8 + rnd.gauss(0, 0.002)) for _ in range(700)]
    one_place = [(1.31, 103.81)] * 150
    far = [(rnd.uniform(0.5, 2.5), rnd.uniform(103, 105)) for _ in range(60)]
    pts = [(f"P{i:04d}", a, b) for i, (a, b) in enumerate(town + one_place + far)]
    df = spark.createDataFrame(pts, "station_id string, lat double, lon double")
    monkeypatch.setattr(spatial, "CROWD", 16)
    met = []
    plain = spatial.within

    def counted(*args):
        out = plain(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within", counted)
    got: dict[str, list] = {}
    for r in spatial.nearest(df, 5).collect():
        got.setdefault(r.station_id, []).append((r.k, r.nb, r.km))
    lat, lon = (np.radians([p[i] for p in pts]) for i in (1, 2))
    q = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    km = 2 * C.EARTH_KM * np.arcsin(np.sqrt(q))
    for i, p in enumerate(pts):
        order = sorted((round(km[i, j], 9), pts[j][0]) for j in range(len(pts)) if j != i)[:6]
        own = sorted(got[p[0]])
        assert len(own) == 5 and all(abs(d - e) < 2e-6 for (*_, d), (e, _) in zip(own, order, strict=False))
        at = {nb: d for d, nb in order}
        assert all(nb in at or abs(d - order[5][0]) < 2e-6 for _, nb, d in own)
        if order[4][0] == 0:  # of one place the smallest ids
            assert [nb for _, nb, _ in own] == [nb for _, nb in order[:5]]
    assert sum(met) < 120 * len(pts)  # all pairs would be 910 rows a station


def _drawn(spark):
    rnd = random.Random(12)
    shared = [rnd.random() for _ in range(40)]
    rows = [(f"S{i}", t * 600, t % 2, round(10 * (shared[t] * math.exp(-i / 5) + rnd.random())) / 10) for i in range(23) for t in range(40) if rnd.random() < 0.8]
    return spark.createDataFrame(rows, "station_id string, slot long, half int, y double")


def test_sums_of_pairs_are_not_moved(spark, monkeypatch):
    """Whatever the tiles are, all pairs come, and what a product gives is final: nothing as large as the pairs is shuffled."""
    df = _drawn(spark)
    whole = sorted(map(tuple, pairs.correlations(df, "half", 600, digits=4).collect()))
    for name, n in (("CELLS", 60), ("NARROW", 3), ("WIDE", 5)):
        monkeypatch.setattr(pairs, name, n)
    got = pairs.correlations(df, "half", 600, 2, 7, digits=4)
    assert sorted(map(tuple, got.collect())) == whole and len(whole) == 23 * 22
    plan = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(plan) > 1 and "Exchange" not in plan[0].split("Final Plan")[-1]


def test_correlations_by_distance(spark):
    """Bins and fit of the sums are those of a row for each pair."""
    df = _drawn(spark)
    places = spark.createDataFrame([(f"S{i}", 1.2 + i * i * 0.0003, 103.6 + (i % 4) * 0.01) for i in range(23)], "station_id string, lat double, lon double")
    bins, nodes = pairs.by_distance(df, "half", 600, places, 2.5)
    at = {r.station_id: np.array([[r.lat], [r.lon]]) for r in places.collect()}
    rows = [(r.half, float(pairs.kilometres(at[r.a], at[r.b])[0, 0]), r.r) for r in pairs.correlations(df, "half", 600).collect()]
    assert min(r[1] for r in rows) < 3 and max(r[1] for r in rows) > 15
    want = {}
    for half, km, r in rows:
        want.setdefault((half, int(km // 2.5)), []).append(r)
    got = {(r.half, r.bin): (r.n, r.r) for r in bins.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(abs(v[1] - np.mean(want[k])) < 1e-12 for k, v in got.items())
    raw = {r.half: r for r in curves.e_folding(spark.createDataFrame(rows, "half int, km double, r double"), "half", "km", "r").collect()}
    for r in curves.e_folding(nodes, "half", "x", "y", summed=True).collect():
        assert r.n == raw[r.half].n and abs(r.c0 - raw[r.half].c0) < 1e-6 and abs(r.efold_km / raw[r.half].efold_km - 1) < 1e-5


def test_nodes_have_the_sums_of_their_rows(spark):
    rnd = np.random.default_rng(8)
    x, y = np.concatenate([[0.0, 1e-4, 20_015.0], 10 ** rnd.uniform(-4, 4, 5000)]), rnd.normal(size=5003)
    m = curves.moments(x, y)
    cells = [(0, int(c), *map(float, m[:, c])) for c in np.flatnonzero(m[0])]
    found = np.array([tuple(r) for r in curves.nodes(spark.createDataFrame(cells, "g long, at long, " + ", ".join(f"s{i} double" for i in range(len(m))))).select("x", "n", "y", "yy").collect()]).T
    assert abs(found[3].sum() - (y * y).sum()) < 1e-9
    for length in (0.1, 3.0, 77.0, 1000.0):
        for f in (lambda v, l=length: np.exp(-v / l), lambda v, l=length: np.exp(-2 * v / l) * v * v / l**2):
            assert abs((f(found[0]) * found[1]).sum() - f(x).sum()) < 1e-9 and abs((f(found[0]) * found[2]).sum() - (f(x) * y).sum()) < 1e-9
    with pytest.raises(ValueError):
        curves.moments(np.array([30_000.0]), np.array([1.0]))
