"""Fits on rows of a known make: against climatology, plain arithmetic, and themselves after saving."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gaugeworks import plans
from gaugeworks.functions import columns as C
from gaugeworks.operators import errors as E
from gaugeworks.operators import models as M
from gaugeworks.operators import nets
from gaugeworks.operators import sketches as K
from gaugeworks.operators import verification as W

NUMERIC = ["a", "b"]
EDGES = (0.0, 2.0, 5.0, 12.0)


@pytest.fixture(scope="module")
def rows(spark):
    """Wet with a probability that rises in a; then log-normal about 1 + b, wider for large a."""
    rnd, out = random.Random(11), []
    for i in range(3000):
        a, b = rnd.uniform(-2, 2), rnd.uniform(0, 1)
        wet = rnd.random() < 1 / (1 + math.exp(-2 * a))
        y = math.exp(1 + b + (0.7 if a > 1 else 0.3) * rnd.gauss(0, 1)) if wet else 0.0
        out.append((f"S{i % 4}", i, i % 2, a, b, round(y, 1)))
    df = spark.createDataFrame(out, "station_id string, slot long, fold int, a double, b double, target double")
    return df.withColumn("label", (F.col("target") > 3).cast("int")).withColumn("weight", F.lit(1.0)).cache()


@pytest.fixture(scope="module")
def parts(rows):
    return M.temporal_split(rows, "slot", 2000, 2500)


@pytest.fixture(scope="module")
def amounts(parts):
    return M.fit_amounts(parts[0], NUMERIC, F.col("fold"), M.SMALL)


def skill(scored):
    return W.brier(scored, F.col("p"), F.col("o")).first()


@pytest.mark.parametrize("make", ["logistic", "gbt", "forest", "net"])
def test_occurrence_models_beat_climatology(parts, make):
    train, _, test = parts
    model = {"logistic": lambda: M.logistic(train, NUMERIC, M.SMALL), "gbt": lambda: M.trees(train, NUMERIC, "gbt", M.SMALL), "forest": lambda: M.trees(train, NUMERIC, "forest", M.SMALL), "net": lambda: M.perceptron(train, NUMERIC, M.SMALL)}[make]()
    got = skill(model.transform(test).select(M.positive().alias("p"), (F.col("label") == 1).alias("o")))
    assert got.n == test.count() and got.skill > 0.1


def test_amounts_beat_climatology_at_every_threshold(parts, amounts):
    s = M.score_amounts(amounts, parts[2]).cache()
    assert s.where("pi < 0 or pi > 1 or s < 0.05").count() == 0
    for r in (0.0, 1.0, 3.0, 8.0):
        for spread in M.SPREADS:
            for errors in M.ERRORS:
                got = skill(s.select(M.exceedance(F.lit(r), amounts, spread, errors).alias("p"), (F.col("target") > r).alias("o")))
                assert got.skill > 0.05, (r, spread, errors)


def test_error_tables(amounts):
    assert set(amounts.tables) == set(M.SPREADS) and len(amounts.edges) == M.CLASSES - 1
    for tables in amounts.tables.values():
        assert len(tables) == M.CLASSES + 1
        for t in tables:
            assert t == sorted(t) and len(t) == len(M.PROBS)
        assert len(M.PROBS) > 1000 and abs(tables[0][len(M.PROBS) // 2]) < 0.3 and tables[0][0] < -1.2 and tables[0][-1] > 1.2  # standardised


def test_tables_follow_their_quantiles():
    q = np.array([NormalDist().inv_cdf(p) for p in E.PROBS])
    t = E.Table(q)
    assert np.allclose(t.below(q), E.PROBS, atol=1e-9) and np.allclose(t.below(t.q) + t.above(t.q), 1)
    assert np.allclose(t.below((q[1:] + q[:-1]) / 2), (np.array(E.PROBS[1:]) + E.PROBS[:-1]) / 2, atol=1e-9)  # straight between
    rate = math.log(10) / (q[3] - q[0])  # the table's own fall from one in a thousand to one in ten thousand
    half = q[0] - math.log(2) / rate
    assert abs(t.below(half) - E.PROBS[0] / 2) < 1e-9 and t.below(-1e6) == 0 == t.above(1e6)
    ties = E.Table([0.0] * 500 + [1.0] * (len(E.PROBS) - 500))
    assert ties.below(-1e-3) < 0.01 and abs(ties.below(0.5) - E.PROBS[499]) < 2e-3 and ties.above(1.1) < 0.01


def quadrature(cdf, y, top=4000.0, n=400_000):
    x = np.concatenate([[0.0], np.exp(np.linspace(-18, math.log(top), n))])
    mid = (x[1:] + x[:-1]) / 2
    return float(np.sum((cdf(mid) - (mid >= y)) ** 2 * np.diff(x)))


def test_crps_of_tables_against_quadrature():
    rnd = np.random.default_rng(4)
    skewed = np.sort(np.concatenate([rnd.exponential(1, 505) - 1, rnd.normal(size=500)]))
    tables = E.Tables([0.5], [skewed, [NormalDist().inv_cdf(p) for p in E.PROBS]])
    rows = [(y, pi, m, s) for y in (0.0, 1e-5, 0.2, 3.0, 900.0) for pi in (0.0, 0.3, 1.0) for m in (-0.5, 1.0) for s in (0.05, 0.4, 1.1)]
    y, pi, m, s = (np.array(c) for c in zip(*rows, strict=True))
    got = tables.crps(pi, m, s, y)
    for i, (y0, p0, m0, s0) in enumerate(rows):
        t = tables.tables[int(m0 > 0.5)]
        want = quadrature(lambda x, t=t, p0=p0, m0=m0, s0=s0: 1 - p0 * t.above((np.log(x) - m0) / s0), y0)
        assert abs(got[i] - want) < 2e-4 * max(1, want), rows[i]


def test_scores_of_all_forms(parts, amounts):
    """Of all six forms: the CRPS is the quadrature of the form's own exceedance, its cell and PIT are that exceedance at the cell's edges."""
    s = M.score_amounts(amounts, parts[2]).limit(40).cache()
    for spread in M.SPREADS:
        for kind in M.ERRORS:
            scored = M.amount_scores(s, "target", 0.1, amounts, spread, kind)
            low, high = (F.greatest((F.round(F.col("target") / 0.1) + d) * 0.1, F.lit(0.0)) for d in (-0.5, 0.5))
            for r in scored.withColumn("a", F.when(low > 0, M.exceedance(low, amounts, spread, kind)).otherwise(1.0)).withColumn("b", M.exceedance(high, amounts, spread, kind)).collect():
                assert abs(r.lo - (1 - r.a)) < 1e-9 and abs(r.hi - (1 - r.b)) < 1e-9 and 0 <= r.lo <= r.hi <= 1
                assert abs(r.nll_lattice + math.log(max(r.a - r.b, 1e-9))) < 1e-6 and (r.nll_density is None) == (kind != "normal")
                if kind == "normal":
                    over = np.vectorize(lambda x, r=r: r.pi * (1 - NormalDist().cdf((math.log(x) - r.m) / (amounts.sigma if spread == "constant" else r.s))))
                    n = 20_000
                else:
                    t = M._tables(amounts, spread, kind)
                    over = lambda x, r=r, t=t: t.over(*(np.full(len(x), v) for v in (r.pi, r.m, amounts.sigma if spread == "constant" else r.s)), x)
                    n = 100_000
                assert abs(r.crps - quadrature(lambda x, over=over: 1 - over(x), r.target, 2000.0, n)) < 3e-3 * max(1, r.crps)


def test_sketches_of_groups_merge(spark):
    rnd = random.Random(8)
    data = [(i % 3, i % 7, rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 3))])) for i in range(60_000)] + [(9, 0, None), (8, 0, 5.0)]
    df = spark.createDataFrame(data, "g int, h int, v double").repartition(9)
    probs = [i / 1000 for i in range(1, 1000)]
    fine = K.sketches(df, ["g", "h"], ["v"])
    got = {r.g: r.q for r in K.merged(fine, ["g"], ["v"]).select("g", K.quantiles(F.col("v"), probs).alias("q")).collect()}
    assert got[9] is None and set(got[8]) == {5.0}
    for g in range(3):
        values = np.sort([v for a, _, v in data if a == g])
        n = len(values)
        worst = max(max(np.searchsorted(values, q, "left") / n - p, p - np.searchsorted(values, q, "right") / n) for p, q in zip(probs, got[g], strict=True))
        assert worst <= 1.5 * K.rank_error()
    few = K.sketches(df.where("g = 0 and h = 0"), ["g"], ["v"]).select(K.quantiles(F.col("v"), probs).alias("q")).first().q
    own = np.sort([v for a, b, v in data if a == 0 and b == 0])
    assert few == [float(own[max(0, math.ceil(p * len(own) - 1e-9) - 1)]) for p in probs]  # exact up to the sketch's size


def test_survival_between_edges(spark):
    grid, s = (0.0, 0.5, 2.0, 8.0), [0.9, 0.6, 0.3, 0.0]
    got = spark.createDataFrame([(s, [-1.0, 0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0])], "s array<double>, rs array<double>").select(C.survivals_at(grid, F.col("s"), F.col("rs")).alias("p")).first().p
    assert got[:4] == [0.9, 0.9, 0.75, 0.6] and abs(got[4] - math.sqrt(0.6 * 0.3)) < 1e-12 and abs(got[5] - 0.3) < 1e-12
    assert abs(got[6] - math.sqrt(0.3 * 1e-300)) < 1e-12 and got[7] < 1e-290 and got[8] < got[7]
    straight = spark.createDataFrame([([1.0, 0.8, 0.4, 0.1], [16.0])], "s array<double>, rs array<double>").select(C.survivals_at(grid, F.col("s"), F.col("rs")).alias("p")).first().p
    assert abs(straight[0] - 0.1 * (0.1 / 0.4) ** (math.log(2) / math.log(4))) < 1e-12  # Pareto beyond


def test_hazard_is_scored_in_the_row(parts):
    model = M.fit_classes("hazard", parts[0], NUMERIC, EDGES, M.SMALL)
    wet = parts[2].where("target > 0")
    got = M.class_survival(model, wet, ["station_id", "slot"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    each = wet.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(len(EDGES)))))
    stay = {(r.slot, r.j): r.stay for r in model.model.transform(each).select("slot", "j", (1 - M.positive()).alias("stay")).collect()}
    for r in got.collect():
        assert np.allclose(r.survival, np.cumprod([stay[r.slot, j] for j in range(1, len(EDGES) + 1)]))


def test_selection_takes_the_lowest_score(parts, amounts):
    best, table = M.select_errors(amounts, parts[1], "target", 0.1)
    scores = {(r.spread, r.errors): r.nll for r in table.collect()}
    assert len(scores) == 6 and scores[best.spread, best.errors] == min(scores.values()) and best.location is amounts.location


def test_refit_keeps_the_other_models(parts, amounts):
    again = M.refit_variance(amounts, parts[0].unionByName(parts[1]), F.col("fold"), M.SMALL)
    assert again.location is amounts.location and again.occurrence is amounts.occurrence and again.variance is not amounts.variance
    got = skill(M.score_amounts(again, parts[2]).select(M.exceedance(F.lit(3.0)).alias("p"), (F.col("target") > 3).alias("o")))
    assert got.skill > 0.05


def test_saved_model_is_the_same_and_refuses_other_features(spark, parts, amounts, tmp_path):
    path = f"file://{tmp_path}/model"
    M.save_amounts(amounts, path, spark)
    back = M.load_amounts(path, spark, NUMERIC)
    ask = lambda m: [(r.slot, r.p) for r in M.score_amounts(m, parts[2]).select("slot", M.exceedance(F.lit(3.0), m, "varying", "table_by_m").alias("p")).orderBy("slot").collect()]
    assert ask(back) == ask(amounts) and back.tables == amounts.tables
    with pytest.raises(ValueError):
        M.load_amounts(path, spark, ["b", "a"])


@pytest.mark.parametrize("kind", M.KINDS)
def test_class_survival(parts, kind):
    model = M.fit_classes(kind, parts[0], NUMERIC, EDGES, M.SMALL)
    wet = parts[2].where("target > 0")
    got = M.class_survival(model, wet, ["station_id", "slot"]).collect()
    assert len(got) == wet.count()
    for r in got:
        assert len(r.survival) == len(EDGES) and all(-1e-9 <= b <= a + 1e-9 <= 1 + 2e-9 for a, b in zip(r.survival, r.survival[1:], strict=False))
    over = wet.agg(F.avg((F.col("target") > 5).cast("double")).alias("x")).first().x
    assert abs(sum(r.survival[2] for r in got) / len(got) - over) < 0.15
    with pytest.raises(ValueError):
        M.fit_classes("other", parts[0], NUMERIC, EDGES, M.SMALL)


def test_calibration_undoes_a_distortion(spark):
    rnd = random.Random(3)
    data = [(p, int(rnd.random() < p)) for p in (rnd.random() for _ in range(4000))]
    df = spark.createDataFrame([(1 / (1 + math.exp(-(2 * math.log(max(p, 1e-6) / max(1 - p, 1e-6)) + 1))), o) for p, o in data], "p double, label int")
    slope, intercept = M.platt(df, "p", "label")
    assert abs(slope - 0.5) < 0.08 and abs(intercept + 0.5) < 0.15
    before, after = (W.brier(df.withColumn("o", F.col("label") == 1).withColumn("q", c), F.col("q"), F.col("o")).first().brier for c in (F.col("p"), M.calibrated(F.col("p"), slope, intercept)))
    assert after < before
    cut = M.equivalent_cutoff(0.3, slope, intercept)
    assert abs(cut - spark.range(1).select(M.calibrated(F.lit(0.3), slope, intercept).alias("q")).first().q) < 1e-12
    assert df.where((F.col("p") >= 0.3) != (M.calibrated(F.col("p"), slope, intercept) >= cut)).count() == 0


def test_log_normal_scores_against_quadrature(spark):
    cases = [(0.0, 0.3, 0.5, 0.4), (2.0, 0.8, 0.5, 0.4), (0.1, 0.5, -1.0, 1.0), (9.0, 0.2, 1.5, 0.7)]
    got = M.amount_scores(spark.createDataFrame(cases, "y double, pi double, m double, s double"), "y", 0.1).collect()
    for (y, pi, m, s), r in zip(cases, got, strict=True):
        phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        cdf = lambda x, pi=pi, m=m, s=s: 1 - pi * (1 - phi((math.log(x) - m) / s)) if x > 0 else 1 - pi
        h, total, x = 0.002, 0.0, 0.001
        while x < 80:
            total += (cdf(x) - (x >= y)) ** 2 * h
            x += h
        assert abs(r.crps - total) < 5e-3
        cell = cdf(y + 0.05) - cdf(max(y - 0.05, 0.05)) if y else cdf(0.05)
        assert abs(r.nll_lattice + math.log(max(cell, 1e-9))) < 1e-3
        assert abs(r.hi - cdf(y + 0.05)) < 1e-6 and abs(r.lo - (cdf(max(y - 0.05, 0.05)) if y else 0)) < 1e-6
        density = pi * math.exp(-(((math.log(y) - m) / s) ** 2) / 2) / (y * s * math.sqrt(2 * math.pi)) if y else 1 - pi
        assert abs(r.nll_density + math.log(density)) < 1e-9


SF = f"{DATA}/sf0.01"


@pytest.mark.parametrize("name", ["ml_logistic", "ml_tree", "ml_mlp", "ml_ziln_fit", "ml_refit_variance", "ml_platt", "ml_persist"])
def test_scores_of_queries(spark, name):
    """The given readings are noise, so no model can do much better than climatology, and none may do much worse."""
    for r in plans.QUERIES[name](spark, SF).collect():
        assert r.n > 100 and 0 <= r.brier <= 0.36 and (r["state"] if "state" in r else "") in ("", "before", "after")
    if name == "ml_persist":
        assert plans.QUERIES[name](spark, SF).first().brier == plans.QUERIES["ml_ziln_fit"](spark, SF).first().brier


def test_tables_of_queries(spark):
    table = plans.QUERIES["ml_error_tables"](spark, SF)
    assert table.count() == 2 * (M.CLASSES + 1) * len(M.PROBS)
    chosen = plans.QUERIES["ml_select"](spark, SF).collect()
    assert len(chosen) == 6 and [r.nll for r in chosen if r.chosen] == [min(r.nll for r in chosen)]
    kinds = plans.QUERIES["ml_amount_models"](spark, SF).groupBy("kind").count().collect()
    assert sorted(r.kind for r in kinds) == sorted(M.KINDS) and len({r["count"] for r in kinds}) == 1
    scores = plans.QUERIES["ver_ziln_scores"](spark, SF)
    assert scores.count() == 6 * plans.QUERIES["ml_ziln_score"](spark, SF).count() > 600
    assert scores.where("crps < 0 or lo > hi or lo < 0 or hi > 1 or nll_lattice < 0").count() == 0


def test_requests_with_gaps(spark):
    asked = plans.QUERIES["ml_predict_batch"](spark, SF).cache()
    assert asked.where("missing").count() > 0 and asked.where("not missing").count() > 0
    assert asked.where("missing and (p is not null or p_hazard is not null or not incomplete)").count() == 0
    assert asked.where("not missing and not (p between 0 and 1 and p_hazard between 0 and 1)").count() == 0
    assert asked.groupBy("station_id", "t").count().where("count <> 3").count() == 0
    asked.unpersist()


def test_gradient_of_the_net():
    rnd = np.random.default_rng(3)
    sizes = [2, 3, 4, 3]
    x, at, label = rnd.normal(size=(30, 2)), rnd.integers(0, 5, 30), rnd.integers(0, 3, 30)
    flat, own = rnd.normal(size=2 * 3 + 3 + 3 * 4 + 4 + 4 * 3 + 3), rnd.normal(size=(5, 3))
    _, g, h = nets.gradient(x, at, label, flat, own, sizes)
    for v, d in ((flat, g), (own, h)):
        for i in np.ndindex(v.shape):
            e = np.zeros(v.shape)
            e[i] = 1e-6
            one, two = (nets.gradient(x, at, label, flat + k * e if v is flat else flat, own + k * e if v is own else own, sizes)[0] for k in (1, -1))
            assert abs((one - two) / 2e-6 - d[i]) < 1e-5


def test_net_over_very_many_stations(spark):
    """200,000 stations: as one-hot vectors, made dense, the rows would be 640 GB."""
    n = 200_000
    rows = spark.range(2 * n, numPartitions=8).select(F.concat(F.lit("S"), (F.col("id") % n).cast("string")).alias("station_id"), ((F.col("id") * 7919 % 1000) / 1000).alias("a"))
    rows = rows.withColumn("label", (F.col("a") > 0.3).cast("int"))
    model = M.perceptron(rows, ["a"], M.SMALL)
    got = model.transform(rows.unionByName(spark.createDataFrame([("new", 0.9, 1), (None, 0.9, 1)], "station_id string, a double, label int"))).select(M.positive().alias("p"), (F.col("label") == 1).alias("o"))
    assert skill(got).skill > 0.5 and skill(got).n == 2 * n + 2


def test_rows_of_the_net_stay_small(spark, monkeypatch):
    """Readers hold 4,096 rows at a time, so no table of a fit may have rows that stand for thousands."""
    tables, table = [], nets.scratch.table
    monkeypatch.setattr(nets.scratch, "table", lambda df, name: tables.append(table(df, name)) or tables[-1])
    rows = spark.range(20_000, numPartitions=1).select(F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("station_id"), ((F.col("id") * 7919 % 1000) / 1000).alias("a"))
    M.perceptron(rows.withColumn("label", (F.col("a") > 0.3).cast("int")), ["a"], M.replace(M.SMALL, net_rounds=1))
    for t in tables:
        assert t.agg(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] < 1000


def test_net_knows_stations(spark):
    """Only its name tells a station's label."""
    rows = spark.createDataFrame([(f"S{i % 6}", (i * 7919 % 1000) / 1000, i % 6 % 2) for i in range(600)], "station_id string, a double, label int")
    got = M.perceptron(rows, ["a"], M.SMALL).transform(rows).select("label", M.positive().alias("p")).collect()
    assert len(got) == 600 and all((r.p > 0.5) == (r.label == 1) for r in got)


def test_class_net_over_very_many_stations(spark):
    """Survival from a net whose one-hot vectors would be 200,000 numbers in each row."""
    rows = spark.range(200_000, numPartitions=8).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("station_id"), F.col("id").alias("slot"), ((F.col("id") * 7919 % 1000) / 1000).alias("a")).withColumn("target", 1 + 8 * F.col("a"))
    got = M.class_survival(M.fit_classes("net", rows, ["a"], EDGES, M.SMALL), rows.where("slot < 2000"), ["station_id", "slot"]).join(rows, ["station_id", "slot"])
    r = got.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.element_at("survival", 3) - (F.col("target") > 5).cast("double"))).alias("off")).first()
    assert r.n == 2000 and r.off < 0.3


def asked_fits(monkeypatch, spark, name, at):
    """The settings that a query asks for; small ones are fitted."""
    asked, fitted = [], getattr(M, at)

    def small(*given):
        asked.extend(g for g in given if isinstance(g, M.Settings))
        return fitted(*(M.SMALL if isinstance(g, M.Settings) else g for g in given))

    monkeypatch.setattr(M, at, small)
    assert plans.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
    return asked


def test_amount_models_are_fitted_in_full(spark, monkeypatch):
    """As many rounds, trees and layers as the reference's: 100 of depth 6, 60 of depth 12 and 200 rows, 300 of 64 and 64."""
    assert asked_fits(monkeypatch, spark, "ml_amount_models", "fit_classes") == 3 * [M.Settings(rounds=100, depth=6, forest=60, forest_depth=12, least_leaf=200, hidden=(64, 64), net_rounds=300)]


def test_occurrence_net_is_fitted_in_full(spark, monkeypatch):
    """Layers of 128 and 64, as the reference's, and no fewer rounds than its 120."""
    (asked,) = asked_fits(monkeypatch, spark, "ml_mlp", "perceptron")
    assert asked.hidden == (128, 64) and asked.net_rounds == 300


def test_direction_from_products():
    """The same as the two loops over the vectors themselves."""
    rnd = np.random.default_rng(6)
    curved = np.diag(rnd.uniform(0.5, 3, 40))
    for k in (0, 1, 4):
        s = [rnd.normal(size=40) for _ in range(k)]
        y, g = [curved @ v for v in s], rnd.normal(size=40)
        d, sums = -g, []
        for a, b in zip(s[::-1], y[::-1], strict=True):
            sums.append(a @ d / (a @ b))
            d = d - sums[-1] * b
        d = d * (s[-1] @ y[-1] / (y[-1] @ y[-1]) if k else 1 / np.linalg.norm(g))
        for a, b, c in zip(s, y, sums[::-1], strict=True):
            d = d + (c - b @ d / (a @ b)) * a
        kept = np.stack([*s, *y, g])
        assert np.allclose(nets.direction(kept @ kept.T) @ kept, d, atol=1e-10)


def test_net_of_many_parts(spark, monkeypatch):
    """Parts, stations of very many rows in several of them and passes written in between don't change the net, and nothing is left behind."""
    rows = spark.createDataFrame([(f"S{i % 40 if i % 3 else 0}", (i * 7919 % 1000) / 1000, int((i * 7919 % 1000) / 1000 + i % 40 / 80 > 0.7)) for i in range(2400)], "station_id string, a double, label int")
    fit = M.replace(M.SMALL, net_rounds=9)
    asked = lambda: [r.p for r in M.perceptron(rows, ["a"], fit).transform(rows).orderBy("station_id", "a").select(M.positive().alias("p")).collect()]
    whole, ended, close = asked(), [], nets.Descent.close
    for name, value in (("PART", 3000), ("PARTITION", 3000), ("MANY", 100), ("CUT", 3)):
        monkeypatch.setattr(nets, name, value)
    monkeypatch.setattr(nets.Descent, "close", lambda self: (ended.append((len(self.now[0]), self.parts.map(lambda p: len(p[0].stations)).collect())), close(self)))
    deleted, delete = [], nets.scratch.delete
    monkeypatch.setattr(nets.scratch, "delete", lambda spark, path: (deleted.append(path), delete(spark, path)))
    assert np.allclose(asked(), whole, atol=1e-6)
    ((shared, stations),) = ended
    assert len(stations) > 10 and sum(stations) == 39 and 0 in stations and max(stations) < 20  # S0 has 800 rows of its own and more
    assert shared == 1 * 8 + 8 + 8 * 2 + 2 + 8 and len(deleted) >= 3 and len(set(deleted)) == len(deleted)
