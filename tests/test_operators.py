"""Operators on small literal inputs: nulls, ties, gaps, both ends, and histories against a plain reading of the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks import plans
from gaugeworks.functions import columns as C
from gaugeworks.operators import audit as A
from gaugeworks.operators import quality as R
from gaugeworks.operators import series as S
from gaugeworks.operators import spatial as P
from gaugeworks.sources import files


def test_null_clause_is_invalid(spark):
    rows = spark.createDataFrame([(1, 10, "a", 1.0, 2.0, 0.5, "mm"), (2, 10, "a", 1.0, 2.0, 0.5, None), (3, None, "a", 1.0, 2.0, 0.5, "mm"), (4, 10, "a", 1.0, 2.0, -0.5, "mm")], "event_id long, epoch long, station_id string, lat double, lon double, y double, unit string")
    assert [r.event_id for r in rows.where(S.is_valid()).collect()] == [1]
    assert sorted(r.event_id for r in rows.where(~S.is_valid()).collect()) == [2, 3, 4]


def test_slot_rounds_halves_up(spark):
    rows = spark.createDataFrame([(149,), (150,), (299,), (-150,)], "s long").select(C.slot(F.col("s"), 300).alias("x"))
    assert [r.x for r in rows.collect()] == [0, 300, 300, 0]


def test_forward_window_leaves_the_row_out(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 300, 2.0), ("a", 600, 4.0)], "station_id string, slot long, y double")
    got = {r.slot: (r.target, r.n_target) for r in S.forward(rows, 600).collect()}
    assert got == {0: (6.0, 2), 300: (4.0, 1), 600: (0.0, 0)}


def test_sessions_split_at_gaps_and_see_missing_rows(spark):
    rows = spark.createDataFrame([("a", t, y) for t, y in ((0, 1.0), (300, 0.0), (600, 2.0), (1800, 3.0), (2400, 1.0))], "station_id string, slot long, y double")
    got = sorted((r.begin, r.end, r.depth, r.complete) for r in S.sessions(rows, 900, 300).collect())
    assert got == [(0, 600, 3.0, True), (1800, 2400, 4.0, False)]


def test_as_of_takes_the_latest_in_reach(spark):
    rows = spark.createDataFrame([("a", 100, 1.0), ("a", 200, 2.0), ("b", 100, 9.0)], "station_id string, epoch long, y double")
    asked = spark.createDataFrame([("a", 150), ("a", 200), ("a", 501), ("a", 99), ("b", 400)], "station_id string, t long")
    got = {(r.station_id, r.t): r.y for r in P.as_of(asked, rows, 300, 100).collect()}
    assert got == {("a", 150): 1.0, ("a", 200): 2.0, ("a", 501): None, ("a", 99): None, ("b", 400): 9.0}


def test_nearest_needs_enough_stations(spark):
    rows = spark.createDataFrame([("a", 1.0, 103.0), ("b", 1.1, 103.0)], "station_id string, lat double, lon double")
    with pytest.raises(ValueError):
        P.nearest(rows, 2)
    assert {(r.station_id, r.nb) for r in P.nearest(rows, 1).collect()} == {("a", "b"), ("b", "a")}


def test_pairs_within_match_all_pairs(spark):
    rnd = random.Random(5)
    pts = [(f"s{i}", rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for i in range(40)] + [(f"t{i}", 50 + rnd.uniform(0, 0.3), 10 + rnd.uniform(0, 0.5)) for i in range(40)]
    df = spark.createDataFrame(pts, "station_id string, lat double, lon double")

    def km(a, b):
        q = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * C.EARTH_KM * math.asin(math.sqrt(q))

    want = {(a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and km(a, b) <= 12}
    assert want and {(r.station_id, r.nb) for r in P.within(df, 12).collect()} == want


def test_normal_cdf(spark):
    z = [-6.0, -1.5, -0.2, 0.0, 0.7, 3.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(C.normal_cdf(F.col("z")).alias("p")).collect()]
    assert all(abs(g - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 2e-7 for g, x in zip(got, z, strict=True))


def test_repeats_and_stuck_days(spark):
    d = spark.createDataFrame([("a", 1), ("a", 3), ("a", 40), ("b", 1)], "station_id string, day long")
    t = R.Thresholds(repeat_gap_days=5, repeat_least=2)
    assert [(r.station_id, r.first_day, r.last_day, r.n_days) for r in R.repeats(d, t).collect()] == [("a", 1, 3, 2)]


def test_unknown_property_is_an_error(spark):
    df = spark.createDataFrame([("h", 0, "a", "read", "ok", "x", 1)], "history_id string, idx int, client string, op string, status string, key string, version int")
    with pytest.raises(Exception, match="unknown property"):
        A.dispatch(df, spark.createDataFrame([("h", "nothing")], "history_id string, property string")).collect()


def test_sources_and_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n")
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv"), ["x", "y"]).collect()] == [("1", "2"), ("3", None)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "p").write_bytes(b"1")
    (tmp_path / "m" / "q").write_bytes(b"2")
    listed = spark.createDataFrame([("p", "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"), ("r", "00")], "name string, sha256 string")
    assert {r.name: r.state for r in files.manifest_check(spark, str(tmp_path / "m"), listed).collect()} == {"p": "ok", "q": "unlisted", "r": "missing"}
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert files.resume(spark, str(tmp_path / "stage"), make).count() == 3
    assert made == [1]


def test_scratch_tables_of_a_block_can_go(spark, tmp_path):
    import pathlib

    from gaugeworks.sources import scratch

    kept = scratch.table(spark.range(3), "kept")
    with scratch.recorded() as held:
        gone = scratch.table(spark.range(4), "gone")
        assert gone.count() == 4
    path = pathlib.Path(gone.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and len(held) == 1
    scratch.release(held)
    assert not path.exists() and kept.count() == 3


def test_import_without_training_data_operators():
    import ast
    import pathlib

    top = pathlib.Path(files.__file__).parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), p


def test_slot_latest_of_equal_times_is_the_one_updated_last(spark, tmp_path):
    """event_id % 3 seconds pass until an update: of events at one second 2 is updated after 3."""
    import duckdb
    from conftest import same

    at = "timestamp'2024-01-01 00:00:11'"
    spark.sql(f"select * from values (2l, {at}, 7l, 'purchase', 50.0d), (3l, {at}, 7l, 'purchase', 90.0d), (9l, {at} - interval 1 second, 7l, 'error', 10.0d) as t(event_id, ts, user_id, event_type, value)").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = plans.QUERIES["win_slot_latest"](spark, str(tmp_path))
    assert [r.y for r in got.collect()] == [5.0]
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    same(got, c.sql(plans.ORACLE_SQL["win_slot_latest"]))
