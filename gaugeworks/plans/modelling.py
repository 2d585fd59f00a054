"""Queries that fit and score models, and sources written and read back."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import series as S
from ..operators import verification as W
from ..sources import files, scratch
from . import series as Q
from . import views as V
from .registry import query

SLOT = V.SLOT_S
NUMERIC = ["y", "sum_2", "sum_4", "sum_12", "peak_12", "count_12"]
R = 10.0
#: Small fits: a query reads the given tables at any size, and a full fit is a matter of hours there.
FIT = M.SMALL
#: Full fits, of the reference's sizes; its occurrence net is wider than its net of amounts.
FULL = M.Settings()
WIDE = M.replace(FULL, hidden=(128, 64))
#: Readings stand on tenths.
STEP = 0.1
#: Days of the given month: train, validation, test.
FIRST, SECOND = 1704067200 + 18 * 86400, 1704067200 + 24 * 86400
EDGES = (0.0, 5.0, 10.0, 20.0, 30.0)


def rows(spark, sf):
    s = S.slot_frames(S.forward(V.slots(spark, sf), 2 * SLOT), SLOT).where("n_target = 2").fillna(0.0, ["lag_1", "lag_2", "lag_3"])
    return s.withColumn("label", (F.col("target") > R).cast("int")).withColumn("fold", F.floor(F.col("slot") / 86400) % 2)


def _split(spark, sf):
    """Written once: fits pass over their rows again and again."""
    path = scratch.folder(spark, "model-rows")
    rows(spark, sf).write.parquet(path)
    return M.temporal_split(spark.read.parquet(path), "slot", FIRST, SECOND)


def _weighted(train):
    return S.class_weights(train, "label")


def _score(test, model):
    p = model.transform(test).select(M.positive().alias("p"), (F.col("label") == 1).alias("o"))
    return W.brier(p, F.col("p"), F.col("o"))


@query("ml_temporal_split", f"with {V.SLOTS} select case when slot < {FIRST} then 'train' when slot < {SECOND} then 'validation' else 'test' end as part, count(*) as n from (select slot, count(y) over (partition by station_id order by slot range between 1 following and {2 * SLOT} following) as n_target from slots) where n_target = 2 group by 1")
def ml_temporal_split(spark, sf):
    parts = M.temporal_split(rows(spark, sf), "slot", FIRST, SECOND)
    named = [p.select(F.lit(n).alias("part")) for n, p in zip(("train", "validation", "test"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("ml_logistic")
def ml_logistic(spark, sf):
    train, _, test = _split(spark, sf)
    return _score(test, M.logistic(_weighted(train), NUMERIC, FIT))


@query("ml_tree")
def ml_tree(spark, sf):
    train, _, test = _split(spark, sf)
    w = _weighted(train)
    return _score(test, M.trees(w, NUMERIC, "gbt", FIT)).withColumn("model", F.lit("gbt")).unionByName(_score(test, M.trees(w, NUMERIC, "forest", FIT)).withColumn("model", F.lit("forest")))


@query("ml_mlp")
def ml_mlp(spark, sf):
    train, _, test = _split(spark, sf)
    return _score(test, M.perceptron(train, NUMERIC, WIDE))


def _amounts(spark, sf):
    train, validation, test = _split(spark, sf)
    return M.fit_amounts(train, NUMERIC, F.col("fold"), FIT), train, validation, test


@query("ml_ziln_fit")
def ml_ziln_fit(spark, sf):
    model, _, _, test = _amounts(spark, sf)
    s = M.score_amounts(model, test).select(M.exceedance(F.lit(R)).alias("p"), (F.col("target") > R).alias("o"))
    return W.brier(s, F.col("p"), F.col("o"))


@query("ml_ziln_score")
def ml_ziln_score(spark, sf):
    model, _, _, test = _amounts(spark, sf)
    return M.score_amounts(model, test).select("station_id", "slot", "pi", "m", "s", M.exceedance(F.lit(R)).alias("p10"))


@query("ml_error_tables")
def ml_error_tables(spark, sf):
    """Quantiles of standardised cross-fitted residuals, of all (class -1) and by tenths of m, for both spreads."""
    model, _, _, _ = _amounts(spark, sf)
    rows_ = [(spread, k - 1, p, float(q)) for spread, tables in model.tables.items() for k, t in enumerate(tables) for p, q in zip(M.PROBS, t, strict=True)]
    return spark.createDataFrame(rows_, "spread string, class int, p double, q double")


@query("ml_select")
def ml_select(spark, sf):
    """The lattice scores of both spreads and three error forms on the validation days, and which was chosen."""
    model, _, validation, _ = _amounts(spark, sf)
    best, table = M.select_errors(model, validation, "target", STEP)
    return table.withColumn("chosen", (F.col("spread") == best.spread) & (F.col("errors") == best.errors))


@query("ml_refit_variance")
def ml_refit_variance(spark, sf):
    model, train, validation, test = _amounts(spark, sf)
    again = M.refit_variance(model, train.unionByName(validation), F.col("fold"), FIT)
    s = M.score_amounts(again, test).select(M.exceedance(F.lit(R)).alias("p"), (F.col("target") > R).alias("o"))
    return W.brier(s, F.col("p"), F.col("o"))


@query("ml_hazard_rows", f"with {V.SLOTS}, e as (select station_id, slot, len(list_filter([{', '.join(map(str, EDGES))}], lambda x: target > x)) as class from (select *, {Q.FORWARD} from slots) where n_target = 2 and target > 0) select station_id, slot, class, j, cast(j = class + 1 as integer) as stopped from (select *, unnest(range(1, least(class + 1, {len(EDGES)}) + 1)) as j from e)")
def ml_hazard_rows(spark, sf):
    h = M.hazard_rows(rows(spark, sf).where("target > 0"), EDGES)
    return h.select("station_id", "slot", F.col("class").cast("long"), F.col("j").cast("long"), "stopped")


@query("ml_amount_models")
def ml_amount_models(spark, sf):
    """Survival over the edges by each kind of model."""
    train, _, test = _split(spark, sf)
    parts = [M.class_survival(M.fit_classes(k, train, NUMERIC, EDGES, FULL), test, ["station_id", "slot"]).withColumn("kind", F.lit(k)) for k in M.KINDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: The cut-off before calibration.
CUTOFF = 0.3


@query("ml_platt")
def ml_platt(spark, sf):
    """Scores before and after calibration, and the cut-offs that call the same rows wet."""
    train, validation, test = _split(spark, sf)
    model = M.trees(_weighted(train), NUMERIC, "gbt", FIT)
    slope, intercept = M.platt(model.transform(validation).select(M.positive().alias("p"), "label"), "p", "label")
    t = model.transform(test).select(M.positive().alias("p"), (F.col("label") == 1).alias("o")).withColumn("q", M.calibrated(F.col("p"), slope, intercept))
    cuts = {"before": CUTOFF, "after": M.equivalent_cutoff(CUTOFF, slope, intercept)}
    parts = [W.brier(t, F.col(c), F.col("o")).join(t.agg(F.count_if(F.col(c) >= cuts[state]).alias("n_over"))).select("*", F.lit(state).alias("state"), F.lit(cuts[state]).alias("cutoff")) for c, state in (("p", "before"), ("q", "after"))]
    return parts[0].unionByName(parts[1])


@query("ml_predict_batch")
def ml_predict_batch(spark, sf):
    """Probabilities for a table of (station, time, threshold) requests, by the log-normal and by the hazard model.

    A request is answered by the station's latest row of the slot before it; without one it is `missing`.
    An answer of a row whose last 12 slots are not all there is marked incomplete."""
    from ..operators import spatial as P

    model, train, _, test = _amounts(spark, sf)
    hazard = M.fit_classes("hazard", train, NUMERIC, EDGES, FIT)
    # every station is asked ten minutes after each of its rows, and two slots later, where it may have none
    asked = test.select("station_id", F.explode(F.array(F.col("slot") + 600, F.col("slot") + 2 * SLOT + 600)).alias("t")).distinct()
    at = P.as_of(asked, test.select("station_id", F.col("slot").alias("epoch"), F.col("slot").cast("double").alias("y")), SLOT, SLOT)
    keys = ["station_id", "slot"]
    s = M.score_amounts(model, test).select(*keys, "pi", "m", "s", "count_12").join(M.class_survival(hazard, test, keys), keys).withColumnRenamed("slot", "epoch")
    j = at.join(s, ["station_id", "epoch"], "left").withColumn("r", F.explode(F.array(F.lit(5.0), F.lit(10.0), F.lit(20.0))))
    by_class = F.col("pi") * F.element_at("survival", F.array_position(F.array(*map(F.lit, EDGES)), F.col("r")).cast("int"))
    return j.select("station_id", "t", "r", M.exceedance(F.col("r")).alias("p"), by_class.alias("p_hazard"), F.col("pi").isNull().alias("missing"), F.coalesce(F.col("count_12") < 12, F.lit(True)).alias("incomplete"))


@query("ml_persist")
def ml_persist(spark, sf):
    """A model saved, loaded again and used; its metadata are checked on loading."""
    model, _, _, test = _amounts(spark, sf)
    path = scratch.folder(spark, "model")
    M.save_amounts(model, path, spark)
    s = M.score_amounts(M.load_amounts(path, spark, NUMERIC), test).select(M.exceedance(F.lit(R)).alias("p"), (F.col("target") > R).alias("o"))
    return W.brier(s, F.col("p"), F.col("o"))


@query("ver_ziln_scores")
def ver_ziln_scores(spark, sf):
    """Of every test row by both spreads and all three forms of errors."""
    model, _, _, test = _amounts(spark, sf)
    s = scratch.table(M.score_amounts(model, test).select("station_id", "slot", "target", "pi", "m", "s"), "amounts")
    each = [M.amount_scores(s, "target", STEP, model, a, b).select("station_id", "slot", F.lit(a).alias("spread"), F.lit(b).alias("errors"), "crps", "nll_density", "nll_lattice", "lo", "hi") for a, b in M.FORMS]
    return functools.reduce(lambda a, b: a.unionByName(b), each)


CSV = ["event_id", "timestamp", "update_timestamp", "station_id", "location_latitude", "location_longitude", "reading_value", "reading_unit"]


@query("src_csv_typed", Q._sql("select event_id, epoch, station_id, y, unit from parsed", V.PARSED))
def src_csv_typed(spark, sf):
    """The raw feed written as CSV and loaded again with its declared schema."""
    path = scratch.folder(spark, "csv")
    V.raw_readings(spark, sf).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.parse(files.csv(spark, path, CSV)).select("event_id", "epoch", "station_id", "y", "unit")


@query("src_parquet_years", "select event_id, event_type, case when event_id % 2 = 0 then value end as value from events")
def src_parquet_years(spark, sf):
    e = V.table(spark, sf, "events")
    a, b = scratch.folder(spark, "y1"), scratch.folder(spark, "y2")
    e.where("event_id % 2 = 0").select("event_id", "event_type", "value").write.parquet(a)
    e.where("event_id % 2 = 1").select("event_id", "event_type").write.parquet(b)
    return files.parquet_years(spark, [a, b]).select("event_id", "event_type", "value")


@query("src_jsonl", "select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k from events")
def src_jsonl(spark, sf):
    path = scratch.folder(spark, "jsonl")
    V.table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).write.json(path)
    return files.json_lines(spark, path).select("event_id", "event_type", "k")


@query("src_history_json", "with " + V.HISTORY + " select history_id as case_id, idx, op, client, key, cast(version as bigint) as version from history")
def src_history_json(spark, sf):
    """Histories nested into one JSON record each, and unnested again."""
    h = V.history(spark, sf)
    path = scratch.folder(spark, "cases")
    one = h.groupBy(F.col("history_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "op", "status", "client", "key", F.col("version").cast("long").alias("version"), "write_id"))), lambda e: F.struct(e["op"].alias("op"), e["status"].alias("status"), e["client"].alias("client"), e["key"].alias("key"), e["version"].alias("version"), e["write_id"].alias("write_id"))).alias("history"))
    one.withColumn("property", F.lit("read_your_writes")).write.json(path)
    return spark.read.schema(files.CASE).json(path).select("case_id", F.posexplode("history").alias("idx", "e")).select("case_id", "idx", "e.op", "e.client", "e.key", "e.version")


@query("src_trajectory_validate", "select cast(event_id % 5 <> 0 and event_id % 7 <> 0 as boolean) as good, count(*) as n from events group by 1")
def src_trajectory_validate(spark, sf):
    i = F.col("event_id")
    name = F.when(i % 5 != 0, F.concat(F.lit('"t'), i.cast("string"), F.lit('"'))).otherwise(F.lit("null"))
    op = F.when(i % 7 != 0, F.lit('"read"')).otherwise(F.lit("null"))
    texts = V.table(spark, sf, "events").select(F.concat(F.lit('{"name":'), name, F.lit(',"property":"p","steps":[{"op":'), op, F.lit(',"client":"a"}]}')).alias("value"))
    good, bad = files.validated_trajectories(texts)
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count(F.lit(1)).alias("n"))


@query("snk_partitioned_parquet", "select event_type, count(*) as n from events group by 1")
def snk_partitioned_parquet(spark, sf):
    path = scratch.folder(spark, "by-type")
    files.write_partitioned(V.table(spark, sf, "events"), path, "event_type")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("snk_csv", "select event_type, count(*) as n from events group by 1")
def snk_csv(spark, sf):
    path = scratch.folder(spark, "summary")
    files.write_csv(V.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type"), path)
    return files.csv(spark, path, ["event_type", "n"]).select("event_type", F.col("n").cast("long").alias("n"))


@query("snk_json_report", "select count(*) as n, min(value) as low, max(value) as high from events")
def snk_json_report(spark, sf):
    path = scratch.folder(spark, "report")
    files.write_report(V.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), path)
    return spark.read.schema("n long, low double, high double").json(path)


@query("snk_resume", "select event_type, count(*) as n from events group by 1")
def snk_resume(spark, sf):
    path = scratch.folder(spark, "stage")
    make = lambda: V.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    files.resume(spark, path, make)
    return files.resume(spark, path, make)


@query("src_manifest_check", "select event_type as name, case event_type when 'click' then 'changed' when 'view' then 'unlisted' else 'ok' end as state from (select distinct event_type from events) union all select 'withdrawn', 'missing'")
def src_manifest_check(spark, sf):
    """A folder for each event type against a manifest of it: one file changed after it was listed, one never listed, one listed and not there."""
    path, e = scratch.folder(spark, "files"), V.table(spark, sf, "events")
    files.write_partitioned(e, path, "event_type")
    listed = scratch.table(files.digests(spark, path).where("name <> 'event_type=view'"), "manifest")
    listed = listed.unionByName(spark.createDataFrame([("event_type=withdrawn", "0")], "name string, sha256 string"))
    files.write_partitioned(e.where("event_type = 'click'").withColumn("value", F.col("value") + 1), path + "-new", "event_type")
    now = files.digests(spark, path).where("name <> 'event_type=click'").unionByName(files.digests(spark, path + "-new"))
    return files.against(now, listed).select(F.element_at(F.split("name", "="), -1).alias("name"), "state")
