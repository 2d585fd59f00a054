"""Queries on neighbours, and joins in space and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import series as S
from ..operators import pairs, sketches
from ..operators import spatial as P
from ..sources import scratch
from . import series as Q
from . import views as V
from .registry import query

SLOT = V.SLOT_S
K = 3
KM = 10.0
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"
PAIRS = V.STATION_SQL + f""",
pairs0 as (select a.station_id, b.station_id as nb, {HAVERSINE} as km0, (b.lon - a.lon) * {C.KM_PER_DEGREE} * cos(radians(a.lat)) as dx0, (b.lat - a.lat) * {C.KM_PER_DEGREE} as dy0
  from stations a join stations b on a.station_id <> b.station_id),
pairs as (select station_id, nb, cast(k as integer) as k, round(km0, 6) as km, 1 / greatest(km0, 0.05) as weight, round(dx0, 6) as dx, round(dy0, 6) as dy
  from (select *, row_number() over (partition by station_id order by km0, nb) as k from pairs0) where k <= {K})"""
LAGGED = PAIRS + f""",
lagged as (select s.station_id, s.slot, p.nb, p.k, p.km, p.weight, p.dx, p.dy, n.y as nb_y
  from slots s join pairs p using (station_id) left join slots n on n.station_id = p.nb and n.slot = s.slot - {SLOT})"""


def _sql(body: str, more: str = "") -> str:
    return f"with {V.SLOTS}{more}\n{body}"


def _pairs(spark, sf):
    return scratch.table(P.nearest(V.stations(spark, sf), K), "pairs")


#: Stations farther apart than this make no pair: pairs would grow with the square of the stations.
PAIR_KM = 20.0
PAIRED = f"join pairs0 p on p.station_id = a.station_id and p.nb = b.station_id and p.km0 <= {PAIR_KM}"


def _paired(spark, sf):
    return P.within(scratch.table(V.stations(spark, sf), "stations"), PAIR_KM).where("station_id < nb").select("station_id", "nb")


@query("fn_haversine", _sql("select a.station_id, b.station_id as nb, round(" + HAVERSINE + ", 6) as km from stations a join stations b on b.station_id = 'S0'", V.STATION_SQL))
def fn_haversine(spark, sf):
    s = V.stations(spark, sf)
    b = s.where("station_id = 'S0'")
    return s.select("station_id", F.lit("S0").alias("nb"), F.round(C.haversine_km(F.col("lat"), F.col("lon"), b.select("lat").scalar(), b.select("lon").scalar()), 6).alias("km"))


@query("fn_offset_km", _sql("select station_id, nb, dx, dy from pairs", PAIRS))
def fn_offset_km(spark, sf):
    return _pairs(spark, sf).select("station_id", "nb", "dx", "dy")


@query("jn_knn", _sql("select station_id, nb, k, km, round(weight, 6) as weight from pairs", PAIRS))
def jn_knn(spark, sf):
    return _pairs(spark, sf).select("station_id", "nb", "k", "km", F.round("weight", 6).alias("weight"))


@query("jn_radius_pairs", _sql(f"select station_id, nb, cast(row_number() over (partition by station_id order by km0, nb) as integer) as nb_rank, round(km0, 6) as km from pairs0 where km0 <= {KM}", PAIRS))
def jn_radius_pairs(spark, sf):
    return P.radius_pairs(V.stations(spark, sf), KM)


def _lagged(spark, sf):
    return P.lagged_neighbours(V.slots_once(spark, sf), _pairs(spark, sf), SLOT)


@query("jn_lagged_neighbour", _sql("select station_id, slot, k, nb, nb_y from lagged", LAGGED))
def jn_lagged_neighbour(spark, sf):
    return _lagged(spark, sf).select("station_id", "slot", "k", "nb", "nb_y")


IDW = "select station_id, slot, count(nb_y) as n_available, round(coalesce(sum(weight) filter (nb_y is not null), 0.0), 6) as weight_sum, round(sum(weight * nb_y) / sum(weight) filter (nb_y is not null), 6) as idw_mean, max(nb_y) as nb_max, round(min(km) filter (nb_y > 0), 6) as nearest_wet, round(avg(cast(nb_y > 0 as double)), 6) as wet_share from lagged group by station_id, slot"


@query("agg_neighbour_idw", _sql(IDW, LAGGED))
def agg_neighbour_idw(spark, sf):
    return P.idw(_lagged(spark, sf))


@query("jn_own_keys", _sql(f"select e.station_id, e.slot, e.target, i.idw_mean, coalesce(i.n_available, 0) as n_available from e left join (select station_id, slot, round(sum(weight * nb_y) / sum(weight) filter (nb_y is not null), 6) as idw_mean, count(nb_y) as n_available from lagged group by all) i using (station_id, slot)", LAGGED + ", " + Q.ELIGIBLE))
def jn_own_keys(spark, sf):
    e = Q._eligible(spark, sf).select("station_id", "slot", "target")
    return e.join(P.idw(_lagged(spark, sf)), ["station_id", "slot"], "left").select("station_id", "slot", "target", "idw_mean", F.coalesce("n_available", F.lit(0)).alias("n_available"))


@query("agg_pivot_k", _sql("select station_id, slot, " + ", ".join([*(f"max(nb_y) filter (k = {i}) as nb{i}_y" for i in range(1, K + 1)), *(f"cast(count(nb_y) filter (k = {i}) as integer) as nb{i}_avail" for i in range(1, K + 1))]) + " from lagged group by station_id, slot", LAGGED))
def agg_pivot_k(spark, sf):
    return P.neighbour_columns(_lagged(spark, sf), K)


@query("agg_storm_geometry", _sql(f"""select s.station_id, s.slot, round(n.x, 4) + 0.0 as x, round(n.y, 4) + 0.0 as y, round(n.spread, 4) + 0.0 as spread, round(n.x - o.x, 4) + 0.0 as move_x, round(n.y - o.y, 4) + 0.0 as move_y,
  round(sqrt(o.x * o.x + o.y * o.y) - sqrt(n.x * n.x + n.y * n.y), 4) + 0.0 as approach
from slots s left join c n on n.station_id = s.station_id and n.slot = s.slot and n.lag = 1 left join c o on o.station_id = s.station_id and o.slot = s.slot and o.lag = 2""", LAGGED + f""",
c0 as (select s.station_id, s.slot, lag, sum(n.y) as rain, sum(n.y * dx) / sum(n.y) as x, sum(n.y * dy) / sum(n.y) as y, sum(n.y * (dx * dx + dy * dy)) / sum(n.y) as q
  from slots s join pairs p using (station_id), (values (1), (2)) l(lag) join slots n on n.station_id = p.nb and n.slot = s.slot - lag * {SLOT} group by all having sum(n.y) > 0),
c as (select station_id, slot, lag, x, y, sqrt(greatest(q - x * x - y * y, 0.0)) as spread from c0)"""))
def agg_storm_geometry(spark, sf):
    return P.storm_geometry(V.slots_once(spark, sf), _pairs(spark, sf), SLOT)


HOURS = f""", hours as (select station_id, (slot - {SLOT}) // 3600 as hour, count(*) as n, round(sum(y), 4) as total, count(*) filter (y > 0) as n_wet, max(y) as peak from slots group by 1, 2)"""


@query("jn_same_hour", _sql("select h.station_id, h.hour, p.nb, h.total, n.total as nb_total from hours h join pairs p using (station_id) join hours n on n.station_id = p.nb and n.hour = h.hour", PAIRS + HOURS))
def jn_same_hour(spark, sf):
    h = scratch.table(A.hourly(V.slots(spark, sf), SLOT), "hours")
    nb = h.select(F.col("station_id").alias("nb"), "hour", F.col("total").alias("nb_total"))
    return h.join(_pairs(spark, sf).select("station_id", "nb"), "station_id").join(nb, ["nb", "hour"]).select("station_id", "hour", "nb", "total", "nb_total")


@query("jn_adjacent", _sql(f"select s.station_id, s.slot, s.y, b.y as before, a.y as after from slots s left join slots b on b.station_id = s.station_id and b.slot = s.slot - {SLOT} left join slots a on a.station_id = s.station_id and a.slot = s.slot + {SLOT}"))
def jn_adjacent(spark, sf):
    return P.adjacent(V.slots_once(spark, sf), SLOT)


@query("jn_window_lookup", _sql(f"select s.station_id, s.slot, p.nb, count(*) as n, max(n.y) as nb_max from slots s join pairs p using (station_id) join slots n on n.station_id = p.nb and n.slot between s.slot - {2 * SLOT} and s.slot + {2 * SLOT} where s.y > 20 group by all", PAIRS))
def jn_window_lookup(spark, sf):
    s = V.slots_once(spark, sf)
    return P.around(s.where("y > 20"), _pairs(spark, sf), s, 2, SLOT).groupBy("station_id", "slot", "nb").agg(F.count(F.lit(1)).alias("n"), F.max("nb_y").alias("nb_max"))


SPANS = """, spans as (select station_id, day - 1 as first_day, day + 1 as last_day from (select station_id, slot // 86400 as day, max(y) as peak from slots group by 1, 2) where peak >= 25)"""


def _spans(d):
    return d.groupBy("station_id", "day").agg(F.max("y").alias("peak")).where("peak >= 25").select("station_id", (F.col("day") - 1).alias("first_day"), (F.col("day") + 1).alias("last_day"))


def _days(spark, sf):
    return V.slots(spark, sf).withColumn("day", F.floor(F.col("slot") / 86400))


IN_SPAN = "exists (select 1 from spans p where p.station_id = s.station_id and s.slot // 86400 between first_day and last_day)"


@query("jn_interval_semi", _sql(f"select station_id, slot from slots s where {IN_SPAN}", SPANS))
def jn_interval_semi(spark, sf):
    d = scratch.table(_days(spark, sf), "days")
    return P.masked(d, _spans(d), keep=True).select("station_id", "slot")


@query("jn_interval_anti", _sql(f"select station_id, slot from slots s where not {IN_SPAN}", SPANS))
def jn_interval_anti(spark, sf):
    d = scratch.table(_days(spark, sf), "days")
    return P.masked(d, _spans(d), keep=False).select("station_id", "slot")


@query("jn_slot_semi_anti", _sql("select station_id, slot, y >= 25 as flagged from slots"))
def jn_slot_semi_anti(spark, sf):
    s = V.slots_once(spark, sf)
    flagged = s.where("y >= 25").select("station_id", "slot")
    keys = ["station_id", "slot"]
    return s.join(flagged, keys, "left_semi").select(*keys, F.lit(True).alias("flagged")).unionByName(s.join(flagged, keys, "left_anti").select(*keys, F.lit(False).alias("flagged")))


@query("jn_interval_inner", _sql("select s.station_id, count(distinct s.slot // 86400) as n_days from slots s join spans p on p.station_id = s.station_id and s.slot // 86400 between first_day and last_day group by 1", SPANS))
def jn_interval_inner(spark, sf):
    every = scratch.table(_days(spark, sf), "days")
    d, p = every.select("station_id", "day").distinct(), _spans(every)
    return d.join(p, "station_id").where("day between first_day and last_day").groupBy("station_id").agg(F.count_distinct("day").alias("n_days"))


@query("jn_time_pairs", _sql("select a.station_id as a, b.station_id as b, count(*) as n, count(*) filter (a.y > 0 and b.y > 0) as both_wet from slots a join slots b on a.slot = b.slot and a.station_id < b.station_id " + PAIRED + " group by 1, 2", PAIRS))
def jn_time_pairs(spark, sf):
    s = V.slots_once(spark, sf)
    b = s.select("slot", F.col("station_id").alias("b"), F.col("y").alias("yb"))
    near = _paired(spark, sf).select(F.col("station_id").alias("a"), F.col("nb").alias("b"))
    return s.select("slot", F.col("station_id").alias("a"), F.col("y").alias("ya")).join(near, "a").join(b, ["slot", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("ya > 0 and yb > 0")).alias("both_wet"))


@query("jn_asof_tolerance", _sql("""select r.station_id, r.t, max(x.epoch) as epoch, arg_max(x.y, x.epoch) as y from (select distinct station_id, slot as t from slots) r
left join (select station_id, epoch, max(y) as y from readings group by 1, 2) x on x.station_id = r.station_id and x.epoch <= r.t and x.epoch >= r.t - 7200 group by 1, 2"""))
def jn_asof_tolerance(spark, sf):
    rows = V.readings(spark, sf).select("station_id", "epoch", "y")
    return P.as_of(V.slots(spark, sf).select("station_id", F.col("slot").alias("t")), rows, 7200, 3600)


@query("jn_forecast_pool", f"with {V.FORECAST} select station_id, slot, [round((s[i] + s[i] * s[i]) / 2, 10) for i in range(1, {len(V.GRID)} + 1)] as pooled from forecast")
def jn_forecast_pool(spark, sf):
    f = V.forecast(spark, sf).select("station_id", "slot", "s")
    other = f.select("station_id", "slot", F.transform("s", lambda x: x * x).alias("s2"))
    return f.join(other, ["station_id", "slot"]).select("station_id", "slot", F.zip_with("s", "s2", lambda a, b: F.round((a + b) / 2, 10)).alias("pooled"))


@query("jn_score_compare", f"with {V.FORECAST} select station_id, slot, round(pow(pi - o, 2) - pow(0.5 - o, 2), 6) + 0.0 as brier_gain from (select *, cast(y > 0 as double) as o from forecast)")
def jn_score_compare(spark, sf):
    f = V.forecast(spark, sf).withColumn("o", (F.col("y") > 0).cast("double"))
    a = f.select("station_id", "slot", F.pow(F.col("pi") - F.col("o"), F.lit(2)).alias("sa"))
    b = f.select("station_id", "slot", F.pow(0.5 - F.col("o"), F.lit(2)).alias("sb"))
    return a.join(b, ["station_id", "slot"]).select("station_id", "slot", (F.round(F.col("sa") - F.col("sb"), 6) + 0.0).alias("brier_gain"))


@query("agg_hourly", _sql("select * from hours", HOURS))
def agg_hourly(spark, sf):
    return A.hourly(V.slots(spark, sf), SLOT)


@query("agg_daily", _sql("select station_id, hour // 24 as day, cast(sum(n) as bigint) as n_slots, count(*) as n_hours, round(sum(total), 4) as total, cast(sum(n_wet) as bigint) as n_wet, max(peak) as peak, count(*) filter (total >= 1) as wet_hours from hours group by 1, 2", HOURS))
def agg_daily(spark, sf):
    return A.daily(A.hourly(V.slots(spark, sf), SLOT), 1.0)


STATION_MONTH = "select station_id, strftime(date '1970-01-01' + cast(hour // 24 as integer), '%Y-%m') as month, cast(sum(n) as bigint) as n_slots, round(sum(total), 4) as total, cast(sum(n_wet) as bigint) as n_wet, count(*) filter (total > 0) as wet_hours, max(peak) as peak from hours group by 1, 2"


@query("agg_station_month", _sql(STATION_MONTH, HOURS))
def agg_station_month(spark, sf):
    return A.station_month(A.hourly(V.slots(spark, sf), SLOT))


@query("agg_neighbour_day", _sql("""select station_id, day, count(*) as n_nb, max(total) as nb_max, round(quantile_cont(total, 0.5), 4) as nb_median, string_agg(nb || ':' || cast(cast(round(total * 10) as bigint) as varchar), ' ' order by k) as evidence
from (select p.station_id, n.day, p.nb, p.k, n.total from days o join pairs p using (station_id) join days n on n.station_id = p.nb and n.day = o.day) group by 1, 2""", PAIRS + ", days as (select station_id, slot // 86400 as day, round(sum(y), 4) as total from slots group by 1, 2)"))
def agg_neighbour_day(spark, sf):
    d = scratch.table(_days(spark, sf).groupBy("station_id", "day").agg(F.round(F.sum("y"), 4).alias("total")), "days")
    nb = d.select(F.col("station_id").alias("nb"), "day", F.col("total").alias("nb_total"))
    j = d.select("station_id", "day").join(_pairs(spark, sf).select("station_id", "nb", "k"), "station_id").join(nb, ["nb", "day"])
    text = F.concat_ws(":", "nb", F.round(F.col("nb_total") * 10).cast("long").cast("string"))
    g = j.groupBy("station_id", "day").agg(F.count(F.lit(1)).alias("n_nb"), F.max("nb_total").alias("nb_max"), F.round(F.percentile("nb_total", F.lit(0.5)), 4).alias("nb_median"), F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("e"))
    return g.select("station_id", "day", "n_nb", "nb_max", "nb_median", F.concat_ws(" ", F.transform("e", lambda x: x["t"])).alias("evidence"))


@query("agg_station_dim", _sql("select station_id, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, round(coalesce(stddev(lat), 0), 6) + 0.0 as lat_sd, min(epoch) as first_epoch, max(epoch) as last_epoch from readings group by 1"))
def agg_station_dim(spark, sf):
    return V.readings(spark, sf).groupBy("station_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), (F.round(F.coalesce(F.stddev("lat"), F.lit(0.0)), 6) + 0.0).alias("lat_sd"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))


@query("agg_mode_coords", "with m as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, min(event_type) as event_type from (select *, rank() over (partition by user_id order by n desc) as r from m) where r = 1 group by 1")
def agg_mode_coords(spark, sf):
    """The most frequent value; the smallest of equals."""
    return V.table(spark, sf, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("event_type"))


ALL_PAIRS = """select a, b, day_half, n, case when va > 1e-6 and vb > 1e-6 then cov / sqrt(va * vb) end as r from (
select a.station_id as a, b.station_id as b, a.slot // 43200 % 2 as day_half, count(*) as n, count(*) * sum(a.y * b.y) - sum(a.y) * sum(b.y) as cov, count(*) * sum(a.y * a.y) - sum(a.y) * sum(a.y) as va, count(*) * sum(b.y * b.y) - sum(b.y) * sum(b.y) as vb
from slots a join slots b on a.slot = b.slot and a.station_id < b.station_id group by 1, 2, 3)"""


def day_halves(spark, sf):
    return V.slots(spark, sf).withColumn("half", F.floor(F.col("slot") / 43200) % 2)


@query("agg_pair_corr", f"with {V.SLOTS} select a, b, day_half, n, round(r, 4) + 0.0 as r from ({ALL_PAIRS})")
def agg_pair_corr(spark, sf):
    """Of all pairs of stations, by halves of the day."""
    return pairs.correlations(day_halves(spark, sf).withColumnRenamed("half", "day_half"), "day_half", SLOT, digits=4)


@query("agg_events_by_class", _sql("select strftime(make_timestamp(begin * 1000000), '%Y-%m') as month, case when duration <= 21600 then 1 when duration <= 43200 then 2 else 3 end as class, complete, count(*) as n, round(sum(depth), 4) as rain, cast(sum(duration) as bigint) as seconds, round(sum(peak), 4) as peaks from spells group by 1, 2, 3", ", " + Q.SPELLS))
def agg_events_by_class(spark, sf):
    e = S.sessions(V.slots(spark, sf), 2 * SLOT, SLOT)
    d = F.when(F.col("duration") <= 21600, 1).when(F.col("duration") <= 43200, 2).otherwise(3)
    return e.groupBy(F.date_format(F.timestamp_seconds("begin"), "yyyy-MM").alias("month"), d.alias("class"), "complete").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("depth"), 4).alias("rain"), F.sum("duration").alias("seconds"), F.round(F.sum("peak"), 4).alias("peaks"))


@query("agg_persistence", _sql("select slot // 3600 % 24 as hour, len(list_filter([0.0, 10.0, 25.0], lambda e: y > e)) as class, count(*) as n, count(*) filter (target > 1) as over_1, count(*) filter (target > 20) as over_20 from (select *, " + Q.FORWARD + " from slots) group by 1, 2"))
def agg_persistence(spark, sf):
    s = S.forward(V.slots(spark, sf), 2 * SLOT)
    return s.groupBy((F.floor(F.col("slot") / 3600) % 24).alias("hour"), C.bucket(F.col("y"), (0, 10, 25)).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("target > 1")).alias("over_1"), F.count_if(F.expr("target > 20")).alias("over_20"))


@query("agg_coverage", _sql("select station_id, count(*) as n, round(count(*) / (select count(distinct slot) from slots), 6) as share from slots group by 1"))
def agg_coverage(spark, sf):
    s = V.slots_once(spark, sf)
    expected = s.agg(F.count_distinct("slot").alias("expected"))
    return s.groupBy("station_id").agg(F.count(F.lit(1)).alias("n")).select("station_id", "n", F.round(F.col("n") / expected.scalar(), 6).alias("share"))


@query("agg_diurnal", _sql("select hour % 24 as hour_of_day, cast(sum(n) as bigint) as n_slots, cast(sum(n_wet) as bigint) as n_wet, round(sum(total), 4) as total, count(*) as n_hours, count(*) filter (total > 10) as heavy from hours group by 1", HOURS))
def agg_diurnal(spark, sf):
    h = A.hourly(V.slots(spark, sf), SLOT)
    return h.groupBy((F.col("hour") % 24).alias("hour_of_day")).agg(F.sum("n").alias("n_slots"), F.sum("n_wet").alias("n_wet"), F.round(F.sum("total"), 4).alias("total"), F.count(F.lit(1)).alias("n_hours"), F.count_if(F.expr("total > 10")).alias("heavy"))


@query("agg_extremes", _sql("select h.station_id, max(h.total) as hour_max, count(*) filter (h.total > 20) as over_20, count(*) filter (h.total > 40) as over_40, any_value(d.day_max) as day_max from hours h left join (select station_id, max(total) as day_max from (select station_id, hour // 24 as day, round(sum(total), 4) as total from hours group by 1, 2) group by 1) d using (station_id) group by 1", HOURS))
def agg_extremes(spark, sf):
    h = scratch.table(A.hourly(V.slots(spark, sf), SLOT), "hours")
    d = A.daily(h, 1.0).groupBy("station_id").agg(F.max("total").alias("day_max"))
    return h.groupBy("station_id").agg(F.max("total").alias("hour_max"), F.count_if(F.expr("total > 20")).alias("over_20"), F.count_if(F.expr("total > 40")).alias("over_40")).join(d, "station_id", "left")


@query("agg_value_counts", _sql("select y, count(*) as n from slots group by 1"))
def agg_value_counts(spark, sf):
    return A.value_counts(V.slots(spark, sf), "y")


#: Probabilities of a station's table.
THOUSANDTHS = [i / 1000 for i in range(1, 1000)]


@query("agg_quantiles", _sql("select station_id, list_transform(range(1, 1000), lambda i: ys[greatest(1, (i * len(ys) + 999) // 1000)]) as q from (select station_id, list(y order by y) as ys from slots group by 1)"))
def agg_quantiles(spark, sf):
    """999 quantiles of each station's values from its sketch, which is exact up to some thousand values."""
    return sketches.quantile_tables(V.slots(spark, sf), ["station_id"], "y", THOUSANDTHS).withColumnRenamed("y", "q")


@query("agg_stratified", _sql("select cast(slot // 3600 % 24 as bigint) as hour, y > 0 as wet, count(*) as n, round(sum(y), 4) as total from slots group by grouping sets ((1), (2), ())"))
def agg_stratified(spark, sf):
    s = V.slots(spark, sf).select((F.floor(F.col("slot") / 3600) % 24).alias("hour"), (F.col("y") > 0).alias("wet"), "y")
    return A.stratified(s, ["hour", "wet"], F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query("srt_summary", _sql(STATION_MONTH + " order by 1, 2", HOURS))
def srt_summary(spark, sf):
    return A.station_month(A.hourly(V.slots(spark, sf), SLOT)).orderBy("station_id", "month")


@query("lim_latest", "select event_id, user_id from events where user_id = 3 order by ts desc, event_id desc limit 1")
def lim_latest(spark, sf):
    return V.table(spark, sf, "events").where("user_id = 3").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id")


@query("set_union_by_name", "select event_id, event_type, null::double as value from events where event_type = 'click' union all select event_id, event_type, value from events where event_type <> 'click'")
def set_union_by_name(spark, sf):
    e = V.table(spark, sf, "events")
    return e.where("event_type = 'click'").select("event_id", "event_type").unionByName(e.where("event_type <> 'click'").select("value", "event_id", "event_type"), allowMissingColumns=True)
