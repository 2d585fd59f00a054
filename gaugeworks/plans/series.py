"""Queries on station series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import series as S
from . import views as V
from .registry import query

SLOT = V.SLOT_S
WITH = "with " + V.SLOTS


def _sql(body: str, views: str = V.SLOTS) -> str:
    return f"with {views}\n{body}"


VALID = "epoch is not null and length(station_id) > 0 and y is not null and y >= 0 and lat between -90 and 90 and lon between -180 and 180 and coalesce(unit = 'mm', false)"


@query("prj_parse_types", _sql("select event_id, epoch, update_epoch, station_id, round(lat, 6) as lat, round(lon, 6) as lon, y, unit from parsed", V.PARSED))
def prj_parse_types(spark, sf):
    return S.parse(V.raw_readings(spark, sf)).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query("flt_valid_split", _sql(f"select event_id, coalesce({VALID}, false) as valid from parsed", V.PARSED))
def flt_valid_split(spark, sf):
    p = S.parse(V.raw_readings(spark, sf))
    return p.where(S.is_valid()).select("event_id", F.lit(True).alias("valid")).unionByName(p.where(~S.is_valid()).select("event_id", F.lit(False).alias("valid")))


@query("agg_invalid_reasons", _sql("select count(*) filter (epoch is null) as no_time, count(*) filter (not length(station_id) > 0) as no_station, count(*) filter (y is null) as no_value, count(*) filter (not coalesce(y >= 0, false)) as negative, count(*) filter (not coalesce(lat between -90 and 90, false)) as latitude, count(*) filter (not coalesce(lon between -180 and 180, false)) as longitude, count(*) filter (not coalesce(unit = 'mm', false)) as unit from parsed", V.PARSED))
def agg_invalid_reasons(spark, sf):
    p = S.parse(V.raw_readings(spark, sf))
    return p.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(reason) for reason, c in S.clauses().items()))


@query("agg_quality_counts", _sql(f"""select count(*) as n_read, count(*) filter (not coalesce({VALID}, false)) as n_invalid,
  count(*) filter ({VALID}) - count(distinct case when {VALID} then station_id || ':' || cast(epoch as varchar) end) as n_duplicate,
  count(distinct case when {VALID} then station_id || ':' || cast(epoch as varchar) end) as n_retained,
  count(distinct case when {VALID} then station_id end) as n_stations, min(case when {VALID} then epoch end) as first_epoch, max(case when {VALID} then epoch end) as last_epoch,
  count(*) filter ({VALID} and epoch // 86400 <> update_epoch // 86400) as n_date_mismatch from parsed""", V.PARSED))
def agg_quality_counts(spark, sf):
    """All counts in one pass over the feed."""
    p = S.parse(V.raw_readings(spark, sf)).withColumn("ok", S.is_valid())
    ok = lambda c: F.when(F.col("ok"), c)
    keys = F.count_distinct(ok(F.concat_ws(":", "station_id", F.col("epoch").cast("string"))))
    days = F.floor(F.col("epoch") / 86400) != F.floor(F.col("update_epoch") / 86400)
    return p.agg(F.count(F.lit(1)).alias("n_read"), F.count_if(~F.col("ok")).alias("n_invalid"), (F.count_if("ok") - keys).alias("n_duplicate"), keys.alias("n_retained"), F.count_distinct(ok(F.col("station_id"))).alias("n_stations"), F.min(ok(F.col("epoch"))).alias("first_epoch"), F.max(ok(F.col("epoch"))).alias("last_epoch"), F.count_if(F.col("ok") & days).alias("n_date_mismatch"))


def _newest():
    return [F.col("epoch").desc_nulls_last(), F.col("update_epoch").desc_nulls_last(), F.col("event_id").desc()]


@query("win_dedup_latest", _sql("select station_id, slot, event_id, rn = 1 as kept from (select *, row_number() over (partition by station_id, slot order by epoch desc, update_epoch desc, event_id desc) as rn from slotted)"))
def win_dedup_latest(spark, sf):
    r = S.with_slot(V.readings(spark, sf), SLOT)
    return S.ranked_latest(r, ["station_id", "slot"], _newest()).select("station_id", "slot", "event_id", (F.col("rn") == 1).alias("kept"))


@query("win_slot_latest", _sql("select station_id, slot, y from (select *, row_number() over (partition by station_id, slot order by epoch desc nulls last, update_epoch desc nulls last, event_id desc nulls last) as rn from slotted) where rn = 1"))
def win_slot_latest(spark, sf):
    """The reading that win_dedup_latest keeps: of the latest the one updated last, then the largest event_id."""
    r = S.with_slot(V.readings(spark, sf), SLOT)
    return S.latest(r, ["station_id", "slot"], _newest()).select("station_id", "slot", "y")


@query("prj_slot", _sql("select event_id, slot from slotted"))
def prj_slot(spark, sf):
    return S.with_slot(V.readings(spark, sf), SLOT).select("event_id", "slot")


@query("prj_accum_day", _sql(f"select station_id, slot, (slot - {SLOT}) // 3600 as acc_hour, cast(date '1970-01-01' + cast((slot - {SLOT} + 28800) // 86400 as integer) as date) as acc_day from slots"))
def prj_accum_day(spark, sf):
    s = V.slots(spark, sf)
    return s.select("station_id", "slot", C.accumulation_hour(F.col("slot"), SLOT).alias("acc_hour"), C.day_of(F.col("slot") - SLOT, 28800).alias("acc_day"))


@query("prj_calendar", _sql("select station_id, slot, hour(t) as hour, dayofweek(t) + 1 as dow, month(t) as month, dayofyear(t) as doy, round(sin(hour(t) * 2 * pi() / 24), 6) + 0.0 as hour_sin, round(cos(hour(t) * 2 * pi() / 24), 6) + 0.0 as hour_cos, round(sin(month(t) * 2 * pi() / 12), 6) + 0.0 as month_sin from (select *, make_timestamp(slot * 1000000) as t from slots)"))
def prj_calendar(spark, sf):
    t = F.timestamp_seconds("slot")
    s = V.slots(spark, sf).select("station_id", "slot", F.hour(t).alias("hour"), F.dayofweek(t).alias("dow"), F.month(t).alias("month"), F.dayofyear(t).alias("doy"))
    (hs, hc), (ms, _) = C.cycle(F.col("hour"), 24), C.cycle(F.col("month"), 12)
    return s.withColumn("hour_sin", F.round(hs, 6) + 0.0).withColumn("hour_cos", F.round(hc, 6) + 0.0).withColumn("month_sin", F.round(ms, 6) + 0.0)


SEASON = "case when m in (12, 1, 2) then 'northeast' when m in (3, 4, 5) then 'first_between' when m in (6, 7, 8, 9) then 'southwest' else 'second_between' end"


@query("prj_season", f"select o_orderkey, {SEASON} as season from (select o_orderkey, month(o_orderdate) as m from orders)")
def prj_season(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", C.season(F.month("o_orderdate")).alias("season"))


@query("prj_bucket", _sql("select station_id, slot, len(list_filter([0.0, 5.0, 10.0, 25.0], lambda e: y > e)) as class from slots"))
def prj_bucket(spark, sf):
    return V.slots(spark, sf).select("station_id", "slot", C.bucket(F.col("y"), (0, 5, 10, 25)).cast("long").alias("class"))


TRAIL = "round(sum(y) over (partition by station_id order by slot range between {s} preceding and current row), 4) as last_{n}, count(y) over (partition by station_id order by slot range between {s} preceding and current row) as n_{n}"
SPANS = {"12h": 2 * SLOT, "day": 4 * SLOT, "3d": 12 * SLOT}
FORWARD = f"round(coalesce(sum(y) over (partition by station_id order by slot range between 1 following and {2 * SLOT} following), 0.0), 4) as target, count(y) over (partition by station_id order by slot range between 1 following and {2 * SLOT} following) as n_target"


@query("win_trailing_range", _sql("select station_id, slot, " + ", ".join(TRAIL.format(s=s, n=n) for n, s in SPANS.items()) + " from slots"))
def win_trailing_range(spark, sf):
    return S.trailing(V.slots(spark, sf), SPANS).drop("y")


@query("win_forward_target", _sql(f"select station_id, slot, {FORWARD} from slots"))
def win_forward_target(spark, sf):
    return S.forward(V.slots(spark, sf), 2 * SLOT).drop("y")


def _lag(k: int) -> str:
    return f"max(y) over (partition by station_id order by slot range between {k * SLOT} preceding and {k * SLOT} preceding) as lag_{k}"


def _over(f: str, k: int) -> str:
    return f"{f} over (partition by station_id order by slot range between {(k - 1) * SLOT} preceding and current row)"


@query("win_slot_frames", _sql("select station_id, slot, " + ", ".join([*(_lag(k) for k in (1, 2, 3)), *(f"round({_over('sum(y)', k)}, 4) as sum_{k}" for k in (2, 4, 12)), f"{_over('max(y)', 12)} as peak_12", f"{_over('count(y)', 12)} as count_12"]) + " from slots"))
def win_slot_frames(spark, sf):
    return S.slot_frames(V.slots(spark, sf), SLOT).drop("y")


ELIGIBLE = f"""e as (select station_id, slot, target from (select station_id, slot, {FORWARD}, {_over('count(y)', 5)} as n_history from slots) where n_history = 5 and n_target = 2)"""


def _eligible(spark, sf):
    s = S.forward(V.slots(spark, sf), 2 * SLOT).withColumn("n_history", F.count("y").over(S.frame("station_id", "slot", -4 * SLOT, 0)))
    return S.eligible(s, 5, 2)


@query("prj_eligible", _sql("select * from e", V.SLOTS + ", " + ELIGIBLE))
def prj_eligible(spark, sf):
    return _eligible(spark, sf).select("station_id", "slot", "target")


@query("prj_label", _sql("select station_id, slot, r, cast(target > r as integer) as label from e, (values (0.5::double), (10.0), (25.0)) t(r)", V.SLOTS + ", " + ELIGIBLE))
def prj_label(spark, sf):
    e = _eligible(spark, sf).select("station_id", "slot", "target", F.explode(F.array(*map(F.lit, (0.5, 10.0, 25.0)))).alias("r"))
    return e.select("station_id", "slot", "r", (F.col("target") > F.col("r")).cast("int").alias("label"))


@query("prj_class_weight", _sql("select station_id, slot, label, round(sum(n) over () / (count(*) over () * n), 6) as weight from l join (select label, count(*) as n from l group by label) c using (label)".replace("sum(n) over ()", "(select count(*) from l)").replace("count(*) over ()", "(select count(distinct label) from l)"), V.SLOTS + ", l as (select station_id, slot, cast(y > 10 as integer) as label from slots)"))
def prj_class_weight(spark, sf):
    l = V.slots(spark, sf).select("station_id", "slot", (F.col("y") > 10).cast("int").alias("label"))
    return S.class_weights(l, "label").withColumn("weight", F.round("weight", 6))


@query("prj_fill_defaults", _sql("select station_id, slot, coalesce(lag_1, 0.0) as lag_1, coalesce(lag_2, 0.0) as lag_2, coalesce(case when lag_3 > 0 then lag_3 end, 20.0) as nearest from (select station_id, slot, " + ", ".join(_lag(k) for k in (1, 2, 3)) + " from slots)"))
def prj_fill_defaults(spark, sf):
    s = S.slot_frames(V.slots(spark, sf), SLOT).select("station_id", "slot", "lag_1", "lag_2", F.when(F.col("lag_3") > 0, F.col("lag_3")).alias("nearest"))
    return s.fillna({"lag_1": 0.0, "lag_2": 0.0, "nearest": 20.0})


@query("prj_logit", _sql("select station_id, slot, round(ln(p / (1 - p)), 6) as z from (select *, least(greatest(pi, 1e-6), 1 - 1e-6) as p from forecast)", V.FORECAST))
def prj_logit(spark, sf):
    return V.forecast(spark, sf).select("station_id", "slot", F.round(C.logit(F.col("pi")), 6).alias("z"))


@query("prj_log_features", _sql("select station_id, slot, round(ln(1 + y / 0.2), 6) as log_y, round(ln(1 + sum_4 / 0.2), 6) as log_sum_4, cast(lag_1 is not null as integer) as has_lag_1 from (select station_id, slot, y, " + f"round({_over('sum(y)', 4)}, 4) as sum_4, " + _lag(1) + " from slots)"))
def prj_log_features(spark, sf):
    s = S.slot_frames(V.slots(spark, sf), SLOT)
    return s.select("station_id", "slot", F.round(C.log_scaled(F.col("y")), 6).alias("log_y"), F.round(C.log_scaled(F.col("sum_4")), 6).alias("log_sum_4"), F.col("lag_1").isNotNull().cast("int").alias("has_lag_1"))


@query("prj_hash_fold", _sql("select event_id, (event_id * 1103515245 + 12345) % 2147483648 // 65536 % 2 as fold from readings", V.READINGS))
def prj_hash_fold(spark, sf):
    return V.readings(spark, sf).select("event_id", F.pmod(F.shiftright(F.pmod(F.col("event_id") * 1103515245 + 12345, F.lit(2147483648)), 16), F.lit(2)).alias("fold"))


@query("prj_mlp_inputs", _sql("select station_id, slot, round(ln(y + sqrt(y * y + 1)), 6) as y_asinh, [case when i = cast(substr(station_id, 2) as integer) % 40 then 1.0::double else 0.0::double end for i in range(40)] as station from slots"))
def prj_mlp_inputs(spark, sf):
    """The station as 40 hashed indicators: a width that doesn't grow with the stations."""
    n = F.substring("station_id", 2, 9).cast("int") % 40
    return V.slots(spark, sf).select("station_id", "slot", F.round(F.asinh("y"), 6).alias("y_asinh"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.when(i == n, 1.0).otherwise(0.0)).alias("station"))


@query("prj_wet_state", _sql("select station_id, slot, case when y > 0 then 'wet' when n > 0 then 'others_wet' else 'all_dry' end as state from (select *, count(*) filter (y > 0) over (partition by slot) as n from slots)"))
def prj_wet_state(spark, sf):
    s = V.slots(spark, sf)
    wet = s.groupBy("slot").agg(F.count_if(F.col("y") > 0).alias("n"))
    return s.join(wet, "slot").select("station_id", "slot", F.when(F.col("y") > 0, "wet").when(F.col("n") > 0, "others_wet").otherwise("all_dry").alias("state"))


@query("smp_stratified", _sql("select event_id, y > 0 as positive, case when y > 0 then 1.0::double else 4.0::double end as weight from readings where y > 0 or (event_id * 1103515245 + 12345) % 2147483648 < 536870912", V.READINGS))
def smp_stratified(spark, sf):
    r = V.readings(spark, sf)
    return S.stratified(r, F.col("y") > 0, 0.25, F.col("event_id")).select("event_id", (F.col("y") > 0).alias("positive"), "weight")


@query("smp_uniform", _sql("select event_id from readings where (event_id * 1103515245 + 12345) % 2147483648 < 214748364", V.READINGS))
def smp_uniform(spark, sf):
    return S.stratified(V.readings(spark, sf), F.lit(False), 0.1, F.col("event_id")).select("event_id")


@query("win_gap", _sql("select station_id, slot, slot - lag(slot) over (partition by station_id order by slot) as gap from slots"))
def win_gap(spark, sf):
    return S.gaps(V.slots(spark, sf), "station_id", "slot").select("station_id", "slot", "gap")


@query("agg_gap_summary", _sql(f"select station_id, count(*) filter (gap > {SLOT}) as n_gaps, cast(coalesce(sum(gap // {SLOT} - 1) filter (gap > {SLOT}), 0) as bigint) as n_missing, max(gap) as longest from (select station_id, slot - lag(slot) over (partition by station_id order by slot) as gap from slots) group by station_id"))
def agg_gap_summary(spark, sf):
    return S.gap_summary(V.slots(spark, sf), "station_id", "slot", SLOT)


SPELLS = f"""sp0 as (select *, row_number() over (partition by station_id order by slot) as rn from slots),
sp1 as (select *, coalesce(cast(slot - lag(slot) over (partition by station_id order by slot) > {2 * SLOT} as integer), 1) as new from sp0 where y > 0),
sp2 as (select *, sum(new) over (partition by station_id order by slot rows between unbounded preceding and current row) as spell from sp1),
spells as (select station_id, cast(spell as bigint) as spell, min(slot) as begin, max(slot) as end, round(sum(y), 4) as depth, max(y) as peak, count(*) as n_wet, max(rn) - min(rn) + 1 as n_rows, max(slot) - min(slot) + {SLOT} as duration,
  (max(rn) - min(rn) + 1) * {SLOT} = max(slot) - min(slot) + {SLOT} as complete from sp2 group by station_id, spell)"""


def spells(spark, sf):
    return S.sessions(V.slots(spark, sf), 2 * SLOT, SLOT)


@query("win_sessionize", _sql("select * from spells", V.SLOTS + ", " + SPELLS))
def win_sessionize(spark, sf):
    return spells(spark, sf)


@query("win_carry_forward", """select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as header from events""")
def win_carry_forward(spark, sf):
    e = V.table(spark, sf, "events").withColumn("header", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return S.carry_forward(e, ["user_id"], ["ts", "event_id"], "header").select("event_id", "header")


@query("fn_string", "select event_id, trim('  ' || event_type || ' ') as trimmed, length(event_type) as n, event_type || ':' || cast(user_id as varchar) as joined, regexp_extract(props, '\"(\\w+)\":', 1) as name, regexp_extract(props, ': *(\\d+)', 1) as number from events")
def fn_string(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("trimmed"), F.length("event_type").cast("long").alias("n"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("joined"), F.regexp_extract("props", '"(\\w+)":', 1).alias("name"), F.regexp_extract("props", ": *(\\d+)", 1).alias("number"))


@query("fn_datetime", "select event_id, cast(floor(epoch(ts)) as bigint) as seconds, year(ts) as y, month(ts) as m, hour(ts + interval 8 hours) as local_hour, dayofyear(ts) as doy, day(last_day(ts)) as days_in_month from events")
def fn_datetime(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.unix_timestamp("ts").alias("seconds"), F.year("ts").alias("y"), F.month("ts").alias("m"), F.hour(F.col("ts") + F.expr("interval 8 hours")).alias("local_hour"), F.dayofyear("ts").alias("doy"), F.dayofmonth(F.last_day("ts")).alias("days_in_month"))


@query("fn_math", "select event_id, round(sqrt(value), 6) as root, round(ln(value + 1), 6) as log, round(exp(-value / 100), 6) as decay, round(sin(radians(value)), 6) + 0.0 as sine, round(ln(value + sqrt(value * value + 1)), 6) as asinh, greatest(value, 10.0) as high, least(value, 10.0) as low, case when event_id % 3 = 0 then null else round(value / (event_id % 3), 6) end as ratio from events")
def fn_math(spark, sf):
    v = F.col("value")
    return V.table(spark, sf, "events").select("event_id", F.round(F.sqrt(v), 6).alias("root"), F.round(F.ln(v + 1), 6).alias("log"), F.round(F.exp(-v / 100), 6).alias("decay"), (F.round(F.sin(F.radians(v)), 6) + 0.0).alias("sine"), F.round(F.asinh(v), 6).alias("asinh"), F.greatest(v, F.lit(10.0)).alias("high"), F.least(v, F.lit(10.0)).alias("low"), F.round(F.try_divide(v, F.col("event_id") % 3), 6).alias("ratio"))


@query("fn_array", _sql("select station_id, slot, round(s[1], 6) as first, round(list_sum(s), 6) as total, [round(x, 6) for x in s[2:4]] as part, round(list_max(s), 6) as top from forecast", V.FORECAST))
def fn_array(spark, sf):
    return V.forecast(spark, sf).select("station_id", "slot", F.round(F.element_at("s", 1), 6).alias("first"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.transform(F.slice("s", 2, 3), lambda x: F.round(x, 6)).alias("part"), F.round(F.array_max("s"), 6).alias("top"))


@query("fn_cumprod", _sql("select station_id, slot, [round(list_product(s[1:i]), 8) for i in range(1, 5)] as product from forecast", V.FORECAST))
def fn_cumprod(spark, sf):
    return V.forecast(spark, sf).select("station_id", "slot", F.transform(C.running_product(F.slice("s", 1, 4)), lambda x: F.round(x, 8)).alias("product"))


@query("fn_normal_cdf")
def fn_normal_cdf(spark, sf):
    """SQL here has no erf; tests hold it against math.erf."""
    return V.forecast(spark, sf).select("station_id", "slot", C.normal_cdf((F.col("m") - F.col("y")) / 10).alias("p"))


@query("src_date_bounded", "select event_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'")
def src_date_bounded(spark, sf):
    """The bounds are on the stored column, so they reach the Parquet scan."""
    return V.table(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-20'").select("event_id")
