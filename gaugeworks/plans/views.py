"""Stand-ins over the given tables for the inputs of the operators: station readings, client histories, run records.

Each has its SQL beside it, as common table expressions, so that a query and its SQL start from one definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import columns as C
from ..sources import scratch

SLOT_S = 21600
#: Stations of a block of 0.28 by 0.45 degrees; more users fill more blocks, so neighbours per station stay as many.
BLOCK = 40
#: Blocks that stand one north of the other before the next column of blocks begins.
COLUMN = 200
#: Orders of a job of run records.
JOB_ORDERS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event a reading, every user a station."""
    e = table(spark, sf_dir, "events")
    n, block = F.col("user_id") % BLOCK, F.floor(F.col("user_id") / BLOCK)
    wet = F.col("event_type").isin("purchase", "signup", "error")
    return e.select(
        "event_id",
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station_id"),
        C.epoch("ts").alias("epoch"),
        (C.epoch("ts") + F.col("event_id") % 3).alias("update_epoch"),
        F.when(wet, F.floor("value") / 10.0).otherwise(0.0).alias("y"),
        (1.20 + (n * 7919 % 1000) * 0.00028 + block % COLUMN * 0.3).alias("lat"),
        (103.60 + (n * 10427 % 1000) * 0.00045 + F.floor(block / COLUMN) * 0.5).alias("lon"),
    )


READINGS = f"""
readings as (
  select event_id, 'S' || cast(user_id as varchar) as station_id, cast(floor(epoch(ts)) as bigint) as epoch,
         cast(floor(epoch(ts)) as bigint) + event_id % 3 as update_epoch,
         case when event_type in ('purchase', 'signup', 'error') then floor(value) / 10.0 else 0.0 end as y,
         1.20::double + (user_id % {BLOCK} * 7919 % 1000) * 0.00028::double + user_id // {BLOCK} % {COLUMN} * 0.3::double as lat,
         103.60::double + (user_id % {BLOCK} * 10427 % 1000) * 0.00045::double + user_id // {BLOCK} // {COLUMN} * 0.5::double as lon
  from events)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per station and slot: the latest, then the largest event_id."""
    r = readings(spark, sf_dir).withColumn("slot", C.slot(F.col("epoch"), SLOT_S))
    return r.groupBy("station_id", "slot").agg(F.max_by("y", F.struct("epoch", "event_id")).alias("y"))


def slots_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slots, written: for plans that use them more than once."""
    return scratch.table(slots(spark, sf_dir), "slots")


SLOTS = READINGS + f""",
slotted as (select *, (epoch + {SLOT_S // 2}) // {SLOT_S} * {SLOT_S} as slot from readings),
slots as (select station_id, slot, arg_max(y, {{'a': epoch, 'b': event_id}}) as y from slotted group by station_id, slot)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("station_id").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))


STATION_SQL = """,
stations as (select station_id, max(lat) as lat, max(lon) as lon from readings group by station_id)"""


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as an untyped feed: all strings, some rows damaged."""
    r = readings(spark, sf_dir)
    k = F.col("event_id") % 97
    stamp = lambda c: F.concat(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return r.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(k != 3, stamp(F.col("epoch"))).alias("timestamp"),
        stamp(F.col("update_epoch")).alias("update_timestamp"),
        F.concat(F.lit(" "), "station_id", F.lit(" ")).alias("station_id"),
        F.when(k == 2, "95.0").otherwise(F.col("lat").cast("string")).alias("location_latitude"),
        F.col("lon").cast("string").alias("location_longitude"),
        F.when(k == 1, "-1.0").when(k == 4, "x").otherwise(F.col("y").cast("string")).alias("reading_value"),
        F.when(k != 0, "mm").alias("reading_unit"),
    )


PARSED = READINGS + """,
parsed as (
  select event_id, case when event_id % 97 <> 3 then epoch end as epoch, update_epoch, station_id,
         case when event_id % 97 = 2 then 95.0 else lat end as lat, lon,
         case when event_id % 97 = 1 then -1.0 when event_id % 97 = 4 then null else y end as y,
         case when event_id % 97 <> 0 then 'mm' end as unit
  from readings)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client operations in recorded order; writes may depend on the client's last ok operation."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("history_id").orderBy("ts", "event_id")
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    h = e.select("ts", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string")).alias("history_id"))
    h = h.withColumn("idx", F.row_number().over(order) - 1).select(
        "history_id",
        F.col("idx").cast("int").alias("idx"),
        "k",
        F.concat(F.lit("C"), (F.col("event_id") % 2).cast("string")).alias("client"),
        F.concat(F.lit("k"), (F.col("k") % 3).cast("string")).alias("key"),
        F.when(F.col("event_type").isin("purchase", "signup"), "write").otherwise("read").alias("op"),
        F.when((F.col("event_type") == "error") & (F.col("k") % 10 == 1), "timeout").otherwise("ok").alias("status"),
        F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("write_id"),
    )
    stale = (F.col("op") == "read") & (F.col("k") % 10 == 0)
    return h.withColumn("version", F.when(stale, F.greatest(F.col("idx") - 6, F.lit(0))).otherwise(F.col("idx")))


HISTORY = """
h0 as (
  select history_id, cast(row_number() over (partition by history_id order by ts, event_id) - 1 as integer) as idx, k, event_id, event_type
  from (select *, cast(json_extract(props, '$.k') as integer) as k,
               cast(user_id as varchar) || '-' || cast((dayofmonth(ts) - 1) // 7 as varchar) as history_id from events)),
h1 as (
  select history_id, idx, k, 'C' || cast(event_id % 2 as varchar) as client, 'k' || cast(k % 3 as varchar) as key,
         case when event_type in ('purchase', 'signup') then 'write' else 'read' end as op,
         case when event_type = 'error' and k % 10 = 1 then 'timeout' else 'ok' end as status,
         'w' || cast(event_id as varchar) as write_id from h0),
history as (select *, case when op = 'read' and k % 10 = 0 then greatest(idx - 6, 0) else idx end as version from h1)"""


def observations(spark: SparkSession, sf_dir: str, cause_op: str, evidence: str) -> DataFrame:
    """history with what its guarantees are judged by.  Writes with k % 3 = 0 say that they depend on their client's last earlier
    ok operation of a kind (some by an id that no operation has).  evidence: `probe`, a local probe after the end for most dependent
    writes, some failed, remote, too old or of another cause; `order`, an order of application for each history, some of them
    without all writes or from another source; `mock`, synthetic observers that read most dependent writes and then their causes."""
    h = history(spark, sf_dir)
    before = Window.partitionBy("history_id", "client").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    is_ok, k = F.col("status") == "ok", F.col("k")
    cause = F.last(F.when(is_ok & (F.col("op") == cause_op), F.struct(F.col("key").alias("key"), F.col("version").alias("min_version"), F.col("write_id").alias("write_id"))), ignorenulls=True).over(before)
    named = F.struct(F.col("c.key").alias("key"), F.col("c.min_version").alias("min_version"), F.when(k % 13 == 6, "unseen").when(k % 2 == 0, F.col("c.write_id")).alias("write_id"))
    h = h.withColumn("c", cause).withColumn("depends_on", F.when((F.col("op") == "write") & is_ok & (k % 3 == 0) & F.col("c").isNotNull(), named))
    h = h.withColumn("node", F.concat(F.lit("N"), (k % 2).cast("string"))).withColumn("seq", F.col("idx").cast("long"))
    if evidence == "mock":
        d = h.where("depends_on is not null and k % 5 <> 4").withColumn("late", F.explode(F.array(F.lit(0), F.lit(1)))).where("late = 0 or k % 11 <> 5")
        late = F.col("late") == 1
        d = d.select(
            "history_id", (1000 + 2 * F.col("idx") + F.col("late")).alias("idx"), F.lit("read").alias("op"), F.when(k % 17 == 3, "timeout").otherwise("ok").alias("status"), F.concat(F.lit("O"), (F.col("idx") % 3).cast("string")).alias("client"),
            F.when(late & (k % 19 == 7), "N2").otherwise("N1").alias("node"), F.when(late, F.col("c.key")).otherwise(F.col("key")).alias("key"),
            F.when(late, F.col("c.min_version") - (k % 7 == 0).cast("int")).otherwise(F.col("version")).alias("version"), F.when(k % 23 != 5, True).alias("mock"))
        h = h.unionByName(d, allowMissingColumns=True)
    if evidence == "probe":
        p = h.where("depends_on is not null and k % 5 <> 4").select(
            "history_id", (F.col("idx") + 1000).alias("idx"), F.lit("dependency_probe").alias("op"), F.when(k % 17 == 3, "timeout").otherwise("ok").alias("status"), F.when(k % 19 != 7, "N1").alias("node"),
            "key", "version", "write_id", (k % 23 != 5).alias("local_observation"), F.lit("1").alias("control_id"), F.col("c.key").alias("cause_key"),
            (F.col("c.min_version") - (k % 7 == 0).cast("int")).alias("cause_version"), F.when(k % 11 == 5, "other").otherwise(F.col("c.write_id")).alias("cause_write_id"))
        h = h.unionByName(p, allowMissingColumns=True)
    if evidence == "order":
        user = F.split("history_id", "-")[0].cast("long")
        shown = F.struct((F.col("idx") - F.when(k % 10 == 3, 3).otherwise(0)).alias("at"), "idx", "write_id")
        lists = h.where(is_ok & (F.col("op") == "write")).where((user % 5 != 2) | (k % 9 != 4)).groupBy("history_id").agg(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["write_id"]).alias("order"))
        h = h.unionByName(lists.select("history_id", F.lit(100000).alias("idx"), F.lit("audit_order").alias("op"), F.lit("ok").alias("status"), "order", F.when(user % 7 == 4, "sorted_table").otherwise("synthetic_application_order").alias("evidence_source")), allowMissingColumns=True)
    return h.drop("c")


def observations_sql(cause_op: str, evidence: str) -> str:
    """Common table expressions up to obs."""
    more = {
        "probe": """
  union all by name
  select history_id, idx + 1000 as idx, 'dependency_probe' as op, case when k % 17 = 3 then 'timeout' else 'ok' end as status, case when k % 19 <> 7 then 'N1' end as node, key, version, write_id,
         k % 23 <> 5 as local_observation, '1' as control_id, c.key as cause_key, c.version - cast(k % 7 = 0 as integer) as cause_version, case when k % 11 = 5 then 'other' else c.write_id end as cause_write_id
  from o1 where dep and k % 5 <> 4""",
        "order": """
  union all by name
  select history_id, 100000 as idx, 'audit_order' as op, 'ok' as status, list(write_id order by idx - case when k % 10 = 3 then 3 else 0 end, idx) as ord,
         case when cast(split_part(history_id, '-', 1) as bigint) % 7 = 4 then 'sorted_table' else 'synthetic_application_order' end as evidence_source
  from o1 where status = 'ok' and op = 'write' and (cast(split_part(history_id, '-', 1) as bigint) % 5 <> 2 or k % 9 <> 4) group by history_id""",
        "mock": """
  union all by name
  select history_id, 1000 + 2 * idx + late as idx, 'read' as op, case when k % 17 = 3 then 'timeout' else 'ok' end as status, 'O' || cast(idx % 3 as varchar) as client,
         case when late = 1 and k % 19 = 7 then 'N2' else 'N1' end as node, case when late = 1 then c.key else key end as key,
         case when late = 1 then c.version - cast(k % 7 = 0 as integer) else version end as version, case when k % 23 <> 5 then true end as mock
  from o1, (values (0), (1)) t(late) where dep and k % 5 <> 4 and (late = 0 or k % 11 <> 5)""",
    }[evidence]
    return HISTORY + f""",
o0 as (select *, last_value(case when status = 'ok' and op = '{cause_op}' then {{'key': key, 'version': version, 'write_id': write_id}} end ignore nulls) over (partition by history_id, client order by idx rows between unbounded preceding and 1 preceding) as c from history),
o1 as (select *, op = 'write' and status = 'ok' and k % 3 = 0 and c is not null as dep from o0),
obs as (
  select history_id, idx, k, op, status, client, key, version, write_id, 'N' || cast(k % 2 as varchar) as node, idx as seq,
         null::boolean as mock,
         dep, case when dep then c.key end as dep_key, case when dep then c.version end as dep_version, case when dep and k % 13 = 6 then 'unseen' when dep and k % 2 = 0 then c.write_id end as dep_write,
         null::boolean as local_observation, null::varchar as control_id, null::varchar as cause_key, null::integer as cause_version, null::varchar as cause_write_id, null::varchar[] as ord, null::varchar as evidence_source
  from o1{more}),
cand as (
  select e.history_id, e.idx as e_idx, e.key as e_key, e.version as e_version, e.write_id as e_write, arg_max(p, p.idx) as cause
  from obs e join obs p on p.history_id = e.history_id and p.idx < e.idx and p.op = '{cause_op}' and p.status = 'ok' and p.client = e.client and p.key = e.dep_key and p.version = e.dep_version and (coalesce(e.dep_write, '') = '' or e.dep_write = p.write_id)
  where e.dep group by all)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem a benchmark run: the trials of each position, backend, split depth, core count and job."""
    li = table(spark, sf_dir, "lineitem")
    r = li.select(
        F.col("l_returnflag").alias("position"),
        F.lit(6).alias("depth"),
        F.when(F.col("l_linenumber") == 1, "serial").otherwise("mpi").alias("backend"),
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("split_depth"),
        (F.col("l_linenumber") * 4).cast("int").alias("cores"),
        F.floor(F.col("l_orderkey") / JOB_ORDERS).cast("long").alias("job"),
        F.col("l_quantity").cast("double").alias("seconds"),
        (F.col("l_quantity") + F.col("l_discount") * 10).cast("double").alias("launch_seconds"),
        (1000 * (F.col("l_linenumber") + 1)).cast("long").alias("nodes"),
        F.col("l_linestatus").alias("score"),
        F.when(F.col("l_tax") > 0.07, 124).otherwise(0).alias("exit_code"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    group = Window.partitionBy("position", "backend", "split_depth", "cores", "job").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return r.withColumn("trial", F.row_number().over(group)).drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


RUNS = f"""
runs as (
  select * exclude (rn), cast(rn as integer) as trial from (
    select l_returnflag as position, 6 as depth, case when l_linenumber = 1 then 'serial' else 'mpi' end as backend,
           cast(l_linenumber % 3 + 1 as integer) as split_depth, cast(l_linenumber * 4 as integer) as cores, cast(l_orderkey // {JOB_ORDERS} as bigint) as job,
           cast(l_quantity as double) as seconds, cast(l_quantity + l_discount * 10 as double) as launch_seconds,
           cast(1000 * (l_linenumber + 1) as bigint) as nodes, l_linestatus as score, case when l_tax > 0.07 then 124 else 0 end as exit_code,
           row_number() over (partition by l_returnflag, l_linenumber, l_orderkey // {JOB_ORDERS} order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn
    from lineitem))"""

GRID = (0.0, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 40.0, 50.0)


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, slot, y, m (mean of the four slots before), pi, s: a survival forecast on GRID."""
    before = Window.partitionBy("station_id").orderBy("slot").rangeBetween(-4 * SLOT_S, -1)
    f = slots(spark, sf_dir).withColumn("m", F.coalesce(F.round(F.avg("y").over(before), 4), F.lit(0.0)))
    f = f.withColumn("pi", F.round(1 / (1 + F.exp(-(F.col("m") / 10 - 1))), 4))
    return f.withColumn("s", F.transform(F.array(*(F.lit(g) for g in GRID)), lambda g: F.col("pi") * F.exp(-g / (1 + F.col("m")))))


FORECAST = SLOTS + f""",
f0 as (select *, coalesce(round(avg(y) over (partition by station_id order by slot range between {4 * SLOT_S} preceding and 1 preceding), 4), 0.0) as m from slots),
f1 as (select *, round(1 / (1 + exp(-(m / 10 - 1))), 4) as pi from f0),
forecast as (select *, [{", ".join(f"pi * exp(-{g} / (1 + m))" for g in GRID)}] as s from f1)"""
