"""Queries on client histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources import scratch
from . import views as V
from .registry import query


def _sql(body: str, more: str = "") -> str:
    return f"with {V.HISTORY}{more}\n{body}"


# The rules as they are stated, by pairs: what was compared (n), what broke the guarantee (m).
RYW = """,
ryw0 as (
  select r.history_id, r.idx, r.version, arg_max({'v': w.version, 'i': w.idx}, {'v': w.version, 'n': -w.idx}) as w
  from history r join history w on w.history_id = r.history_id and w.client = r.client and w.key = r.key and w.idx < r.idx
  where r.op = 'read' and w.op = 'write' and r.status = 'ok' and w.status = 'ok' group by all),
ryw as (select history_id, min({'idx': idx, 'other': w.i}) filter (version < w.v) as m, count(*) > 0 as complete from ryw0 group by 1)"""
MR = """,
mr0 as (
  select r.history_id, r.idx, r.version, arg_max({'v': p.version, 'i': p.idx}, p.idx) as p
  from history r join history p on p.history_id = r.history_id and p.client = r.client and p.key = r.key and p.idx < r.idx
  where r.op = 'read' and p.op = 'read' and r.status = 'ok' and p.status = 'ok' group by all),
mr as (select history_id, min({'idx': idx, 'other': p.i}) filter (version < p.v) as m, count(*) > 0 as complete from mr0 group by 1)"""
VERDICT = """select h.history_id, case when v.m is not null then 'VIOLATION' when h.failed or not coalesce(v.complete, false) then 'INCONCLUSIVE' else 'PASS' end as status, {witness} as witness{more}
from (select history_id, bool_or(status <> 'ok' and op in ('write', 'read', 'dependency_probe', 'partition', 'stop')) as failed from {of}{where} group by 1) h left join {name} v using (history_id)"""


def _verdict(name: str, witness: str = "case when v.m is not null then [v.m.other, v.m.idx] end", more: str = "", where: str = "", of: str = "history") -> str:
    return VERDICT.format(name=name, witness=witness, more=more, where=where, of=of)


@query("chk_read_your_writes", _sql(_verdict("ryw"), RYW))
def chk_read_your_writes(spark, sf):
    h = V.history(spark, sf)
    return A.verdict(h, A.read_your_writes(h))


@query("chk_monotonic_reads", _sql(_verdict("mr"), MR))
def chk_monotonic_reads(spark, sf):
    h = V.history(spark, sf)
    return A.verdict(h, A.monotonic_reads(h))


@query("win_running_max_prior", _sql("select history_id, idx, max(case when status = 'ok' and op = 'write' then version end) over (partition by history_id, client, key order by idx rows between unbounded preceding and 1 preceding) as prior from history"))
def win_running_max_prior(spark, sf):
    w = Window.partitionBy("history_id", "client", "key").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return V.history(spark, sf).select("history_id", "idx", F.max(F.when(A.ok() & (F.col("op") == "write"), F.col("version"))).over(w).alias("prior"))


@query("win_prev_read", _sql("select history_id, idx, lag(idx) over (partition by history_id, client, key order by idx) as previous from history where status = 'ok' and op = 'read'"))
def win_prev_read(spark, sf):
    reads = V.history(spark, sf).where(A.ok() & (F.col("op") == "read"))
    return reads.select("history_id", "idx", F.lag("idx").over(Window.partitionBy("history_id", "client", "key").orderBy("idx")).alias("previous"))


def _cause(op: str, name: str) -> str:
    return f""",
{name}0 as (select *, last_value(case when status = 'ok' and op = '{op}' then {{'idx': idx, 'key': key, 'version': version}} end ignore nulls) over (partition by history_id, client order by idx rows between unbounded preceding and 1 preceding) as c from history),
{name} as (select history_id, client, k, idx as effect_idx, key as effect_key, version as effect_version, write_id as effect_write_id, c.idx as cause_idx, c.key as cause_key, c.version as cause_version from {name}0 where status = 'ok' and op = 'write' and c is not null)"""


PROBES = """,
probes as (select history_id, effect_key, effect_version, effect_write_id, cause_key as seen_key, cause_version - case when k % 7 = 0 then 1 else 0 end as seen_version,
  (select max(idx) from history h where h.history_id = {name}.history_id) + 1 as probe_idx from {name} where k % 3 = 0),
bad as (select e.history_id, min({{'p': probe_idx, 'e': effect_idx, 'c': cause_idx}}) as m from {name} e join probes p using (history_id, effect_key, effect_version, effect_write_id)
  where probe_idx > effect_idx and cause_key = seen_key and seen_version < cause_version group by 1)"""


def _probes(h, effects):
    """After the end of its history, a local probe for every dependent write; some show the cause one version too old."""
    last = h.groupBy("history_id").agg((F.max("idx") + 1).cast("int").alias("probe_idx"))
    p = effects.where("k % 3 = 0").join(last, "history_id")
    return p.select("history_id", "effect_key", "effect_version", "effect_write_id", F.col("cause_key").alias("seen_key"), (F.col("cause_version") - F.when(F.col("k") % 7 == 0, 1).otherwise(0)).alias("seen_version"), "probe_idx", F.lit("N1").alias("node"), F.lit(True).alias("local_observation"), F.lit(1).alias("control_id"))


@query("jn_last_cause", _sql("select history_id, effect_idx, cause_idx, cause_key, cause_version from c", _cause("write", "c")))
def jn_last_cause(spark, sf):
    return A.last_cause(V.history(spark, sf), "write").select("history_id", "effect_idx", "cause_idx", "cause_key", "cause_version")


@query("jn_probe_candidate", _sql("select e.history_id, probe_idx, effect_idx, cause_idx from c e join probes p using (history_id, effect_key, effect_version, effect_write_id) where probe_idx > effect_idx", _cause("write", "c") + PROBES.format(name="c")))
def jn_probe_candidate(spark, sf):
    h = V.history(spark, sf)
    e = A.last_cause(h, "write")
    return e.join(_probes(h, e), ["history_id", "effect_key", "effect_version", "effect_write_id"]).where("probe_idx > effect_idx").select("history_id", "probe_idx", "effect_idx", "cause_idx")


def _obs(cause_op: str, evidence: str, body: str, more: str) -> str:
    return f"with {V.observations_sql(cause_op, evidence)}{more}\n{body}"


PROBED = """,
shown as (
  select c.history_id, c.e_idx, p.idx as p_idx, c.cause.idx as c_idx, p.cause_version < c.cause.version as old, p.cause_write_id is not distinct from c.cause.write_id as same
  from cand c join obs p on p.history_id = c.history_id and p.op = 'dependency_probe' and p.status = 'ok' and p.node is not null and p.local_observation and p.control_id is not null
   and p.idx > c.e_idx and p.key = c.e_key and p.version = c.e_version and p.write_id = c.e_write and p.cause_key = c.cause.key and p.cause_version is not null),
bare as (select history_id, count(*) as n from cand c where not exists (select 1 from shown s where s.history_id = c.history_id and s.e_idx = c.e_idx and s.same and not s.old) group by 1),
res as (
  select history_id, (select min({'p': p_idx, 'e': e_idx, 'c': c_idx}) from shown s where s.history_id = x.history_id and s.old) as m, bare.n is null as complete
  from (select distinct history_id from cand) x left join bare using (history_id))"""
PROBE_WITNESS = "case when v.m is not null then [v.m.c, v.m.e, v.m.p] end"
ORDERED = """,
ws as (select history_id, write_id, arg_max({'client': client, 'seq': seq, 'idx': idx}, idx) as w from obs where op = 'write' and status = 'ok' and seq is not null group by all),
au as (select history_id, idx as audit, unnest(ord) as write_id, generate_subscripts(ord, 1) as pos from obs where op = 'audit_order' and status = 'ok' and evidence_source = 'synthetic_application_order'),
sh as (select au.*, w from au join ws using (history_id, write_id)),
wn as (select history_id, count(*) as n from ws group by 1),
good as (select history_id, audit from sh join wn using (history_id) group by history_id, audit, n having n >= 2 and count(distinct write_id) = n),
st as (select *, lag(w) over (partition by history_id, audit, w.client order by pos) as p from sh semi join good using (history_id, audit)),
res as (select history_id, min({'a': audit, 'o': pos, 'b': p.idx, 'c': w.idx}) filter (w.seq < p.seq) as m, true as complete from st group by 1)"""
OBSERVED = """,
rd as (select * from obs where op = 'read' and status = 'ok' and mock is not null),
late as (
  select c.history_id, c.e_idx, c.cause.idx as c_idx, s.idx as s_idx, l.idx as l_idx, l.version < c.cause.version as old
  from cand c join rd s on s.history_id = c.history_id and s.idx > c.e_idx and s.key = c.e_key and s.version = c.e_version
  join rd l on l.history_id = c.history_id and l.idx > s.idx and l.client = s.client and l.node = s.node and l.key = c.cause.key),
bare as (select history_id, count(*) as n from cand c where not exists (select 1 from late s where s.history_id = c.history_id and s.e_idx = c.e_idx) group by 1),
res as (
  select history_id, (select min({'e': e_idx, 's': s_idx, 'l': l_idx, 'c': c_idx}) from late s where s.history_id = x.history_id and s.old) as m, bare.n is null as complete
  from (select distinct history_id from cand) x left join bare using (history_id))"""


@query("chk_monotonic_writes_probe", _obs("write", "probe", _verdict("res", PROBE_WITNESS, of="obs"), PROBED))
def chk_monotonic_writes_probe(spark, sf):
    h = scratch.table(V.observations(spark, sf, "write", "probe"), "observations")
    return A.verdict(h, A.probes_of(h, A.dependencies(h, "write")))


@query("chk_writes_follow_reads_probe", _obs("read", "probe", _verdict("res", PROBE_WITNESS, of="obs"), PROBED))
def chk_writes_follow_reads_probe(spark, sf):
    h = scratch.table(V.observations(spark, sf, "read", "probe"), "observations")
    return A.verdict(h, A.probes_of(h, A.dependencies(h, "read")))


@query("chk_monotonic_writes_order", _obs("write", "order", _verdict("res", "case when v.m is not null then [v.m.b, v.m.c, v.m.a] end", of="obs"), ORDERED))
def chk_monotonic_writes_order(spark, sf):
    h = scratch.table(V.observations(spark, sf, "write", "order"), "observations")
    return A.verdict(h, A.monotonic_writes(h))


@query("chk_writes_follow_reads_observer", _obs("read", "mock", _verdict("res", "case when v.m is not null then [v.m.c, v.m.e, v.m.s, v.m.l] end", of="obs"), OBSERVED))
def chk_writes_follow_reads_observer(spark, sf):
    h = scratch.table(V.observations(spark, sf, "read", "mock"), "observations")
    return A.verdict(h, A.writes_follow_reads(h))


@query("chk_verdict", _sql("select status, count(*) as n from (" + _verdict("ryw") + ") group by 1", RYW))
def chk_verdict(spark, sf):
    return chk_read_your_writes(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


ODD = "cast(split_part(history_id, '-', 1) as bigint) % 2"


@query("chk_dispatch", _sql("select * from (" + _verdict("ryw", more=", 'read_your_writes' as property", where=f" where {ODD} = 0") + ") union all select * from (" + _verdict("mr", more=", 'monotonic_reads' as property", where=f" where {ODD} = 1") + ")", RYW + MR))
def chk_dispatch(spark, sf):
    h = V.history(spark, sf)
    user = F.split("history_id", "-")[0].cast("long")
    p = h.select("history_id").distinct().select("history_id", F.when(user % 2 == 0, "read_your_writes").otherwise("monotonic_reads").alias("property"))
    return A.dispatch(h, p)


USER = "cast(split_part(history_id, '-', 1) as bigint)"


@query("chk_replay_audit", _sql("select history_id, status, recorded from (select *, case when " + USER + " % 7 <> 2 then case when " + USER + " % 7 = 3 then 'PASS' else status end end as recorded, case when " + USER + " % 7 = 2 then null when " + USER + " % 11 <> 5 then witness end as w from (" + _verdict("ryw") + ")) where status is distinct from recorded or witness is distinct from w", RYW))
def chk_replay_audit(spark, sf):
    """Results recorded as JSON, read back and held against a check of the same histories.  The record is faulty by rule: some
    histories are missing, some pass that don't, some witnesses are lost."""
    h = V.history(spark, sf)
    path = scratch.folder(spark, "recorded")
    user = F.split("history_id", "-")[0].cast("long")
    faulty = A.verdict(h, A.read_your_writes(h)).where(user % 7 != 2)
    faulty.select("history_id", F.when(user % 7 == 3, "PASS").otherwise(F.col("status")).alias("status"), F.when(user % 11 != 5, F.col("witness")).alias("witness")).write.json(path)
    recorded = spark.read.schema("history_id string, status string, witness array<int>").json(path)
    return A.differing(A.verdict(h, A.read_your_writes(h)), recorded)


@query("agg_status_matrix", _sql("select week, count(*) filter (status = 'PASS') as pass, count(*) filter (status = 'VIOLATION') as violation, count(*) filter (status = 'INCONCLUSIVE') as inconclusive from (select split_part(history_id, '-', 2) as week, status from (" + _verdict("ryw") + ")) group by 1", RYW))
def agg_status_matrix(spark, sf):
    names = ["PASS", "VIOLATION", "INCONCLUSIVE"]
    p = chk_read_your_writes(spark, sf).withColumn("week", F.split("history_id", "-")[1]).groupBy("week").pivot("status", names).agg(F.count(F.lit(1)))
    return p.select("week", *(F.coalesce(n, F.lit(0)).alias(n.lower()) for n in names))


@query("agg_request_counts", _sql("select op, status, count(*) as n from history group by 1, 2"))
def agg_request_counts(spark, sf):
    return V.history(spark, sf).groupBy("op", "status").agg(F.count(F.lit(1)).alias("n"))


@query("jn_control_evidence", _sql("select e.history_id, e.effect_idx, x.event_type as control from c e left join (select history_id, idx, event_type from h0 where event_type = 'signup') x on x.history_id = e.history_id and x.idx = e.cause_idx", _cause("write", "c")))
def jn_control_evidence(spark, sf):
    e = V.table(spark, sf, "events").where("event_type = 'signup'").select(F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("control_id"), F.col("event_type").alias("control"))
    h = V.history(spark, sf)
    ids = h.select("history_id", F.col("idx").alias("cause_idx"), F.col("write_id").alias("control_id"))
    return A.last_cause(h, "write").join(ids, ["history_id", "cause_idx"]).join(e, "control_id", "left").select("history_id", "effect_idx", "control")


@query("jn_coordinator_match", _sql("select history_id, idx from history where status = 'ok' and k % 2 <> cast(substr(client, 2) as integer)"))
def jn_coordinator_match(spark, sf):
    nodes = V.history(spark, sf).select("client").distinct().withColumn("address", F.substring("client", 2, 1).cast("int"))  # a row per node
    return V.history(spark, sf).where(A.ok()).join(nodes, "client").where(F.col("k") % 2 != F.col("address")).select("history_id", "idx")
