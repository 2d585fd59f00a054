"""Session-guarantee checks over many client histories.

A history is the rows of one history_id: idx (its order), op, status, client, key, version, and where an
operation has them the columns of EVIDENCE, which may be missing.  A check gives history_id, witness (the operations
that break the guarantee, or null) and complete: whether the history has what the check needs to find nothing wrong.
A guarantee passes only where its check was complete and no operation failed (`verdict`).  All checks are windows and
aggregates by history, or joins of a history with itself by keys inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that only some operations have: names of writes, what a write depends on, orders of application, marks of observers, probes.
EVIDENCE = {
    "write_id": "string",
    "node": "string",
    "seq": "long",
    "depends_on": "struct<key:string,min_version:int,write_id:string>",
    "order": "array<string>",
    "evidence_source": "string",
    "mock": "boolean",
    "local_observation": "boolean",
    "control_id": "string",
    "cause_key": "string",
    "cause_version": "int",
    "cause_write_id": "string",
}
#: Operations whose failure leaves a history without a verdict.
REQUIRED = ("write", "read", "dependency_probe", "partition", "stop")


def observed(history: DataFrame) -> DataFrame:
    """history with all columns of EVIDENCE, null where they are missing."""
    return history.select("*", *(F.lit(None).cast(t).alias(c) for c, t in EVIDENCE.items() if c not in history.columns))


def ok() -> Column:
    return F.col("status") == "ok"


def _given(c: str) -> Column:
    """Not null, empty or zero."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "false") == F.lit(False)


def _session(*keys: str):
    return Window.partitionBy("history_id", *keys).orderBy("idx")


def _known() -> Column:
    return ok() & F.col("client").isNotNull() & F.col("key").isNotNull() & F.col("version").isNotNull()


def _found(pairs: DataFrame, bad: Column, other: Column) -> DataFrame:
    """Of a history's compared pairs: the first bad one, and that there are any."""
    first = pairs.groupBy("history_id").agg(F.min(F.when(bad, F.struct("idx", other.alias("other")))).alias("m"))
    return first.select("history_id", F.when(F.col("m").isNotNull(), F.array("m.other", "m.idx")).alias("witness"), F.lit(True).alias("complete"))


def read_your_writes(history: DataFrame) -> DataFrame:
    """Of each history with an ok read after an ok write of the same client to the same key: the earliest read older than the
    largest version written before it.  Of equal versions the first write is the witness."""
    before = _session("client", "key").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.max(F.when(F.col("op") == "write", F.struct("version", (-F.col("idx")).alias("neg")))).over(before)
    pairs = history.where(_known()).withColumn("w", wrote).where((F.col("op") == "read") & F.col("w").isNotNull())
    return _found(pairs, F.col("version") < F.col("w.version"), -F.col("w.neg"))


def monotonic_reads(history: DataFrame) -> DataFrame:
    """Of each history with two ok reads of a client and key: the earliest read older than the one before it."""
    reads = history.where(_known() & (F.col("op") == "read"))
    pairs = reads.withColumn("p", F.lag(F.struct("version", "idx")).over(_session("client", "key"))).where(F.col("p").isNotNull())
    return _found(pairs, F.col("version") < F.col("p.version"), F.col("p.idx"))


def dependencies(history: DataFrame, cause_op: str) -> DataFrame:
    """Ok writes whose depends_on an earlier ok operation of the same client bears out, by key, version and, where it is named,
    write_id: history_id, effect_* and, of the last such operation, cause_*.

    Causes and effects meet in one window by what is asked for, so nothing is joined."""
    h = observed(history).where(ok())
    causes = h.where((F.col("op") == cause_op) & F.col("version").isNotNull()).select("history_id", "idx", "client", "key", "version", F.coalesce("write_id", F.lit("")).alias("id"), F.struct("idx", "write_id").alias("cause"))
    effect = F.struct("idx", "key", "version", "write_id").alias("effect")
    effects = h.where((F.col("op") == "write") & F.col("depends_on").isNotNull()).select("history_id", "idx", "client", F.col("depends_on.key").alias("key"), F.col("depends_on.min_version").alias("version"), F.coalesce("depends_on.write_id", F.lit("")).alias("id"), effect)
    both = causes.unionByName(effects, allowMissingColumns=True)
    last = lambda *by: F.last("cause", ignorenulls=True).over(_session("client", "key", "version", *by).rangeBetween(Window.unboundedPreceding, -1))
    met = both.withColumn("any", last()).withColumn("same", last("id")).where("effect is not null").withColumn("c", F.when(F.col("id") == "", F.col("any")).otherwise(F.col("same")))
    return met.where("c is not null").select("history_id", *(F.col(f"effect.{c}").alias(f"effect_{c}") for c in ("idx", "key", "version", "write_id")), F.col("c.idx").alias("cause_idx"), F.col("key").alias("cause_key"), F.col("version").alias("cause_version"), F.col("c.write_id").alias("cause_write_id"))


def probes_of(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate with what local probes show of it: the relational division of candidates by probes, and the witness.

    A probe counts if it was ok, on a named node, local and under control, came after the effect and shows it by its identity.
    It is a witness if it shows an older version of the cause, and covers the effect if it shows the cause's own identity."""
    h = observed(history).where(ok() & (F.col("op") == "dependency_probe") & _given("node") & _given("local_observation") & _given("control_id") & _given("write_id"))
    seen = h.select("history_id", F.col("idx").alias("probe_idx"), F.col("key").alias("p_key"), F.col("version").alias("p_version"), F.col("write_id").alias("effect_write_id"), F.col("cause_key").alias("p_cause"), F.col("cause_version").alias("shown"), F.col("cause_write_id").alias("shown_id"))
    same = F.col("p_key").eqNullSafe(F.col("effect_key")) & F.col("p_version").eqNullSafe(F.col("effect_version")) & F.col("p_cause").eqNullSafe(F.col("cause_key")) & (F.col("probe_idx") > F.col("effect_idx")) & F.col("shown").isNotNull()
    met = candidates.alias("c").join(seen.alias("p"), (F.col("c.history_id") == F.col("p.history_id")) & (F.col("c.effect_write_id") == F.col("p.effect_write_id")) & same, "left").drop(F.col("p.history_id"), F.col("p.effect_write_id"))
    old = F.col("shown") < F.col("cause_version")
    one = met.groupBy("history_id", "effect_idx").agg(F.min(F.when(old, F.struct("probe_idx", "effect_idx", "cause_idx"))).alias("m"), F.coalesce(F.bool_or(F.col("shown_id").eqNullSafe(F.col("cause_write_id")) & ~old), F.lit(False)).alias("covered"))
    every = one.groupBy("history_id").agg(F.min("m").alias("m"), F.bool_and("covered").alias("complete"))
    return every.select("history_id", F.when(F.col("m").isNotNull(), F.array("m.cause_idx", "m.effect_idx", "m.probe_idx")).alias("witness"), "complete")


def order_of(history: DataFrame) -> DataFrame:
    """Orders in which writes were applied, of synthetic histories only: where a client's sequence goes backwards.

    An order counts if the history has two writes or more and the order has all of them.  Ids it has besides are passed over."""
    h = observed(history).where(ok())
    writes = h.where((F.col("op") == "write") & _given("write_id") & F.col("seq").isNotNull()).groupBy("history_id", "write_id").agg(F.max_by(F.struct("client", "seq", "idx"), "idx").alias("w"))
    n = writes.groupBy("history_id").agg(F.count(F.lit(1)).alias("n"))
    audits = h.where((F.col("op") == "audit_order") & (F.col("evidence_source") == "synthetic_application_order")).select("history_id", F.col("idx").alias("audit"), F.posexplode("order").alias("position", "write_id"))
    shown = audits.join(writes, ["history_id", "write_id"])
    whole = shown.groupBy("history_id", "audit").agg(F.countDistinct("write_id").alias("shown")).join(n, "history_id").where("n >= 2 and shown = n").select("history_id", "audit")
    w = Window.partitionBy("history_id", "audit", "w.client").orderBy("position")
    steps = shown.join(whole, ["history_id", "audit"]).withColumn("p", F.lag("w").over(w))
    first = steps.groupBy("history_id").agg(F.min(F.when(F.col("w.seq") < F.col("p.seq"), F.struct("audit", "position", F.col("p.idx").alias("before"), F.col("w.idx").alias("after")))).alias("m"))
    return first.select("history_id", F.when(F.col("m").isNotNull(), F.array("m.before", "m.after", "m.audit")).alias("witness"), F.lit(True).alias("complete"))


def observers_of(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """Synthetic observers: one that reads an effect and later, as the same client on the same node, its cause.

    The first such observation that is too old is the witness.  An effect is covered if any observer read its cause later.
    What an observer reads later of a key is a running minimum from the end; only the first witness's observation
    meets single reads again."""
    reads = observed(history).where(ok() & (F.col("op") == "read") & F.col("mock").isNotNull())
    r = reads.select("history_id", "idx", "client", "node", "key", "version")
    seen = candidates.alias("c").join(r.alias("r"), (F.col("c.history_id") == F.col("r.history_id")) & F.col("r.key").eqNullSafe(F.col("effect_key")) & F.col("r.version").eqNullSafe(F.col("effect_version")) & (F.col("r.idx") > F.col("effect_idx")), "left")
    asked = seen.select("c.history_id", "r.idx", "r.client", "r.node", F.col("cause_key").alias("key"), "cause_version", "effect_idx", "cause_idx")
    later = Window.partitionBy("history_id", "client", "node", "key").orderBy("idx").rangeBetween(1, Window.unboundedFollowing)
    both = asked.unionByName(r, allowMissingColumns=True).withColumn("least", F.min("version").over(later)).where("effect_idx is not null")
    bad = F.col("idx").isNotNull() & (F.col("least") < F.col("cause_version"))
    one = both.groupBy("history_id", "effect_idx").agg(F.min(F.when(bad, F.struct("effect_idx", "idx", "cause_idx", "cause_version", "client", "node", "key"))).alias("m"), F.bool_or(F.col("idx").isNotNull() & F.col("least").isNotNull()).alias("covered"))
    every = one.groupBy("history_id").agg(F.min("m").alias("m"), F.bool_and("covered").alias("complete"))
    late = every.alias("e").join(r.alias("r"), (F.col("e.history_id") == F.col("r.history_id")) & F.col("r.client").eqNullSafe(F.col("m.client")) & F.col("r.node").eqNullSafe(F.col("m.node")) & (F.col("r.key") == F.col("m.key")) & (F.col("r.idx") > F.col("m.idx")) & (F.col("r.version") < F.col("m.cause_version")), "left")
    hit = late.groupBy("e.history_id").agg(F.first("m").alias("m"), F.first("complete").alias("complete"), F.min("r.idx").alias("late"))
    return hit.select("history_id", F.when(F.col("m").isNotNull(), F.array("m.cause_idx", "m.effect_idx", "m.idx", "late")).alias("witness"), "complete")


def _by_probes(history: DataFrame, probed: DataFrame, otherwise: DataFrame) -> DataFrame:
    """The check by probes for histories that have any probe, failed ones too, else the other one."""
    has = history.where(F.col("op") == "dependency_probe").select("history_id").distinct()
    return probed.join(has, "history_id", "left_semi").unionByName(otherwise.join(has, "history_id", "left_anti"))


def monotonic_writes(history: DataFrame) -> DataFrame:
    """A client's write is applied before its later ones: by local probes of dependent writes, else by synthetic orders."""
    return _by_probes(history, probes_of(history, dependencies(history, "write")), order_of(history))


def writes_follow_reads(history: DataFrame) -> DataFrame:
    """What a client had read is applied before what it wrote then: by local probes, else by synthetic observers."""
    candidates = dependencies(history, "read")
    return _by_probes(history, probes_of(history, candidates), observers_of(history, candidates))


def last_cause(history: DataFrame, cause_op: str) -> DataFrame:
    """Every ok write with the client's last earlier ok operation of a kind: history_id, client, effect_*, cause_*."""
    before = _session("client").rowsBetween(Window.unboundedPreceding, -1)
    cause = F.last(F.when(ok() & (F.col("op") == cause_op), F.struct("idx", "key", "version", "write_id")), ignorenulls=True).over(before)
    w = history.withColumn("c", cause).where(ok() & (F.col("op") == "write") & F.col("c").isNotNull())
    return w.select("history_id", "client", "k", F.col("idx").alias("effect_idx"), F.col("key").alias("effect_key"), F.col("version").alias("effect_version"), F.col("write_id").alias("effect_write_id"), F.col("c.idx").alias("cause_idx"), F.col("c.key").alias("cause_key"), F.col("c.version").alias("cause_version"))


def differing(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """history_id, status, recorded: where a recomputed result (history_id, status, witness) isn't the recorded one, or one of the two is missing."""
    r = recorded.select("history_id", F.col("status").alias("recorded"), F.col("witness").alias("w"))
    j = now.join(r, "history_id", "full")
    return j.where(~F.col("status").eqNullSafe(F.col("recorded")) | ~F.col("witness").eqNullSafe(F.col("w"))).select("history_id", "status", "recorded")


def verdict(history: DataFrame, found: DataFrame) -> DataFrame:
    """VIOLATION where there is a witness; INCONCLUSIVE where the check was not complete or a required operation failed; else PASS."""
    lost = F.col("op").isin(*REQUIRED) & ~F.coalesce(ok(), F.lit(False))
    every = history.groupBy("history_id").agg(F.bool_or(F.coalesce(lost, F.lit(False))).alias("failed")).join(found, "history_id", "left")
    short = F.col("failed") | ~F.coalesce("complete", F.lit(False))
    return every.select("history_id", F.when(F.col("witness").isNotNull(), "VIOLATION").when(short, "INCONCLUSIVE").otherwise("PASS").alias("status"), "witness")


CHECKS = {"read_your_writes": read_your_writes, "monotonic_reads": monotonic_reads, "monotonic_writes": monotonic_writes, "writes_follow_reads": writes_follow_reads}


def dispatch(history: DataFrame, properties: DataFrame) -> DataFrame:
    """Each history by the check its property names; an unknown property fails the query."""
    known = F.col("property").isin(*CHECKS)
    named = properties.withColumn("property", F.when(known, F.col("property")).otherwise(F.raise_error(F.concat(F.lit("unknown property "), F.coalesce("property", F.lit("null"))))))
    parts = None
    for name, check in CHECKS.items():
        own = history.join(named.where(F.col("property") == name).select("history_id"), "history_id", "left_semi")
        part = verdict(own, check(own)).withColumn("property", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts
