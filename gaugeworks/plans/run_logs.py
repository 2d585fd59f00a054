"""Queries on run records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import runlog as L
from . import views as V
from .registry import query

GROUP = ", ".join(L.GROUP)
MEDIANS = f"""select {GROUP}, count(*) as trials, count(distinct trial) as distinct_trials, count(*) filter (exit_code <> 0) as failed, quantile_cont(seconds, 0.5) filter (exit_code = 0) as median,
  min(seconds) filter (exit_code = 0) as low, max(seconds) filter (exit_code = 0) as high, coalesce(list_sort(list(distinct score) filter (exit_code = 0)), []) as scores from runs group by all"""
REFERENCE = "select position, depth, list_sort(list(distinct score)) as reference from runs where backend = 'serial' and exit_code = 0 group by all"


def _sql(body: str) -> str:
    return f"with {V.RUNS}\n{body}"


@query("agg_trial_medians", _sql(MEDIANS))
def agg_trial_medians(spark, sf):
    return L.trial_medians(V.runs(spark, sf))


@query("run_reference_scores", _sql(REFERENCE))
def run_reference_scores(spark, sf):
    return L.reference_scores(V.runs(spark, sf))


@query("run_trial_status", _sql(f"select {GROUP}, case when distinct_trials <> 3 then 'INCOMPLETE' when len(reference) = 1 and scores = reference then 'PASS' else 'CHECK' end as status, failed from ({MEDIANS}) left join ({REFERENCE}) using (position)"))
def run_trial_status(spark, sf):
    return L.trial_status(V.runs(spark, sf))


CELL = "select position, depth, cores, quantile_cont(seconds, 0.5) as median from runs where backend = 'mpi' and exit_code = 0 group by all"


@query("run_strong_scaling", _sql(f"select p.position, p.depth, p.cores, p.median, round(s.m / p.median, 6) as over_serial, round(o.m / p.median, 6) as over_one, round(o.m / p.median * o.c / p.cores, 6) as efficiency from ({CELL}) p join (select position, quantile_cont(seconds, 0.5) as m from runs where backend = 'serial' and exit_code = 0 group by 1) s using (position) join (select position, arg_min(median, cores) as m, min(cores) as c from ({CELL}) group by 1) o using (position)"))
def run_strong_scaling(spark, sf):
    return L.strong_scaling(V.runs(spark, sf))


@query("run_work_ratio", _sql("select position, round(avg(nodes) filter (split_depth = 1) / any_value(s), 6) as split_1, round(avg(nodes) filter (split_depth = 2) / any_value(s), 6) as split_2, round(avg(nodes) filter (split_depth = 3) / any_value(s), 6) as split_3 from runs join (select position, avg(nodes) as s from runs where backend = 'serial' group by 1) using (position) where backend = 'mpi' group by 1"))
def run_work_ratio(spark, sf):
    r = V.runs(spark, sf)
    s = r.where("backend = 'serial'").groupBy("position").agg(F.avg("nodes").alias("s"))
    p = r.where("backend = 'mpi'").groupBy("position").pivot("split_depth", [1, 2, 3]).agg(F.avg("nodes"))
    return p.join(s, "position").select("position", *(F.round(F.col(str(k)) / F.col("s"), 6).alias(f"split_{k}") for k in (1, 2, 3)))


@query("run_strategy_matrix", _sql("select position, arg_min(split_depth, {'m': m, 'd': split_depth}) as best, round(min(m), 4) as best_seconds, round(max(m) / min(m), 6) as spread from (select position, split_depth, quantile_cont(seconds, 0.5) as m from runs where backend = 'mpi' and exit_code = 0 group by 1, 2) group by 1"))
def run_strategy_matrix(spark, sf):
    m = L.cell_medians(V.runs(spark, sf).where("backend = 'mpi'"), "position", "split_depth")
    return m.groupBy("position").agg(F.min_by("split_depth", F.struct("median", "split_depth")).alias("best"), F.round(F.min("median"), 4).alias("best_seconds"), F.round(F.max("median") / F.min("median"), 6).alias("spread"))


@query("run_launch_scope", _sql("select position, cores, round(quantile_cont(launch_seconds, 0.5) / quantile_cont(seconds, 0.5), 6) as ratio from runs where exit_code = 0 group by 1, 2"))
def run_launch_scope(spark, sf):
    return V.runs(spark, sf).where("exit_code = 0").groupBy("position", "cores").agg(F.round(F.percentile("launch_seconds", F.lit(0.5)) / F.percentile("seconds", F.lit(0.5)), 6).alias("ratio"))


@query("run_constant_work", _sql("select position, split_depth, count(distinct nodes) as n_values from runs group by 1, 2 having count(distinct nodes) <> 1"))
def run_constant_work(spark, sf):
    """Groups whose work is not constant: the assertion's anomalies."""
    return V.runs(spark, sf).groupBy("position", "split_depth").agg(F.count_distinct("nodes").alias("n_values")).where("n_values <> 1")


@query("run_phase_shares", _sql("select position, round(sum(launch_seconds - seconds) / sum(launch_seconds), 6) as launch, round(sum(seconds) / sum(launch_seconds), 6) as search from runs group by 1"))
def run_phase_shares(spark, sf):
    return V.runs(spark, sf).groupBy("position").agg(F.round(F.sum(F.col("launch_seconds") - F.col("seconds")) / F.sum("launch_seconds"), 6).alias("launch"), F.round(F.sum("seconds") / F.sum("launch_seconds"), 6).alias("search"))


@query("run_pilot_depth", _sql("select job, max(cores) as last_ok from (select *, min(case when exit_code <> 0 or seconds >= 45 then cores end) over (partition by job) as stop from runs where backend = 'mpi') where stop is null or cores <= stop group by 1"))
def run_pilot_depth(spark, sf):
    """The last step of a pilot that stops at its first failed or long run."""
    w = Window.partitionBy("job")
    p = V.runs(spark, sf).where("backend = 'mpi'").withColumn("stop", F.min(F.when((F.col("exit_code") != 0) | (F.col("seconds") >= 45), F.col("cores"))).over(w))
    return p.where("stop is null or cores <= stop").groupBy("job").agg(F.max("cores").alias("last_ok"))


@query("src_kv_log", _sql("select job, sum(cores) as cores, count(*) as n from runs group by 1").replace("sum(cores)", "cast(sum(cores) as bigint)"))
def src_kv_log(spark, sf):
    """Run lines made of the records, parsed back from their text; the job stands in a header line only."""
    r = V.runs(spark, sf).select("job", "cores", "seconds")
    n = Window.partitionBy("job").orderBy("cores", "seconds")
    body = r.withColumn("k", F.row_number().over(n)).select("job", "k", F.concat(F.lit("backend=mpi cores="), F.col("cores").cast("string"), F.lit(" seconds="), F.col("seconds").cast("string")).alias("value"))
    head = r.select("job").distinct().select("job", F.lit(0).alias("k"), F.concat(F.lit("job="), F.col("job").cast("string")).alias("value"))
    lines = head.unionByName(body).select(F.struct("job", "k").alias("line_no"), "value")
    parsed = L.parse_lines(lines).select("line_no", F.col("fields")["job"].cast("long").alias("job"), F.col("fields")["cores"].cast("int").alias("cores"))
    w = Window.partitionBy("line_no.job").orderBy("line_no.k").rowsBetween(Window.unboundedPreceding, 0)
    return parsed.withColumn("job", F.last("job", ignorenulls=True).over(w)).where("cores is not null").groupBy("job").agg(F.sum("cores").alias("cores"), F.count(F.lit(1)).alias("n"))


@query("set_plan_prefix", """select position, cores, rep, cast(rn as integer) as step from (select *, row_number() over (order by (rep * 7919 + h * 104729) % 1009, position, cores, rep) as rn from (select l_returnflag as position, l_linenumber as cores, rep, ascii(l_returnflag) * 31 + l_linenumber as h from (select distinct l_returnflag, l_linenumber from lineitem), (values (0), (1), (2)) r(rep))) where rn <= 40""")
def set_plan_prefix(spark, sf):
    """A factorial plan in shuffled order, its first 40 steps; the factors are distinct values, a few rows."""
    cells = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("position"), F.col("l_linenumber").alias("cores")).distinct().withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    h = F.ascii("position") * 31 + F.col("cores")
    order = Window.orderBy((F.col("rep") * 7919 + h * 104729) % 1009, "position", "cores", "rep")
    return cells.withColumn("step", F.row_number().over(order)).where("step <= 40")
