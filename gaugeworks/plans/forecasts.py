"""Queries on forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import verification as W
from . import series as Q
from . import views as V
from .registry import query

GRID = V.GRID
R = 10.0
# p(y > 10) is the grid value at 10
AT = GRID.index(R) + 1
SCORED = V.FORECAST + f", scored as (select *, round(s[{AT}], 6) as p, y > {R} as o, cast(slot // 3600 % 24 as bigint) as hour from forecast)"


def _sql(body: str, more: str = "") -> str:
    return f"with {SCORED}{more}\n{body}"


def scored(spark, sf):
    return V.forecast(spark, sf).withColumn("p", F.round(F.element_at("s", AT), 6)).withColumn("o", F.col("y") > R).withColumn("hour", F.floor(F.col("slot") / 3600) % 24)


CONFUSION = "count(*) filter ({p} and o) as tp, count(*) filter ({p} and not o) as fp, count(*) filter (not {p} and o) as fn, count(*) filter (not {p} and not o) as tn"
RATES = "tp, fp, fn, tn, round(case when tp + fp > 0 then tp / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) end, 6) as f1"


@query("ver_confusion", _sql(f"select {RATES} from (select {CONFUSION.format(p='(p >= 0.3)')} from scored)"))
def ver_confusion(spark, sf):
    return W.confusion(scored(spark, sf), F.col("p") >= 0.3, F.col("o"))


@query("ver_rule_baselines", f"with {V.SLOTS}, b as (select *, target > {R} as o, last_12h > {R} as persist, y > {R} as now from (select *, {Q.FORWARD}, {Q.TRAIL.format(s=2 * V.SLOT_S, n='12h')} from slots)) select 'never' as rule, {RATES} from (select {CONFUSION.format(p='false')} from b) union all select 'now', {RATES} from (select {CONFUSION.format(p='now')} from b) union all select 'persist', {RATES} from (select {CONFUSION.format(p='persist')} from b)")
def ver_rule_baselines(spark, sf):
    """Three rules in one pass: a row per rule and reading, reduced before the shuffle."""
    from ..operators import series as S

    b = S.trailing(S.forward(V.slots(spark, sf), 2 * V.SLOT_S), {"12h": 2 * V.SLOT_S})
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), c.alias("yes")) for n, c in (("never", F.lit(False)), ("now", F.col("y") > R), ("persist", F.col("last_12h") > R))))
    e = b.select((F.col("target") > R).alias("o"), F.explode(rules).alias("x")).select("o", "x.rule", "x.yes")
    return W.confusion(e, F.col("yes"), F.col("o"), "rule")


@query("ver_best_f1", _sql("select bin, f1 from (select bin, round(2 * tp / (tp + fp + total), 8) as f1 from (select bin, sum(pos) over (order by bin desc) as tp, sum(neg) over (order by bin desc) as fp, sum(pos) over () as total from (select cast(floor(p * 1000) as bigint) as bin, count(*) filter (o) as pos, count(*) filter (not o) as neg from scored group by 1))) order by f1 desc, bin desc limit 1"))
def ver_best_f1(spark, sf):
    return W.best_f1(scored(spark, sf), "p", F.col("o"))


BRIER = "count(*) as n, round(avg(pow(p - cast(o as double), 2)), 6) as brier, round(avg(cast(o as double)) * (1 - avg(cast(o as double))), 6) as brier_clim, round(1 - avg(pow(p - cast(o as double), 2)) / nullif(avg(cast(o as double)) * (1 - avg(cast(o as double))), 0), 6) as skill"


@query("ver_brier", _sql(f"select {BRIER} from scored"))
def ver_brier(spark, sf):
    return W.brier(scored(spark, sf), F.col("p"), F.col("o"))


@query("ver_stratified_skill", _sql(f"select hour, {BRIER}, round(count(*) / (select count(*) from scored), 6) as share from scored group by hour"))
def ver_stratified_skill(spark, sf):
    from pyspark.sql import Window

    b = W.brier(scored(spark, sf), F.col("p"), F.col("o"), "hour")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return b.withColumn("share", F.round(F.col("n") / F.sum("n").over(every), 6))


@query("ver_auc", _sql("select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) as pr_auc from (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp from (select p, count(*) filter (o) as pos, count(*) filter (not o) as neg from scored group by 1))"))
def ver_auc(spark, sf):
    return W.auc(scored(spark, sf), "p", F.col("o"))


@query("ver_reliability", _sql("select least(cast(floor(p * 20) as bigint), 19) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(cast(o as double)), 6) as rate from scored group by 1"))
def ver_reliability(spark, sf):
    return W.reliability(scored(spark, sf), "p", F.col("o"), 20)


G = "[" + ", ".join(f"{g}::double" for g in GRID) + "]"
N = len(GRID)


@query("ver_grid_scores", _sql(f"""select hour, round(avg(rps), 6) as rps, round(avg(crps), 6) as crps, round(avg(log_score), 6) as log_score from (
select hour, list_sum(q) as rps, list_sum([(q[i] + q[i + 1]) / 2 * ({G}[i + 1] - {G}[i]) for i in range(1, {N})]) as crps, -ln(greatest(case when k = 0 then 1.0 else s[k] end - case when k = {N} then 0.0 else s[k + 1] end, 1e-9)) as log_score
from (select *, [pow(s[i] - case when y > {G}[i] then 1.0 else 0.0 end, 2) for i in range(1, {N} + 1)] as q, len(list_filter({G}, lambda e: y > e)) as k from scored)) group by 1"""))
def ver_grid_scores(spark, sf):
    return W.grid_scores(scored(spark, sf), GRID).groupBy("hour").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("rps", "crps", "log_score")))


@query("ver_clim_crps", _sql("select round((select avg(abs(a.y - b.y)) from slots a, slots b where a.slot // 86400 % 2 = 0 and b.slot // 86400 % 2 = 1) - (select avg(abs(a.y - b.y)) / 2 from slots a, slots b where a.slot // 86400 % 2 = 0 and b.slot // 86400 % 2 = 0), 4) as crps"))
def ver_clim_crps(spark, sf):
    s = V.slots(spark, sf).withColumn("half", F.floor(F.col("slot") / 86400) % 2)
    return W.climatology_crps(s.where("half = 0"), s.where("half = 1"))


@query("ver_climatology_prob", f"with {V.SLOTS} select round(avg(cast(y > 0.5 as double)), 6) as over_0_5, round(avg(cast(y > 10 as double)), 6) as over_10, round(avg(cast(y > 25 as double)), 6) as over_25 from slots")
def ver_climatology_prob(spark, sf):
    return V.slots(spark, sf).agg(*(F.round(F.avg((F.col("y") > r).cast("double")), 6).alias(n) for r, n in ((0.5, "over_0_5"), (10, "over_10"), (25, "over_25"))))


@query("ver_pit", _sql(f"""select cast(least(floor((lo + (hi - lo) * u) * 10), 9) as bigint) as bin, count(*) as n from (select (slot // 21600 * 7919 + cast(substr(station_id, 2) as bigint) * 104729) % 1000 / 1000.0::double as u,
  case when k = {N} then 1.0 else 1 - s[least(k + 1, {N})] end as hi, case when k = 0 then 0.0 else 1 - s[greatest(k, 1)] end as lo from (select *, len(list_filter({G}, lambda e: y > e)) as k from scored)) group by 1"""))
def ver_pit(spark, sf):
    """Randomised PIT by an arithmetic draw on the keys."""
    n = F.substring("station_id", 2, 9).cast("long")
    u = ((F.floor(F.col("slot") / 21600) * 7919 + n * 104729) % 1000) / 1000.0
    g = F.array(*(F.lit(float(x)) for x in GRID))
    k = F.size(F.filter(g, lambda e: F.col("y") > e))
    hi = F.when(k == N, 1.0).otherwise(1 - F.element_at("s", F.least(k + 1, F.lit(N))))
    lo = F.when(k == 0, 0.0).otherwise(1 - F.element_at("s", F.greatest(k, F.lit(1))))
    pit = scored(spark, sf).select(F.least(F.floor((lo + (hi - lo) * u) * 10), F.lit(9)).cast("long").alias("bin"))
    return pit.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


BOOT = 200


@query("ver_block_bootstrap", _sql(f"""select round(avg(m), 6) as mean, round(quantile_cont(m, 0.05), 6) as low, round(quantile_cont(m, 0.95), 6) as high from (
select rep, sum(value) / sum(n) as m from range({BOOT}) r(rep), range((select count(*) from days)) x(d) join days on days.i = ((rep * 1000003 + d) * 1103515245 + 12345) % 2147483648 // 4096 % (select count(*) from days) group by rep)""", ", days as (select *, row_number() over (order by day) - 1 as i from (select slot // 86400 as day, sum(pow(p - cast(o as double), 2) - pow(0.3 - cast(o as double), 2)) as value, count(*) as n from scored group by 1))"))
def ver_block_bootstrap(spark, sf):
    o = F.col("o").cast("double")
    gain = F.pow(F.col("p") - o, F.lit(2)) - F.pow(0.3 - o, F.lit(2))
    daily = scored(spark, sf).groupBy(F.floor(F.col("slot") / 86400).alias("day")).agg(F.sum(gain).alias("value"), F.count(F.lit(1)).alias("n"))
    return W.block_bootstrap(daily, BOOT)


@query("ver_label_flips", f"with {V.SLOTS} select cast(year(make_timestamp(slot * 1000000)) as integer) as year, r, count(*) filter ((t > 10 * r) <> ((t + 5) // 10 > r)) as flips, count(*) as n from (select slot, cast(sum(cast(round(y * 10) as bigint)) over (partition by station_id order by slot range between {4 * V.SLOT_S} preceding and current row) as bigint) as t from slots), (values (1), (10), (50)) x(r) group by 1, 2")
def ver_label_flips(spark, sf):
    """Labels over three thresholds that rounding a day's sum to whole units flips, per year.  Sums are of whole tenths, so they are exact."""
    from ..operators import series as S

    tenths = V.slots(spark, sf).withColumn("y", F.round(F.col("y") * 10).cast("long"))
    t = tenths.select("slot", F.sum("y").over(S.frame("station_id", "slot", -4 * V.SLOT_S, 0)).alias("t"))
    e = t.select(F.year(F.timestamp_seconds("slot")).alias("year"), "t", F.explode(F.array(*map(F.lit, (1, 10, 50)))).alias("r"))
    flipped = (F.col("t") > 10 * F.col("r")) != (F.floor((F.col("t") + 5) / 10) > F.col("r"))
    return e.groupBy("year", "r").agg(F.count_if(flipped).alias("flips"), F.count(F.lit(1)).alias("n"))


#: Amounts in all three regions: up to the first edge, between edges (and on one), beyond the last.
AMOUNTS = (0.0, 0.1, 0.2, 0.3, 1.5, 5.0, 15.0, 50.0, 80.0)


def _survival_sql() -> str:
    g = ", ".join(map(str, GRID))
    return f"""select station_id, slot, r, round(case when r <= 0 then s[1] when r <= {GRID[1]} then s[1] + (s[2] - s[1]) * r / {GRID[1]}
  else exp(ln(greatest(s[k - 1], 1e-300)) + (ln(r) - ln(g[k - 1])) / (ln(g[k]) - ln(g[k - 1])) * (ln(greatest(s[k], 1e-300)) - ln(greatest(s[k - 1], 1e-300)))) end, 6) as p
from (select *, least(len(list_filter(g, lambda e: e < r)) + 1, {len(GRID)}) as k from (select station_id, slot, s, [{g}] as g, unnest([{", ".join(map(str, AMOUNTS))}]) as r from forecast))"""


@query("ver_survival_at", f"with {V.FORECAST} " + _survival_sql())
def ver_survival_at(spark, sf):
    rs = F.array(*map(F.lit, AMOUNTS))
    p = V.forecast(spark, sf).select("station_id", "slot", F.explode(F.arrays_zip(rs.alias("r"), C.survivals_at(GRID, F.col("s"), rs).alias("p"))).alias("x"))
    return p.select("station_id", "slot", "x.r", F.round("x.p", 6).alias("p"))


@query("sel_best_model", _sql("select arg_min(name, b) as name, round(min(b), 6) as brier from (select 'grid' as name, avg(pow(p - cast(o as double), 2)) as b from scored union all select 'flat', avg(pow(0.3 - cast(o as double), 2)) from scored union all select 'pi', avg(pow(pi - cast(o as double), 2)) from scored)"))
def sel_best_model(spark, sf):
    o = F.col("o").cast("double")
    c = F.array(*(F.struct(F.lit(n).alias("name"), F.pow(p - o, F.lit(2)).alias("b")) for n, p in (("grid", F.col("p")), ("flat", F.lit(0.3)), ("pi", F.col("pi")))))
    e = scored(spark, sf).select(F.explode(c).alias("x")).groupBy("x.name").agg(F.avg("x.b").alias("b"))
    return e.agg(F.min_by("name", "b").alias("name"), F.round(F.min("b"), 6).alias("brier"))
