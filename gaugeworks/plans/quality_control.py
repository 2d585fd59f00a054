"""Queries on the plausibility rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as R
from ..sources import scratch
from . import spatial as G
from . import views as V
from .registry import query

T = R.Thresholds()
DAYS = G.PAIRS + f""",
d0 as (select station_id, slot // 86400 as day, round(sum(y), 4) as total, count(*) filter (y >= 1) as wet_hours from slots group by 1, 2),
days as (select d.station_id, d.day, d.total, d.wet_hours, count(n.total) as n_nb, max(n.total) as nb_max from d0 d left join pairs p using (station_id) left join d0 n on n.station_id = p.nb and n.day = d.day group by all),
extreme as (select * from days where total >= {T.extreme} and n_nb >= {T.extreme_neighbours} and nb_max < {T.extreme_share} * total),
phantom as (select * from days where total >= {T.phantom} and wet_hours >= {T.phantom_hours} and n_nb >= {T.phantom_neighbours} and nb_max <= {T.phantom_share} * total),
z as (select *, sum(cast(total > 0 as integer)) over (partition by station_id order by day rows between unbounded preceding and current row) as run from days),
stuck as (select station_id, min(day) as first_day, max(day) as last_day, count(*) as n_days, count(*) filter (nb_max >= {T.stuck_wet}) as nb_wet_days from z where total = 0 group by station_id, run having count(*) filter (nb_max >= {T.stuck_wet}) >= {T.stuck_days}),
f as (select station_id, day from extreme union select station_id, day from phantom),
ch as (select *, sum(new) over (partition by station_id order by day rows between unbounded preceding and current row) as chain from (select *, coalesce(cast(day - lag(day) over (partition by station_id order by day) > {T.repeat_gap_days} as integer), 1) as new from f)),
repeats as (select station_id, min(day) as first_day, max(day) as last_day, count(*) as n_days from ch group by station_id, chain having count(*) >= {T.repeat_least}),
lone as (select s.station_id, s.slot, s.y from slots s left join slots b on b.station_id = s.station_id and b.slot = s.slot - {V.SLOT_S} left join slots a on a.station_id = s.station_id and a.slot = s.slot + {V.SLOT_S}
  where s.y >= {T.spike} and coalesce(b.y, 0) < {T.spike_share} * s.y and coalesce(a.y, 0) < {T.spike_share} * s.y),
spikes as (select l.station_id, l.slot, l.y, count(distinct p.nb) as n_nb, max(n.y) as nb_max from lone l join pairs p using (station_id) join slots n on n.station_id = p.nb and n.slot between l.slot - {T.spike_reach * V.SLOT_S} and l.slot + {T.spike_reach * V.SLOT_S} group by 1, 2, 3 having count(distinct p.nb) >= {T.spike_neighbours} and max(n.y) < {T.spike_wet}),
masks as (select station_id, first_day, last_day, 'stuck_zero' as rule from stuck union all select station_id, day - 1, day + 1, 'extreme' from extreme union all select station_id, day - 1, day + 1, 'phantom' from phantom union all select station_id, first_day, last_day, 'repeat' from repeats)"""


def _sql(body: str) -> str:
    return f"with {V.SLOTS}{DAYS}\n{body}"


def _days(spark, sf, slots=None, pairs=None):
    """Written once: every rule reads them."""
    s = V.slots_once(spark, sf) if slots is None else slots
    return scratch.table(R.station_days(s, G._pairs(spark, sf) if pairs is None else pairs), "station-days")


@query("qc_isolated_extreme", _sql("select station_id, day, total, n_nb, nb_max from extreme"))
def qc_isolated_extreme(spark, sf):
    return R.isolated_extreme(_days(spark, sf), T).select("station_id", "day", "total", "n_nb", "nb_max")


@query("qc_phantom_rain", _sql("select station_id, day, total, wet_hours, nb_max from phantom"))
def qc_phantom_rain(spark, sf):
    return R.phantom_rain(_days(spark, sf), T).select("station_id", "day", "total", "wet_hours", "nb_max")


@query("win_stuck_zero", _sql("select * from stuck"))
def win_stuck_zero(spark, sf):
    return R.stuck_zero(_days(spark, sf), T)


@query("win_repeat_spans", _sql("select * from repeats"))
def win_repeat_spans(spark, sf):
    return R.repeats(R.day_flags(_days(spark, sf), T), T)


@query("win_topk_ranked", _sql("select station_id, day, nb, k from (select o.station_id, o.day, p.nb, row_number() over (partition by o.station_id, o.day order by p.k) as k from d0 o join pairs p using (station_id) join d0 n on n.station_id = p.nb and n.day = o.day) where k <= 2"))
def win_topk_ranked(spark, sf):
    from pyspark.sql import Window

    d = _days(spark, sf).select("station_id", "day")
    usable = d.join(G._pairs(spark, sf).select("station_id", "nb", F.col("k").alias("rank")), "station_id").join(d.select(F.col("station_id").alias("nb"), "day"), ["nb", "day"])
    return usable.withColumn("k", F.row_number().over(Window.partitionBy("station_id", "day").orderBy("rank"))).where("k <= 2").select("station_id", "day", "nb", "k")


@query("qc_spike", _sql("select * from spikes"))
def qc_spike(spark, sf):
    return R.spikes(V.slots_once(spark, sf), G._pairs(spark, sf), V.SLOT_S, T)


@query("qc_masks", _sql("select * from masks"))
def qc_masks(spark, sf):
    return R.masks(_days(spark, sf), T)


@query("qc_flag_table", _sql("""select 'extreme' as rule, station_id, day as first_day, day as last_day, 'total=' || cast(cast(round(total * 10) as bigint) as varchar) || ' nb=' || cast(n_nb as varchar) as evidence from extreme
union all select 'phantom', station_id, day, day, 'total=' || cast(cast(round(total * 10) as bigint) as varchar) || ' nb=' || cast(n_nb as varchar) from phantom
union all select 'stuck_zero', station_id, first_day, last_day, 'days=' || cast(n_days as varchar) from stuck
union all select 'repeat', station_id, first_day, last_day, 'days=' || cast(n_days as varchar) from repeats
union all select 'spike', station_id, slot // 86400, slot // 86400, 'y=' || cast(cast(round(y * 10) as bigint) as varchar) from spikes order by 1, 2, 3"""))
def qc_flag_table(spark, sf):
    s, pairs = V.slots_once(spark, sf), G._pairs(spark, sf)
    d = _days(spark, sf, s, pairs)
    tenths = lambda c: F.round(F.col(c) * 10).cast("long").cast("string")
    span = lambda f, rule: f.select(F.lit(rule).alias("rule"), "station_id", "first_day", "last_day", F.concat(F.lit("days="), F.col("n_days").cast("string")).alias("evidence"))
    flags = R.day_flags(d, T)
    days = flags.select("rule", "station_id", F.col("day").alias("first_day"), F.col("day").alias("last_day"), F.concat(F.lit("total="), tenths("total"), F.lit(" nb="), F.col("n_nb").cast("string")).alias("evidence"))
    at = F.floor(F.col("slot") / 86400)
    spike = R.spikes(s, pairs, V.SLOT_S, T).select(F.lit("spike").alias("rule"), "station_id", at.alias("first_day"), at.alias("last_day"), F.concat(F.lit("y="), tenths("y")).alias("evidence"))
    return days.unionByName(span(R.stuck_zero(d, T), "stuck_zero")).unionByName(span(R.repeats(flags, T), "repeat")).unionByName(spike).orderBy("rule", "station_id", "first_day")


@query("agg_masked_days", _sql("select rule, count(*) as n_days from (select distinct m.rule, s.station_id, s.slot // 86400 as day from slots s join masks m on m.station_id = s.station_id and s.slot // 86400 between first_day and last_day) group by 1"))
def agg_masked_days(spark, sf):
    s = V.slots_once(spark, sf)
    m = R.masks(_days(spark, sf, s), T).select("rule", "station_id", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    d = s.select("station_id", F.floor(F.col("slot") / 86400).alias("day")).distinct()
    return m.join(d, ["station_id", "day"]).distinct().groupBy("rule").agg(F.count(F.lit(1)).alias("n_days"))


@query("agg_mask_effect", _sql("select strftime(make_timestamp(slot * 1000000), '%Y-%m') as month, count(*) as before, count(*) filter (m) as removed, count(*) filter (not m) as left from (select s.*, exists (select 1 from masks k where k.station_id = s.station_id and s.slot // 86400 between first_day and last_day) as m from slots s) group by 1".replace(" as left", ' as "left"')))
def agg_mask_effect(spark, sf):
    s = V.slots_once(spark, sf)
    return R.mask_effect(s, R.masks(_days(spark, sf, s), T))


@query("snk_mask_rewrite", _sql("select station_id, slot, y from slots s where not exists (select 1 from masks k where k.station_id = s.station_id and s.slot // 86400 between first_day and last_day)"))
def snk_mask_rewrite(spark, sf):
    """The masked copy: same columns, masked days left out by an anti join."""
    from ..operators import spatial as P

    s = V.slots_once(spark, sf)
    return P.masked(s.withColumn("day", F.floor(F.col("slot") / 86400)), R.masks(_days(spark, sf, s), T), keep=False).select("station_id", "slot", "y")
