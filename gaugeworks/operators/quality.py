"""Rules that flag implausible station days and readings, with their evidence, and the masks made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial


@dataclass(frozen=True)
class Thresholds:
    """Scaled to the stand-in readings; the rules keep their shapes."""

    extreme: float = 45.0
    extreme_share: float = 0.8
    extreme_neighbours: int = 3
    phantom: float = 40.0
    phantom_share: float = 0.9
    phantom_neighbours: int = 3
    phantom_hours: int = 2
    stuck_days: int = 1
    stuck_wet: float = 5.0
    repeat_gap_days: int = 15
    repeat_least: int = 2
    spike: float = 30.0
    spike_share: float = 0.25
    spike_neighbours: int = 1
    spike_wet: float = 45.0
    spike_reach: int = 1


def station_days(slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """station_id, day, total, wet_hours and what the neighbours had on the day: n_nb, nb_max."""
    d = slots.groupBy("station_id", F.floor(F.col("slot") / 86400).alias("day")).agg(F.round(F.sum("y"), 4).alias("total"), F.count_if(F.col("y") >= 1).alias("wet_hours"))
    nb = d.select(F.col("station_id").alias("nb"), "day", F.col("total").alias("nb_total"))
    seen = d.select("station_id", "day").join(pairs.select("station_id", "nb"), "station_id").join(nb, ["nb", "day"]).groupBy("station_id", "day").agg(F.count(F.lit(1)).alias("n_nb"), F.max("nb_total").alias("nb_max"))
    return d.join(seen, ["station_id", "day"], "left").select("station_id", "day", "total", "wet_hours", F.coalesce("n_nb", F.lit(0)).alias("n_nb"), "nb_max")


def _extreme(t: Thresholds) -> Column:
    return (F.col("total") >= t.extreme) & (F.col("n_nb") >= t.extreme_neighbours) & (F.col("nb_max") < t.extreme_share * F.col("total"))


def _phantom(t: Thresholds) -> Column:
    return (F.col("total") >= t.phantom) & (F.col("wet_hours") >= t.phantom_hours) & (F.col("n_nb") >= t.phantom_neighbours) & (F.col("nb_max") <= t.phantom_share * F.col("total"))


def isolated_extreme(days: DataFrame, t: Thresholds) -> DataFrame:
    return days.where(_extreme(t))


def phantom_rain(days: DataFrame, t: Thresholds) -> DataFrame:
    return days.where(_phantom(t))


def day_flags(days: DataFrame, t: Thresholds) -> DataFrame:
    """The days with each rule that flags them, both rules in one pass."""
    rules = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in (("extreme", _extreme(t)), ("phantom", _phantom(t)))))
    return days.withColumn("rule", F.explode(F.array_compact(rules)))


def stuck_zero(days: DataFrame, t: Thresholds) -> DataFrame:
    """Runs of dry days, days without data not breaking a run, while neighbours were wet on several of them."""
    w = Window.partitionBy("station_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    runs = days.withColumn("run", F.sum((F.col("total") > 0).cast("int")).over(w)).where("total = 0")
    out = runs.groupBy("station_id", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("nb_max") >= t.stuck_wet).alias("nb_wet_days"))
    return out.where(F.col("nb_wet_days") >= t.stuck_days).drop("run")


def repeats(flagged: DataFrame, t: Thresholds) -> DataFrame:
    """Chains of flagged days with short gaps between them; flagged: station_id, day."""
    w = Window.partitionBy("station_id").orderBy("day")
    new = F.coalesce((F.col("day") - F.lag("day").over(w) > t.repeat_gap_days).cast("int"), F.lit(1))
    chained = flagged.select("station_id", "day").distinct().withColumn("new", new).withColumn("chain", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy("station_id", "chain").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days")).where(F.col("n_days") >= t.repeat_least).drop("chain")


def spikes(slots: DataFrame, pairs: DataFrame, slot_s: int, t: Thresholds) -> DataFrame:
    """A high reading between two low ones (missing: 0) while enough neighbours report and none is wet near it."""
    high = slots.where(F.col("y") >= t.spike).select("station_id", "slot", "y")
    # only the high readings need their neighbours in time
    at = lambda k, name: slots.select("station_id", (F.col("slot") + k * slot_s).alias("slot"), F.col("y").alias(name))
    lone = high.join(at(1, "before"), ["station_id", "slot"], "left").join(at(-1, "after"), ["station_id", "slot"], "left")
    lone = lone.where((F.coalesce("before", F.lit(0.0)) < t.spike_share * F.col("y")) & (F.coalesce("after", F.lit(0.0)) < t.spike_share * F.col("y")))
    near = spatial.around(lone, pairs, slots, t.spike_reach, slot_s).groupBy("station_id", "slot").agg(F.count_distinct("nb").alias("n_nb"), F.max("nb_y").alias("nb_max"))
    return lone.join(near, ["station_id", "slot"]).where((F.col("n_nb") >= t.spike_neighbours) & (F.col("nb_max") < t.spike_wet)).select("station_id", "slot", "y", "n_nb", "nb_max")


def masks(days: DataFrame, t: Thresholds) -> DataFrame:
    """station_id, first_day, last_day, rule: flagged days widened by one day, and spans as they are."""
    span = lambda d, rule: d.select("station_id", "first_day", "last_day", F.lit(rule).alias("rule"))
    flags = day_flags(days, t)
    wide = flags.select("station_id", (F.col("day") - 1).alias("first_day"), (F.col("day") + 1).alias("last_day"), "rule")
    return span(stuck_zero(days, t), "stuck_zero").unionByName(wide).unionByName(span(repeats(flags, t), "repeat"))


def mask_effect(slots: DataFrame, spans: DataFrame) -> DataFrame:
    """Readings before, removed, and left, by month, in one pass over a tagged frame."""
    days = slots.withColumn("day", F.floor(F.col("slot") / 86400))
    hit = spans.select("station_id", F.explode(F.sequence("first_day", "last_day")).alias("day")).distinct().withColumn("masked", F.lit(True))
    tagged = days.join(hit, ["station_id", "day"], "left")
    return tagged.groupBy(F.date_format(F.timestamp_seconds("slot"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("masked")).alias("removed"), F.count_if(F.col("masked").isNull()).alias("left"))
