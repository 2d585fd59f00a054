"""Summaries of station series: hours, days, months, extremes, spells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def hourly(slots: DataFrame, slot_s: int) -> DataFrame:
    h = slots.withColumn("hour", C.accumulation_hour(F.col("slot"), slot_s))
    return h.groupBy("station_id", "hour").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"), F.count_if(F.col("y") > 0).alias("n_wet"), F.max("y").alias("peak"))


def daily(hours: DataFrame, wet_mm: float) -> DataFrame:
    d = hours.withColumn("day", F.floor(F.col("hour") / 24))
    return d.groupBy("station_id", "day").agg(F.sum("n").alias("n_slots"), F.count(F.lit(1)).alias("n_hours"), F.round(F.sum("total"), 4).alias("total"), F.sum("n_wet").alias("n_wet"), F.max("peak").alias("peak"), F.count_if(F.col("total") >= wet_mm).alias("wet_hours"))


def station_month(hours: DataFrame) -> DataFrame:
    h = hours.withColumn("month", F.date_format(C.day_of(F.col("hour") * 3600), "yyyy-MM"))
    return h.groupBy("station_id", "month").agg(F.sum("n").alias("n_slots"), F.round(F.sum("total"), 4).alias("total"), F.sum("n_wet").alias("n_wet"), F.count_if(F.col("total") > 0).alias("wet_hours"), F.max("peak").alias("peak"))


def stratified(df: DataFrame, strata: list[str], *aggregates) -> DataFrame:
    """One row per value of each stratum and one over all, by grouping sets: a single shuffle."""
    sets = [[F.col(s)] for s in strata] + [[]]
    return df.groupingSets(sets, *strata).agg(*aggregates)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, within: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*within)))
