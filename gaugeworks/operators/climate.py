"""Climatology of station series: monthly totals, panels, indices, anomalies, trends.  Tables here are stations times months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def rate_totals(station_months: DataFrame, expected: Column, least_share: float) -> DataFrame:
    """Monthly totals as if every slot had been observed; months under the least coverage are left out."""
    m = station_months.withColumn("coverage", F.col("n_slots") / expected).where(F.col("coverage") >= least_share)
    return m.withColumn("full_total", F.col("total") / F.col("n_slots") * expected)


def ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """column, name: the average rank of each of its values."""
    by = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return ordered.running(by, column, ["n"]).select(column, (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Rank correlation of the rows that have both values."""
    both = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.join(ranks(both, x, "rx"), x).join(ranks(both, y, "ry"), y).agg(F.round(F.corr("rx", "ry"), 6).alias(name))
