"""Scores of probability and grid forecasts: conditional sums, windows over bins, or sums along ranges of an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import ordered


def confusion(df: DataFrame, predicted: Column, observed: Column, *keys: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count_if(predicted & observed).alias("tp"), F.count_if(predicted & ~observed).alias("fp"), F.count_if(~predicted & observed).alias("fn"), F.count_if(~predicted & ~observed).alias("tn"))
    p, r, f1 = C.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(f1, 6))


def best_f1(df: DataFrame, p: str, observed: Column) -> DataFrame:
    """The cut-off of 0, 0.001, ... 1 with the largest F1, the larger of equals.  Rows become 1,001 bins first; windows see bins."""
    bins = df.groupBy(F.floor(F.col(p) * 1000).cast("long").alias("bin")).agg(F.count_if(observed).alias("pos"), F.count_if(~observed).alias("neg"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = bins.select("bin", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("all"))
    f1 = F.round(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all")), 8)
    return s.agg(F.max(F.struct(f1.alias("f1"), "bin")).alias("m")).select("m.bin", "m.f1")


def brier(df: DataFrame, p: Column, observed: Column, *keys: str) -> DataFrame:
    """Brier score, that of the climatology (the event rate), and the skill."""
    o = observed.cast("double")
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((p - o) * (p - o)).alias("b"), F.avg(o).alias("rate"))
    clim = F.col("rate") * (1 - F.col("rate"))
    return g.select(*keys, "n", F.round("b", 6).alias("brier"), F.round(clim, 6).alias("brier_clim"), F.round(1 - F.try_divide(F.col("b"), clim), 6).alias("skill"))


def auc(df: DataFrame, p: str, observed: Column) -> DataFrame:
    """ROC-AUC by midranks and PR-AUC by steps; equal scores are one step."""
    by = df.groupBy(p).agg(F.count_if(observed).alias("pos"), F.count_if(~observed).alias("neg"))
    s = ordered.running(by, p, ["pos", "neg"])
    tp, fp = F.col("all_pos") - F.col("before_pos"), F.col("all_neg") - F.col("before_neg")
    roc = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))
    pr = F.sum(F.col("pos") * tp / (tp + fp)) / F.sum("pos")
    return s.agg(F.round(roc, 6).alias("roc_auc"), F.round(pr, 6).alias("pr_auc"))


def reliability(df: DataFrame, p: str, observed: Column, bins: int) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(observed.cast("double")), 6).alias("rate"))


def grid_scores(df: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Row scores of a survival array on a grid: RPS (sum of squared differences), CRPS on the grid, log score of the class."""
    n = len(grid)
    g = F.array(*(F.lit(float(x)) for x in grid))
    sq = F.zip_with("s", g, lambda s, e: F.pow(s - (F.col("y") > e).cast("double"), F.lit(2)))
    widths = F.array(*(F.lit(float(b - a)) for a, b in zip(grid, grid[1:], strict=False)))
    mid = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: (F.element_at(sq, i) + F.element_at(sq, i + 1)) / 2 * F.element_at(widths, i))
    k = F.size(F.filter(g, lambda e: F.col("y") > e))
    high = F.when(k == 0, F.lit(1.0)).otherwise(F.element_at("s", F.greatest(k, F.lit(1))))
    low = F.when(k == n, F.lit(0.0)).otherwise(F.element_at("s", F.least(k + 1, F.lit(n))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return df.withColumn("rps", total(sq)).withColumn("crps", total(mid)).withColumn("log_score", -F.ln(F.greatest(high - low, F.lit(1e-9))))


def climatology_crps(train: DataFrame, test: DataFrame) -> DataFrame:
    """Mean CRPS of the training values as one empirical forecast, exactly, from (value, count) tables.

    E|X - y| - E|X - X'| / 2 by sums along the values of both."""
    both = train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit(0).cast("long")).unionByName(test.groupBy("y").agg(F.count(F.lit(1)).alias("m")).withColumn("n", F.lit(0).cast("long"))).groupBy("y").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    s = ordered.running(both.withColumn("s", F.col("n") * F.col("y")), "y", ["n", "s"]).withColumn("cn", F.col("before_n") + F.col("n")).withColumn("cs", F.col("before_s") + F.col("s"))
    dist = (F.col("y") * F.col("cn") - F.col("cs")) + (F.col("all_s") - F.col("cs") - F.col("y") * (F.col("all_n") - F.col("cn")))
    t = s.agg(F.sum(F.col("m") * dist).alias("d"), F.sum(F.col("n") * dist).alias("dd"), F.sum("m").alias("all_m"), F.max("all_n").alias("all_n"))
    return t.select(F.round(F.col("d") / (F.col("all_m") * F.col("all_n")) - F.col("dd") / (2 * F.col("all_n") * F.col("all_n")), 4).alias("crps"))


def block_bootstrap(daily: DataFrame, reps: int) -> DataFrame:
    """Mean and 5-95 % range of sum(value) / sum(n) over resampled days; daily: day, value, n.

    Draw d of replicate r takes a day by arithmetic, so runs agree; only daily sums are joined.  Days are numbered by one window,
    a row per day, and a replicate is as many rows as there are days."""
    days = daily.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    count = days.agg(F.count(F.lit(1)).alias("days"))
    spark = daily.sparkSession
    r = spark.range(reps).select(F.col("id").alias("rep"), count.scalar().alias("days"))
    draws = r.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("days") - 1)))
    picked = draws.withColumn("i", F.pmod(F.shiftright(F.pmod((F.col("rep") * 1000003 + F.col("d")) * 1103515245 + 12345, F.lit(2147483648)), 12), F.col("days")))
    means = picked.join(days, "i").groupBy("rep").agg((F.sum("value") / F.sum("n")).alias("mean"))
    return means.agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.percentile("mean", F.lit(0.05)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.95)), 6).alias("high"))
