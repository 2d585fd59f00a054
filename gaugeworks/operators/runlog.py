"""Statistics of benchmark run records: trials, agreement with a reference, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ["position", "backend", "split_depth", "cores", "job"]


def trial_medians(runs: DataFrame) -> DataFrame:
    good = F.col("exit_code") == 0
    t = F.when(good, F.col("seconds"))
    return runs.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("trial").alias("distinct_trials"), F.count_if(~good).alias("failed"), F.percentile(t, F.lit(0.5)).alias("median"), F.min(t).alias("low"), F.max(t).alias("high"), F.sort_array(F.collect_set(F.when(good, F.col("score")))).alias("scores"))


def reference_scores(runs: DataFrame) -> DataFrame:
    """The scores of ok serial runs per position and depth."""
    return runs.where("backend = 'serial' and exit_code = 0").groupBy("position", "depth").agg(F.sort_array(F.collect_set("score")).alias("reference"))


def trial_status(runs: DataFrame) -> DataFrame:
    """INCOMPLETE unless three distinct trials are there, CHECK unless all scores equal the one reference, else PASS."""
    ref = reference_scores(runs).select("position", "reference")
    m = trial_medians(runs).join(ref, "position", "left")
    status = F.when(F.col("distinct_trials") != 3, "INCOMPLETE").when(F.coalesce((F.size("reference") == 1) & (F.col("scores") == F.col("reference")), F.lit(False)), "PASS").otherwise("CHECK")
    return m.select(*GROUP, status.alias("status"), "failed")


def cell_medians(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.where("exit_code = 0").groupBy(*keys).agg(F.percentile("seconds", F.lit(0.5)).alias("median"))


def strong_scaling(runs: DataFrame) -> DataFrame:
    """Speed-up over serial and over the smallest parallel run, efficiency per core."""
    par = cell_medians(runs.where("backend = 'mpi'"), "position", "depth", "cores")
    serial = cell_medians(runs.where("backend = 'serial'"), "position", "depth").withColumnRenamed("median", "serial")
    one = par.groupBy("position", "depth").agg(F.min_by("median", "cores").alias("one"), F.min("cores").alias("least"))
    j = par.join(serial, ["position", "depth"]).join(one, ["position", "depth"])
    over_one = F.col("one") / F.col("median")
    return j.select("position", "depth", "cores", "median", F.round(F.col("serial") / F.col("median"), 6).alias("over_serial"), F.round(over_one, 6).alias("over_one"), F.round(over_one * F.col("least") / F.col("cores"), 6).alias("efficiency"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """key=value text to a map per line."""
    pairs = F.regexp_extract_all("value", F.lit("(\\w+)=(\\S+)"), F.lit(0))
    return lines.select("line_no", F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split(p, "=", 2)[0], F.split(p, "=", 2)[1]))).alias("fields"))
