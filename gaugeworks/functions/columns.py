"""Column expressions: slots, calendars, classes, distances, probabilities.  All run inside Spark's generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def epoch(ts: str | Column) -> Column:
    return F.unix_timestamp(ts)


def slot(seconds: Column, slot_s: int) -> Column:
    """The nearest slot, halves up, in whole numbers."""
    return F.floor((seconds + slot_s // 2) / slot_s).cast("long") * slot_s


def accumulation_hour(slot_col: Column, slot_s: int) -> Column:
    """A reading stamped t covers (t - slot, t]; its hour is that of the covered time."""
    return F.floor((slot_col - slot_s) / 3600).cast("long")


def day_of(seconds: Column, offset_s: int = 0) -> Column:
    return F.date_from_unix_date(F.floor((seconds + offset_s) / 86400).cast("int"))


def season(month: Column) -> Column:
    """Four seasons by month: the two monsoons and what lies between them."""
    return F.when(month.isin(12, 1, 2), "northeast").when(month.isin(3, 4, 5), "first_between").when(month.isin(6, 7, 8, 9), "southwest").otherwise("second_between")


def bucket(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are strictly below x."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: x > e))


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def log_scaled(x: Column, unit: float = 0.2) -> Column:
    return F.log1p(x / unit)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def offset_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """East and north of the first point."""
    return (lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians(lat1)), (lat2 - lat1) * KM_PER_DEGREE


def running_product(values: Column) -> Column:
    """Products of the first, the first two, ... values: one pass that carries the last product along."""
    grown = F.aggregate(values, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(x * F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(1.0)))))
    return grown


def normal_cdf(z: Column) -> Column:
    """Phi by a rational approximation of erf (absolute error under 2e-7); Spark has no erf."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def survival_at(grid: Sequence[float], survival: Column, r: Column) -> Column:
    """P(Y > r) from survival values on a grid that starts at 0: straight up to its first edge, then straight in the logarithms of r and
    of the survival, and on by the last two edges beyond the grid (a Pareto tail)."""
    g, n = [float(x) for x in grid], len(grid)
    logs = F.array(F.lit(None).cast("double"), *(F.lit(math.log(x)) for x in g[1:]))
    k = F.greatest(F.lit(3), F.least(F.size(F.filter(F.array(*map(F.lit, g)), lambda e: e < r)) + 1, F.lit(n)))  # of the edge at or above r, from 1
    log_s = lambda i: F.ln(F.greatest(F.element_at(survival, i), F.lit(1e-300)))
    t = (F.ln(F.greatest(r, F.lit(g[1]))) - F.element_at(logs, k - 1)) / (F.element_at(logs, k) - F.element_at(logs, k - 1))
    first, second = F.element_at(survival, 1), F.element_at(survival, 2)
    return F.when(r <= 0, first).when(r <= g[1], first + (second - first) * r / g[1]).otherwise(F.exp(log_s(k - 1) + t * (log_s(k) - log_s(k - 1))))


def survivals_at(grid: Sequence[float], survival: Column, rs: Column) -> Column:
    """survival_at of each of an array of amounts, which may differ from row to row."""
    return F.transform(rs, lambda r: survival_at(grid, survival, r))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(2 * tp, 2 * tp + fp + fn)
