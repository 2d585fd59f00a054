"""Quantile tables of groups from mergeable sketches: a bounded number of bytes per group, however many rows it has.

Every task sketches its rows and the sketches are merged, so a hot group is no task's burden.  Sketches are binary columns:
they can be written, and merged further with those of other days or classes.  While a group has no more than `size` rows its
quantiles are exact; beyond that they are off in rank by less than rank_error(size) of the rows with 99 % confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank error of about 7 in 10,000; a sketch takes some 30,000 values at most.
SIZE = 8192


def rank_error(size: int = SIZE) -> float:
    """The published bound of these sketches (KLL) for one quantile, as a share of the rows."""
    return 2.296 / size**0.9021  # fixed values of the sketch


def sketches(df: DataFrame, keys: Sequence[str], values: Sequence[str], size: int = SIZE) -> DataFrame:
    """keys and a sketch of each of values; nulls are left out, and a group without values has a sketch of none."""
    return df.groupBy(*keys).agg(*(F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(size)).alias(v) for v in values))


def merged(sketched: DataFrame, keys: Sequence[str], values: Sequence[str], size: int = SIZE) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, without the rows."""
    return sketched.groupBy(*keys).agg(*(F.kll_merge_agg_double(v, F.lit(size)).alias(v) for v in values))


def quantiles(sketch: Column, probabilities: Sequence[float]) -> Column:
    """The smallest values that at least these shares of the rows don't exceed; null of no rows."""
    asked = F.array(*(F.lit(float(p)) for p in probabilities))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, asked))


def quantile_tables(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], size: int = SIZE) -> DataFrame:
    """keys, and the quantiles of each group as an array named as the value."""
    return sketches(df, keys, [value], size).select(*keys, quantiles(F.col(value), probabilities).alias(value))
