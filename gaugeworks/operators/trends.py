"""Kendall's tau and the Theil-Sen slope of one series, without its pairs.

For a slope b, the pairs of points that rise faster than b are those with u = v - b t larger at the later time.  They are
counted in n log n: points go to ranges of time and, at once, to ranges of u.  Pairs inside a range are counted there by
merging; pairs of different ranges follow from how many points each pair of ranges shares, a table of at most RANGES^2 counts,
which is all that the driver gets.  Tau is the count at slope 0.  The median slope is found by the same counts: many slopes of a
bracket are counted in one job, and the bracket becomes the gap between two of them in which the median lies, until it is
narrower than the asked precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch, shipping

#: Points of a series that is compared pair by pair at once (some 2 million pairs), ranges of time and of u, slopes counted in a job.
FEW, RANGES, SLOPES = 2048, 64, 16
#: Width of the bracket in which the slope is at last, of its size or absolutely.
PRECISION = 1e-11


def rises(a: np.ndarray, b: np.ndarray) -> int:
    """Pairs with smaller a and smaller b, by merging runs of doubled length."""
    order = np.lexsort((-b, a))  # of equal a the larger b first, so that no pair of them counts
    x = np.unique(b[order], return_inverse=True)[1].astype(np.int64)
    n, total, run = len(x), 0, 1
    while run < n:
        # every run is sorted; where a value of a right run would stand in its left run is how many it rises from
        block = np.arange(n) // (2 * run)
        right = (np.arange(n) // run) % 2 == 1
        keys = block * (n + 1) + x
        left = keys[~right]
        starts = np.searchsorted(left, block[right] * (n + 1))
        total += int((np.searchsorted(left, keys[right]) - starts).sum())
        x = x[np.argsort(keys, kind="stable")]
        run *= 2
    return total


def _inside(column: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, u = rows[column].to_numpy(), rows["u"].to_numpy()
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "up": pa.array([rises(a, u)]), "down": pa.array([rises(a, -u)])})

    return run


def counts(points: DataFrame, slopes: Sequence[float]) -> list[tuple[int, int]]:
    """For each slope the pairs of points (t, v, part: a range of t) that rise faster and those that rise slower; a few jobs for all of them."""
    each = F.posexplode(F.array(*(F.lit(float(s)) for s in slopes))).alias("b", "slope")
    u = points.select("t", "v", "part", each).select("t", "part", F.col("b").cast("int").alias("b"), (F.col("v") - F.col("slope") * F.col("t")).alias("u"))
    ranged = scratch.table(u.repartitionByRange(RANGES, "b", "u").withColumn("cell", F.spark_partition_id()), "ranges-of-slopes")
    out = [[0, 0] for _ in slopes]
    for by, column in (("part", "t"), ("cell", "part")):
        found = ranged.groupBy("b", by).applyInArrow(_inside(column), "b int, up long, down long")
        for r in found.groupBy("b").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).collect():
            out[r["b"]][0] += r["up"]
            out[r["b"]][1] += r["down"]
    shared = ranged.groupBy("b", "part", "cell").count().collect()
    for b in range(len(slopes)):
        # earlier ranges of time and of u, and earlier ranges of time but later of u; a range of u may begin in another slope's
        own = [r for r in shared if r["b"] == b]
        if not own:
            continue
        parts, cells = ({x: i for i, x in enumerate(sorted({r[c] for r in own}))} for c in ("part", "cell"))
        h = np.zeros((len(parts), len(cells)), dtype=object)  # whole numbers of any size
        for r in own:
            h[parts[r["part"]], cells[r["cell"]]] += r["count"]
        before = np.cumsum(h, 0) - h
        under = np.cumsum(before, 1) - before
        over = before.sum(1, keepdims=True) - under - before
        out[b][0] += int((h * under).sum())
        out[b][1] += int((h * over).sum())
    return [tuple(x) for x in out]


def _ranged(series: DataFrame, at: str, value: str) -> DataFrame:
    points = series.select(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    return scratch.table(points.repartitionByRange(RANGES, "t").withColumn("part", F.spark_partition_id()), "ranges-of-time")


def select_slopes(points: DataFrame, ranks: Sequence[int], low: float, high: float) -> list[float]:
    """The slopes of these ranks (from 1) among the slopes of all pairs of points of different times; low and high enclose all slopes."""
    brackets = [(low, high) for _ in ranks]
    while True:
        open_ = [i for i, (a, b) in enumerate(brackets) if b - a > PRECISION * max(1.0, abs(a), abs(b))]
        if not open_:
            return [(a + b) / 2 for a, b in brackets]
        tried = sorted({float(x) for i in open_ for x in np.linspace(*brackets[i], SLOPES + 2)[1:-1]})
        slower = [down for _, down in counts(points, tried)]  # slopes below each
        for i in open_:
            a, b = brackets[i]
            a = max([a, *(s for s, n in zip(tried, slower, strict=True) if n < ranks[i])])
            b = min([b, *(s for s, n in zip(tried, slower, strict=True) if n >= ranks[i])])
            if (a, b) == brackets[i]:  # no number between them
                a = b
            brackets[i] = (a, b)


def _pairs_at_once(rows: np.ndarray) -> tuple[float, float] | None:
    t, v = rows[:, 0], rows[:, 1]
    i, j = np.triu_indices(len(t), 1)
    later = t[j] > t[i]
    i, j = i[later], j[later]
    if not len(i):
        return None
    return float(np.mean(np.sign(v[j] - v[i]))), float(np.median((v[j] - v[i]) / (t[j] - t[i])))


def trend(series: DataFrame, at: str, value: str, few: int = FEW) -> DataFrame:
    """tau (a), slope: Kendall's tau and the median of the slopes of all pairs of points of different times, rounded to six digits.

    Rows without a time or a value are left out; both are null without a pair."""
    spark = series.sparkSession
    known = series.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    first = known.select(F.col(at).cast("double"), F.col(value).cast("double")).limit(few + 1).collect()  # of a short series all points
    if len(first) <= few:
        found = _pairs_at_once(np.array(sorted(map(tuple, first)), float).reshape(-1, 2))
    else:
        shipping.ship(spark)
        points = _ranged(known, at, value)
        n = points.count()
        same = points.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        # neighbours in time enclose all slopes: a slope over a longer way is a mean of slopes over its steps
        edges = points.agg(F.min("v").alias("a"), F.max("v").alias("b"))
        earlier = Window.partitionBy("part").orderBy("t")
        gaps = points.withColumn("g", F.col("t") - F.lag("t").over(earlier)).groupBy("part").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min(F.when(F.col("g") > 0, F.col("g"))).alias("g")).orderBy("a").collect()  # a row per range
        between = [y["a"] - x["b"] for x, y in zip(gaps, gaps[1:], strict=False)] + [r["g"] for r in gaps if r["g"]]
        tied = same.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
        pairs = n * (n - 1) // 2 - int(tied)
        if not pairs:
            found = None
        else:
            e = edges.first()
            steepest = (e["b"] - e["a"]) / min(x for x in between if x > 0) * 1.001 + 1e-12
            (up, down), = counts(points, [0.0])
            middle = sorted({(pairs + 1) // 2, pairs // 2 + 1})
            slopes = select_slopes(points, middle, -steepest, steepest)
            found = (up - down) / pairs, sum(slopes) / len(slopes)
    tau, slope = found or (None, None)
    return spark.createDataFrame([(tau, slope)], "tau double, slope double").select(F.round("tau", 6).alias("tau"), F.round("slope", 6).alias("slope"))
