"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that a task reduces to a forest at a time.
BLOCK = 1 << 20


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each of rows 0..n-1 is linked to by pairs (a, b), over any number of steps."""
    root = np.arange(n)
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (node, smallest node) that join what the links (a, b) of named nodes join."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = labels(at[: len(a)], at[len(a) :], len(names))
    rest = np.flatnonzero(root != np.arange(len(names)))
    return names[rest], names[root[rest]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def reduced() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return pa.record_batch([pa.array(x) for x in stars(t["a"].to_numpy(), t["b"].to_numpy())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield reduced()
            held, size = [], 0
    if size:
        yield reduced()


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _settled(links: DataFrame) -> bool:
    """Whether the links, larger to smaller node, are stars: a node with a link down has one only, and none from above."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    down, up = F.sum("down"), F.max("up")
    return ends.groupBy("n").agg(((down > 1) | ((down == 1) & (up == 1))).alias("open")).where("open").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node it is linked to, over any number of links), for all nodes of links (a, b, long).

    Tasks first reduce the links that they hold to forests.  Each step then moves links towards the
    smallest neighbour.  Minima are aggregates, combined before the shuffle, never collected lists; the
    links of a node with very many join a single row of minima, so Spark can split them over tasks as a
    skewed join.  The links of a step are written to the shared folder; the driver sees whether a step
    was the last."""
    now = common.write_table(links.where("a <> b").select("a", "b").mapInArrow(_forests, "a long, b long").distinct(), "links")
    while not _settled(now):
        sides = _both(now)
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of these
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = common.write_table(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
