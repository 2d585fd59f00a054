"""SimHash near-duplicates through vantage-point trees (operator 5).

Texts with equal fingerprints are linked by grouping.  The distinct fingerprints are searched for
pairs at 3 or fewer differing bits.  Such a pair differs by at most one bit in the upper or in the
lower 32 bits, so there is a tree for each half, searched with radius 1: Hamming distance in a half
is a pseudometric, and the triangle bound holds for it.  A node parts fingerprints by their distance
to a vantage point; a fingerprint whose distance is within the radius of the border belongs to one
side and is a query to the other.  A leaf is a shard: its own fingerprints and the queries that
overlap it meet in one task, pairs are checked on all 64 bits, and a leaf gives a spanning set of
links, not all its pairs.

The trees are built on the driver from a bounded sample of distinct fingerprints; that decides how
even the leaves are, not what is found.  A leaf over LEAF_ROWS all the same is dealt in parts, each of
which meets every other part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Distinct fingerprints that the trees are built from: one of SAMPLE_SHARE, within these bounds.
SAMPLE, MOST_SAMPLE, SAMPLE_SHARE = 20_000, 400_000, 50
#: Fingerprints that a leaf should hold, and of a part of a larger leaf: a task compares two parts at a time.
LEAF_GOAL = 1_000
LEAF_ROWS = 8_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of one whole text.  No words: 0; fewer words than a shingle: their sequence is the only shingle."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    return run


def bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Tree:
    """A vantage-point tree over one half: arrays of vantage points, borders and children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.points, self.borders, self.left, self.right, self.leaves = [], [], [], [], 0
        self.root = self._grow(np.unique(sample), depth)

    def _grow(self, x: np.ndarray, depth: int) -> int:
        """A node's number, or -1 - leaf."""
        if depth == 0 or len(x) < 2:
            self.leaves += 1
            return -self.leaves
        # of a few candidates, the vantage point whose distances leave the fewest on both sides of the border
        best = None
        for p in x[np.linspace(0, len(x) - 1, min(8, len(x))).astype(int)]:
            d = bits(x ^ p)
            for border in np.unique(np.quantile(d, (0.4, 0.5, 0.6)).astype(np.int64)):
                inside, both = int((d <= border).sum()), int(((d == border) | (d == border + 1)).sum())
                if 0 < inside < len(x):
                    cost = both + abs(2 * inside - len(x))
                    if best is None or cost < best[0]:
                        best = (cost, p, border, d)
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, p, border, d = best
        node = len(self.points)
        self.points.append(p)
        self.borders.append(border)
        self.left.append(0)
        self.right.append(0)
        self.left[node] = self._grow(x[d <= border], depth - 1)
        self.right[node] = self._grow(x[d > border], depth - 1)
        return node

    def place(self, x: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int, bool]]:
        """(rows, leaf, whether they are at home there): every leaf that may hold a partner.

        A pair that a border parts is met once: only fingerprints inside it go over as queries."""
        stack = [(self.root, np.arange(len(x)), np.ones(len(x), bool))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                for h in (True, False):
                    if (home == h).any():
                        yield rows[home == h], -1 - node, h
                continue
            d = bits(x[rows] ^ self.points[node]).astype(np.int64)
            inside = d <= self.borders[node]
            near_in = home & inside & (d + radius > self.borders[node])
            go_left = np.where(home, inside, d - radius <= self.borders[node])
            go_right = np.where(home, ~inside, d + radius > self.borders[node])
            stack.append((self.left[node], rows[go_left], home[go_left]))
            stack.append((self.right[node], np.concatenate([rows[go_right], rows[near_in]]), np.concatenate([home[go_right], np.zeros(near_in.sum(), bool)])))


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return (u >> np.uint64(32)).astype(np.uint32), (u & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _placed(trees: tuple[Tree, Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for half, (tree, x) in enumerate(zip(trees, _halves(fp), strict=True)):
                for rows, leaf, home in tree.place(x, RADIUS // 2):
                    n = len(rows)
                    yield pa.record_batch([pa.array(np.full(n, 2 * leaf + half, np.int32)), pa.array(fp[rows]), pa.array(np.full(n, home))], names=["leaf", "fp", "home"])

    return run


def _close(fp: np.ndarray, own: int, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of pairs within RADIUS; i below `own`, j > i (not inside: j from `own` on): a spanning forest of the rows that all such pairs make.

    Of pairs between parts that aren't joined yet, each part takes one to a part of a smaller row, and parts are
    joined, until none is left."""
    root, out = np.arange(len(fp)), [np.zeros((2, 0), np.int64)]
    step = max(1, (1 << 22) // max(1, len(fp)))
    for at in range(0, own, step):
        rows, to = np.arange(at, min(at + step, own)), at if inside else own
        i, j = np.nonzero((bits(fp[rows, None] ^ fp[None, to:]) <= RADIUS) & (root[rows, None] != root[None, to:]))
        i, j = i + at, j + to
        i, j = np.minimum(i, j), np.maximum(i, j)
        while len(i):
            p, q = root[i], root[j]
            high, first = np.unique(np.maximum(p, q), return_index=True)
            out.append(np.stack([i[first], j[first]]))
            root = components.labels(high, np.minimum(p, q)[first], len(fp))[root]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
    pairs = np.concatenate(out, axis=1)
    return pairs[0], pairs[1]


def _leaf(key: tuple, table: pa.Table) -> pa.Table:
    """Links between two parts of a leaf, or inside one part and from it to the leaf's queries."""
    t = table.sort_by([("side", "ascending"), ("fp", "ascending")])
    fp, side = t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy()
    i, j = _close(fp, int((side == 0).sum()), key[1].as_py() == key[2].as_py())
    return pa.table([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame, leaf_goal: int = LEAF_GOAL, leaf_rows: int = LEAF_ROWS, sample: int | None = None) -> DataFrame:
    """a, b: links that join all fingerprints (column fp, distinct) within RADIUS bits, over any number of steps."""
    total = distinct.count()
    sample = min(MOST_SAMPLE, max(SAMPLE, total // SAMPLE_SHARE)) if sample is None else sample
    share = min(1.0, sample / max(1, total))
    drawn = np.array([r["fp"] for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("fp")).limit(sample).collect()], np.int64)
    depth = max(0, int(np.ceil(np.log2(max(1, total / leaf_goal)))))
    trees = tuple(Tree(x, depth) for x in _halves(drawn))
    placed = common.write_table(distinct.select("fp").mapInArrow(_placed(trees), "leaf int, fp long, home boolean"), "leaves")

    # a leaf of more rows, or queries, than leaf_rows is dealt in parts: each part meets itself, every other one and every part of the queries
    size = lambda rows: F.greatest(F.ceil(F.count_if(rows) / leaf_rows), F.lit(1)).cast("int")
    sizes = placed.groupBy("leaf").agg(size(F.col("home")).alias("parts"), size(~F.col("home")).alias("asked")).where("parts > 1 or asked > 1")
    sizes = common.write_table(sizes, "large-leaves")  # the trees have MOST_SAMPLE leaves each at most, so this may go to all tasks
    own = placed.join(F.broadcast(sizes), "leaf", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("parts")).otherwise(F.col("asked"))).cast("int"))
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at_home = F.concat(F.transform(every("parts"), lambda x: pair(F.least(x, F.col("part")), F.greatest(x, F.col("part")))), F.transform(every("asked"), lambda x: pair(F.col("part"), F.col("parts") + x)))
    asking = F.transform(every("parts"), lambda x: pair(x, F.col("parts") + F.col("part")))
    alone = F.array(pair(F.lit(0), F.lit(0)))
    met = own.select("leaf", "fp", "home", "part", F.explode(F.when(F.col("parts").isNull(), alone).when(F.col("home"), at_home).otherwise(asking)).alias("at"))
    first = F.col("home") & (F.col("part").isNull() | (F.col("part") == F.col("at.low")))
    return met.select("leaf", "at.low", "at.high", "fp", F.when(first, 0).otherwise(1).alias("side")).groupBy("leaf", "low", "high").applyInArrow(_leaf, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among documents linked over any number of steps.  Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows get a row each; a
    null doc_id is linked but is no component_id unless its whole component has none.  Only doc_id and
    text are read; an empty table gives no rows."""
    common.ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _named(own, "", shingle).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(own: DataFrame, more: str, shingle: int) -> DataFrame:
    """Of rows (doc_id, text and what `more` declares): doc_id, fp, more, component (a fingerprint; no two components share one), component_id."""
    fps = common.write_table(own.mapInArrow(_fingerprints(shingle), "doc_id long, fp long" + more), "fingerprints")
    distinct = common.write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    joined = components.components(links(distinct))
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", F.col("root").alias("component"), "component_id")
    # one row of `named` for each fingerprint: of a fingerprint that very many documents have, Spark may split the documents over tasks
    return fps.join(named, "fp")


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component, of its smallest doc_id; rows without a doc_id stay."""
    common.ship(docs.sparkSession)
    rows, scan = common.numbered(docs)
    own = scan.where("doc_id is not null").select("doc_id", F.col("doc.text").alias("text"), "part", "row")
    found = _named(own, ", part int, row long", shingle)
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "part", "row")).alias("it")).select("it.part", "it.row")
    return common.chosen(rows, first, docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
