"""Best-fit packing of documents into sequences of a fixed length (operator 9).

Hierarchical residual packing: every partition cuts its documents into pieces and packs them
best-fit, longest first.  A bin that later rounds cannot use is emitted at once; the few that
remain go up a tree of groups as items of their own, and each group packs them best-fit again.

How few remain is bounded without loss.  Best-fit leaves at most one bin of half the length or
less in a group, and two bins over half can never be joined.  So of n groups, each can use at
most n of its larger bins as hosts: a group carries its one small bin and its n emptiest others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenizer

#: Groups that one group of the next level takes in.
FAN_IN = 16

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("place", pa.int64())])
MOVES = pa.schema([("grp", pa.int64()), ("bin", pa.int64()), ("fill", pa.int64()), ("from_bin", pa.int64()), ("shift", pa.int64())])


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, place of each item in its bin, fill of each bin): longest items first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, places, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit f: some bin has f free
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                mask ^= 1 << f
        else:
            f, b = size, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += n
        if f > n:
            free[f - n].append(b)
            mask |= 1 << (f - n)
    return bins, places, np.array(fills, np.int64)


def carried(fills: np.ndarray, size: int, groups: int) -> np.ndarray:
    """Which bins go up: see the module's text."""
    small = np.flatnonzero(fills * 2 <= size)
    large = np.flatnonzero((fills * 2 > size) & (fills < size))
    return np.concatenate([small, large[np.argsort(fills[large], kind="stable")][:groups]])


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer.chunk_ids(path)
        part = TaskContext.get().partitionId()
        doc, piece, start, length, crc = [], [], [], [], []
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for row, ids, counts in ids_of.batch(batch.column(1)):
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for k, n in enumerate(counts.tolist()):
                    for s in range(0, n + 1, size):
                        m = min(size, n + 1 - s)
                        c = zlib.crc32(raw[4 * (at + s) : 4 * min(at + s + m, at + n)])
                        doc.append(docs[row + k])
                        piece.append(s // size)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(end, c) if s + m > n else c)
                    at += n
        if doc:
            bins, places, _ = best_fit(np.array(length, np.int64), size)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(bins + (part << 32)), pa.array(places)], schema=PIECES)

    return run


def _merge(size: int, groups: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """One group: bins as items.  A row for each carried bin of the result and for each bin that moved."""
        table = table.sort_by("bin")
        old, fill = table["bin"].to_numpy(), table["fill"].to_numpy()
        bins, places, fills = best_fit(fill, size)
        host = np.full(len(fills), -1)
        host[bins[places == 0]] = np.flatnonzero(places == 0)
        new = old[host[bins]]
        up = old[host[carried(fills, size, groups)]]
        moved = places > 0
        n, m = len(up), int(moved.sum())
        return pa.table([pa.array(np.full(n + m, key[0].as_py())), pa.array(np.concatenate([up, new[moved]])), pa.array(np.concatenate([fills[carried(fills, size, groups)], np.zeros(m, np.int64)])), pa.array([None] * n + old[moved].tolist(), pa.int64()), pa.array([None] * n + places[moved].tolist(), pa.int64())], schema=MOVES)

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents over `size` ids (their end id included) are cut.  Null and empty texts are one
    piece, the end id alone.  Repeated rows and null doc_ids are packed like any other row.  Only
    doc_id and text are read, so other columns may have any names.  An empty table gives no rows."""
    spark = docs.sparkSession
    common.ship(spark)
    local = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path, end_id, size), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long")
    placed = common.write_table(local, "pack-local")

    fills = placed.groupBy("bin").agg(F.sum("length").alias("fill")).withColumn("grp", F.shiftright("bin", 32))
    groups = placed.select(F.shiftright("bin", 32).alias("grp")).distinct().count()
    rank = F.row_number().over(_by_fill())
    small = F.col("fill") * 2 <= size
    carry = fills.where(F.col("fill") < size).withColumn("small", small).withColumn("rank", rank).where(F.col("small") | (F.col("rank") <= max(groups, 1))).select("grp", "bin", "fill")
    moves: DataFrame | None = None
    level = common.write_table(carry, "pack-carry")
    while groups > 1:
        groups = -(-groups // FAN_IN)
        dense = level.select("grp").distinct().withColumn("next", F.dense_rank().over(_all_groups()) - 1)
        up = level.join(dense, "grp").select(F.floor(F.col("next") / FAN_IN).alias("grp"), "bin", "fill")
        out = common.write_table(up.groupBy("grp").applyInArrow(_merge(size, groups), "grp long, bin long, fill long, from_bin long, shift long"), "pack-round")
        step = out.where("from_bin is not null").select("from_bin", F.col("bin").alias("to_bin"), "shift")
        moves = step if moves is None else _then(moves, step)
        level = out.where("from_bin is null").select("grp", "bin", "fill")
    if moves is None:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    p = placed.join(moves.withColumnRenamed("from_bin", "bin"), "bin", "left")
    return p.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to_bin", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _by_fill():
    from pyspark.sql import Window

    return Window.partitionBy("grp", "small").orderBy("fill", "bin")


def _all_groups():
    """Over the group numbers alone: one row per partition of the input."""
    from pyspark.sql import Window

    return Window.orderBy("grp")


def _then(first: DataFrame, then: DataFrame) -> DataFrame:
    """The moves of `first` followed by those of `then`."""
    t = then.select(F.col("from_bin").alias("f"), F.col("to_bin").alias("t"), F.col("shift").alias("s"))
    on = first.join(t, F.col("to_bin") == F.col("f"), "left")
    return on.select("from_bin", F.coalesce("t", "to_bin").alias("to_bin"), (F.col("shift") + F.coalesce("s", F.lit(0))).alias("shift")).unionByName(then)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, word_bpe_49k ids and end id 0, sequences of at most 2048."""
    return pack(common.documents(spark, sf_dir), tokenizer.vocabulary())
