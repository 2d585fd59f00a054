"""Tokens per document from flat token files without an index (operator 1).

A file is only ids, one document after the other, each closed by an end-of-document id; it is cut
into blocks of a fixed number of ids wherever they fall.  Every block is searched on its own with
numpy; a document that runs over block borders is stitched by a prefix scan over block summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokenizer

BLOCK_IDS = 1 << 18


def _flat(path: str, end_id: int, block_ids: int):
    schema = pa.schema([("file_no", pa.int64()), ("block_no", pa.int64()), ("ids", pa.binary()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer.chunk_ids(path, specials_are_text=True)
        part, no, first, left = TaskContext.get().partitionId(), 0, 0, np.zeros(0, "<u2")
        for batch in batches:
            for row, ids, counts in ids_of.batch(batch.column(1)):
                flat = np.concatenate([left, np.insert(ids, np.cumsum(counts), end_id).astype("<u2")])
                full = len(flat) // block_ids
                for k in range(full):
                    yield pa.record_batch([[part], [no + k], [flat[k * block_ids : (k + 1) * block_ids].tobytes()], [None], [None]], schema=schema)
                no, left = no + full, flat[full * block_ids :]
                docs = batch.column(0).slice(row, len(counts)).to_pylist()
                yield pa.record_batch([[part], [None], [None], [first], [docs]], schema=schema)
                first += len(docs)
        if len(left):
            yield pa.record_batch([[part], [no], [left.tobytes()], [None], [None]], schema=schema)

    return run


def write(docs: DataFrame, path: str, end_id: int = 49407, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """(flat files: file_no, block_no, ids; which documents a file holds, in order: file_no, first, doc_ids).

    Control strings inside a text are encoded as ordinary text, so end_id closes documents only."""
    common.ship(docs.sparkSession)
    flat = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_flat(path, end_id, block_ids), "file_no long, block_no long, ids binary, first long, doc_ids array<long>")
    table = common.write_table(flat, "flat-tokens")
    return table.where("block_no is not null").select("file_no", "block_no", "ids"), table.where("first is not null").select("file_no", "first", "doc_ids")


def _scan(end_id: int):
    schema = pa.schema([("file_no", pa.int64()), ("block_no", pa.int64()), ("lengths", pa.list_(pa.int64())), ("tail", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, tails = [], []
            for ids in batch.column("ids").to_pylist():
                block = np.frombuffer(ids, "<u2")
                ends = np.flatnonzero(block == end_id)
                lengths.append(np.diff(ends, prepend=-1) - 1)
                tails.append(len(block) - 1 - int(ends[-1]) if len(ends) else len(block))
            yield pa.record_batch([batch.column("file_no"), batch.column("block_no"), pa.array(lengths, pa.list_(pa.int64())), pa.array(tails, pa.int64())], schema=schema)

    return run


def count(blocks: DataFrame, end_id: int = 49407) -> DataFrame:
    """file_no, ordinal (from 0 in its file), n_tokens (without the end id), closed.

    Ids after a file's last end id are one more row with closed = false.  A file of no blocks gives
    no rows; an empty document counts 0."""
    found = blocks.mapInArrow(_scan(end_id), "file_no long, block_no long, lengths array<long>, tail long")
    order = Window.partitionBy("file_no").orderBy("block_no")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.size("lengths")
    # carry: ids since the last end id in an earlier block = tails up to here less tails before that block
    scanned = (
        found.withColumn("seps_before", F.coalesce(F.sum(ends).over(earlier), F.lit(0)))
        .withColumn("tails", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
        .withColumn("carry", F.col("tails") - F.coalesce(F.last(F.when(ends > 0, F.col("tails")), ignorenulls=True).over(earlier), F.lit(0)))
        .withColumn("final", F.lead("block_no").over(order).isNull())
    )
    closed = scanned.select("file_no", "seps_before", "carry", F.posexplode("lengths").alias("k", "n")).select("file_no", (F.col("seps_before") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = F.col("tail") + F.when(ends == 0, F.col("carry")).otherwise(0)
    open_end = scanned.where(F.col("final") & (rest > 0)).select("file_no", (F.col("seps_before") + ends).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_end)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by word_bpe_49k: doc_id, n_tokens, found again in the flat files.

    Null and empty texts count 0; repeated rows and null doc_ids give a row each."""
    blocks, held = write(common.documents(spark, sf_dir), tokenizer.vocabulary())
    docs = held.select("file_no", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file_no", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return docs.join(count(blocks), ["file_no", "ordinal"]).select("doc_id", "n_tokens")
