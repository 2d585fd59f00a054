"""Token-id files in a byte-aligned variable-length code (operator 6).

Ids are ranked by how often they occur in the corpus, so that frequent ids are small numbers.  A
rank takes one to four bytes; the lengths of four ranks stand in one control byte, and control
bytes and data bytes are separate streams.  Reading is a table lookup in numpy: control byte ->
four lengths, rank -> id.

A file is a range of the documents in ascending doc_id order, a sequence of blocks of whole documents,
kept as rows (file_no, block_no, doc ids, counts, control, data) of a Parquet table, so Spark's
committer makes the write all or nothing and any executor can read any block.  Spark's range
partitioning deals the files: documents of one doc_id, or of none, are told apart by their counts,
contents and rows, so any number of them still spreads over files.  Every document is padded with rank 0 to a
multiple of four ids, so that the streams of documents can be joined as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokenizer

BLOCK_IDS = 1 << 16
FILE_IDS = 16 << 20
#: Ids below this: what two bytes can name.  Bounds the frequency table that the driver holds.
ID_LIMIT = 1 << 16

#: control byte -> byte lengths of its four numbers
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers; their count must be a multiple of four."""
    n = np.ascontiguousarray(numbers, "<u4")
    extra = (n > 0xFF).astype(np.uint8) + (n > 0xFFFF) + (n > 0xFFFFFF)
    quads = extra.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = n.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokens(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer.chunk_ids(path)
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for row, ids, counts in ids_of.batch(batch.column(1)):
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u2").tobytes())
                rows = [bytes(raw[2 * (e - n) : 2 * e]) + end for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(row, len(rows)), pa.array(counts + 1), pa.array(rows, pa.binary())], schema=schema)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ID_LIMIT, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=ID_LIMIT) if len(ids.as_buffer()) > 1 << 16 else 0
        small = b"".join(x.as_py() for x in batch.column(0) if len(x.as_buffer()) <= 1 << 16)
        total += np.bincount(np.frombuffer(small, "<u2"), minlength=ID_LIMIT)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])


BLOCKS = pa.schema([("file_no", pa.int32()), ("block_no", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def _blocks(rank_of: np.ndarray, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, no, docs, counts, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def coded() -> pa.RecordBatch:
            n = np.array(counts, np.int64)
            padded = n + -n % 4
            numbers = np.zeros(int(padded.sum()), np.uint32)
            at = np.repeat(np.cumsum(padded) - padded - (np.cumsum(n) - n), n) + np.arange(held)
            numbers[at] = rank_of[np.frombuffer(b"".join(ids), "<u2")]
            control, data = encode(numbers)
            return pa.record_batch([[file_no], [no], [held], [docs], [counts], [control], [data]], schema=BLOCKS)

        for batch in batches:
            for doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs.append(doc)
                counts.append(n)
                ids.append(raw)
                held += n
                if held >= block_ids:
                    yield coded()
                    no, docs, counts, ids, held = no + 1, [], [], [], 0
        if docs:
            yield coded()

    return run


def write(docs: DataFrame, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> tuple[DataFrame, np.ndarray]:
    """(the written blocks, rank -> id).

    Files follow each other, and documents inside a file, in ascending doc_id order: null doc_ids
    first, repeated ids in the order of their counts and contents.  Null and empty texts are the end
    id alone.  Only doc_id and text are read.  An empty table gives no blocks."""
    spark = docs.sparkSession
    common.ship(spark)
    tokens = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokens(path, end_id), "doc_id long, n_tokens long, ids binary")
    tokens = common.write_table(tokens.withColumn("hash", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id()), "tokens")
    counted = tokens.select("ids").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # ID_LIMIT rows at most
    id_of = np.array([r["id"] for r in sorted(counted, key=lambda r: (-r["n"], r["id"]))], "<u4")
    rank_of = np.zeros(ID_LIMIT, "<u4")
    rank_of[id_of] = np.arange(len(id_of))

    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "hash", "row"]
    filed = tokens.repartitionByRange(max(1, -(-total // file_ids)), *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    blocks = filed.mapInArrow(_blocks(rank_of, block_ids), "file_no int, block_no long, n_ids long, doc_ids array<long>, counts array<long>, control binary, data binary")
    return common.write_table(blocks, "id-files"), id_of


def _opened(batch: pa.RecordBatch, id_of: np.ndarray) -> Iterator[tuple[int, int, list, np.ndarray, list[memoryview]]]:
    """(file_no, block_no, doc ids, counts, each document's ids as bytes) of each block."""
    for f, no, docs, counts, control, data in zip(*(batch.column(c).to_pylist() for c in ("file_no", "block_no", "doc_ids", "counts", "control", "data")), strict=True):
        raw = memoryview(id_of[decode(control, data)]).cast("B")
        n = np.array(counts, np.int64)
        at = np.cumsum(n + -n % 4) - (n + -n % 4)
        yield f, no, docs, n, [raw[4 * a : 4 * (a + m)] for a, m in zip(at.tolist(), counts, strict=True)]


def _read(id_of: np.ndarray, last: pa.Field, of):
    """Blocks to rows of documents, with what `of` makes of a document's ids as the last column."""
    schema = pa.schema([("file_no", pa.int32()), ("block_no", pa.int64()), ("doc_id", pa.int64()), ("in_block", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, no, docs, n, ids in _opened(batch, id_of):
                k = len(docs)
                yield pa.record_batch([pa.array([f] * k, pa.int32()), pa.array([no] * k, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([of(x) for x in ids], last.type)], schema=schema)

    return run


def read(blocks: DataFrame, id_of: np.ndarray) -> DataFrame:
    """doc_id, file_no, block_no, in_block (ids before it in its block), n_tokens, ids (little-endian unsigned 32-bit)."""
    return blocks.mapInArrow(_read(id_of, pa.field("ids", pa.binary()), bytes), "file_no int, block_no long, doc_id long, in_block long, n_tokens long, ids binary")


def digests(blocks: DataFrame, id_of: np.ndarray) -> DataFrame:
    """The same with the crc32 of the ids in their place."""
    return blocks.mapInArrow(_read(id_of, pa.field("ids_crc32", pa.int64()), zlib.crc32), "file_no int, block_no long, doc_id long, in_block long, n_tokens long, ids_crc32 long")


def starts(blocks: DataFrame) -> DataFrame:
    """file_no, block_no, before: ids in all earlier blocks.  Sums per file first; only file totals pass one window."""
    sizes = blocks.select("file_no", "block_no", "n_ids")
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file_no").agg(F.sum("n_ids").alias("n")).select("file_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("files_before"))
    inside = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(files, "file_no").select("file_no", "block_no", (F.col("files_before") + F.col("inside")).alias("before"))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by word_bpe_49k and end id 1: doc_id, start, n_tokens, ids_crc32, read from the files."""
    blocks, id_of = write(common.documents(spark, sf_dir), tokenizer.vocabulary())
    return digests(blocks, id_of).join(starts(blocks), ["file_no", "block_no"]).select("doc_id", (F.col("before") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")
