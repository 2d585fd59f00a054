"""What the training-data operators share: shipping code, scratch tables, readers."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that a Python worker gets at a time; rows alone would not bound it.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20

_scratch: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, by Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.join(name, os.path.relpath(p, top)))
    path = os.path.join(tempfile.mkdtemp(prefix="gaugeworks-"), f"{name}.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    sc.addPyFile(path)
    if not sc.getConf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="gaugeworks-shared-")
    spark.conf.set("spark.checkpoint.dir", "file://" + path)
    return "file://" + path


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/gaugeworks/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def recorded():
    """Collects what is written to the shared folder inside the block; give it to release() once what reads it is written."""
    held: list[tuple[SparkSession, str]] = []
    tables, paths = len(_tables), len(_scratch)
    yield held
    held += [*_tables[tables:], *_scratch[paths:]]


def release(held: list[tuple[SparkSession, str]]) -> None:
    """Drop these tables and delete these folders now."""
    while held:
        entry = held.pop()
        for every in (_tables, _scratch):
            if entry in every:
                every.remove(entry)
                if entry[0].sparkContext._jsc is None:  # stopped: its owner cleans the folder
                    continue
                entry[0].sql(f"DROP TABLE IF EXISTS {entry[1]}") if every is _tables else delete(*entry)


def unread(held: list[tuple[SparkSession, str]], out: DataFrame) -> list[tuple[SparkSession, str]]:
    """Of what was written, what out's plan doesn't read (by the folders' names, which no other folder has)."""
    read = {part for f in out.inputFiles() for part in f.split("/")[-4:-1]}
    marks = {m.rsplit("-", 1)[-1] for m in read}
    return [e for e in held if e[1].rsplit("-", 1)[-1].rsplit("_", 1)[-1] not in marks]


def clean_scratch() -> None:
    """Delete the scratch tables written so far; call it once what reads them is written."""
    while _tables:
        spark, name = _tables.pop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _scratch:
        delete(*_scratch.pop())


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the sessions may be gone by now; then their owner cleans the folder
        clean_scratch()


atexit.register(_at_exit)


def write_table(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and return a scan of what was written.

    A lost executor costs its running tasks only; nothing written is lost with it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.option("compression", codec)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, *then: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """df as a table bucketed by a column of which each task has whole values only: nothing is shuffled, and later joins by it
    move no row of df.  The second is a plain scan of the same files."""
    spark = df.sparkSession
    path = scratch_path(spark, "buckets")
    name = "gaugeworks_" + path.rsplit("-", 1)[1]
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, by).sortBy(by, *then).saveAsTable(name)
    _tables.append((spark, name))
    return spark.table(name), spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """part, row, doc_id (long), doc (all columns of docs, of any names), twice: bucketed by part, so that decisions join by
    (part, row) where the texts lie; and as a plain scan, whose splits are even, for passes without a join."""
    spark = docs.sparkSession
    at = F.monotonically_increasing_id()
    rows = docs.select(F.shiftright(at, 33).cast("int").alias("part"), at.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return bucketed(rows, "part", "row", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))


def chosen(rows: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """Of numbered rows those in kept (part, row) and those without a doc_id, with docs' columns."""
    named = rows.hint("shuffle_merge").join(kept.select("part", "row", F.lit(True).alias("kept")), ["part", "row"], "left").where("kept or doc_id is null")
    return named.select(*(F.col(f"doc.`{c}`").alias(c) for c in columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes of all texts: one pass over the lengths."""
    row = df.agg(F.sum(F.octet_length("text")).alias("n")).first()
    return int(row["n"] or 0)
