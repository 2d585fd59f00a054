"""A folder that driver and executors share, for stages that are written and read back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gaugeworks-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/gaugeworks/{name}-{uuid.uuid4().hex[:12]}"
    _folders.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written once and scanned by all that follows: a plan that uses it many times doesn't make it as often."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recorded():
    """Collects what is written inside the block; give it to release() once what reads it is written."""
    held: list[tuple[SparkSession, str]] = []
    before = len(_folders)
    yield held
    held += _folders[before:]


def release(held: list[tuple[SparkSession, str]]) -> None:
    """Delete these folders now."""
    while held:
        entry = held.pop()
        if entry in _folders:
            _folders.remove(entry)
            delete(*entry)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    """Delete what was written so far; call it once what reads it is written."""
    while _folders:
        delete(*_folders.pop())


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the sessions may be gone by now; then their owner cleans the folder
        clean()


atexit.register(_at_exit)
