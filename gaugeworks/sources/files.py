"""Readers and writers: typed CSV, yearly Parquet, nested case records, JSON lines, manifests, resumable stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str]) -> DataFrame:
    """All columns as declared strings; nothing is inferred, short rows get nulls."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(strings(*columns)).csv(paths)


def parquet_years(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Folders of different years by column name; a column that a year lacks is null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


EVENT = T.StructType([T.StructField(n, t) for n, t in (("op", T.StringType()), ("status", T.StringType()), ("client", T.StringType()), ("key", T.StringType()), ("version", T.LongType()), ("write_id", T.StringType()))])
CASE = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("property", T.StringType()), T.StructField("history", T.ArrayType(EVENT))])


def case_events(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Nested case records (one JSON document per file) to one row per event, by its place in the history."""
    cases = spark.read.schema(CASE).option("multiLine", True).json(paths)
    return cases.select("case_id", "property", F.posexplode("history").alias("idx", "e")).select("case_id", "property", "idx", "e.*")


def json_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return spark.read.json(paths)


TRAJECTORY = T.StructType([T.StructField("name", T.StringType()), T.StructField("property", T.StringType()), T.StructField("steps", T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("client", T.StringType())])))])


def validated_trajectories(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a column `value` of JSON: bad lack a name, a property, steps, or a step's op."""
    t = texts.withColumn("t", F.from_json("value", TRAJECTORY))
    good = F.coalesce((F.length("t.name") > 0) & (F.length("t.property") > 0) & (F.size("t.steps") > 0) & ~F.exists("t.steps", lambda s: s["op"].isNull()), F.lit(False))
    return t.where(good).select("t.*"), t.where(~good).select("value")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """name, sha256 of each folder below `folder`: of its files' digests in their order of size and digest.

    A file is a row and is digested where it is read; no task holds more than one file."""
    each = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    parts = each.select(F.element_at(F.split("path", "/"), -2).alias("name"), F.struct("length", F.sha2("content", 256).alias("d")).alias("f"))
    return parts.groupBy("name").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("f"))).cast("binary"), 256).alias("sha256"))


def against(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Digests (name, sha256) against a manifest (name, sha256): ok, changed, missing or unlisted."""
    j = found.select("name", F.col("sha256").alias("have")).join(manifest, "name", "full")
    return j.select("name", F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("have") == F.col("sha256"), "ok").otherwise("changed").alias("state"))


def manifest_check(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Single files against a manifest of their names."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return against(found, manifest)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """For small ordered summaries: one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def resume(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table if it was written to the end before, else made, written and read back."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
