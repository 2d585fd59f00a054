"""Size-tiered compaction of immutable shards under versioned manifests (operator 3), in DataFrame functions only.

Arrivals are appended as small Parquet files that are never changed.  Compaction reads the shards of a
tier (of similar size) together and writes them as files of a target size: a merge is a scan, a
coalesce and a write, and nothing is shuffled.  It is repeated until no tier has enough small shards.

What a reader sees is decided by the newest version alone.  The shards of a version are a table; the
version itself is one small file that names this table, written aside and put in its place by an
operation that fails if another writer was there first: a hard link on a local file system, a rename
without overwriting elsewhere (HDFS does it atomically; a store without an atomic rename needs a
conditional put here).  A job that dies leaves files that no version names.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TARGET_BYTES = 64 << 20
#: A shard's tier: how many times its size can be divided by this, from SMALLEST on.
TIER_FACTOR = 4
SMALLEST = 64 << 10
#: Shards of one tier that make a merge worthwhile.
LEAST_RUN = 4
#: Arrivals of a table that is sharded as a whole.
WAVES = 8
#: Files that a task keeps open when it writes in waves; of more waves it sorts its rows.
MOST_WAVES = 64
SPLITS = "spark.sql.files.maxPartitionBytes"
#: A shard in the path of one of its files: the folder, or one of the folders that a write in waves made, and the file.
_NAME = r"([^/]+(?:/[^/=]+=[^/]+)?/[^/]+)$"
#: folder and in_folder: where a shard was written, and how many were written there; level: how many merges made it.
MANIFEST = "shard string, folder string, in_folder long, level int, bytes long, rows long"


class ShardStore:
    """A folder with data/ (a folder of shards for each write), tables/ (of shards) and versions/ (a file for each)."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.target = spark, target_bytes
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)
        self.path = self._fs.makeQualified(self._path(path)).toString()

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        if not self._fs.exists(self._path(f"{self.path}/versions")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/versions"))]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version."""
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], MANIFEST)
        table = self.spark.read.text(f"{self.path}/versions/{v:08d}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/tables/{table}")

    def commit(self, shards: DataFrame, based_on: int) -> int:
        """Make `shards` the next version, or fail if another writer has committed since `based_on`."""
        version, name = based_on + 1, common.uuid.uuid4().hex
        shards.select(*(c.split()[0] for c in MANIFEST.split(", "))).coalesce(1).write.parquet(f"{self.path}/tables/{name}")
        aside, final = self._path(f"{self.path}/versions/_{name}"), self._path(f"{self.path}/versions/{version:08d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                nio = self._jvm.java.nio.file
                at = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                nio.Files.createLink(at(final), at(aside))
            else:
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, final, options)
        except Exception as e:
            if not self._fs.exists(final):
                raise
            common.delete(self.spark, f"{self.path}/tables/{name}")
            raise RuntimeError(f"version {version} is committed already; read it and try again") from e
        finally:
            self._fs.delete(aside, False)
        return version

    def _write(self, rows: DataFrame, kind: str, level: int, wave: str | None = None) -> DataFrame:
        """Write rows as shards: their rows of a manifest.  Sizes come from the file system and counts from footers.

        With wave, a column of rows, each of its values gets a folder of its own and isn't stored."""
        name = f"{kind}-{common.uuid.uuid4().hex[:12]}"
        w = rows.write.option("compression", "zstd")
        if wave:
            with self._set("spark.sql.maxConcurrentOutputFileWriters", str(MOST_WAVES)):  # else each task would sort its texts by wave
                w.partitionBy(wave).parquet(f"{self.path}/data/{name}")
        else:
            w.parquet(f"{self.path}/data/{name}")
        held = rows.drop(wave) if wave else rows
        own = lambda path: F.regexp_extract(path, _NAME, 1)
        files = self.spark.read.schema(held.schema).option("recursiveFileLookup", True).parquet(f"{self.path}/data/{name}")
        counts = files.select(own(F.input_file_name()).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
        sizes = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/data/{name}").select(own(F.col("path")).alias("shard"), F.col("length").alias("bytes"))
        folder = F.regexp_extract("shard", "^(.*)/[^/]+$", 1)
        shards = counts.join(sizes, "shard").withColumn("folder", folder)
        return shards.select("shard", "folder", F.count(F.lit(1)).over(Window.partitionBy("folder")).alias("in_folder"), F.lit(level).alias("level"), "bytes", "rows")

    def append(self, rows: DataFrame) -> int:
        """Write rows as new small shards and commit them."""
        based_on = self.version()
        return self.commit(self.manifest(based_on).unionByName(self._write(rows, "arrived", 0)), based_on)

    def append_waves(self, rows: DataFrame, wave: str) -> int:
        """Write rows once, commit the shards of each value of the column `wave` as a version of its own, in their order, and compact after each."""
        shards = common.write_table(self._write(rows, "arrived", 0, wave), "arrived")
        version = self.version()
        for r in shards.select("folder").distinct().orderBy(F.regexp_extract("folder", "=(.*)$", 1).cast("long")).collect():  # a row per wave
            version = self.commit(self.manifest(version).unionByName(shards.where(F.col("folder") == r["folder"])), version)
            version = self.compact_all()
        return version

    def plan(self, shards: DataFrame) -> DataFrame:
        """shards with `merge`: the tier in which each is merged (null: it stays), over manifest rows only."""
        tier = F.floor(F.log(F.greatest(F.col("bytes") / SMALLEST, F.lit(1.0))) / F.log(F.lit(float(TIER_FACTOR)))).cast("int")
        small = F.when(F.col("bytes") < self.target / 2, tier)
        t = shards.withColumn("small", small).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("small")))
        return t.withColumn("merge", F.when(F.col("n") >= LEAST_RUN, F.col("small"))).drop("small", "n")

    def compact(self) -> int:
        """One merge of each tier that has LEAST_RUN small shards; the same version if none has.  Old shards stay for readers of old versions (vacuum() deletes them)."""
        based_on = self.version()
        now = common.write_table(self.plan(self.manifest(based_on)), "shard-plan")
        tiers = now.where("merge is not null").groupBy("merge").agg(F.sum("bytes").alias("bytes"), F.max("level").alias("level")).orderBy("merge").collect()  # a row per tier
        if not tiers:
            return based_on
        kept = now.where("merge is null").drop("merge")
        for t in tiers:
            rows = self._scan(now.where(F.col("merge") == t["merge"]))
            # a merge can't write more files than it has splits
            with self._set(SPLITS, str(min(self.target, self._bytes(self.spark.conf.get(SPLITS))))):
                kept = kept.unionByName(self._write(rows.coalesce(max(1, -(-t["bytes"] // self.target))), "merged", t["level"] + 1))
        return self.commit(kept, based_on)

    @contextlib.contextmanager
    def _set(self, name: str, value: str):
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, value)
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _bytes(self, text: str) -> int:
        return int(self._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))

    def compact_all(self) -> int:
        """Compact until no tier is worth it."""
        version = self.version()
        while (now := self.compact()) != version:
            version = now
        return version

    def _scan(self, shards: DataFrame, named: bool = False) -> DataFrame:
        """The rows of the shards (with named, as columns row and shard).

        Folders of which all shards are asked for are read as folders, others by their shards' files: the driver sees a row for
        each write, and one for each shard of a write that is merged in part."""
        folders = shards.groupBy("folder").agg((F.count(F.lit(1)) == F.first("in_folder")).alias("whole")).collect()
        if not folders:
            raise ValueError("the store has no shards")
        whole, cut = ([f["folder"] for f in folders if f["whole"] == w] for w in (True, False))
        paths = [*whole, *(r["shard"] for r in shards.where(F.col("folder").isin(cut)).select("shard").collect())] if cut else whole
        schema = self.spark.read.parquet(f"{self.path}/data/{folders[0]['folder']}").schema
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{p}" for p in paths))
        return rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.regexp_extract(F.input_file_name(), _NAME, 1).alias("shard")) if named else rows

    def read(self, version: int | None = None, named: bool = False) -> DataFrame:
        """The rows of a version; with named, as columns row (a struct) and shard."""
        return self._scan(self.manifest(version), named)

    def vacuum(self, keep: int) -> None:
        """Delete the folders of shards that only versions before `keep` name."""
        live = self.manifest(keep)
        for v in range(keep + 1, self.version() + 1):
            live = live.unionByName(self.manifest(v))
        names = {r["folder"].split("/")[0] for r in live.select("folder").distinct().collect()}  # a row for each write
        for s in self._fs.listStatus(self._path(f"{self.path}/data")):
            if s.getPath().getName() not in names:
                self._fs.delete(s.getPath(), True)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written once and appended in waves, a version each, compacted after each wave until nothing is worth merging, and read through
    the newest version: doc_id, source, n_chars, text_sha256, shard_bytes, shard_rows, level, version.

    Null texts give a null digest; repeated rows stay repeated; an empty table gives no rows."""
    docs = common.documents(spark, sf_dir)
    store = ShardStore(spark, common.scratch_path(spark, "shards"))
    return sharded(docs, store)


def sharded(docs: DataFrame, store: ShardStore, waves: int = WAVES) -> DataFrame:
    wave = f"wave_{common.uuid.uuid4().hex[:12]}"
    version = store.append_waves(docs.withColumn(wave, F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(waves))), wave)
    none = docs.limit(0).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.lit(None).cast("string").alias("shard"))
    rows = (none if store.manifest(version).isEmpty() else store.read(version, named=True)).select("row.doc_id", "row.source", "row.n_chars", F.sha2("row.text", 256).alias("text_sha256"), "shard")
    named = store.manifest(version).select("shard", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "level")
    return rows.join(named, "shard").drop("shard").withColumn("version", F.lit(version).cast("long"))
