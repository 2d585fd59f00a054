"""A Merkle manifest of a dataset whose leaves know their witnesses (operator 11).

A row is a leaf.  The leaves of a source, by ascending doc_id, are the leaves of a tree: every 16
consecutive nodes of a level become one node of the next, the last run of a level with what is
left.  The trees' roots, by source, are the leaves of one more tree, whose root stands for the
dataset.  A leaf's witness is what stands beside it on the way up: with it and the root, the leaf
can be verified alone.

A tree grows by appending (`Tree`): each node of an unfinished run holds the witnesses, as far as
they go, of the leaves below it, and the sibling that completes the run extends them.  On Spark
a source's leaves are cut into aligned blocks of 16^LEVELS; a task appends a block's leaves and
keeps the block's root, and the roots of blocks are appended in turn, as the leaves of further blocks,
until one is left.  What the upper trees say of a block's root is the last part of its leaves'
witnesses.  No task holds more than a block, however large a source is.

Rows are put in order by ranges of (source, doc_id, leaf), of which hot sources get many.  Of each
range only its first and last source and their counts go to the driver (a row per task); from
these every row knows its place in its source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FANOUT = 16
#: Levels of a block: 256 leaves.
LEVELS = 2
#: A leaf's columns, in the order in which they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """Leaves are appended; a completed run of 16 becomes a node one level up and extends the witnesses below it.

    `witness[i]` of leaf i is a list of texts, two a level: the siblings left of it, joined, and those right of it."""

    def __init__(self, levels: int):
        self.open: list[list[tuple[str, list[int]]]] = [[] for _ in range(levels + 1)]
        self.witness: list[list[str]] = []

    def append(self, leaf: str) -> None:
        self.witness.append([])
        self._put(0, leaf, [len(self.witness) - 1])

    def _put(self, level: int, node: str, leaves: list[int]) -> None:
        run = self.open[level]
        run.append((node, leaves))
        if len(run) == FANOUT and level + 1 < len(self.open):
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, leaves) in enumerate(run):
            beside = ["".join(nodes[:i]), "".join(nodes[i + 1 :])]
            for leaf in leaves:
                self.witness[leaf] += beside
        self._put(level + 1, digest("".join(nodes)), [leaf for _, leaves in run for leaf in leaves])

    def close(self, whole: bool) -> str:
        """The root.  whole: up to the last level, as other blocks stand beside this one; else until one node is left."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                if not whole and len(self.open[level]) == 1 and not any(self.open[level + 1 :]):
                    return self.open[level][0][0]
                self._complete(level)
        return self.open[-1][0][0]


def fold(leaf: str, witness: list[str]) -> str:
    """The root that a leaf and its witness lead to."""
    for left, right in zip(witness[::2], witness[1::2], strict=True):
        leaf = digest(left + leaf + right)
    return leaf


def folded(leaf: Column, witness: Column) -> Column:
    """The same as a column."""
    levels = F.sequence(F.lit(1), F.floor(F.size(witness) / 2).cast("int"))
    levels = F.when(F.size(witness) > 0, levels).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, leaf, lambda now, i: F.sha2(F.concat(F.element_at(witness, 2 * i - 1), now, F.element_at(witness, 2 * i)), 256))


def _place(df: DataFrame, order: list[str]) -> DataFrame:
    """df (grp and more; written before) with pos, a row's rank in its grp by `order`, nulls first; rows that are equal in it in any order."""
    spark = df.sparkSession
    schema = T.StructType([*df.schema, T.StructField("part", T.IntegerType()), T.StructField("idx", T.LongType())])
    by = [F.col("grp").asc(), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = common.write_table(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_ranks, schema), "leaves")
    ends = ranged.groupBy("part").agg(F.min("grp").alias("first"), F.max(F.struct("grp", "idx")).alias("last")).orderBy("part").collect()  # a row per task
    starts, grp, total = [], None, 0
    for e in ends:
        start = total if e["first"] == grp else 0
        if start:
            starts.append((e["part"], e["first"], start))
        total = e["last"]["idx"] + 1 + (start if e["last"]["grp"] == e["first"] else 0)
        grp = e["last"]["grp"]
    before = spark.createDataFrame(starts, "part int, grp string, start long")
    placed = ranged.join(F.broadcast(before), ["part", "grp"], "left")  # a row per task at most
    return placed.select(*(c for c in df.columns), (F.col("idx") + F.coalesce("start", F.lit(0))).alias("pos"))


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    part = TaskContext.get().partitionId()
    grp, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column("grp").dictionary_encode()
        codes = runs.indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        lengths = np.diff(np.append(starts, len(codes)))
        idx = np.arange(len(codes)) - np.repeat(starts, lengths)
        if runs.dictionary[int(codes[0])].as_py() == grp:
            idx[: lengths[0]] += n
        grp, n = runs.dictionary[int(codes[-1])].as_py(), int(idx[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(idx)], names=[*batch.schema.names, "part", "idx"])


def _roots(levels: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block = Tree(levels), key[1].as_py()
        for leaf in rows.sort_by("pos")["node"].to_pylist():
            tree.append(leaf)
        return pa.table({"grp": [key[0].as_py()], "pos": pa.array([block], pa.int64()), "node": [tree.close(block > 0)]})

    return run


def _witnesses(levels: int, keep: list[str]):
    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, tree = rows.sort_by("pos"), Tree(levels)
        for leaf in rows["node"].to_pylist():
            tree.append(leaf)
        tree.close(key[1].as_py() > 0)
        rest, *roots = (above[c][0].as_py() for c in ("witness", "base", "top"))
        every = [pa.array([root] * len(tree.witness), pa.string()) for root in roots]
        return pa.table([*(rows[c] for c in keep), pa.array([w + rest for w in tree.witness], pa.list_(pa.string())), *every], names=[*keep, "witness", "base", "top"])

    return run


def witnesses(nodes: DataFrame, levels: int, over=None) -> DataFrame:
    """nodes (grp, pos from 0 in each grp, node, and more) with each row's witness, base (the root of its tree) and top.

    over(roots), of grp and node, gives what a tree over the trees' roots says: grp, witness, top; without it top is base."""
    block = F.expr(f"pos div {FANOUT**levels}")
    placed = nodes.withColumn("block", block)
    roots = common.write_table(placed.groupBy("grp", "block").applyInArrow(_roots(levels), "grp string, pos long, node string"), "roots")
    if not roots.where("pos > 0").isEmpty():
        upper = witnesses(roots, levels, over).withColumnRenamed("pos", "block")
    elif over:
        upper = roots.withColumnRenamed("pos", "block").join(over(roots.select("grp", "node")), "grp").withColumn("base", F.col("node"))
    else:
        upper = roots.select("grp", F.col("pos").alias("block"), F.array().cast("array<string>").alias("witness"), F.col("node").alias("base"), F.col("node").alias("top"))
    keep = list(nodes.columns)
    schema = T.StructType([*nodes.schema, T.StructField("witness", T.ArrayType(T.StringType())), T.StructField("base", T.StringType()), T.StructField("top", T.StringType())])
    return placed.groupBy("grp", "block").cogroup(upper.select("grp", "block", "witness", "base", "top").groupBy("grp", "block")).applyInArrow(_witnesses(levels, keep), schema)


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row of documents: each column `-` if null, else its UTF-8 byte count, `:`, value."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*(field(text if c == "text" and text is not None else F.col(c)) for c in COLUMNS)), 256)


def manifest(docs: DataFrame, levels: int = LEVELS, **more: Column) -> DataFrame:
    """One row per row of docs: doc_id, source, leaf, `more`, pos (place in its source), witness (see Tree), subroot, root.

    A null source is a source of its own, before the others.  Null doc_ids come first in their source; of equal doc_ids the
    smaller leaf comes first, and equal rows are leaves of their own.  Null and empty texts are different leaves.  An empty
    table has no rows.  Columns other than the five and those in `more` aren't read."""
    common.ship(docs.sparkSession)
    grp = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first, then by bytes
    narrow = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("node"), *(c.alias(n) for n, c in more.items()))
    leaves = _place(common.write_table(narrow, "rows"), ["doc_id", "node"])

    def over(roots: DataFrame) -> DataFrame:
        """The tree over the sources' roots: one group, by source."""
        rows = common.write_table(roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node"), "subroots")
        return witnesses(_place(rows, ["of"]), levels).select(F.col("of").alias("grp"), "witness", "top")

    found = witnesses(leaves.withColumn("leaf", F.col("node")), levels, over)
    source = F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1))
    return found.select("doc_id", source.alias("source"), "leaf", *more, "pos", "witness", F.col("base").alias("subroot"), F.col("top").alias("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and witness digest, and whether a partly tampered table folds to the same root."""
    docs = common.documents(spark, sf_dir)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(hit, leaf(F.translate("text", upper, lower)))
    m = manifest(docs, changed=changed)
    seen = m.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("witness")))
    return seen.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("witness", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    """The same in SQL: levels by recursion, crc32 by steps over bytes and bits."""
    every = ", ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in COLUMNS)
    lower = every.replace("strlen(cast(text as varchar))", "strlen(text)").replace("':' || text", "':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

    def tree(name: str, leaves: str) -> str:
        """leaves: grp, pos, node.  The nodes of all levels, and the heights."""
        return f"""
{name}_h as (select grp, (select min(h) from range(0, 16) t(h) where 16 ** h >= n) as h from (select grp, count(*) as n from {leaves} group by grp)),
{name}(grp, level, pos, node) as (
  select grp, 0, pos, node from {leaves}
  union all
  select grp, level + 1, pos // 16, sha256(string_agg(node, '' order by pos)) from {name} join {name}_h using (grp) where level < h group by grp, level, pos // 16),
{name}_beside as (
  select l.grp, l.pos, n.level, coalesce(string_agg(n.node, '' order by n.pos) filter (n.pos < l.pos // 16 ** n.level), '') as lft,
         coalesce(string_agg(n.node, '' order by n.pos) filter (n.pos > l.pos // 16 ** n.level), '') as rgt
  from {leaves} l join {name}_h using (grp) join {name} n on n.grp = l.grp and n.level < h and n.pos // 16 = l.pos // cast(16 ** (n.level + 1) as bigint)
  group by all)""".replace("16 ** n.level)", "cast(16 ** n.level as bigint))")

    return f"""
with recursive d as (
  select doc_id, coalesce('=' || source, '') as grp, sha256(concat({every})) as leaf,
         xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, b: case when b < 0 then xor(a >> 1, 3988292384 * (a & 1)) else xor(a, b) end), 4294967295) as crc,
         sha256(concat({lower})) as lowered
  from documents),
leaves as (select *, leaf as node, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos from d),{tree("s", "leaves")},
tops as (select s.grp as source, '' as grp, node, row_number() over (order by s.grp) - 1 as pos from s join s_h using (grp) where level = h),{tree("t", "tops")},
beside as (
  select l.grp, l.pos, b.level, lft, rgt from leaves l join s_beside b using (grp, pos)
  union all
  select l.grp, l.pos, 100 + b.level, lft, rgt from leaves l join tops on tops.source = l.grp join t_beside b on b.pos = tops.pos),
steps as (select grp, pos, row_number() over (partition by grp, pos order by level) as step, lft, rgt from beside),
f(grp, pos, step, now) as (
  select grp, pos, 0::bigint, case when crc % 5 = 0 then lowered else leaf end from leaves
  union all
  select f.grp, f.pos, f.step + 1, sha256(lft || now || rgt) from f join steps on steps.grp = f.grp and steps.pos = f.pos and steps.step = f.step + 1),
ends as (select grp, pos, arg_max(now, step) as folded_root from f group by 1, 2),
proof as (select grp, pos, sha256(string_agg(lft || rgt, '' order by step)) as proof_sha256 from steps group by 1, 2),
root as (select node as root from t join t_h using (grp) where level = h)
select doc_id, leaf, tops.node as subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from leaves l join tops on tops.source = l.grp join ends e on e.grp = l.grp and e.pos = l.pos left join proof p on p.grp = l.grp and p.pos = l.pos, root"""
