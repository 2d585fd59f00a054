"""Near-duplicates by exact Jaccard similarity of word shingles (the pipeline's near-duplicate stage).

Candidates come from operator 5's search: texts whose fingerprints its vantage-point trees link.  Fingerprints of
64 bits of pairs of similarity 0.8 differ in some ten bits, more than a search by bits can reach, so texts that share a
band of minima are candidates too: BANDS times ROWS minima of a text's shingle hashes; a pair of similarity 0.8 shares
no band with a probability of 6 in a million, of 0.85 and more below 1e-8.
Texts that are candidates over any number of steps make a cluster.  Within clusters similarity is exact,
on sets of 64-bit shingle hashes.  A task gives a link per text, not all its pairs, and finds the pairs
by their rarest shingles.  A cluster of one piece is one task.  A larger one is narrowed in turns:

1. Its first piece is sets outside its largest component so far, drawn at random where these are more than
   a piece; the others are dealt at random.  The first piece meets each of the others, so a turn sends no more
   than twice the cluster, and a task holds two pieces.  The first piece has then met all others and is done.
2. Each other set tells its rarest shingles, in an order that all tasks of the cluster share: by how often
   the first piece has a shingle, then by its hash.  A pair of similarity LEAST shares one of them.
3. Lists of the sets by such a shingle: one whose sets are all of one component has nothing left to find.
   What shares any other list, over any number of steps, is a cluster of the next turn, mostly far smaller.

Groups of near copies are joined by the first turn, since copies of each are in the first piece; the second
one holds what is close to them without being a copy against all of them.  What has more than one piece after
TURNS turns is compared by all pairs of pieces, so that no link is lost: clusters whose texts are similar to
a few texts only and hardly to each other, which no index of shingles narrows either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, simhash
from .simhash import _LOWER, SEED

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 40, 6
#: Shingles of a piece of a cluster.
PIECE = 1 << 20
#: Turns that narrow clusters of more pieces.
TURNS = 3
_draw = np.random.default_rng(SEED)
_XOR = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Different hashes, sorted; fewer words than a shingle: their sequence is the only one."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = hashes.astype(np.uint32)
    for at in range(0, len(low), 4096):
        least = np.minimum(least, ((low[None, at : at + 4096] ^ _XOR) * _TIMES).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for m in least.reshape(BANDS, ROWS).T:
        key = (key ^ m) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        sets, prints = [shingles(t) for t in texts], np.array([simhash.fingerprint(t) for t in texts], np.uint64)
        keys = np.concatenate([bands(s) for s in sets]) if sets else np.zeros(0, np.int64)
        packed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys))
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "part", "row", "key")), pa.array([len(s) for s in sets], pa.int64()), packed, pa.array(prints.view(np.int64))], names=["doc_id", "part", "row", "key", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t or b"").tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.record_batch([*(batch.column(c) for c in ("node", "cluster", "pieces", "piece")), pa.array(sets, pa.binary())], names=["node", "cluster", "pieces", "piece", "hashes"])


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the smallest row that pairs of similarity LEAST or more link it to, over any number of steps.

    Such a pair shares one of the rarest shingles of both: of n, all but the least possible overlap, and one
    more.  Only pairs that do are compared, and only while they aren't linked."""
    num, den = LEAST
    order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)), np.int64)
    size = np.array([len(sets[i]) for i in order], np.int64)
    who = np.repeat(np.arange(len(order)), size)
    _, ids, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    by = np.lexsort((ids, times[ids], who))
    ids, ends = ids[by], np.cumsum(size)
    starts = ends - size
    rare = size - -(-num * size // den) + 1
    place = np.arange(len(ids)) - starts[who]
    entries = np.flatnonzero((place < rare[who]) & (times[ids] > 1))
    entries = entries[np.argsort(ids[entries], kind="stable")]  # within a shingle, by rising size
    first = np.searchsorted(ids[entries], np.arange(len(times) + 1))
    holder = who[entries]
    limit = np.searchsorted(size * num, size * den, "right")  # rows beyond are too large to reach
    mark, group = np.zeros(len(times), bool), np.arange(len(order))
    for i in range(len(order)):
        own = ids[starts[i] : ends[i]]
        head = own[: rare[i]]
        head = head[times[head] > 1]
        if not len(head):
            continue
        met = np.unique(np.concatenate([holder[first[t] : first[t + 1]] for t in head.tolist()]))
        met = met[(met > i) & (met < limit[i])]
        met = met[group[met] != group[i]]
        mark[own] = True
        at = 0
        while at < len(met):  # a bounded number of shingles at a time
            some = met[at : at + max(1, int(np.searchsorted(np.cumsum(size[met[at:]]), PIECE)))]
            at += len(some)
            n = size[some]
            begin = np.cumsum(n) - n
            both = np.add.reduceat(mark[ids[np.repeat(starts[some] - begin, n) + np.arange(int(n.sum()))]], begin, dtype=np.int64)
            linked = np.unique(group[some[den * both >= num * (size[i] + n - both)]])
            if len(linked):
                group[np.isin(group, linked)] = group[i]
        mark[own] = False
    _, group = np.unique(group, return_inverse=True)
    least = np.full(len(order), len(order))
    np.minimum.at(least, group, order)
    root = np.empty(len(order), np.int64)
    root[order] = least[group]
    return root


def _linked(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Nodes in rising order, their sets, the smallest node that each is linked to, and where they are in the table."""
    nodes = table["node"].to_numpy()
    by = np.argsort(nodes)
    sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].take(pa.array(by)).to_pylist()]
    return nodes[by], sets, nodes[by][similar(sets)], by


def rarest(sets: list[np.ndarray], first: list[np.ndarray]) -> list[np.ndarray]:
    """Of each set the shingles of which similarity LEAST needs one in common; those that the sets of first have least often."""
    num, den = LEAST
    ids, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *first]), return_counts=True)
    found = []
    for s in sets:
        at = np.searchsorted(ids, s)
        at[at == len(ids)] = 0
        often = np.where(ids[at] == s, times[at], 0) if len(ids) else np.zeros(len(s), np.int64)
        found.append(s[np.argsort(often, kind="stable")[: len(s) - -(-num * len(s) // den) + 1]].view(np.int64))
    return found


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """Links of a cluster's only piece, or of its first and another one; of the other one all sets with their rarest shingles."""
    nodes, sets, roots, by = _linked(table)
    alone = table["pieces"][0].as_py() == 1
    own = np.zeros(len(nodes), bool) if alone else (table["piece"].to_numpy() == key[1].as_py())[by]
    rare = iter(rarest([s for s, o in zip(sets, own, strict=True) if o], [s for s, o in zip(sets, own, strict=True) if not o]) if own.any() else [])
    told = np.flatnonzero(own | (roots != nodes))
    lists = pa.array([next(rare) if own[i] else None for i in told], pa.list_(pa.int64()))
    same = [pa.array(np.full(len(told), x)) for x in (key[0].as_py(), alone)]
    return pa.table([pa.array(nodes[told]), pa.array(roots[told]), *same, lists], names=["node", "root", "cluster", "alone", "rare"])


def _compared(table: pa.Table) -> pa.Table:
    """Links of the sets of two pieces: each to the smallest node of those it is linked to."""
    nodes, _, roots, _ = _linked(table)
    more = np.flatnonzero(roots != nodes)
    return pa.table([pa.array(nodes[more]), pa.array(roots[more])], names=["a", "b"])


def _dealt(members: DataFrame, piece: int, turn: int) -> DataFrame:
    """The sets of clusters with their pieces; root is the component of a set so far, null before the first turn."""
    sizes = members.groupBy("cluster", "root").agg(F.sum("n").alias("n")).groupBy("cluster").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"))
    outside = F.col("all") - F.when(F.col("most.root").isNull(), 0).otherwise(F.col("most.n"))
    number = F.ceil(F.col("all") / piece).cast("int")
    sizes = sizes.select("cluster", F.when(number > 1, number + 1).otherwise(1).alias("pieces"), F.col("most.root").alias("most"), F.ceil(outside / piece).cast("int").alias("draws"))
    lead = F.coalesce(F.col("root") != F.col("most"), F.lit(True)) & (F.pmod(F.xxhash64("node", F.lit(2 * turn)), F.col("draws")) == 0)
    rest = F.pmod(F.xxhash64("node", F.lit(2 * turn + 1)), F.col("pieces") - 1) + 1
    dealt = members.join(sizes, "cluster").withColumn("piece", F.when((F.col("pieces") == 1) | lead, 0).otherwise(rest).cast("int"))
    # written, so that Spark knows its size
    return common.write_table(dealt.select("node", "part", "row", "n", "cluster", "pieces", "piece"), "clusters")


def _open(met: DataFrame, dealt: DataFrame, links: DataFrame) -> DataFrame:
    """The sets that may have links between components, with the clusters that they share rare shingles in."""
    roots = dealt.select("node", "part", "row", "n").join(components.components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = met.where("rare is not null").select("node", "cluster", "rare").join(roots.select("node", "root"), "node")
    entries = told.select("node", "cluster", "root", F.explode("rare").alias("shingle"))
    lists = entries.groupBy("cluster", "shingle").agg(F.min("node").alias("lead"), F.min("root").alias("low"), F.max("root").alias("high"))
    lists = lists.where("low < high").select("cluster", "shingle", "lead")
    ties = entries.hint("shuffle_merge").join(lists, ["cluster", "shingle"]).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return roots.join(components.components(ties).withColumnRenamed("root", "cluster"), "node")


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b: links of nodes (node, fp, bands) that operator 5's trees find between fingerprints, and of those that share a fingerprint or a band."""
    prints = common.write_table(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.max("node").alias("last")), "prints")
    ends = [prints.select(F.col("fp").alias(x), F.col("lead").alias(n)) for x, n in (("a", "one"), ("b", "two"))]
    close = simhash.links(prints).join(ends[0], "a").join(ends[1], "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    equal = nodes.select("node", "fp").hint("shuffle_merge").join(prints.where("lead < last"), "fp").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    met = nodes.select("node", F.explode("bands").alias("band"))
    leads = met.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("band", "lead")
    loose = met.hint("shuffle_merge").join(leads, "band").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return close.unionByName(equal).unionByName(loose)


def near_duplicates(rows: DataFrame, scan: DataFrame, piece: int = PIECE) -> DataFrame:
    """part, row, doc_id, component, component_id for each different text of numbered rows (common.numbered gives both arguments): the first row
    that has it, and the smallest doc_id of all texts linked to it over any number of steps.  Rows without a doc_id link nothing."""
    text = F.col("doc.text")
    key = F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    found = scan.where("doc_id is not null").select("doc_id", "part", "row", key.alias("key"), text.alias("text")).mapInArrow(_signatures, "doc_id long, part int, row long, key binary, n long, bands array<long>, fp long")
    texts = found.groupBy("key").agg(F.min(F.struct("doc_id", "part", "row")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    nodes = common.write_table(texts.select(F.monotonically_increasing_id().alias("node"), "first.*", "n", "bands", "fp"), "minima")
    clusters = components.components(candidates(nodes)).withColumnRenamed("root", "cluster")

    left, links = nodes.select("node", "part", "row", "n", F.lit(None).cast("long").alias("root")).join(clusters, "node"), None
    for turn in range(TURNS + 1):
        dealt = _dealt(left, piece, turn)
        sets = rows.select("part", "row", text.alias("text")).join(dealt, ["part", "row"]).mapInArrow(_sets, "node long, cluster long, pieces int, piece int, hashes binary")
        if turn == TURNS:
            other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
            pairs = sets.select("*", other.alias("other")).select("node", "hashes", "cluster", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"))
            links = links.unionByName(common.write_table(pairs.groupBy("cluster", "low", "high").applyInArrow(_compared, "a long, b long"), "similar"))
            break
        others = F.when((F.col("piece") == 0) & (F.col("pieces") > 1), F.sequence(F.lit(1), F.col("pieces") - 1)).otherwise(F.array("piece"))
        met = sets.select("*", F.explode(others).alias("other")).groupBy("cluster", "other")
        met = common.write_table(met.applyInArrow(_met, "node long, root long, cluster long, alone boolean, rare array<long>"), "similar")
        now = met.where("node <> root")
        if turn == 0:  # a cluster that one task has compared needs no more steps
            joined, now = now.where("alone").select("node", "root"), now.where("not alone")
        now = now.select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = now if links is None else links.unionByName(now)
        if met.where("rare is not null").isEmpty():
            break
        left = _open(met, dealt, links)
    if turn:
        joined = joined.unionByName(components.components(links))

    rooted = nodes.select("node", "part", "row", "doc_id").join(joined, "node", "left").select("part", "row", "doc_id", F.coalesce("root", "node").alias("component"))
    least = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "component")


def representatives(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row of docs for each component, of its smallest doc_id; rows without a doc_id stay.

    Null and empty texts are one text without words.  Of repeated rows one stays.  An empty table gives no rows."""
    common.ship(docs.sparkSession)
    rows, scan = common.numbered(docs)
    found = near_duplicates(rows, scan, piece)
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "part", "row")).alias("it")).select("it.part", "it.row")
    return common.chosen(rows, first, docs.columns)
