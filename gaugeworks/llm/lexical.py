"""Ranked lexical search with range-maximum tables on the posting lists (operator 12).

The index has a row for each shard, some megabytes of whole texts that one task has read: which
terms its documents hold and how often, as posting lists by term and document.  Documents of a shard
are in the order of their length, as impacts of a term depend on it most.

For a query, each term's posting list has the impacts (what the term adds to a document's score) and
a sparse table over them that gives the largest impact of any range of postings.  An interval of
documents then can't hold a score above the sum of its terms' largest impacts.  The search takes the
intervals with the highest such bounds first, scores the document of the largest impact in each,
splits the interval there, and bounds both parts; an interval whose bound is below the k-th score found
so far goes.  What is found is exact; no list is cut.  A task keeps its k best of each query from
shard to shard, so later shards lose most intervals at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a shard (a longer text is a shard of its own), and of a text that are split into terms at a time.
SHARD_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: Bytes of query terms that are sent to all tasks at a time; more queries take more passes over the index.
QUERY_BYTES = 8 << 20
#: Intervals that the search takes at a time.
WAVE = 128
#: Terms are runs of ASCII letters and digits and all other characters beyond ASCII; only A-Z have small forms.
_TERM = "0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b >= 128 or chr(b) in _TERM else ord(chr(b).lower()) if chr(b).lower() in _TERM else 32 for b in range(256))

INDEX = "docs long, length long, doc_ids binary, no_id binary, sizes binary, terms binary, starts binary, post_doc binary, post_tf binary"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


class _Numbers(dict):
    """Terms by number, in the order of their first occurrence."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class Shard:
    """Documents on their way into a row of the index."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.numbers = _Numbers()
        self.found: list[np.ndarray] = []
        self.n_bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        size, number = 0, self.numbers.__getitem__
        for piece in terms(text):
            self.found.append(np.fromiter(map(number, piece), np.int64, len(piece)))
            size += len(piece)
        if size:
            self.ids.append(doc_id)
            self.sizes.append(size)
            self.n_bytes += len(text)

    def row(self) -> dict:
        sizes = np.array(self.sizes, np.int64)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, sizes))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, tf = np.unique(np.concatenate(self.found) * len(order) + np.repeat(rank, sizes), return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(self.numbers) + 1) * len(order))
        lost = np.array([i is None for i in self.ids])[order]
        return {"docs": len(order), "length": int(sizes.sum()), "doc_ids": ids[order].tobytes(), "no_id": lost.astype(np.uint8).tobytes(), "sizes": sizes[order].tobytes(), "terms": b"\n".join(self.numbers), "starts": starts.astype(np.int64).tobytes(), "post_doc": (keys % len(order)).astype(np.int32).tobytes(), "post_tf": tf.astype(np.int32).tobytes()}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in INDEX.split(", ")])
    shard = Shard()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            shard.add(doc_id, text.as_py() or b"")
            if shard.n_bytes >= SHARD_BYTES:
                yield pa.RecordBatch.from_pylist([shard.row()], schema)
                shard = Shard()
    if shard.ids:
        yield pa.RecordBatch.from_pylist([shard.row()], schema)


def index(docs: DataFrame) -> DataFrame:
    """The index of all documents (doc_id, text) with a term: a row per shard, written to the shared folder."""
    common.ship(docs.sparkSession)
    return common.write_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index, INDEX), "lexical")


class Lists:
    """The posting lists of a shard for some terms (numbers 0, 1, ...), with impacts and their sparse tables, one list after the other."""

    def __init__(self, row: dict, wanted: dict[bytes, int], weights: np.ndarray, n_docs: int, length: int):
        self.doc_ids, self.no_id = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["no_id"], np.uint8).astype(bool)
        starts, doc, tf = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["post_doc"], np.int32), np.frombuffer(row["post_tf"], np.int32)
        here = [(wanted[t], i) for i, t in enumerate(row["terms"].split(b"\n")) if t in wanted]
        self.slot = np.full(len(wanted), -1)
        self.slot[[n for n, _ in here]] = np.arange(len(here))
        own = np.array([i for _, i in here], np.int64)
        sizes = starts[own + 1] - starts[own]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[own] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.doc = doc[take].astype(np.int64)
        m = 50 + (50 * np.frombuffer(row["sizes"], np.int64) * n_docs) // length
        times = tf[take].astype(np.int64)
        self.impact = np.repeat(weights[[n for n, _ in here]] if here else weights[:0], sizes) * ((1_000_000_000 * times) // (1000 * times + 20 * m[self.doc]))
        self.keys = np.repeat(np.arange(len(here)), sizes) * len(self.doc_ids) + self.doc
        # best[j][i]: where the largest impact of i .. i + 2^j - 1 is
        self.best = [np.arange(len(self.doc), dtype=np.int32)]
        longest = int(sizes.max(initial=0))
        while 2 << (len(self.best) - 1) <= longest:
            half, now = 1 << (len(self.best) - 1), self.best[-1]
            a, b = now[:-half], now[half:]
            self.best.append(np.concatenate([np.where(self.impact[b] > self.impact[a], b, a), now[-half:]]))
        self.best = np.stack(self.best)
        self.log = np.zeros(longest + 1, np.int8)
        for j in range(1, len(self.best)):
            self.log[1 << j :] = j

    def top(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the largest impact of postings left .. right - 1 is, and the impact; 0 of none."""
        j = self.log[np.maximum(right - left, 0)]
        some = right > left
        a = self.best[j, np.where(some, left, 0)]
        b = self.best[j, np.where(some, right - (1 << j.astype(np.int64)), 0)]
        x, y = self.impact[a], self.impact[b]
        return np.where(y > x, b, a), np.where(some, np.maximum(x, y), 0)

    def search(self, query: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of `found` (score, no_id, doc_id, best first) and this shard, for the terms `query`."""
        slots = self.slot[query]
        slots = slots[slots >= 0]
        if not len(slots):
            return found
        base = slots[:, None] * len(self.doc_ids)
        left, right = self.starts[slots][:, None], self.starts[slots + 1][:, None]
        at, value = self.top(left, right)
        bound = value.sum(0)
        while True:
            least = found[0][-1] if len(found[0]) == k else 1
            live = np.flatnonzero(bound >= least)
            if not len(live):
                return found
            if len(live) > WAVE:
                first = np.argpartition(-bound[live], WAVE)
                now, rest = live[first[:WAVE]], live[first[WAVE:]]
            else:
                now, rest = live, live[:0]
            # the document of the largest impact in each of these intervals, and its postings in all lists
            doc = self.doc[at[value[:, now].argmax(0), now]]
            cut = np.searchsorted(self.keys, base + doc)
            inside = cut < right[:, now]
            held = inside & (self.doc[np.where(inside, cut, 0)] == doc)
            score = np.where(held, self.impact[np.where(held, cut, 0)], 0).sum(0)
            found = self._merged(found, score, doc, k)
            least = found[0][-1] if len(found[0]) == k else 1
            lefts, rights = np.concatenate([left[:, now], cut + held], 1), np.concatenate([cut, right[:, now]], 1)
            ats, values = self.top(lefts, rights)
            bounds = values.sum(0)
            good = bounds >= least
            left, right = np.concatenate([left[:, rest], lefts[:, good]], 1), np.concatenate([right[:, rest], rights[:, good]], 1)
            at, value, bound = np.concatenate([at[:, rest], ats[:, good]], 1), np.concatenate([value[:, rest], values[:, good]], 1), np.concatenate([bound[rest], bounds[good]])

    def _merged(self, found, score: np.ndarray, doc: np.ndarray, k: int):
        if len(found[0]) == k:
            better = score >= found[0][-1]
            score, doc = score[better], doc[better]
        if not len(score):
            return found
        every = [np.concatenate(x) for x in zip(found, (score, self.no_id[doc], self.doc_ids[doc]), strict=True)]
        order = np.lexsort((every[2], every[1], -every[0]))
        order = order[every[0][order] > 0][:k]
        return tuple(x[order] for x in every)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({t for piece in terms(x or b"") for t in piece}) for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])


def _frequencies(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = wanted.value
        df = np.zeros(len(numbers), np.int64)
        for batch in batches:
            for names, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                sizes = np.diff(np.frombuffer(starts, np.int64))
                for i, t in enumerate(names.split(b"\n")):
                    if t in numbers:
                        df[numbers[t]] += sizes[i]
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], names=["term", "df"])

    return run


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, queries, weights, n_docs, length = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        found = [none] * len(queries)
        for batch in batches:
            for row in batch.to_pylist():
                lists = Lists(row, wanted, weights, n_docs, length)
                found = [lists.search(q, f, k) for q, f in zip(queries, found, strict=True)]
        for i, (score, lost, doc_id) in enumerate(found):
            if len(score):
                yield pa.record_batch([pa.array(np.full(len(score), i)), pa.array(score), pa.array(doc_id, mask=lost)], names=["query", "score", "doc_id"])

    return run


def search(indexed: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """For each row of items (item_id, text) its k best documents of score above 0: item_id, rank, doc_id, score.

    Equal scores by ascending doc_id, a null doc_id last; documents that are the same row come as often as they are there.
    Null or empty texts, of documents or items, have no terms: no rows.  An item that comes twice is ranked twice."""
    spark = indexed.sparkSession
    common.ship(spark)
    totals = indexed.agg(F.sum("docs"), F.sum("length")).first()
    n_docs, length = totals[0] or 0, totals[1] or 0
    kind = items.schema["item_id"].dataType.simpleString()
    asked = common.write_table(items.select("item_id", "text").mapInArrow(_query_terms, f"item_id {kind}, terms array<binary>"), "queries")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(asked):
        numbers: dict[bytes, int] = {}
        queries = [np.array([numbers.setdefault(bytes(t), len(numbers)) for t in r["terms"]], np.int64) for r in block]
        weights = np.zeros(len(numbers), np.int64)
        counted = indexed.select("terms", "starts").mapInArrow(_frequencies(spark.sparkContext.broadcast(numbers)), "term long, df long")
        for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the block
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        sent = spark.sparkContext.broadcast((numbers, queries, weights, n_docs, length))
        found = indexed.mapInArrow(_search(sent, k), "query long, score long, doc_id long")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"query long, item_id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # QUERY_BYTES bound the names
    return out


def _blocks(asked: DataFrame) -> Iterator[list]:
    """Queries with terms, in blocks of QUERY_BYTES or one query."""
    block, size = [], 0
    for r in asked.toLocalIterator():
        if r["terms"]:
            block.append(r)
            size += 64 + sum(32 + len(t) for t in r["terms"])
            if size >= QUERY_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(common.documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle_sql(k: int = 50) -> str:
    """The same in SQL, by scoring every document that holds a term."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def found(of: str) -> str:
        return f"regexp_extract_all(translate({of}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')"

    return f"""
with d as (select row_number() over () as r, doc_id, {found("text")} as terms from documents),
t as (select r, doc_id, len(terms) as n, unnest(terms) as term from d),
p as (select r, doc_id, n, term, count(*) as tf from t group by all),
s as (select count(*) as nn, sum(len(terms)) as ll from d where len(terms) > 0),
q as (select row_number() over () as i, item_id, {found("text")} as terms from benchmark),
a as (select distinct i, item_id, unnest(terms) as term from q),
w as (select term, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) as w from p, s group by term, nn),
x as (
  select i, item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + cast((50 * n * nn) // ll as bigint))))) as bigint) as score
  from a join w using (term) join p using (term), s group by all),
o as (select *, cast(row_number() over (partition by i order by score desc, doc_id nulls last) as integer) as rank from x where score > 0)
select item_id, rank, doc_id, score from o where rank <= {k}"""
