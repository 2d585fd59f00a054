"""The search against scoring every document; ties, nulls, small shards, empty tables."""

import math
import re
from collections import Counter

import pytest
from cases import awkward, documents, frame
from pyspark.sql import functions as F

from gaugeworks.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(0, "The of ing tion 42 over"), (1, "DON'T ßß Ué"), (2, ""), (3, None), (4, "nowhere"), (0, "ing"), (None, "and the")]


def found(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(rows, items, k):
    docs = [(r[0], Counter(found(r[1]))) for r in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in docs:
            m = 50 + 50 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(found(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if none else d, -score) for rank, (score, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("shard", "wave", "k"), [(16 << 20, 128, 50), (2000, 3, 7)])
def test_against_all_documents(spark, monkeypatch, shard, wave, k):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "WAVE", wave)
    rows = documents(n=120)
    rows += [r for r in rows if r[1] and "tion" in r[1]][:9] * 4  # equal scores beyond the k-th
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(lexical.index(awkward(frame(spark, rows))), items.withColumn("score", F.lit(1)), k)
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows, ITEMS, k)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 1)
    rows = documents(n=30)
    got = lexical.search(lexical.index(frame(spark, rows)), spark.createDataFrame(ITEMS, "item_id long, text string"), 5)
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows, ITEMS, 5)


def test_empty_tables(spark):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(lexical.index(frame(spark, [])), items).collect() == []
    assert lexical.search(lexical.index(frame(spark)), none).collect() == []


def test_pieces_keep_terms_whole(monkeypatch):
    text = ("abc déf-42 " * 500 + "x" * 3000).encode()
    whole = [t for piece in lexical.terms(text) for t in piece]
    monkeypatch.setattr(lexical, "PIECE_BYTES", 7)
    assert [t for piece in lexical.terms(text) for t in piece] == whole == [t.encode() for t in found(text.decode())]


def test_range_maximum(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    shard = lexical.Shard()
    for i in range(60):
        shard.add(i, b" ".join(rnd.choice([b"a", b"b", b"c", b"d"], rnd.integers(1, 40))))
    numbers = {t: i for i, t in enumerate((b"a", b"b", b"c", b"d"))}
    lists = lexical.Lists(shard.row(), numbers, np.array([5, 9, 2, 7]), 60, 1200)
    for slot in range(4):
        for left in range(lists.starts[slot], lists.starts[slot + 1] + 1):
            for right in range(left, lists.starts[slot + 1] + 1):
                at, value = lists.top(np.array([left]), np.array([right]))
                assert value[0] == lists.impact[left:right].max(initial=0) and (left == right or lists.impact[at[0]] == value[0])
