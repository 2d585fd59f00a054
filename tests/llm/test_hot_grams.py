"""A passage in very many documents with other words around it: its stretches are spread, and results stay those of brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, frame, words
from test_texts import brute_repeats

from gaugeworks.llm import suffixes

PHRASE = "this common phrase of forty bytes or so is everywhere"


def around(n=60):
    rnd = random.Random(11)
    return [(5000 + i, f"{words(rnd, 12)} {PHRASE[:30]} {words(rnd, 12)} {PHRASE} {words(rnd, 12)}", "en", "s1", 0) for i in range(n)]


@pytest.mark.parametrize("hot", [1, 40, 1000])
def test_repeats_with_hot_grams(spark, hot):
    rows = documents() + around()
    got = suffixes.remove_repeats(frame(spark, rows).repartition(3), unit_bytes=400, hot_windows=hot).collect()
    assert Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got) == Counter(brute_repeats(rows))


def test_no_bucket_takes_a_whole_gram():
    """As the tasks do it, for units of one document each, over 16 buckets."""
    n, units = 16, [t.encode() for _, t, *_ in around()]
    raws = [np.frombuffer(t, np.uint8) for t in units]
    batches = [pa.record_batch([[i], [[5000 + i]], [[len(t)]], [t]], names=["unit", "doc_ids", "ends", "bytes"]) for i, t in enumerate(units)]
    buckets = {}
    for b in suffixes._sent_grams(n)(iter(batches)):
        for r in b.to_pylist():
            buckets.setdefault(r["bucket"], []).append(r)
    told = {}
    for k, rows in buckets.items():
        for r in suffixes._shared_grams(200)((pa.scalar(k),), pa.Table.from_pylist(rows)).to_pylist():
            told.setdefault(r["unit"], []).append(r)
    sent = Counter()
    most = Counter()
    for i, raw in enumerate(raws):
        gram, *_ = suffixes._stretches(raw, np.array([len(raw)]), np.array([5000 + i]), np.array([True]), told.get(i, []), n)[4:5]
        for k in suffixes._bucket(gram, n).tolist():
            sent[k] += 1
        most.update(gram.tolist())
    # a phrase of 30 bytes gives each document windows of their own with one gram: they are spread over the buckets
    assert len(sent) == n and max(sent.values()) < sum(sent.values()) / 4
    assert max(most.values()) <= len(units)


def test_ranges_by_the_size_of_the_text():
    from gaugeworks.llm import suffixes

    assert suffixes.ranges(0) == 1 and suffixes.ranges(100 << 20) == 13
    for total in (10**9, 10**11, 10**13, 10**14, 10**17):
        n = suffixes.ranges(total)
        assert total / n <= suffixes.MOST_ROUND_BYTES
        assert n <= suffixes.RANGES or total > suffixes.RANGES * suffixes.ROUND_BYTES


def test_more_ranges_than_the_usual(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGES", 2)
    monkeypatch.setattr(suffixes, "ROUND_BYTES", 500)
    monkeypatch.setattr(suffixes, "MOST_ROUND_BYTES", 2000)
    rows = documents() + around(20)
    got = suffixes.remove_repeats(frame(spark, rows).repartition(3), unit_bytes=400).collect()
    assert Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got) == Counter(brute_repeats(rows))


def test_quicksort_by_characters(monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL_GROUP", 4)
    rnd = np.random.default_rng(7)
    for n in (0, 1, 5, 40, 700):
        for values in (1, 3, 1 << 60):
            group = np.sort(rnd.integers(0, 4, n))
            c = rnd.integers(0, values, n).astype(np.uint64)
            by = suffixes.quicksorted(c, group)
            assert sorted(by.tolist()) == list(range(n)) and (group[by] == group).all()
            assert [(g, x) for g, x in zip(group, c[by], strict=True)] == sorted(zip(group, c, strict=True))


def test_windows_in_order(monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL_GROUP", 8)
    rnd = random.Random(3)
    text = np.frombuffer("".join(rnd.choice(["abab" * 12, "abab" * 13 + "c", "xyz", "q" * 60]) for _ in range(120)).encode(), np.uint8)
    at = np.arange(len(text) - suffixes.LENGTH)
    order, first = suffixes.equal_windows(text, at)
    raw = text.tobytes()
    windows = [raw[i : i + suffixes.LENGTH] for i in at[order].tolist()]
    assert windows == sorted(windows)
    assert first.tolist() == [i for i in range(len(windows)) if not i or windows[i] != windows[i - 1]]
