"""The pipeline's near-duplicate stage against all pairs, and one row for each component."""

import random

import numpy as np
import pytest
from cases import awkward, documents, frame, words
from test_texts import split

from gaugeworks.llm import components, jaccard, simhash


def grams(text):
    w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 5 else frozenset([tuple(w)])


def least_of_components(rows):
    rows = [r for r in rows if r[0] is not None]
    sets, root = [grams(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((r[0], r[1] or ""))
    return sorted(min(g) for g in groups.values())


def edited(seed=5):
    """Texts with a few words changed: of similarity around 0.8, far over three bits of a fingerprint."""
    rnd, rows = random.Random(seed), documents()
    for base in range(12):
        text = words(rnd, 150).split()
        for k in range(6):
            now = list(text)
            for at in rnd.sample(range(150), k):
                now[at] = f"changed{base}x{k}x{at}"
            rows.append((2000 + 10 * base + k, " ".join(now), "en", "s1", 0))
    return rows


@pytest.mark.parametrize("part", [1 << 20, 300])
def test_stage_keeps_one_of_each_component(spark, part):
    rows = edited()
    df = awkward(frame(spark, rows)).selectExpr("*", "5 as component", "6 as piece", "7 as node")
    kept = jaccard.representatives(df, part)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id is not None) == least_of_components(rows)
    assert sum(r.doc_id is None for r in got) == sum(r[0] is None for r in rows)
    assert jaccard.representatives(frame(spark, [])).count() == 0


def test_pipeline_stage_finds_edited_copies(spark):
    import corpus_pipeline

    rows = edited()
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id is not None) == least_of_components(rows)


@pytest.mark.parametrize("stage", [jaccard, simhash])
def test_one_doc_id_with_two_texts(spark, stage):
    rnd = random.Random(1)
    a, b = words(rnd, 80), words(rnd, 80)
    rows = [(2, a, "en", "s1", 0), (5, a, "en", "s1", 0), (5, b, "en", "s1", 0), (9, b, "en", "s1", 0), (9, words(rnd, 80), "en", "s1", 0)]
    got = stage.representatives(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(2, a), (5, b), (9, rows[4][1])])


def test_similar_against_all_pairs():
    rnd = np.random.default_rng(3)
    for size, n in ((1, 30), (6, 80), (40, 120)):
        base = rnd.integers(0, 1 << 62, size)
        sets = []
        for _ in range(n):
            now = base.copy()
            at = rnd.integers(0, size, rnd.integers(0, max(1, size // 5) + 1))
            now[at] = rnd.integers(0, 1 << 62, len(at))
            sets.append(np.unique(now[: rnd.integers(max(1, size * 3 // 4), size + 1)]).astype(np.uint64))
        want = np.arange(n)
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j], True))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == want[i]] = want[j]
        least = {w: int(np.flatnonzero(want == w).min()) for w in set(want.tolist())}
        assert jaccard.similar(sets).tolist() == [least[w] for w in want.tolist()]


def test_rarest_shingles_of_similar_sets_meet():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 62, 50)
    sets = []
    for _ in range(60):
        now = base.copy()
        at = rnd.integers(0, 50, rnd.integers(0, 9))
        now[at] = rnd.integers(0, 1 << 62, len(at))
        sets.append(np.unique(now).astype(np.uint64))
    for first in ([], sets[:7]):
        rare = [set(r.tolist()) for r in jaccard.rarest(sets, first)]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j], True))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    assert rare[i] & rare[j]


def templates(edits, n=160, seed=11):
    """One large cluster: near copies of a text, chains of steps away from it, texts too far from all others."""
    rnd = random.Random(seed)
    text = words(rnd, 120).split()
    rows, chain = [], list(text)
    for k in range(n):
        now = list(text)
        for at in rnd.sample(range(120), rnd.choice(edits)):
            now[at] = f"edit{k}x{at}"
        rows.append((k + 1, " ".join(now), "en", "s1", 0))
        if k % 12 == 0:
            chain[k // 12 * 5] = f"step{k}"
            rows.append((1000 + k, " ".join(chain), "en", "s1", 0))
    return rows


def test_large_cluster_is_narrowed_not_paired(spark, monkeypatch):
    rows, sent, deal = templates((0, 1, 1, 1, 1, 1, 12)), [], jaccard._dealt

    def dealt(members, piece, turn):
        out = deal(members, piece, turn)
        sent.append(tuple(out.selectExpr("count(*)", "coalesce(sum(if(piece = 0 and pieces > 1, pieces - 1, 1)), 0)", "coalesce(max(pieces), 0)").first()))
        return out

    monkeypatch.setattr(jaccard, "_dealt", dealt)
    got = jaccard.representatives(frame(spark, rows), 1000).collect()
    assert sorted((r.doc_id, r.text) for r in got) == least_of_components(rows)
    print(sent)
    assert sent[0][2] > 12 and sum(out for _, out, _ in sent) < 5 * sent[0][0], "linear, where pieces by pieces are over 12 times the cluster"


def test_large_cluster_held_together_by_one_text(spark, monkeypatch):
    rows = templates((0, 1, 2, 2, 2, 3, 12), 100)
    monkeypatch.setattr(jaccard, "TURNS", 1)
    got = jaccard.representatives(frame(spark, rows), 1000).collect()
    assert sorted((r.doc_id, r.text) for r in got) == least_of_components(rows)


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(7)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(200)] + [(5000 + rnd.randrange(80), 5000 + rnd.randrange(80)) for _ in range(60)] + [(7, 7)]
    graph = {}
    for a, b in links:
        if a != b:
            graph.setdefault(a, set()).add(b)
            graph.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(graph):
        stack = [node] if node not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = node
                stack += graph[x]
    rnd.shuffle(links)
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_trees_give_candidates(spark):
    """Fingerprints within 3 bits link texts that share no band; more bits don't, and a band still does."""
    base = 0x0123456789ABCDEF
    nodes = spark.createDataFrame([(1, base, [1]), (2, base ^ 0b1011, [2]), (3, base ^ (0b1111 << 20), [3]), (4, base ^ (0x1FF << 30), [3]), (5, base, [5])], "node long, fp long, bands array<long>")
    roots = {r.node: r.root for r in jaccard.components.components(jaccard.candidates(nodes)).collect()}
    assert roots == {1: 1, 2: 1, 5: 1, 3: 3, 4: 3}
