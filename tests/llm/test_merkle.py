"""The manifest against trees built by hand; witnesses; ties, nulls, empty tables, clashing names."""

import hashlib
import zlib

import pytest
from cases import SCHEMA, awkward, documents, frame
from pyspark.sql import functions as F

from gaugeworks.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=None):
    values = [*row[:1], row[3], row[2], row[4], text if text is not None else row[1]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, for each leaf the siblings level by level as (left, right))."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 16, len(nodes))) for i in range(0, len(nodes), 16)]
        for run in runs:
            for i in run:
                for leaf in below[i]:
                    paths[leaf].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        nodes, below = [h(*(nodes[i] for i in run)) for run in runs], [[leaf for i in run for leaf in below[i]] for run in runs]
    return nodes[0], paths


def by_hand(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = [], []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        order.append(own)
        trees.append(tree([leaf_of(r) for r in own]))
    root, above = tree([t[0] for t in trees])
    out = []
    for own, (subroot, paths), over in zip(order, trees, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if hit and r[1] is not None else r[1]
            now, whole = leaf_of(r, changed), path + over
            for left, right in whole:
                now = h(left, now, right)
            out.append((r[0], leaf_of(r), subroot, root, h(*(x + y for x, y in whole)), now, now == root))
    return sorted(map(str, out))


def result(spark, rows, tmp_path, name, more=lambda df: df):
    folder = str(tmp_path / name)
    more(frame(spark, rows)).write.parquet(f"{folder}/documents.parquet")
    return sorted(str(tuple(r)) for r in merkle.op11_merkle_manifest(spark, folder).collect())


def test_against_trees_by_hand(spark, tmp_path):
    rows = documents(n=330)  # more than a block of 256 in a source
    rows = [(*r[:3], "s1" if i % 10 else r[3], r[4]) for i, r in enumerate(rows)]
    assert result(spark, rows, tmp_path, "d") == by_hand(rows)
    assert any(x.endswith("False)") for x in by_hand(rows))


def test_clashing_names_and_no_rows(spark, tmp_path):
    rows = documents(n=20)
    clash = lambda df: awkward(df).withColumns({c: F.lit("x") for c in ("grp", "node", "pos", "witness", "top", "block", "leaf")})
    assert result(spark, rows, tmp_path, "c", clash) == by_hand(rows)
    assert result(spark, [], tmp_path, "e") == []


@pytest.mark.parametrize("levels", [1, 3])
def test_any_block_size_gives_the_same_tree(spark, levels):
    rows = [(i, f"t{i}", None, "s" if i % 50 else None, 0) for i in range(300)]
    got = {(r.doc_id, r.subroot, r.root, tuple(r.witness)) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), levels).collect()}
    assert got == {(r.doc_id, r.subroot, r.root, tuple(r.witness)) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_witness_by_appending():
    """What a leaf's witness is after each append leads to the node that covers it by then."""
    t = merkle.Tree(2)
    leaves = [h(str(i)) for i in range(256)]
    for i, x in enumerate(leaves):
        t.append(x)
        if i == 15:
            assert merkle.fold(leaves[3], t.witness[3]) == h(*leaves[:16])
    root = t.close(False)
    assert all(merkle.fold(x, w) == root for x, w in zip(leaves, t.witness, strict=True)) and root == tree(leaves)[0]
    assert merkle.fold(h("other"), t.witness[3]) != root
