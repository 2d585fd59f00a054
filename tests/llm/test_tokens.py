"""Token ids, counts, files and packing against the tokenizers library and plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, awkward, documents, frame
from tokenizers import Tokenizer

from gaugeworks.llm import packing, token_counts, token_files, tokenizer

PATH = tokenizer.vocabulary()


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_ids_equal_whole_text_encoding(whole):
    rnd = random.Random(1)
    letters = "aAbZé É ñ ß 'sS'tT'reL'll0 1 9,.!#<|endoftext|> \n\t́ \u0085\x1c Σςσ½٣_-\"ªµ×÷Ç家 😀İ  "
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>b", "don't I'LL é ́x"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [t for _, t, *_ in documents() if t]
    got = [ids[e - n : e].tolist() for _, ids, ns in tokenizer.chunk_ids(PATH).batch(pa.array(texts)) for n, e in zip(ns, np.cumsum(ns), strict=True)]
    assert got == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


def test_codec_round_trip():
    rnd = np.random.default_rng(1)
    n = (rnd.integers(0, 2**32, 4000, dtype=np.uint64) >> rnd.integers(0, 32, 4000, dtype=np.uint64)).astype(np.uint32)
    assert (token_files.decode(*token_files.encode(n)) == n).all()
    assert len(token_files.decode(*token_files.encode(n[:0]))) == 0


@pytest.mark.parametrize("block,file", [(50, 400), (1 << 16, 4 << 20)])
def test_id_files(spark, whole, block, file):
    rows = documents()
    blocks, id_of = token_files.write(awkward(frame(spark)), PATH, 1, block, file)
    starts = {(r.file_no, r.block_no): r.before for r in token_files.starts(blocks).collect()}
    got = sorted(((-1 if r.doc_id is None else r.doc_id), starts[r.file_no, r.block_no] + r.in_block, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read(blocks, id_of).collect())
    ids = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [1]
    assert sorted((d, n, c) for d, _, n, c in got) == sorted((-1 if d is None else d, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t, *_ in rows)
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: (r[0], r[1])):
        assert start == at, d
        at += n


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_counts_from_flat_files(spark, whole, block):
    rows = [r for r in documents() if r[0] is not None]
    blocks, held = token_counts.write(frame(spark, rows).repartition(3), PATH, block_ids=block)
    counts = {(r.file_no, r.ordinal): r.n_tokens for r in token_counts.count(blocks).collect() if r.closed}
    got = sorted((d, counts[r.file_no, r["first"] + k]) for r in held.collect() for k, d in enumerate(r.doc_ids))
    assert got == sorted((d, len(whole.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)


def test_counts_with_an_open_end(spark):
    blocks = spark.createDataFrame([(0, k, bytes(np.array(b, "<u2").tobytes())) for k, b in enumerate([[9, 5, 5], [5, 5, 5], [5, 9, 9], [5, 5]])], "file_no long, block_no long, ids binary")
    got = sorted((r.ordinal, r.n_tokens, r.closed) for r in token_counts.count(blocks, 9).collect())
    assert got == [(0, 0, True), (1, 6, True), (2, 0, True), (3, 2, False)]


def test_best_fit_of_lengths():
    bins, places, fills = packing.best_fit(np.array([5, 5, 3, 7, 2, 10, 8]), 10)
    assert fills.max() <= 10 and len(fills) == 4 and sorted(fills) == [10, 10, 10, 10]
    assert all(sorted(places[bins == b])[0] == 0 for b in set(bins))


def check_packed(got, rows, whole, size):
    want = {}
    for d, t, *_ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), size):
            key = (d, s // size, s, len(ids[s : s + size]), zlib.crc32(np.array(ids[s : s + size], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    have = {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        have[key] = have.get(key, 0) + 1
    assert have == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by), -(-sum(r.length for r in got) // size)


@pytest.mark.parametrize("parts,size", [(1, 2048), (40, 300), (40, 2048)])
def test_packing(spark, whole, parts, size):
    rows = documents()
    got = packing.pack(awkward(frame(spark, rows)).repartition(parts), PATH, 0, size).collect()
    used, least = check_packed(got, rows, whole, size)
    assert used <= least + 1 + used // 20


def test_packing_hosts_of_other_groups(spark, whole):
    """Groups of half-full bins whose only partners lie in other groups."""
    rows = [(i, "the " * (1199 if i % 2 else 799), "en", "s", 0) for i in range(40)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(random.Random(2).sample(rows, 40), 40), SCHEMA)
    used, least = check_packed(packing.pack(df, PATH, 0, 2048).collect(), rows, whole, 2048)
    assert used <= 24  # 20 if all were in one group


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack(none, PATH).count() == 0
    blocks, id_of = token_files.write(none, PATH)
    assert token_files.read(blocks, id_of).count() == 0
    blocks, held = token_counts.write(none, PATH)
    assert token_counts.count(blocks).count() == held.count() == 0


def test_mixture_of_very_large_sources(spark):
    """On sizes alone: a source of 10^13 words has fewer than 2^31 blocks, a small one has the shortest blocks."""
    from gaugeworks.llm import mixing

    sizes = spark.createDataFrame([(i, i, s, n) for i, (s, n) in enumerate([("a", 10**13), ("b", 3 * 10**9), ("b", 10**9), ("c", 40), (None, 0)])], "row long, doc_id long, source string, size long")
    got = {r.source: r for r in mixing._sources(sizes, mixing.BLOCK_WORDS).collect()}
    assert all(r.n_blocks == -(-r.source_size // r.length) and r.n_blocks <= 2**30 and r.n_slots <= 2 * r.n_blocks for r in got.values())
    assert got["c"].length == mixing.BLOCK_WORDS and got["b"].length == 8 * mixing.BLOCK_WORDS and got["a"].length > got["b"].length
    assert all(abs(r.n_slots * r.length - r.target) <= 2 * r.length for r in got.values() if r.source_size)
