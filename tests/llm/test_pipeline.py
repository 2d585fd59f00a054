"""The pipeline's stages, each held against brute force on what its predecessor kept, and the registered queries on the smallest tables."""

import sys
from collections import Counter

import pytest
from cases import frame
from test_jaccard import least_of_components
from test_texts import brute_repeats, split
from test_tokens import PATH, check_packed
from tokenizers import Tokenizer

from gaugeworks.llm import quality


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("sf")
    docs = frame(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3 * i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(folder)).write.parquet(f"{folder}/out-{i}")
        after = spark.read.parquet(f"{folder}/out-{i}")
        found.append((name, now.collect(), after.collect(), after.columns))
        now = after
    return str(folder), docs.columns, found


def test_stages(outputs):
    _, columns, found = outputs
    assert [f[0] for f in found] == ["quality_rules", "near_dedup", "suffix_array_dedup", "mixing_sources", "best_fit_packing"]
    assert all(f[3] == columns for f in found[:-1])


def test_quality_stage(outputs):
    _, before, after, _ = outputs[2][0]
    keep = []
    for r in before:
        n, *_, repeated, _ = quality.features((r.text or "").encode())
        if n >= 50 and 100 * repeated <= 50 * n:
            keep.append(r)
    assert Counter(map(str, after)) == Counter(map(str, keep))  # too few labels here for a certified cut-off


def test_near_duplicate_stage(outputs):
    """The stage's rule is five words and similarity 0.8, by all pairs."""
    _, before, after, _ = outputs[2][1]
    assert sorted((r.doc_id, r.text or "") for r in after if r.doc_id is not None) == least_of_components([tuple(r) for r in before])
    assert Counter(r.text for r in after if r.doc_id is None) == Counter(r.text for r in before if r.doc_id is None)


def test_repeats_stage(outputs):
    _, before, after, _ = outputs[2][2]
    rows = [tuple(r) for r in before]
    removed = {d: n for d, _, n, _, _ in brute_repeats(rows) if d is not None}
    old = {r.doc_id: r.text.encode() for r in before if r.doc_id is not None}
    assert len(after) == len(before) and any(removed.values())
    for r in after:
        assert r.n_chars == len(r.text)
        if r.doc_id is not None:
            assert 0 <= len(r.text.encode()) - (len(old[r.doc_id]) - removed[r.doc_id]) <= 6 * removed[r.doc_id]
            assert removed[r.doc_id] or r.text.encode() == old[r.doc_id]


def test_mixing_stage(outputs):
    _, before, after, _ = outputs[2][3]
    size = sum(len(split(r.text)) for r in before)
    assert abs(sum(len(split(r.text)) for r in after) - 1.5 * size) <= 64 * 5
    held = {r.doc_id: Counter(split(r.text)) for r in before if r.doc_id is not None}
    for r in after:
        assert r.n_chars == len(r.text)
        if r.doc_id is not None:
            assert not Counter(split(r.text)) - held[r.doc_id]
    assert max(Counter(r.doc_id for r in after if r.doc_id is not None).values()) <= 2


def test_packing_stage(outputs):
    _, before, after, _ = outputs[2][4]
    used, least = check_packed(after, [tuple(r) for r in before], Tokenizer.from_file(PATH), 2048)
    assert used <= least + 1


def test_run_gives_the_same_rows(spark, outputs):
    import corpus_pipeline

    keys = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert keys(corpus_pipeline.run(spark, outputs[0]).collect()) == keys(outputs[2][4][2])


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and "corpus_pipeline" in sys.modules
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", ["op8_mixing_sources", "op10_quality_rules", "op11_merkle_manifest", "op12_ranked_lexical_search"])
def test_queries_against_sql(spark, duck, name):
    from conftest import DATA, same

    from gaugeworks.llm import registry

    same(registry.QUERIES[name](spark, f"{DATA}/sf0.001"), duck.sql(registry.ORACLE_SQL[name]))


def test_two_runs_in_a_session(spark, outputs):
    """A run leaves alone what another one's result still reads."""
    import corpus_pipeline

    a, b = (corpus_pipeline.run(spark, outputs[0]) for _ in range(2))
    first = sorted(map(str, a.collect()))
    assert first == sorted(map(str, b.collect())) == sorted(map(str, a.collect()))
    assert first
