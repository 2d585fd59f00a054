"""documents -> quality rules -> near-duplicates -> repeated passages -> mixture -> packed sequences."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import common, jaccard, mixing, packing, quality, suffixes, tokenizer


def _stage(f):
    """What a stage wrote on its way goes when it returns, but for the tables that its result still reads."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.recorded() as held:
            out = f(spark, docs, sf_dir)
        common.release(common.unread(held, out))
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the cut-offs come from the labels of sf_dir."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more) stays, that of the smallest doc_id.

    Operator 5's fingerprints and vantage-point trees give candidates within 3 bits; most such pairs differ by some ten bits, so
    minima of shingle hashes give candidates too, and every link is an exact similarity (see README)."""
    return jaccard.representatives(docs)


@_stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller doc_id has too are cut out of the texts; characters stay whole."""
    return suffixes.cut_texts(docs)


@_stage
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts in the mixture's amounts: a document comes once, twice, in part or not at all."""
    return mixing.mixed(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row per piece."""
    return packing.pack(docs, tokenizer.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Token ids and sorted suffixes are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    Once a stage's output is written, what it wrote on its way and the output before it go.  What the last stage's
    result reads is this call's own and stays until common.clean_scratch(); other runs in the session don't touch it."""
    docs, before = common.documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with common.recorded() as held:
            docs = common.write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        done = common.unread(held, docs)
        common.release(before + done)
        before = [e for e in held if e not in done]
    return STAGES[-1][1](spark, docs, sf_dir)
