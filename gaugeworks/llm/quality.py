"""Quality rules whose cut-offs are chosen with a guarantee (operator 10).

A rule rejects a document whose score is above the rule's cut-off for the document's stratum.  The
cut-offs come from labelled documents alone: for a stratum and a rule, cut-offs are tried from the
most lenient to the strictest, and each is held against the exact binomial bound: if it rejected
more than `risk` of the good documents, how likely were as few rejections as the labels show?  The
walk stops at the first cut-off for which that is not below the level.  A walk in fixed order
needs no correction; the level is divided by the number of walks (rules times strata), and the
risk by the number of rules, so that with probability 1 - delta no stratum loses more than `risk` of
its good documents to the rules together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SYMBOLS = b"#*$%&|<>"
#: Counts of a document.  Loud words have two bytes or more, a capital letter and no small one (ASCII).
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_loud_words"]


@dataclass(frozen=True)
class Rules:
    risk: float = 0.02
    delta: float = 0.05
    #: Cut-offs of every rule, from lenient to strict; per cent of the words.
    ladder: tuple[int, ...] = (100, 80, 60, 50, 40, 30, 25, 20, 15, 10)
    min_words: int = 50
    max_repeat: int = 50


#: Scores in whole per cent of the words, rounded up, so that both engines compare integers.
SCORES = ("n_symbols", "n_repeat_words", "n_loud_words", "n_dup_lines")


def features(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Of one whole text in UTF-8.  Words are runs of bytes other than white space (ASCII)."""
    words = text.split()
    n = len(words)
    glued = b"".join(words)
    chars = len(glued.decode("utf-8"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            upto = 0  # words before this index are counted
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    loud = sum(1 for w in words if len(w) > 1 and w.isupper()) if glued.upper() != glued.lower() else 0
    return n, chars, symbols, dup_lines, repeated, loud


def _features(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6))], names=[*keep, *FEATURES])

    return run


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' columns `keep` and the features of its texts; a null text has no words."""
    common.ship(docs.sparkSession)
    schema = T.StructType([*docs.select(*keep).schema, *(T.StructField(f, T.LongType()) for f in FEATURES)])
    return docs.select(*dict.fromkeys(["text", *keep])).mapInArrow(_features(keep), schema)


def score(name: str) -> Column:
    return F.when(F.col("n_words") > 0, F.ceil(100 * F.col(name) / F.col("n_words"))).otherwise(0)


def failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certify(counts: list[tuple[str, str, int, list[int], list[int]]], rules: Rules) -> dict[tuple[str, str], int]:
    """(stratum, rule) -> cut-off.  counts: stratum, rule, good documents, good and bad ones rejected at each step of the ladder.

    Of the certified cut-offs the one that rejects the most bad documents over good ones, the most lenient of equals."""
    walks = max(1, len(counts))
    risk = rules.risk / len(SCORES)
    found = {}
    for stratum, rule, n, good, bad in counts:
        best = 0
        for cut, k, caught in zip(rules.ladder, good, bad, strict=True):
            if n == 0 or tail(k, n, risk) > rules.delta / walks:
                break
            if caught - k > best:
                best, found[stratum, rule] = caught - k, cut
    return found


def thresholds(measured: DataFrame, labels: DataFrame, rules: Rules) -> dict[tuple[str, str], int]:
    """From all different texts of labelled documents that pass the base rules.  The result has a row for each stratum
    (language) and rule; what the driver gets is that many counts, whatever the corpus."""
    graded = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("good"))
    # copies are no trials of their own: a text counts once in a stratum, as good if any label of it says so
    every = measured.where(~failed(rules)).join(graded, F.col("doc_id") == F.col("labelled"))
    held = every.groupBy("stratum", "key").agg(F.max("good").alias("good"), *(F.first(c).alias(c) for c in FEATURES))

    def steps(s: str, good: int) -> Column:
        return F.array(*(F.count_if((F.col("good") == good) & (score(s) > cut)) for cut in rules.ladder))

    counts = held.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("n"), *(steps(s, g).alias(f"{s}_{g}") for s in SCORES for g in (0, 1))).collect()
    return certify([(r["stratum"], s, r["n"], r[f"{s}_1"], r[f"{s}_0"]) for r in sorted(counts, key=lambda r: r["stratum"]) for s in SCORES], rules)


def verdict(found: dict[tuple[str, str], int]) -> Column:
    """Whether any certified rule of the document's stratum rejects it."""
    bad = F.lit(False)
    for (stratum, rule), cut in sorted(found.items()):
        bad = bad | ((F.col("stratum") == stratum) & (score(rule) > cut))
    return bad


def _narrow(docs: DataFrame, *more: Column) -> DataFrame:
    """text, doc_id, stratum (a null language is none of the names), key of the text."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"), *more)


def judge(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of docs: doc_id, the features, base_failed, kept.

    The stratum is the language, null as its own.  Null or empty texts have no words and fail the
    base rules.  Repeated rows are judged alike; a repeated label counts once; null labels and null
    doc_ids of labels count for nothing.  Without enough labels in a stratum no cut-off of it can be
    certified and only the base rules reject.  Only doc_id, text and lang are read."""
    measured = common.write_table(measure(_narrow(docs), ["doc_id", "stratum", "key"]), "quality")
    found = thresholds(measured, labels, rules)
    base = F.coalesce(failed(rules), F.lit(True))
    return measured.select("doc_id", *FEATURES, base.alias("base_failed"), (~base & ~verdict(found)).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps; columns may have any names."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    measured = common.write_table(measure(_narrow(docs, rest), ["doc_id", "stratum", "key", "row", "text"]), "quality")
    found = thresholds(measured.drop("row", "text"), labels, rules)
    return measured.where(~F.coalesce(failed(rules), F.lit(True)) & ~verdict(found)).select(*(F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("n_loud_words")


def oracle_sql(rules: Rules = Rules()) -> str:
    """The same in SQL: features, exact binomial walks, verdict."""
    scores = " union all ".join(f"select doc_id, stratum, text, failed, n_words, '{s}' as rule, case when n_words > 0 then cast(ceil(100 * {s} / n_words) as bigint) else 0 end as score from f" for s in SCORES)
    ladder = ", ".join(f"({i}, {c})" for i, c in enumerate(rules.ladder))
    return f"""
with w as (
  select doc_id, coalesce('=' || lang, '') as stratum, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
p as (select doc_id, words, unnest(range(1, len(words) + 1)) as i from w),
g as (select doc_id, i, [words[i], words[i + 1], words[i + 2]] as g from p where i + 2 <= len(words)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g),
r as (select doc_id, count(distinct i + k) as n_repeat_words from c, range(0, 3) t(k) where n > 1 group by doc_id),
f as (
  select w.doc_id, stratum, text, cast(len(words) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
         cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
              - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         cast(len(list_filter(words, lambda x: strlen(x) > 1 and regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]'))) as bigint) as n_loud_words,
         len(words) < {rules.min_words} or 100 * coalesce(n_repeat_words, 0) > {rules.max_repeat} * len(words) as failed
  from w left join r using (doc_id)),
s as ({scores}),
l as (select doc_id, max(quality) as good from labels where doc_id is not null and quality is not null group by doc_id),
steps(step, cut) as (values {ladder}),
k as (
  select stratum, rule, step, cut, count(*) filter (good = 1) as n,
         count(*) filter (good = 1 and score > cut) as k, count(*) filter (good = 0 and score > cut) as caught
  from (select stratum, rule, text, max(good) as good, any_value(score) as score from s join l using (doc_id) where not failed group by all), steps group by stratum, rule, step, cut),
t as (
  select *, n > 0 and k < n and (
    select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rules.risk / len(SCORES)}) + (n - i) * ln(1 - {rules.risk / len(SCORES)})))
    from range(0, k + 1) x(i)) <= {rules.delta} / (select count(*) from (select distinct stratum, rule from k)) as sure
  from k),
o as (select *, bool_and(sure) over (partition by stratum, rule order by step) as certified from t),
b as (
  select stratum, rule, arg_max(cut, (caught - k) * 1000 - step) as cut
  from o where certified and caught > k group by stratum, rule),
bad as (select distinct s.doc_id from s join b on s.stratum = b.stratum and s.rule = b.rule where s.score > b.cut)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed,
       not failed and bad.doc_id is null as kept
from f left join bad on f.doc_id = bad.doc_id"""
