"""Toxicity by a weighted finite-state grammar over clauses (operator 13).

Tokens of a clause are read as symbols (an insult, violence, intent, a target, a negation, speech,
a quotation mark, anything else), and a cascade of sequential transducers rewrites them: negation
and reported speech turn what they cover into symbols of their own, intent makes violence a
threat, a target makes an insult an address, and the last one gives each match its kind and weight.
`compose` joins the cascade into one table, so a clause is read once.  A document's score comes
from its matched clauses: what kinds they are of, how heavy their best match is, how many they are and how many of
the document's clauses; isolated words count for nothing but as parts of matches.

Which words are insults is known for few languages, so beyond a short list of common ones the lexicon
is learned from labelled documents: words and beginnings of words that are in more toxic documents than
chance gives (exact binomial tails, over all that were tried).  A beginning must explain documents that no
single longer form of it does.  Weights of kinds are fitted by logistic regression on the same documents.

Only rows of labels outside the held-out quarter are read.  At most about SAMPLE of them, chosen by a
hash of doc_id, are used, and at most FORMS candidates; both bounds are parameters.  Everything else, the
scores first of all, covers all documents and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the lexicon and the weights are fitted on, at most (in expectation), and candidates for the lexicon.
SAMPLE, FORMS = 1 << 18, 1 << 18
#: Characters of a text that are read at a time, at least; the next clause's end is where they are cut.
PIECE = 1 << 20
#: Beginnings of words that are tried.
PREFIXES = range(4, 9)
#: Chance that any form of the lexicon is there by luck.
LEVEL = 0.05
#: Part of a beginning's toxic texts that no single longer form of it explains, at least.
OWN = 0.25

# Short lists for the four languages of the corpus.
INSULTS = "idiot idiots moron morons stupid dumb fool loser losers scum jerk imbecile pathetic worthless disgusting trottel dummkopf idiotin abschaum imbécile idiote crétin connard idiota estúpido estúpida imbécil"
VIOLENCE = "kill hurt beat destroy punch stab shoot töten schlagen tuer frapper matar golpear"
INTENT = "will gonna ll shall going werde werden wird vais va voy vamos"
TARGETS = "you your yours u he she him her they them this that these those du dich dir ihr euch sie tu te toi vous ce cette tú ti usted ustedes este esta"
NEGATIONS = "not no never nor without isn aren wasn don doesn didn nicht kein keine keinen nie ohne pas jamais sans aucun nunca jamás sin ni"
SPEECH = "said says say called calls wrote quoted claimed according reported sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió"

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]+|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?;\n]")
SYMBOLS = "oivmynsq"
#: Kinds of matches.
KINDS = ("plain", "targeted", "hedged", "threat", "mention")
FEATURES = (*KINDS, "heaviest", "matches", "share")
#: What a score is before anything is fitted: (intercept, weight of the heaviest match).
UNFITTED = (-3.0, 1.0)

Arcs = dict[tuple[int, str], tuple[int, str, float]]


def transducer(states: int, alphabet: str, step) -> Arcs:
    """step(state, symbol) -> (state, symbol, weight)."""
    return {(s, x): step(s, x) for s in range(states) for x in alphabet}


def compose(a: Arcs, b: Arcs) -> Arcs:
    """What b makes of what a writes, from both starts (state 0); weights multiply."""
    numbers, todo, out = {(0, 0): 0}, [(0, 0)], {}
    for p, q in todo:
        for x in {x for s, x in a if s == p}:
            p2, y, v = a[p, x]
            q2, z, w = b[q, y]
            if (p2, q2) not in numbers:
                numbers[p2, q2] = len(numbers)
                todo.append((p2, q2))
            out[numbers[p, q], x] = (numbers[p2, q2], z, v * w)
    return out


def _negation(left: int, x: str):
    """Three tokens after a negation an insult is I and violence V."""
    if x == "n":
        return 3, "o", 1.0
    return max(0, left - 1), {"i": "I", "v": "V"}.get(x, x) if left else x, 1.0


def _reported(s: int, x: str):
    """After a verb of speech (bit 1), up to the clause's end, and inside quotation marks (bit 2) an insult is R and violence W."""
    if x == "s":
        return s | 1, "o", 1.0
    if x == "q":
        return s ^ 2, "o", 1.0
    return s, {"i": "R", "v": "W"}.get(x, x) if s else x, 1.0


def _threat(left: int, x: str):
    """Violence within four tokens of an intent is a threat (T)."""
    if x == "m":
        return 4, "o", 1.0
    return max(0, left - 1), "T" if x == "v" and left else x, 1.0


def _target(s: int, x: str):
    """An insult within four tokens after a target (s of 1 to 4) or two before one (s of 5, 6) is an address (A)."""
    if x == "y":
        return 4, "A" if s > 4 else "o", 0.5 if s > 4 else 1.0
    if x == "i":
        return 6, "A" if 0 < s <= 4 else "i", 1.0
    return (s - 1 if s not in (0, 5) else 0), x, 1.0


#: The last transducer's weights, before any are fitted.
WEIGHTS = {"i": ("plain", 1.0), "A": ("targeted", 1.0), "I": ("hedged", 1.0), "R": ("hedged", 1.0), "T": ("threat", 1.0), "v": ("mention", 1.0), "V": ("mention", 0.5), "W": ("mention", 0.5)}


def _kinds(_: int, x: str):
    kind, weight = WEIGHTS.get(x, ("", 0.0))
    return 0, str(KINDS.index(kind)) if kind else "", weight


def grammar() -> Arcs:
    cascade = [transducer(4, SYMBOLS, _negation), transducer(4, "oivmyIVsq", _reported), transducer(5, "oivmyIVRW", _threat), transducer(7, "oivyIVRWT", _target), transducer(1, "oivIVRWTA", _kinds)]
    out = cascade[0]
    for t in cascade[1:]:
        out = compose(out, t)
    return out


class Lexicon(dict):
    """Word -> (symbol, weight): the lists, then the heaviest learned form of an insult that fits.  Words seen are kept, up to a bound."""

    def __init__(self, forms: dict[str, float]):
        self.forms = forms
        self.known = {w: (x, 1.0) for words, x in ((VIOLENCE, "v"), (INTENT, "m"), (TARGETS, "y"), (NEGATIONS, "n"), (SPEECH, "s")) for w in words.split()}
        self.known |= {w: ("i", 3.0) for w in INSULTS.split()}

    def __missing__(self, word: str) -> tuple[str, float]:
        if len(self) > 1 << 20:
            self.clear()
        found = self.known.get(word, ("q", 0.0) if not word.isalpha() else ("o", 0.0))
        weight = max((self.forms[f] for f in forms_of(word) if f in self.forms), default=0.0)
        if weight > (found[1] if found[0] == "i" else 0.0):
            found = ("i", weight)
        if _END.match(word):
            found = (".", 0.0)
        self[word] = found
        return found


def forms_of(word: str) -> list[str]:
    """A word (lower case) and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def pieces(text: str) -> Iterator[str]:
    """Of a long text, cut at the ends of clauses (or of two pieces' characters, where no clause ends)."""
    at = 0
    while at < len(text):
        end = _END.search(text, at + PIECE, at + 2 * PIECE)
        to = end.end() if end else min(len(text), at + 2 * PIECE)
        yield text[at:to]
        at = to


class Reader:
    """Reads texts by the grammar and a lexicon."""

    def __init__(self, forms: dict[str, float]):
        self.lexicon, self.arcs = Lexicon(forms), grammar()

    def features(self, text: str) -> list[float]:
        """Of one text, as named in FEATURES: kinds as log(1 + the sum of the clauses' heaviest match of the kind)."""
        sums, heaviest, matched, clauses = [0.0] * len(KINDS), 0.0, 0, 0
        for piece in pieces(text.lower()):
            tokens = _TOKEN.findall(piece)
            found = list(map(self.lexicon.__getitem__, tokens))
            symbols = "".join([x for x, _ in found])
            at = 0
            for clause in symbols.split("."):
                if clause:
                    clauses += 1
                    if "i" in clause or "v" in clause:
                        best = self._clause(clause, found[at : at + len(clause)])
                        matched += 1
                        for kind, weight in best.items():
                            sums[kind] += weight
                            heaviest = max(heaviest, weight)
                at += len(clause) + 1
        return [*(math.log1p(x) for x in sums), heaviest, math.log1p(matched), matched / max(clauses, 1)]

    def _clause(self, clause: str, found: list[tuple[str, float]]) -> dict[int, float]:
        """The heaviest match of each kind."""
        state, last, best = 0, 0.0, {}
        for x, (_, lexical) in zip(clause, found, strict=True):
            last = lexical or last  # an address after an insult has the insult's weight
            state, kind, weight = self.arcs[state, x]
            if kind:
                best[int(kind)] = max(best.get(int(kind), 0.0), weight * last)
        return best


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _toxic_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """form, n: texts of the task that have it."""
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["form", "n"])

    for batch in batches:
        for text in _texts(batch):
            words = set(_WORD.findall(text.lower()))
            seen.update({f for w in words for f in forms_of(w)})
            if len(seen) > 1 << 19:
                yield out()
                seen.clear()
    yield out()


def _clean_forms(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        count = np.zeros(len(numbers), np.int64)
        of: dict[str, list[int]] = {}
        for batch in batches:
            for text in _texts(batch):
                here: set[int] = set()
                for w in set(_WORD.findall(text.lower())):
                    if w not in of:
                        if len(of) > 1 << 20:
                            of.clear()
                        of[w] = [numbers[f] for f in forms_of(w) if f in numbers]
                    here.update(of[w])
                count[list(here)] += 1
        held = np.flatnonzero(count)
        yield pa.record_batch([pa.array(held), pa.array(count[held])], names=["form", "n"])

    return run


def luck(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """log P(X >= k) for X binomial(n, p), bounded above by Chernoff's exponent, which is exact enough for levels and never too small."""
    share = k / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(share >= 1, -np.log(p), share * np.log(share / p) + (1 - share) * np.log((1 - share) / (1 - p)))
    return np.where(share > p, -n * apart, 0.0)


def lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """form -> weight (log odds), of the forms that are in toxic texts by more than luck."""
    if not toxic or not n_toxic or not n_clean:
        return {}
    names = list(toxic)
    place = {f: i for i, f in enumerate(names)}
    a, b = np.array([toxic[f] for f in names]), np.array([clean.get(f, 0) for f in names])
    # toxic texts of the longer form that has most
    of = np.zeros(len(names), np.int64)
    for i, f in enumerate(names):
        stem = f[:-1] if f.endswith("*") else f
        shorter = stem if not f.endswith("*") and len(stem) in PREFIXES else stem[:-1] if f.endswith("*") else stem[: PREFIXES[-1]]
        j = place.get(shorter + "*", -1)
        if j >= 0:
            of[j] = max(of[j], a[i])
    rate, level = n_toxic / (n_toxic + n_clean), math.log(LEVEL / len(names))
    good = (luck(a, a + b, rate) < level) & (a - of > OWN * a)
    weight = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    return {names[i]: float(weight[i]) for i in np.flatnonzero(good & (weight > 1))}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """labelled, toxic: of each label outside the held-out quarter, or of about `rows` of them; a repeated label is toxic if any says so."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.count()
    chosen = usable if n <= rows else usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * rows / n))
    return common.write_table(chosen.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic")), "labels")


def learn(docs: DataFrame, sample: DataFrame, forms: int = FORMS) -> dict[str, float]:
    """The lexicon, from the texts of a bounded sample of labels (labelled, toxic)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))  # SAMPLE rows
    counts = texts.where("text is not null").groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in counts}
    every = texts.where("toxic > 0").select("text").mapInArrow(_toxic_forms, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).where("n >= 4")
    toxic = {r["form"]: r["n"] for r in every.orderBy(F.desc("n"), "form").limit(forms).collect()}
    names = list(toxic)
    sent = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    found = texts.where("toxic = 0").select("text").mapInArrow(_clean_forms(sent), "form long, n long").groupBy("form").agg(F.sum("n").alias("n")).collect()  # FORMS rows
    return lexicon(toxic, {names[r["form"]]: r["n"] for r in found}, n.get(1, 0), n.get(0, 0))


def _read(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            rows = [reader.features(t) for t in _texts(batch)]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.float64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(FEATURES)))], names=["doc_id", *FEATURES])

    return run


def weights(measured: DataFrame, sample: DataFrame) -> tuple[float, dict[str, float]]:
    """Intercept and weights of the features, by logistic regression; those of UNFITTED where the sample has one class only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = common.write_table(measured.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select(F.col("toxic").cast("double").alias("label"), *FEATURES), "graded")
    if rows.select("label").distinct().count() < 2:
        return UNFITTED[0], {"heaviest": UNFITTED[1]}
    model = LogisticRegression(regParam=1e-3, maxIter=100).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    return model.intercept, dict(zip(FEATURES, map(float, model.coefficients), strict=True))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE, forms: int = FORMS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, and the features of its clauses (see FEATURES).

    Null and empty texts have no clauses: their features are 0 and their score is that of such a document.  A null doc_id has no
    label and is not held out.  Copies and repeated rows have equal scores.  Labels of null doc_ids, null labels and labels of
    the held-out quarter aren't used.  Without labels, or with labels of one class, the lists alone give a score.  Only doc_id
    and text of docs are read."""
    spark = docs.sparkSession
    common.ship(spark)
    sample = _sample(labels, sample_rows)
    sent = spark.sparkContext.broadcast(learn(docs, sample, forms))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = common.write_table(narrow.mapInArrow(_read(sent), f"doc_id long, {', '.join(f'{f} double' for f in FEATURES)}"), "clauses")
    intercept, fitted = weights(measured, sample)
    logit = F.lit(intercept)
    for f, w in fitted.items():
        logit = logit + F.lit(w) * F.col(f)
    found = measured.withColumn("score", 1 / (1 + F.exp(-logit)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
