"""Spark ML jobs: occurrence and amount models of station rows, calibration, selection.

Models are fitted by Spark on the cluster; the driver holds fitted models and single rows of metrics."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from . import errors, nets, sketches

SEED = 7


@dataclass(frozen=True)
class Settings:
    """Sizes of the fits; the defaults are those of full fits, tests and small inputs take smaller ones."""

    rounds: int = 100
    depth: int = 6
    forest: int = 60
    forest_depth: int = 12
    least_leaf: int = 200
    hidden: tuple[int, ...] = (64, 64)
    net_rounds: int = 300
    linear_rounds: int = 100


SMALL = Settings(rounds=5, depth=3, forest=10, forest_depth=4, least_leaf=1, hidden=(8,), net_rounds=20, linear_rounds=20)


def positive(probability: str = "probability") -> Column:
    return F.element_at(vector_to_array(probability), 2)


def temporal_split(df: DataFrame, at: str, first: int, second: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows before `first`, then before `second`, then the rest, which no model sees."""
    return df.where(F.col(at) < first), df.where((F.col(at) >= first) & (F.col(at) < second)), df.where(F.col(at) >= second)


def _station_vector(numeric: Sequence[str]) -> list:
    return [StringIndexer(inputCol="station_id", outputCol="station_index", handleInvalid="keep"), OneHotEncoder(inputCols=["station_index"], outputCols=["station_vec"], handleInvalid="keep"), VectorAssembler(inputCols=list(numeric), outputCol="numeric", handleInvalid="keep"), VectorAssembler(inputCols=["numeric", "station_vec"], outputCol="features")]


def logistic(train: DataFrame, numeric: Sequence[str], fit: Settings = Settings()) -> PipelineModel:
    return Pipeline(stages=[*_station_vector(numeric), LogisticRegression(labelCol="label", weightCol="weight", maxIter=fit.linear_rounds)]).fit(train)


def trees(train: DataFrame, numeric: Sequence[str], kind: str, fit: Settings = Settings()) -> PipelineModel:
    model = (
        GBTClassifier(labelCol="label", weightCol="weight", maxIter=fit.rounds, maxDepth=fit.depth, seed=SEED)
        if kind == "gbt"
        else RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=fit.forest, maxDepth=fit.forest_depth, minInstancesPerNode=fit.least_leaf, seed=SEED)
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(numeric), outputCol="features"), model]).fit(train)


def perceptron(train: DataFrame, numeric: Sequence[str], fit: Settings = Settings(), classes: int = 2) -> nets.Perceptron:
    """Of scaled numbers and the station; a station takes a row of the first layer's weights, not a place in each row."""
    return nets.fit(train, numeric, fit.hidden, classes, fit.net_rounds, SEED)


# amounts: a point mass at zero and log-normal amounts, or amounts with their own error tables

FLOOR = 0.05
#: Probabilities of the error tables, and in how many classes of m they are kept.
PROBS = errors.PROBS
CLASSES = 10
SPREADS, ERRORS = ("constant", "varying"), ("normal", "table", "table_by_m")


@dataclass(frozen=True)
class AmountModel:
    """Occurrence, location and variance of log amounts, and quantiles of their standardised cross-fitted residuals.

    tables: for each spread, the quantiles of all residuals, then those of each class of m that `edges` part."""

    occurrence: PipelineModel
    location: object
    variance: object
    scale: float
    sigma: float
    edges: list[float]
    tables: dict[str, list[list[float]]]
    features: list[str]
    spread: str = "varying"
    errors: str = "normal"


def _amount_tree(fit: Settings) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="z", predictionCol="m", maxIter=fit.rounds, maxDepth=fit.depth, seed=SEED)


def _wet(rows: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(numeric), outputCol="features").transform(rows.where("target > 0").withColumn("z", F.ln("target")))


def residuals(wet: DataFrame, fold: Column, fit: Settings = Settings()) -> DataFrame:
    """wet with m and resid of a location model fitted on the other fold."""
    parts = []
    for k in (0, 1):
        fitted = _amount_tree(fit).fit(wet.where(fold != k))
        parts.append(fitted.transform(wet.where(fold == k)).withColumn("resid", F.col("z") - F.col("m")))
    return parts[0].unionByName(parts[1])


def _spread(rows: DataFrame, fit: Settings) -> tuple[object, float, float, list[float], dict[str, list[list[float]]]]:
    """Of rows with m and resid: the variance model (of log squared residuals) and the factor that makes it unbiased, the constant
    spread, the edges of the classes of m, and the error tables.  A class without residuals takes the table of all."""
    r = rows.withColumn("log_r2", F.ln(F.pow("resid", F.lit(2)) + 1e-4))
    v = GBTRegressor(featuresCol="features", labelCol="log_r2", predictionCol="v", maxIter=fit.rounds, maxDepth=fit.depth, seed=SEED).fit(r)
    s = v.transform(r)
    one = s.agg(F.avg(F.pow("resid", F.lit(2)) / F.exp("v")).alias("c"), F.sqrt(F.avg(F.pow("resid", F.lit(2)))).alias("sigma")).first()
    scale, sigma = float(one["c"] or 1.0), max(float(one["sigma"] or 1.0), FLOOR)
    edges = s.approxQuantile("m", [i / CLASSES for i in range(1, CLASSES)], 0.001)
    e = s.select(_class_of(F.col("m"), edges).alias("class"), (F.col("resid") / sigma).alias("constant"), (F.col("resid") / F.greatest(F.sqrt(F.exp("v") * scale), F.lit(FLOOR))).alias("varying"))
    by_class = sketches.sketches(e, ["class"], SPREADS)
    every = by_class.unionByName(sketches.merged(by_class, [], SPREADS).withColumn("class", F.lit(-1)))
    found = {row["class"]: row for row in every.select("class", *(sketches.quantiles(F.col(n), PROBS).alias(n) for n in SPREADS)).collect()}  # a row per class, and one of all
    return v, scale, sigma, edges, {n: [list(found.get(k, found[-1])[n]) for k in range(-1, CLASSES)] for n in SPREADS}


def _class_of(m: Column, edges: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda c: m > c))


def fit_amounts(train: DataFrame, numeric: Sequence[str], fold: Column, fit: Settings = Settings()) -> AmountModel:
    occurrence = trees(train.withColumn("label", (F.col("target") > 0).cast("int")).withColumn("weight", F.lit(1.0)), numeric, "gbt", fit)
    wet = _wet(train, numeric)
    spread = _spread(residuals(wet, fold, fit), fit)
    return AmountModel(occurrence, _amount_tree(fit).fit(wet), *spread, list(numeric))


def refit_variance(model: AmountModel, train: DataFrame, fold: Column, fit: Settings = Settings()) -> AmountModel:
    """Variance and error tables anew from cross-fitted residuals of these rows; occurrence and location are kept."""
    variance, scale, sigma, edges, tables = _spread(residuals(_wet(train, model.features), fold, fit), fit)
    return replace(model, variance=variance, scale=scale, sigma=sigma, edges=edges, tables=tables)


def score_amounts(model: AmountModel, rows: DataFrame) -> DataFrame:
    """rows with pi, m, s."""
    o = model.occurrence.transform(rows).withColumn("pi", positive()).drop("rawPrediction", "probability", "prediction")
    v = model.variance.transform(model.location.transform(o))
    return v.withColumn("s", F.greatest(F.sqrt(F.exp("v") * model.scale), F.lit(FLOOR))).drop("v", "features")


def _spread_of(model: AmountModel | None, spread: str) -> Column:
    return F.lit(model.sigma) if spread == "constant" else F.col("s")


def _tables(model: AmountModel, spread: str, kind: str) -> errors.Tables:
    return errors.Tables([], model.tables[spread][:1]) if kind == "table" else errors.Tables(model.edges, model.tables[spread][1:])


def exceedance(r: Column, model: AmountModel | None = None, spread: str | None = None, kind: str | None = None) -> Column:
    """P(Y > r) from pi, m and s; with a model by its chosen spread and errors, or those named."""
    spread, kind = spread or (model.spread if model else "varying"), kind or (model.errors if model else "normal")
    s = _spread_of(model, spread)
    if kind != "normal":
        return errors.over(_tables(model, spread, kind), F.col("pi"), F.col("m"), s, r)
    over = 1 - C.normal_cdf((F.ln(F.greatest(r, F.lit(1e-9))) - F.col("m")) / s)
    return F.when(r <= 0, F.col("pi")).otherwise(F.col("pi") * over)


def lattice_nll(over_low: Column, over_high: Column) -> Column:
    """-log of the probability that a forecast gives to a cell of the lattice, from P(Y > edge) of its edges (1 below the cell of 0)."""
    return -F.ln(F.greatest(over_low - over_high, F.lit(1e-9)))


def _cell(y: Column, step: float, p_over) -> tuple[Column, Column]:
    """P(Y > edge) of both edges of y's cell; the cell of 0 has everything below it."""
    low, high = errors.lattice(step, y)
    return F.when(low > 0, p_over(low)).otherwise(1.0), p_over(high)


FORMS = [(a, b) for a in SPREADS for b in ERRORS]


def select_errors(model: AmountModel, validation: DataFrame, y: str, step: float) -> tuple[AmountModel, DataFrame]:
    """(the model with the spread and error form of the lowest mean lattice NLL, the scores of all six): one pass over the rows."""
    each = F.array(*(F.struct(F.lit(a).alias("spread"), F.lit(b).alias("errors"), lattice_nll(*_cell(F.col(y), step, lambda r, a=a, b=b: exceedance(r, model, a, b))).alias("nll")) for a, b in FORMS))
    table = score_amounts(model, validation).select(F.explode(each).alias("x")).groupBy("x.spread", "x.errors").agg(F.avg("x.nll").alias("nll"))
    best = min(table.collect(), key=lambda r: (r["nll"], r["spread"], r["errors"]))  # six rows
    return replace(model, spread=best["spread"], errors=best["errors"]), table


def _normal_crps(at: Column, pi: Column, m: Column, s: Column) -> Column:
    """E|X - y| - E|X - X'| / 2 of a point mass 1 - pi at zero and a log-normal: both have closed forms."""
    z, mean = (F.ln(F.greatest(at, F.lit(1e-9))) - m) / s, F.exp(m + s * s / 2)
    apart = F.when(at > 0, at * (2 * C.normal_cdf(z) - 1) - mean * (2 * C.normal_cdf(z - s) - 1)).otherwise(mean)
    return (1 - pi) * at + pi * apart - pi * (1 - pi) * mean - pi * pi * mean * (2 * C.normal_cdf(s / math.sqrt(2)) - 1)


def amount_scores(df: DataFrame, y: str, step: float, model: AmountModel | None = None, spread: str = "varying", kind: str = "normal") -> DataFrame:
    """df (pi, m, s) with crps, nll_density (normal errors only, else null), nll_lattice, and lo, hi: what the forecast has below the
    lower and the upper edge of y's cell of the lattice, between which its PIT lies.

    Normal errors, or the model's tables: the same distribution gives all of a row's scores."""
    pi, m, at, s = F.col("pi"), F.col("m"), F.col(y), _spread_of(model, spread)
    if kind == "normal":
        z = (F.ln(F.greatest(at, F.lit(1e-9))) - m) / s
        crps = _normal_crps(at, pi, m, s)
        density = F.when(at > 0, -F.ln(F.greatest(pi, F.lit(1e-9))) + z * z / 2 + F.ln(s * math.sqrt(2 * math.pi)) + F.ln(at)).otherwise(-F.ln(F.greatest(1 - pi, F.lit(1e-9))))
    else:
        crps, density = errors.crps(_tables(model, spread, kind), pi, m, s, at), F.lit(None).cast("double")
    low, high = _cell(at, step, lambda r: exceedance(r, model, spread, kind))
    # the functions' columns first, so that each is computed once
    named = df.select("*", crps.alias("crps"), density.alias("nll_density"), low.alias("_low"), high.alias("_high"))
    return named.withColumn("nll_lattice", lattice_nll(F.col("_low"), F.col("_high"))).withColumn("lo", 1 - F.col("_low")).withColumn("hi", 1 - F.col("_high")).drop("_low", "_high")


def hazard_rows(rows: DataFrame, edges: Sequence[float]) -> DataFrame:
    """One row per edge that a wet row reaches: stopped = whether it ends in that class."""
    k = C.bucket(F.col("target"), edges)
    e = rows.withColumn("class", k).withColumn("j", F.explode(F.sequence(F.lit(1), F.least(k + 1, F.lit(len(edges))))))
    return e.withColumn("stopped", (F.col("j") == F.col("class") + 1).cast("int"))


KINDS = ("hazard", "forest", "net")


@dataclass(frozen=True)
class ClassModel:
    """Amounts of wet rows by classes between edges: a model of stopping at an edge, or of the class itself."""

    kind: str
    model: PipelineModel | nets.Perceptron
    edges: list[float]
    features: list[str]


def fit_classes(kind: str, train: DataFrame, numeric: Sequence[str], edges: Sequence[float], fit: Settings = Settings()) -> ClassModel:
    wet = train.where("target > 0")
    if kind == "hazard":
        model = trees(hazard_rows(wet, edges).withColumn("label", F.col("stopped")).withColumn("weight", F.lit(1.0)), [*numeric, "j"], "gbt", fit)
    else:
        rows = wet.withColumn("label", C.bucket(F.col("target"), edges).cast("double")).withColumn("weight", F.lit(1.0))
        if kind == "forest":
            model = trees(rows, numeric, "forest", fit)
        elif kind == "net":
            model = perceptron(rows, numeric, fit, len(edges) + 1)
        else:
            raise ValueError(f"unknown kind {kind}; one of {KINDS}")
    return ClassModel(kind, model, list(map(float, edges)), list(numeric))


def class_survival(model: ClassModel, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, survival: P(Y > edge) of a wet row for each edge, as an array.

    A hazard model is asked edge by edge with the edge as a constant column of the row, so no row is copied or moved."""
    n = len(model.edges)
    if model.kind == "hazard":
        now = rows
        for j in range(1, n + 1):
            scored = model.model.transform(now.withColumn("j", F.lit(j)))
            now = scored.select(*now.columns, (1 - positive()).alias(f"_stay_{j}"))
        return now.select(*keys, C.running_product(F.array(*(f"_stay_{j}" for j in range(1, n + 1)))).alias("survival"))
    # classes that no training row had are missing at the end of the vector
    p = vector_to_array("probability")
    over = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.aggregate(F.slice(p, j + 1, F.lit(n + 1)), F.lit(0.0), lambda a, x: a + x))
    return model.model.transform(rows).select(*keys, over.alias("survival"))


FORMAT = 1


def save_amounts(model: AmountModel, path: str, spark: SparkSession) -> None:
    """The fitted models and, beside them, what else the model is, as one line of JSON."""
    for name in ("occurrence", "location", "variance"):
        getattr(model, name).write().overwrite().save(f"{path}/{name}")
    meta = {"format": FORMAT, **{k: getattr(model, k) for k in ("scale", "sigma", "edges", "tables", "features", "spread", "errors")}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_amounts(path: str, spark: SparkSession, features: Sequence[str]) -> AmountModel:
    """The saved model; refused if it was saved in another format or for other features."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta.pop("format") != FORMAT:
        raise ValueError("the model was saved in another format")
    if meta["features"] != list(features):
        raise ValueError(f"the model was fitted on {meta['features']}, not on {list(features)}")
    return AmountModel(PipelineModel.load(f"{path}/occurrence"), GBTRegressionModel.load(f"{path}/location"), GBTRegressionModel.load(f"{path}/variance"), **meta)


def platt(scored: DataFrame, p: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a logistic calibration on the logit."""
    rows = scored.select(F.col(label).alias("label"), array_to_vector(F.array(C.logit(F.col(p)))).alias("features"))
    m = LogisticRegression(maxIter=20).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(p: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(slope * C.logit(p) + intercept)))


def equivalent_cutoff(cutoff: float, slope: float, intercept: float) -> float:
    """The calibrated probability that a raw one becomes: who is called wet at one is called wet at the other."""
    return 1 / (1 + math.exp(-(slope * math.log(cutoff / (1 - cutoff)) + intercept)))
