"""A multilayer perceptron over numbers and a station, fitted by Spark without one-hot vectors.

Spark's own classifier makes its inputs dense, so a row takes as many numbers as there are stations.  Here the first layer adds the
station's row of weights to what the numbers give, which is the same net.  Training rows lie in parts of whole stations; with them lie
their stations' weights and what L-BFGS keeps of its last MEMORY steps.  A look one step ahead is one pass over the parts, which moves
no row: it takes how much of each kept vector the step is made of and the shared weights, and gives the loss, the shared weights'
gradient and the products of the kept vectors.  So the driver holds nothing for each station, but for those of over MANY rows, whose
weights are shared and whose rows lie in any part."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch, shipping
from . import ordered

MEMORY = 6
#: Bytes of a part and of a partition of parts, about; rows of a station whose weights are shared; rows that are multiplied at once.
PART, PARTITION, MANY, SLICE = 2 << 20, 16 << 20, 1 << 17, 4096
#: Passes between two that are written to the shared folder: so many are done again, at most, for a lost executor.
CUT = 16
Layers = list[tuple[np.ndarray, np.ndarray]]


def _cut(flat: np.ndarray, sizes: Sequence[int]) -> Layers:
    """Weights (in by out) and offsets of each layer."""
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, own: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """The values of every layer: sigmoids, then probabilities; own is added in the first layer."""
    found = [x]
    for i, (w, b) in enumerate(layers):
        z = found[-1] @ w + b + (own if i == 0 else 0.0)
        if i < len(layers) - 1:
            found.append(0.5 + 0.5 * np.tanh(z / 2))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            found.append(e / e.sum(axis=1, keepdims=True))
    return found


def gradient(x: np.ndarray, at: np.ndarray, label: np.ndarray, flat: np.ndarray, own: np.ndarray, sizes: Sequence[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed cross-entropy, and its gradient by the shared weights and by the stations' rows."""
    layers = _cut(flat, sizes)
    values = _forward(x, own[at], layers)
    rows = np.arange(len(x))
    loss = -float(np.log(np.maximum(values[-1][rows, label], 1e-300)).sum())
    d, parts = values[-1].copy(), []
    d[rows, label] -= 1
    for i in reversed(range(len(layers))):
        parts += [d.sum(axis=0), (values[i].T @ d).ravel()]
        if i:
            d = (d @ layers[i][0].T) * values[i] * (1 - values[i])
    return loss, np.concatenate(parts[::-1]), np.stack([np.bincount(at, d[:, k], len(own)) for k in range(d.shape[1])], axis=1)


class Part(NamedTuple):
    """Rows of some stations. at: place of a row's station among `stations` and, after them, those of very many rows.

    now: the stations' weights and the gradient by them; steps: the last steps and what each added to the gradient."""

    stations: np.ndarray
    at: np.ndarray
    label: np.ndarray
    x: np.ndarray
    now: np.ndarray
    steps: np.ndarray


class Sums(NamedTuple):
    """Of a pass: the loss, the gradient by the shared weights, products of all steps, all that they added, and the gradient."""

    loss: float
    shared: np.ndarray
    products: np.ndarray


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part; its rows follow each other."""

    def slices() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            part = batch["part"].to_numpy()
            for a, b in itertools.pairwise([*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]):
                yield int(part[a]), batch.slice(a, b - a)

    for _, own in itertools.groupby(slices(), lambda s: s[0]):
        t = pa.Table.from_batches([batch for _, batch in own]).combine_chunks()
        arrays = t["number"].to_numpy(), t["label"].to_numpy(), np.asarray(t["x"].combine_chunks().flatten()).reshape(t.num_rows, -1)
        yield pa.record_batch([pa.array([pickle.dumps(arrays)], pa.binary())], names=["rows"])


def _unpacked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each station, with its weights."""
        for batch in batches:
            for stations, own in zip(batch["stations"], batch["own"], strict=True):
                number = np.frombuffer(stations.as_py(), np.int64)
                weights = pa.ListArray.from_arrays(np.arange(len(number) + 1, dtype=np.int32) * width, np.frombuffer(own.as_py()))
                yield pa.record_batch([pa.array(number), weights], names=["number", "_own"])

    return run


def _part(rows: bytes, width: int) -> Part:
    number, label, x = pickle.loads(rows)
    stations = np.unique(number[number >= 0])
    at = np.where(number >= 0, np.searchsorted(stations, number), len(stations) - 1 - number)
    return Part(stations, at, label, x, np.zeros((2, len(stations), width)), np.zeros((0, 2, len(stations), width), np.float32))


def _ahead(now: np.ndarray, steps: np.ndarray, share: np.ndarray, step: float) -> np.ndarray:
    """What a step adds to weights: shares of the steps, of what each added to the gradient, and of the gradient."""
    k = len(steps)
    return step * (np.tensordot(share[:k], steps[:, 0], 1) + np.tensordot(share[k : 2 * k], steps[:, 1], 1) + share[-1] * now[1])


def _stepped(now: np.ndarray, steps: np.ndarray, ahead: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and gradient there, the steps with this one, their products."""
    new = np.concatenate([steps, np.stack([ahead, g - now[1]])[None].astype(steps.dtype)])
    kept = np.concatenate([new[:, 0].reshape(len(new), -1), new[:, 1].reshape(len(new), -1), g.reshape(1, -1)]).astype(float)
    return np.stack([now[0] + ahead, g]), new, kept @ kept.T


def _moved(part: Part, shared: np.ndarray, sizes: Sequence[int], n: int, keep: Sequence[int], share: np.ndarray, step: float) -> tuple[Part, Sums]:
    """The part a step on; g is that of the mean loss of all n rows."""
    width, own = sizes[1], len(part.stations)
    net = sum(a * b + b for a, b in itertools.pairwise(sizes))
    steps = part.steps[list(keep)]
    ahead = _ahead(part.now, steps, share, step)
    weights = np.concatenate([part.now[0] + ahead, shared[net:].reshape(-1, width)])
    loss, flat, g = 0.0, np.zeros(net), np.zeros_like(weights)
    for i in range(0, len(part.x), SLICE):
        rows = slice(i, i + SLICE)
        one, f, h = gradient(part.x[rows], part.at[rows], part.label[rows], shared[:net], weights, sizes)
        loss, flat, g = loss + one / n, flat + f / n, g + h / n
    now, steps, products = _stepped(part.now, steps, ahead, g[:own])
    return part._replace(now=now, steps=steps), Sums(loss, np.concatenate([flat, g[own:].ravel()]), products)


def _added(sums: Iterable[Sums]) -> Sums | None:
    total = None
    for s in sums:
        total = s if total is None else Sums(*(a + b for a, b in zip(total, s, strict=True)))
    return total


class Descent:
    """Weights that are moved: the shared ones here, those of stations in `parts`."""

    def __init__(self, spark: SparkSession, parts: RDD, shared: np.ndarray, sizes: Sequence[int], n: int) -> None:
        self.spark, self.parts, self.sizes, self.n = spark, parts, sizes, max(1, n)
        self.now, self.steps = np.stack([shared, np.zeros_like(shared)]), np.zeros((0, 2, len(shared)))
        self.asked, self.since, self.written = None, 0, None

    def ask(self, keep: Sequence[int], share: np.ndarray, step: float) -> tuple[float, np.ndarray]:
        """The loss a step ahead, and the products of the vectors that are kept there."""
        self._forget()
        steps, sizes, n = self.steps[list(keep)], self.sizes, self.n
        ahead = _ahead(self.now, steps, share, step)
        shared = self.now[0] + ahead
        parts = self.parts.map(lambda p: _moved(p[0], shared, sizes, n, keep, share, step)).persist(StorageLevel.MEMORY_AND_DISK)
        cut = self.since + 1 >= CUT
        if cut:
            parts.checkpoint()
        sums = _added(parts.mapPartitions(lambda ps: filter(None, [_added(p[1] for p in ps)])).collect())  # one for each partition
        loss, g, products = sums or Sums(0.0, np.zeros_like(shared), np.zeros((2 * len(steps) + 3,) * 2))
        now, steps, own = _stepped(self.now, steps, ahead, g)
        self.asked = parts, now, steps, cut
        return loss, products + own

    def take(self) -> None:
        """Goes where it looked last."""
        before, written = self.parts, self.written
        (self.parts, self.now, self.steps, cut), self.asked = self.asked, None
        self.since = 0 if cut else self.since + 1
        before.unpersist()
        if cut:
            self.written = self.parts.getCheckpointFile()
            self._delete(written)

    def close(self) -> None:
        self._forget()
        self.parts.unpersist()
        self._delete(self.written)

    def _forget(self) -> None:
        if self.asked:
            parts, _, _, cut = self.asked
            parts.unpersist()
            if cut:
                self._delete(parts.getCheckpointFile())
            self.asked = None

    def _delete(self, path: str | None) -> None:
        if path:
            scratch.delete(self.spark, path)


def direction(products: np.ndarray) -> np.ndarray:
    """L-BFGS's direction as shares of the steps, of what they added to the gradient, and of the gradient, from their products."""
    k = len(products) // 2
    share, sums = np.zeros(2 * k + 1), np.zeros(k)
    share[-1] = -1.0
    for i in reversed(range(k)):
        sums[i] = share @ products[:, i] / products[i, k + i]
        share[k + i] -= sums[i]
    share *= products[k - 1, 2 * k - 1] / products[2 * k - 1, 2 * k - 1] if k else 1 / max(1e-30, float(np.sqrt(products[0, 0])))
    for i in range(k):
        share[i] += sums[i] - share @ products[:, k + i] / products[i, k + i]
    return share


def minimised(ask: Callable[[Sequence[int], np.ndarray, float], tuple[float, np.ndarray]], take: Callable[[], None], rounds: int, tol: float = 1e-6) -> None:
    """L-BFGS with halved steps, the first one of length 1; done when MEMORY steps together gain less than a share of tol.

    ask(which steps are kept, shares, step) looks ahead, take() goes there."""
    value, products = ask([], np.zeros(1), 0.0)
    take()
    keep, held, values = [], 1, [value]
    for _ in range(rounds):
        kept = [*keep, *(held + i for i in keep), 2 * held]
        now = products[np.ix_(kept, kept)]
        share = direction(now)
        slope, step = float(now[-1] @ share), 1.0
        if not slope < 0:
            break
        while True:
            found, products = ask(keep, share, step)
            if found <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if not found < value:
            break
        take()
        held, value = len(keep) + 1, found
        both = products[held - 1, 2 * held - 1] > 1e-12 * products[2 * held - 1, 2 * held - 1]
        keep = list(range(held if both else held - 1))[-MEMORY:]
        values.append(value)
        if len(values) > MEMORY and values[-1 - MEMORY] - value <= tol * max(1.0, abs(value)):
            break


@dataclass(frozen=True)
class Perceptron:
    """transform() adds `probability`.  A station that no training row had adds nothing to the first layer."""

    numeric: list[str]
    mean: np.ndarray
    scale: np.ndarray
    sizes: list[int]
    flat: np.ndarray
    stations: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        shipping.ship(df.sparkSession)
        mean, scale, layers = self.mean, self.scale, _cut(self.flat, self.sizes)

        def asked(x: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series(list(_forward((np.stack(x.to_numpy()) - mean) * scale, np.stack(own.to_numpy()), layers)[-1]))

        none = F.array(*(F.lit(0.0) for _ in range(self.sizes[1])))
        p = F.pandas_udf(asked, "array<double>")(_numbers(self.numeric), F.coalesce("_own", none))
        return df.join(self.stations, "station_id", "left").withColumn("probability", array_to_vector(p)).drop("_own")


def _numbers(numeric: Sequence[str]):
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric))


def fit(train: DataFrame, numeric: Sequence[str], hidden: Sequence[int], classes: int, rounds: int, seed: int) -> Perceptron:
    """train: station_id, label (0 to classes - 1) and the numeric columns, which are scaled to mean 0 and deviation 1."""
    spark = train.sparkSession
    shipping.ship(spark)
    known = scratch.table(train.where("station_id is not null").select("station_id", F.col("label").cast("int").alias("label"), _numbers(numeric).alias("x")), "net-rows")
    stats = known.agg(F.count(F.lit(1)).alias("n"), *(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(numeric)) for n, f in (("m", F.avg), ("s", F.stddev)))).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(numeric))])
    spread = np.array([stats[f"s{i}"] or 0.0 for i in range(len(numeric))])
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)
    sizes = [len(numeric), *hidden, classes]
    row, kept = 8 * len(numeric) + 16, hidden[0] * (16 + 8 * (MEMORY + 1))  # bytes in a part: of a row, of a station
    many = F.col("rows") > MANY
    counted = known.groupBy("station_id").agg(F.count(F.lit(1)).alias("rows")).select("*", F.lit(1).alias("one"), many.cast("int").alias("many"), F.when(many, 0).otherwise(F.col("rows") * row + kept).alias("bytes"))
    placed = ordered.running(counted, "station_id", ["one", "many", "bytes"])
    number, part = F.when(many, -1 - F.col("before_many")).otherwise(F.col("before_one")), F.when(~many, F.floor(F.col("before_bytes") / PART))
    numbers = scratch.table(placed.select(*counted.columns, number.cast("long").alias("number"), part.cast("long").alias("part")), "net-stations")
    found = numbers.agg(F.sum("many").alias("many"), F.max("part").alias("last"), F.sum("bytes").alias("bytes"), F.sum(F.col("many") * F.col("rows")).alias("rows")).first()
    few, dealt, size = (-1 if found["last"] is None else found["last"]) + 1, (found["rows"] or 0) * row // PART + 1, (found["bytes"] or 0) + (found["rows"] or 0) * row
    count = max(1, min(few + dealt, max(2 * spark.sparkContext.defaultParallelism, size // PARTITION)))
    scaled = F.array(*((F.col("x")[i] - float(mean[i])) * float(scale[i]) for i in range(len(numeric)))).alias("x")
    # rows of a station of very many go to all parts beyond the others' by their places in the written table
    rows = known.withColumn("_i", F.monotonically_increasing_id()).join(numbers.select("station_id", "number", "part"), "station_id").select(F.coalesce("part", few + F.col("_i") % dealt).alias("part"), "number", "label", scaled)
    packed = rows.repartitionByRange(count, "part").sortWithinPartitions("part", "number", "label", "x").mapInArrow(_packed, "rows binary")
    draw, width = np.random.default_rng(seed), sizes[1]
    flat = np.concatenate([np.concatenate([draw.uniform(-1, 1, a * b) * 2.4 / a, np.zeros(b)]) for a, b in itertools.pairwise(sizes)])
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch.folder(spark, "net-steps"))
    net = Descent(spark, packed.rdd.map(lambda r: (_part(r[0], width), None)), np.concatenate([flat, np.zeros((found["many"] or 0) * width)]), sizes, stats["n"])
    minimised(net.ask, net.take, rounds)
    shared = net.now[0]
    shared_own = [(-1 - i, w.tolist()) for i, w in enumerate(shared[len(flat) :].reshape(-1, width))]
    schema = "number long, _own array<double>"
    parts = spark.createDataFrame(net.parts.map(lambda p: (p[0].stations.tobytes(), p[0].now[0].tobytes())), "stations binary, own binary", verifySchema=False)
    own = parts.mapInArrow(_unpacked(width), schema).unionByName(spark.createDataFrame(shared_own, schema))
    named = scratch.table(numbers.select("station_id", "number").join(own, "number").select("station_id", "_own"), "net-weights")
    net.close()
    return Perceptron(list(numeric), mean, scale, sizes, shared[: len(flat)], named)
