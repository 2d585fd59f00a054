"""Station series: typed loading, cleaning, slots, range frames, sessions.

All frames of one function share one partitioning (station) and one order, so Spark plans a single
shuffle and sort for them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

STAMP = "yyyy-MM-dd'T'HH:mm:ssXXX"


def parse(raw: DataFrame) -> DataFrame:
    """Strings to typed columns; what can't be read is null, never an error."""
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit(STAMP)))
    number = lambda c: F.col(c).try_cast("double")
    return raw.select(
        F.col("event_id").try_cast("long").alias("event_id"),
        seconds("timestamp").alias("epoch"),
        seconds("update_timestamp").alias("update_epoch"),
        F.trim("station_id").alias("station_id"),
        number("location_latitude").alias("lat"),
        number("location_longitude").alias("lon"),
        number("reading_value").alias("y"),
        F.trim("reading_unit").alias("unit"),
    )


def clauses() -> dict[str, Column]:
    """Reason -> what a valid row satisfies."""
    return {
        "no_time": F.col("epoch").isNotNull(),
        "no_station": F.length("station_id") > 0,
        "no_value": F.col("y").isNotNull(),
        "negative": F.col("y") >= 0,
        "latitude": F.col("lat").between(-90, 90),
        "longitude": F.col("lon").between(-180, 180),
        "unit": F.col("unit") == "mm",
    }


def is_valid() -> Column:
    """Null counts as invalid, so every row is in exactly one of the two halves."""
    whole = F.lit(True)
    for clause in clauses().values():
        whole = whole & F.coalesce(clause, F.lit(False))
    return whole


def ranked_latest(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))


def latest(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """One row per key; with rn = 1 Spark limits the groups before it shuffles them."""
    return ranked_latest(df, keys, newest).where("rn = 1").drop("rn")


def discarded(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    return ranked_latest(df, keys, newest).where("rn > 1").drop("rn")


def with_slot(readings: DataFrame, slot_s: int) -> DataFrame:
    return readings.withColumn("slot", C.slot(F.col("epoch"), slot_s))


def gaps(df: DataFrame, key: str, at: str) -> DataFrame:
    return df.withColumn("gap", F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at)))


def gap_summary(df: DataFrame, key: str, at: str, slot_s: int) -> DataFrame:
    g = gaps(df, key, at)
    return g.groupBy(key).agg(
        F.count_if(F.col("gap") > slot_s).alias("n_gaps"),
        F.coalesce(F.sum(F.when(F.col("gap") > slot_s, F.floor(F.col("gap") / slot_s) - 1)), F.lit(0)).cast("long").alias("n_missing"),
        F.max("gap").alias("longest"),
    )


def frame(key: str, at: str, first_s: int, last_s: int):
    return Window.partitionBy(key).orderBy(at).rangeBetween(first_s, last_s)


def trailing(df: DataFrame, spans: Mapping[str, int], digits: int = 4) -> DataFrame:
    """last_<name> and n_<name>: sum and count over the closed span that ends at the row."""
    for name, seconds in spans.items():
        w = frame("station_id", "slot", -seconds, 0)
        df = df.withColumn(f"last_{name}", F.round(F.sum("y").over(w), digits)).withColumn(f"n_{name}", F.count("y").over(w))
    return df


def forward(df: DataFrame, seconds: int, digits: int = 4) -> DataFrame:
    """target and n_target: sum and count over (t, t + seconds]; the row itself is not in it."""
    w = frame("station_id", "slot", 1, seconds)
    return df.withColumn("target", F.round(F.coalesce(F.sum("y").over(w), F.lit(0.0)), digits)).withColumn("n_target", F.count("y").over(w))


def slot_frames(df: DataFrame, slot_s: int, digits: int = 4) -> DataFrame:
    """Exact lags as point frames (null where the slot is missing), sums, peak and count."""
    at = lambda k: F.max("y").over(frame("station_id", "slot", -k * slot_s, -k * slot_s))
    over = lambda f, k: f.over(frame("station_id", "slot", -(k - 1) * slot_s, 0))
    out = df
    for k in (1, 2, 3):
        out = out.withColumn(f"lag_{k}", at(k))
    for k in (2, 4, 12):
        out = out.withColumn(f"sum_{k}", F.round(over(F.sum("y"), k), digits))
    return out.withColumn("peak_12", over(F.max("y"), 12)).withColumn("count_12", over(F.count("y"), 12))


def eligible(df: DataFrame, slots_before: int, slots_after: int) -> DataFrame:
    return df.where((F.col("n_history") == slots_before) & (F.col("n_target") == slots_after))


def sessions(df: DataFrame, gap_s: int, slot_s: int) -> DataFrame:
    """Wet spells: a wet reading over gap_s after the last starts a new one.

    complete: no slot of the spell is missing, seen from the row numbers over all readings, dry ones included."""
    every = Window.partitionBy("station_id").orderBy("slot")
    wet = df.withColumn("rn", F.row_number().over(every)).where("y > 0")
    new = F.coalesce((F.col("slot") - F.lag("slot").over(every) > gap_s).cast("int"), F.lit(1))
    marked = wet.withColumn("new", new).withColumn("spell", F.sum("new").over(every.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("station_id", "spell").agg(F.min("slot").alias("begin"), F.max("slot").alias("end"), F.round(F.sum("y"), 4).alias("depth"), F.max("y").alias("peak"), F.count(F.lit(1)).alias("n_wet"), (F.max("rn") - F.min("rn") + 1).alias("n_rows"))
    return out.withColumn("duration", F.col("end") - F.col("begin") + slot_s).withColumn("complete", F.col("n_rows") * slot_s == F.col("duration"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def stratified(df: DataFrame, positive: Column, share: float, key: Column) -> DataFrame:
    """All positives and a share of the negatives, chosen by arithmetic on a key, with weight 1 / share."""
    kept = F.pmod(key * 1103515245 + 12345, F.lit(2147483648)) < F.lit(int(share * 2147483648))
    return df.where(positive | kept).withColumn("weight", F.when(positive, 1.0).otherwise(1.0 / share))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = rows / (classes * rows of the class); the joined side has a row per class."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = n.select(label, (F.sum("n_class").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_class"))).alias("weight"))
    return df.join(w, label)
