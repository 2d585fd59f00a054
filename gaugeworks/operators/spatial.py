"""Station geometry and joins in space and time.

Neighbours are found by cells: a station meets only stations of its own and the adjoining cells, so
the join is an equality join on the cell and never all stations against all.  Where stations are dense, cells are narrower."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import scratch


def _celled(stations: DataFrame, targets: DataFrame, km: float) -> tuple[DataFrame, DataFrame]:
    """Stations in cells of `km`; the second frame has each target in its cell and the eight around it."""
    dlat = km / C.KM_PER_DEGREE
    # cells of a row of latitude are as wide as at the row's far edge, so they are never under `km`
    width = lambda cy: dlat / F.greatest(F.cos(F.radians((F.abs(cy) + 2) * dlat)), F.lit(0.01))
    cy = F.floor(F.col("lat") / dlat)
    beside = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    at = targets.select("station_id", "lat", "lon", cy.alias("cy")).withColumn("d", beside).withColumn("gy", F.col("cy") + F.col("d"))
    spread = at.withColumn("e", beside).select(F.col("station_id").alias("target"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("gy").alias("cy"), (F.floor(F.col("lon") / width(F.col("gy"))) + F.col("e")).alias("cx"))
    homes = stations.select("station_id", "lat", "lon", cy.alias("cy"), F.floor(F.col("lon") / width(cy)).alias("cx"))
    return homes, spread


def within(stations: DataFrame, km: float, targets: DataFrame | None = None) -> DataFrame:
    """station_id, nb, km: ordered pairs of a station (of targets, if given) and another within `km` of it."""
    homes, spread = _celled(stations, stations if targets is None else targets, km)
    pairs = spread.join(homes.withColumnRenamed("station_id", "nb"), ["cy", "cx"]).where("target <> nb")
    d = C.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))
    return pairs.select(F.col("target").alias("station_id"), "nb", d.alias("km"), "lat1", "lon1", "lat", "lon").where(F.col("km") <= km)


def radius_pairs(stations: DataFrame, km: float) -> DataFrame:
    w = Window.partitionBy("station_id").orderBy("km", "nb")
    return within(stations, km).select("station_id", "nb", F.row_number().over(w).alias("nb_rank"), F.round("km", 6).alias("km"))


#: Stations of a cell beyond which the search begins with cells of half the width, and how often they are halved at most (4 km: 1 m).
CROWD, HALVINGS = 64, 12


def _crowded(stations: DataFrame, km: float) -> DataFrame:
    """The stations whose cell of `km` has more than CROWD of them: from counts alone."""
    homes, _ = _celled(stations, stations, km)
    full = homes.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    return homes.join(full, ["cy", "cx"], "left_semi").select("station_id", "lat", "lon")


def _begun(stations: DataFrame, start_km: float) -> list[tuple[float, DataFrame]]:
    """(width, stations that begin there), from the narrowest cells on: cells are split while they are crowded, like a quadtree's."""
    levels, here, km = [], stations, start_km
    for _ in range(HALVINGS):
        crowded = scratch.table(_crowded(here, km), "crowded")
        if crowded.isEmpty():
            break
        levels.append((km, here.join(crowded.select("station_id"), "station_id", "left_anti")))
        here, km = crowded, km / 2
    return [(km, here), *reversed(levels)]


def nearest(stations: DataFrame, k: int, start_km: float = 4.0, widest_km: float = 1000.0) -> DataFrame:
    """The k nearest other stations of each, ties by id, with weights 1 / max(km, 0.05) and offsets in km.

    A station begins with the cells around it at a width at which its own cell isn't crowded, and the width doubles for
    the stations that have fewer than k neighbours within it, and for these only.  So where stations are dense each
    meets some multiple of CROWD and k others, however many there are.  Of stations at one place only the k + 1 of the smallest
    ids are anyone's neighbours, as no others can be.  Fails where the network has fewer than k + 1.  Stations farther
    than widest_km from others keep what they have."""
    stations = scratch.table(stations, "stations")  # a row per station; without it every radius would read the readings again
    n = stations.count()
    if n <= k:
        raise ValueError(f"{n} stations can't have {k} neighbours each")
    east, north = C.offset_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))
    w = Window.partitionBy("station_id").orderBy("km", "nb")
    place = Window.partitionBy("lat", "lon").orderBy("station_id")
    homes = scratch.table(stations.withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= k + 1).drop("_at"), "places")
    levels = _begun(stations, start_km)
    rest, found = None, None
    while True:
        km, begun = levels.pop(0) if levels else (2 * km, None)
        rest = begun if rest is None else rest if begun is None else rest.unionByName(begun)
        near = scratch.table(within(homes, km, rest).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k), "near")
        full = near.where(F.col("k") == k).select("station_id")
        last = km > widest_km and not levels
        part = near if last else near.join(full, "station_id", "left_semi")
        found = part if found is None else found.unionByName(part)
        rest = scratch.table(rest.join(full, "station_id", "left_anti"), "far-stations").select("station_id", "lat", "lon")
        if last or (not levels and rest.isEmpty()):
            break
    return found.select("station_id", "nb", "k", F.round("km", 6).alias("km"), (1 / F.greatest("km", F.lit(0.05))).alias("weight"), F.round(east, 6).alias("dx"), F.round(north, 6).alias("dy"))


def lagged_neighbours(slots: DataFrame, pairs: DataFrame, slot_s: int) -> DataFrame:
    """For each row its neighbours' values one slot earlier; null where a neighbour has none, so nothing later leaks in."""
    nb = slots.select(F.col("station_id").alias("nb"), (F.col("slot") + slot_s).alias("slot"), F.col("y").alias("nb_y"))
    return slots.select("station_id", "slot").join(pairs, "station_id").join(nb, ["nb", "slot"], "left")


def idw(lagged: DataFrame) -> DataFrame:
    have = F.col("nb_y").isNotNull()
    w = F.when(have, F.col("weight"))
    return lagged.groupBy("station_id", "slot").agg(
        F.count_if(have).alias("n_available"),
        F.round(F.coalesce(F.sum(w), F.lit(0.0)), 6).alias("weight_sum"),
        F.round(F.try_divide(F.sum(w * F.col("nb_y")), F.sum(w)), 6).alias("idw_mean"),
        F.max("nb_y").alias("nb_max"),
        F.round(F.min(F.when(F.col("nb_y") > 0, F.col("km"))), 6).alias("nearest_wet"),
        F.round(F.avg((F.col("nb_y") > 0).cast("double")), 6).alias("wet_share"),
    )


def neighbour_columns(lagged: DataFrame, k: int) -> DataFrame:
    return lagged.groupBy("station_id", "slot").agg(*(F.max(F.when(F.col("k") == i, F.col("nb_y"))).alias(f"nb{i}_y") for i in range(1, k + 1)), *(F.count_if((F.col("k") == i) & F.col("nb_y").isNotNull()).cast("int").alias(f"nb{i}_avail") for i in range(1, k + 1)))


def storm_geometry(slots: DataFrame, pairs: DataFrame, slot_s: int) -> DataFrame:
    """Rain-weighted centroid of the neighbours' rain one and two slots ago, its movement, spread, and approach.

    Each wet reading goes to the slots one and two later of the stations that have it as a neighbour; both lags
    are one aggregate, which the stations' own slots join once."""
    told = slots.where("y > 0").select(F.col("station_id").alias("nb"), "slot", F.col("y").alias("r")).join(pairs.select("station_id", "nb", "dx", "dy"), "nb")
    each = told.select("station_id", "r", "dx", "dy", "slot", F.explode(F.array(F.lit(1), F.lit(2))).alias("lag")).withColumn("slot", F.col("slot") + F.col("lag") * slot_s)
    sums = [F.sum(F.when(F.col("lag") == k, v)).alias(f"{name}_{n}") for k, name in ((1, "now"), (2, "old")) for n, v in (("rain", F.col("r")), ("x0", F.col("r") * F.col("dx")), ("y0", F.col("r") * F.col("dy")), ("q", F.col("r") * (F.pow("dx", 2) + F.pow("dy", 2))))]
    m = each.groupBy("station_id", "slot").agg(*sums)
    for name in ("now", "old"):
        x, y = F.try_divide(F.col(f"{name}_x0"), F.col(f"{name}_rain")), F.try_divide(F.col(f"{name}_y0"), F.col(f"{name}_rain"))
        m = m.withColumn(f"{name}_x", x).withColumn(f"{name}_y", y).withColumn(f"{name}_spread", F.when(x.isNotNull(), F.sqrt(F.greatest(F.try_divide(F.col(f"{name}_q"), F.col(f"{name}_rain")) - x * x - y * y, F.lit(0.0)))))
    j = slots.select("station_id", "slot").join(m, ["station_id", "slot"], "left")
    far = lambda p: F.sqrt(F.pow(f"{p}_x", F.lit(2)) + F.pow(f"{p}_y", F.lit(2)))
    r = lambda c: F.round(c, 4) + 0.0
    return j.select("station_id", "slot", r(F.col("now_x")).alias("x"), r(F.col("now_y")).alias("y"), r(F.col("now_spread")).alias("spread"), r(F.col("now_x") - F.col("old_x")).alias("move_x"), r(F.col("now_y") - F.col("old_y")).alias("move_y"), r(far("old") - far("now")).alias("approach"))


def adjacent(slots: DataFrame, slot_s: int) -> DataFrame:
    """Values of the slots just before and after, null where missing."""
    at = lambda k, name: slots.select("station_id", (F.col("slot") + k * slot_s).alias("slot"), F.col("y").alias(name))
    return slots.join(at(1, "before"), ["station_id", "slot"], "left").join(at(-1, "after"), ["station_id", "slot"], "left")


def around(rows: DataFrame, pairs: DataFrame, slots: DataFrame, reach: int, slot_s: int) -> DataFrame:
    """Neighbours' values within +-reach slots of each row, by equality on every offset."""
    wanted = rows.select("station_id", "slot").join(pairs.select("station_id", "nb"), "station_id").withColumn("at", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda i: F.col("slot") + i * slot_s)))
    nb = slots.select(F.col("station_id").alias("nb"), F.col("slot").alias("at"), F.col("y").alias("nb_y"))
    return wanted.join(nb, ["nb", "at"])


def as_of(requests: DataFrame, rows: DataFrame, tolerance_s: int, step_s: int) -> DataFrame:
    """For each request (station_id, t) the latest row at or before t, no older than tolerance_s; requests without one keep nulls.

    Rows and requests meet by equality on (station, step): a row can only answer requests of its own
    step or of the few after it that the tolerance reaches."""
    reach = math.ceil(tolerance_s / step_s)
    cells = rows.select("station_id", "epoch", "y", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda i: F.floor(F.col("epoch") / step_s) + i)).alias("cell"))
    asked = requests.withColumn("cell", F.floor(F.col("t") / step_s))
    hit = asked.join(cells, ["station_id", "cell"]).where((F.col("epoch") <= F.col("t")) & (F.col("epoch") >= F.col("t") - tolerance_s))
    found = hit.groupBy("station_id", "t").agg(F.max(F.struct("epoch", "y")).alias("r")).select("station_id", "t", F.col("r.epoch").alias("epoch"), F.col("r.y").alias("y"))
    return requests.join(found, ["station_id", "t"], "left")


def masked(slots: DataFrame, spans: DataFrame, keep: bool, key: Column | None = None) -> DataFrame:
    """Rows inside (keep=False: outside) any span of their station; spans: station_id, first_day, last_day."""
    s = spans.withColumnRenamed("station_id", "sid")
    inside = (F.col("station_id") == F.col("sid")) & F.col("day").between(F.col("first_day"), F.col("last_day"))
    return slots.join(s, inside, "left_semi" if keep else "left_anti")
