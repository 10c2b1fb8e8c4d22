"""Joins.

Broadcast is only forced for sides whose size is bounded by a dimension
(hour spine, runway/aircraft dimension, hub set = airports).  Joins against
data-derived tables (weather, assignments, group counts) are left to AQE,
which converts them to broadcast joins at run time only when the measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise keeps a
shuffle join with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import columns as C


def _us(c) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


# J01
WEATHER_DEFAULTS = {
    "Weather_Condition": "Clear",
    "Capacity_Reduction_Factor": 1.0,
    "Landing_Restrictions": False,
    "Takeoff_Restrictions": False,
    "Crosswind_Runway_Closure": False,
}


def join_weather(flights: DataFrame, weather: DataFrame, airport_col: str | None = None) -> DataFrame:
    """Left-join hourly weather on the floored scheduled hour (optionally also airport).

    Several weather rows for one hour multiply the flight (reference semantics);
    unmatched hours get clear-weather defaults.
    """
    f = flights.withColumn("Weather_Hour", F.date_trunc("hour", "Scheduled_Time").cast("timestamp_ntz"))
    w = weather.withColumn("Weather_Hour", F.date_trunc("hour", "Datetime").cast("timestamp_ntz"))
    keys = ["Weather_Hour"] + ([airport_col] if airport_col else [])
    w = w.select(*keys, *WEATHER_DEFAULTS.keys())
    out = f.join(w, keys, "left")
    for c, v in WEATHER_DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


# J02
def with_group_counts(df: DataFrame, keys: list[str], name: str, capacity_col: str | None = None, util_name: str | None = None) -> DataFrame:
    """Attach the size of each row's (keys) group as column ``name``.

    Implemented as a partial aggregate (one row per group per task leaves the
    map side) joined back on the keys: unlike a window, the facts are never
    sorted into one task per group, so a hot key does not become one giant
    task; the count table is small and AQE broadcasts it when it measures so.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = df.join(counts, keys, "left")
    if capacity_col and util_name:
        out = out.withColumn(util_name, F.try_divide(F.col(name), F.col(capacity_col)))
    return out


def with_all_group_counts(df: DataFrame, counts: dict[str, list[str]]) -> DataFrame:
    """Attach several group sizes (name -> keys) from one aggregate of the facts at the finest key.

    The coarser counts are window sums over the finest table's rows, so the facts
    are read twice whatever the number of counts.
    """
    finest = list(dict.fromkeys(k for keys in counts.values() for k in keys))
    base = df.groupBy(*finest).agg(F.count(F.lit(1)).alias("__n"))
    for name, keys in counts.items():
        base = base.withColumn(name, F.sum("__n").over(Window.partitionBy(*keys)))  # over groups, not over facts
    return df.join(base.drop("__n"), finest, "left")


# J03
def apply_assignment(df: DataFrame, asg: DataFrame, cols: list[str], key: str = "Flight_ID") -> DataFrame:
    """Left-merge assignment columns on the key; unassigned rows keep their original values."""
    a = asg.select(key, *[F.col(c).alias(f"__new_{c}") for c in cols])
    out = df.join(a, key, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"__new_{c}"), F.col(c))).drop(f"__new_{c}")
    return out


# J04
def flag_members(df: DataFrame, ids: DataFrame, key: str = "Flight_ID", flag: str = "Is_Member") -> DataFrame:
    m = ids.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(m, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def members_only(df: DataFrame, ids: DataFrame, key: str = "Flight_ID") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


# J05
def off_peak(df: DataFrame, hours=(7, 8, 9, 18, 19, 20), hour_col: str = "Hour") -> DataFrame:
    return df.where(~F.col(hour_col).isin(list(hours)))


# J06
def candidates(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Every row x every candidate of a fixed, small dimension (hours, runways, rules)."""
    return df.crossJoin(F.broadcast(dim))


# G05 (used by J07)
def hub_airports(flights: DataFrame, k: int = 10) -> DataFrame:
    """Airports with >= k arrivals or >= k departures (one row per hub)."""
    arr = flights.groupBy(F.col("Destination").alias("hub")).count().where(F.col("count") >= k).select("hub")
    dep = flights.groupBy(F.col("Origin").alias("hub")).count().where(F.col("count") >= k).select("hub")
    return arr.union(dep).distinct()


# J07
def hub_connections(flights: DataFrame, hubs: DataFrame | None = None, lo: float = 45, hi: float = 240, k: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Arrival -> departure pairs at the same hub with lo <= (t_dep - t_arr) <= hi minutes, with ``carry`` of the departure.

    Range join rewritten as an equi-join on (hub, hour bucket): each arrival is
    copied to the <= ceil((hi-lo)/60)+1 departure-hour buckets it can reach,
    each departure sits in exactly one bucket, so every pair is produced once
    and the join never compares flights more than ``hi`` minutes apart.  The
    hub set is bounded by the airport dimension and is broadcast.
    """
    if hubs is None:
        hubs = hub_airports(flights, k)
    hubs = F.broadcast(hubs.select("hub").distinct())
    bucket = 3_600_000_000
    arr = (
        flights.select(F.col("Flight_ID").alias("src"), F.col("Destination").alias("hub"), _us("Scheduled_Time").alias("src_us"))
        .join(hubs, "hub", "left_semi")
        .withColumn(
            "bucket",
            F.explode(
                F.sequence(
                    F.floor((F.col("src_us") + int(lo * 60_000_000)) / bucket),
                    F.floor((F.col("src_us") + int(hi * 60_000_000)) / bucket),
                )
            ),
        )
    )
    dep = (
        flights.select(F.col("Flight_ID").alias("dst"), F.col("Origin").alias("hub"), _us("Scheduled_Time").alias("dst_us"), *carry)
        .join(hubs, "hub", "left_semi")
        .withColumn("bucket", F.floor(F.col("dst_us") / bucket))
    )
    gap = (F.col("dst_us") - F.col("src_us")) / 60_000_000.0
    return (
        arr.join(dep, ["hub", "bucket"])
        .where(gap.between(lo, hi))
        .select("src", "dst", "hub", gap.alias("time_buffer"), *carry)
    )


# J08
def slot_pairs(flights: DataFrame, slot_minutes: int = 30, max_gap: float = 30.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Earlier -> later pairs of flights on the same runway in the same clock slot, with ``carry`` of the later one.

    Equi-join on (Runway, slot); the slot bounds how many flights can meet
    (a runway serves ~1 movement a minute), ties in time break by Flight_ID.
    """
    base = flights.select(
        "Flight_ID", "Runway", _us("Scheduled_Time").alias("t"), C.floor_minutes("Scheduled_Time", slot_minutes).alias("slot"), *carry
    )
    a = base.select(F.col("Flight_ID").alias("src"), "Runway", "slot", F.col("t").alias("src_us"))
    b = base.select(F.col("Flight_ID").alias("dst"), "Runway", "slot", F.col("t").alias("dst_us"), *carry)
    gap = (F.col("dst_us") - F.col("src_us")) / 60_000_000.0
    return (
        a.join(b, ["Runway", "slot"])
        .where((F.col("src_us") < F.col("dst_us")) | ((F.col("src_us") == F.col("dst_us")) & (F.col("src") < F.col("dst"))))
        .where(gap <= max_gap)
        .select("src", "dst", "Runway", "slot", gap.alias("time_buffer"), *carry)
    )


# J10
def hour_spine(stats: DataFrame, defaults: dict, hour_col: str = "Hour", hours=range(24)) -> DataFrame:
    """Complete hour spine (fixed 24 rows) left-joined to per-hour stats with defaults."""
    spark = stats.sparkSession
    spine = spark.createDataFrame([(int(h),) for h in hours], f"{hour_col} int")
    out = spine.join(stats, hour_col, "left")
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out
