"""Canonical ``flights`` and ``weather`` views over the driver's test tables.

The mapping is FIXTURES.md §2.  Both views are narrow projections of one
parquet scan (no join, no shuffle): dimension attributes come from literal
array/map expressions, so Catalyst keeps the whole view inside one
whole-stage-codegen span and prunes the scan to the five event columns used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import dims

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flights_from_events(events: DataFrame) -> DataFrame:
    """Map the events table onto the canonical flight schema (FIXTURES.md §1.1)."""
    e = events.select(*EVENT_COLS)
    eid, uid = F.col("event_id"), F.col("user_id")
    delay = F.greatest(F.col("value") - F.lit(20.0), F.lit(0.0))
    dest_idx = F.pmod(eid * 5 + 3, F.lit(12))
    orig_idx = F.pmod(eid * 7 + uid, F.lit(12))
    type_idx = F.pmod(uid, F.lit(9))
    rw_idx = F.pmod(eid, F.lit(3))
    hour = F.hour("ts")
    dest = dims.pick(dest_idx, dims.AIRPORT_ORDER)
    out = e.select(
        F.concat(F.lit("FL"), eid.cast("string")).alias("Flight_ID"),
        F.concat(F.upper(F.substring("event_type", 1, 2)), F.pmod(uid, F.lit(40)).cast("string")).alias("Airline"),
        F.concat(F.lit("AC"), uid.cast("string")).alias("Aircraft_ID"),
        dims.pick(type_idx, [a[0] for a in dims.AIRCRAFT_FIXTURE]).alias("Aircraft_Type"),
        dims.pick(type_idx, [a[1] for a in dims.AIRCRAFT_FIXTURE]).cast("int").alias("Capacity"),
        dims.pick(type_idx, [a[2] for a in dims.AIRCRAFT_FIXTURE]).cast("int").alias("Base_Turnaround"),
        F.col("ts").alias("Scheduled_Time"),
        delay.alias("Delay_Minutes"),
        dims.pick(orig_idx, dims.AIRPORT_ORDER).alias("Origin"),
        dest.alias("Destination"),
        dims.pick(dest_idx, [dims.AIRPORTS[a][1] for a in dims.AIRPORT_ORDER]).alias("Destination_Priority"),
        dims.pick(dest_idx, [dims.AIRPORTS[a][0] for a in dims.AIRPORT_ORDER]).alias("Congestion_Factor"),
        dims.pick(rw_idx, dims.RUNWAY_ORDER).alias("Runway"),
        dims.pick(rw_idx, [dims.RUNWAYS_OPS[r][0] for r in dims.RUNWAY_ORDER]).cast("int").alias("Runway_Capacity"),
        dims.pick(rw_idx, [dims.RUNWAYS_OPS[r][1] for r in dims.RUNWAY_ORDER]).alias("Runway_Efficiency"),
        hour.alias("Hour"),
        F.weekday("ts").alias("Day_of_Week"),
        F.to_date("ts").alias("Date"),
        dims.peak_category_col(hour).alias("Peak_Category"),
        (F.pmod(eid, F.lit(97)) == 0).alias("is_emergency"),
        (F.pmod(eid, F.lit(5)) == 0).alias("is_international"),
    )
    out = out.withColumn(
        "Actual_Time",
        F.timestamp_micros(
            F.unix_micros(F.col("Scheduled_Time").cast("timestamp"))
            + F.round(F.col("Delay_Minutes") * F.lit(60_000_000.0)).cast("long")
        ).cast("timestamp_ntz"),
    )
    out = out.withColumn("Is_Peak_Hour", F.col("Hour").isin(dims.GENERATOR_PEAK_HOURS))
    out = out.withColumn(
        "Is_High_Impact",
        F.col("Destination").isin(dims.MAJOR_DESTINATIONS)
        | F.col("Aircraft_Type").isin(dims.LARGE_AIRCRAFT)
        | (F.col("Capacity") > 250),
    )
    return out


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights_from_events(read_table(spark, sf_dir, "events"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather derived from the event hours (FIXTURES.md §2.2).

    One row per hour h since 2024-01-01 that occurs in the events table.
    The hour spine is derived from the data (distinct hours), so it grows
    with the table instead of being a fixed literal.
    """
    ev = read_table(spark, sf_dir, "events").select("ts")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hrs = (
        ev.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("Datetime"))
        .distinct()
        .withColumn("h", (F.unix_seconds(F.col("Datetime").cast("timestamp")) - F.unix_seconds(base.cast("timestamp"))) / 3600)
        .withColumn("h", F.col("h").cast("long"))
    )
    idx = F.pmod(F.col("h") * 7 + F.floor(F.col("h") / 24), F.lit(8))
    cond = dims.pick(idx, dims.WEATHER_ORDER)
    w = [dims.WEATHER[c] for c in dims.WEATHER_ORDER]
    return hrs.select(
        "Datetime",
        F.hour("Datetime").alias("Hour"),
        cond.alias("Weather_Condition"),
        dims.pick(idx, [x[0] for x in w]).alias("Visibility_km"),
        dims.pick(idx, [x[1] for x in w]).cast("int").alias("Wind_Speed_kts"),
        dims.pick(idx, [x[2] for x in w]).alias("Precipitation_mm"),
        dims.pick(idx, [x[3] for x in w]).alias("Capacity_Reduction_Factor"),
        dims.pick(idx, [x[4] for x in w]).alias("Landing_Restrictions"),
        dims.pick(idx, [x[5] for x in w]).alias("Takeoff_Restrictions"),
        dims.pick(idx, [x[6] for x in w]).alias("Crosswind_Runway_Closure"),
    )
