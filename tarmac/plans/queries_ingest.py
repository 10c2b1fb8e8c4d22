"""Registered queries for ingest and cleaning (S*) over schedule text derived from the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.plans.catalog import register
from tarmac.plans.sql_views import with_views
from tarmac.sources import ingest as S
from tarmac.sources.fixtures import flights


def _upload(spark, sf):
    """The flights as a user upload would spell them: alias headers, text values, some junk delays."""
    f = flights(spark, sf)
    bad = F.pmod(F.substring("Flight_ID", 3, 12).cast("long"), F.lit(50)) == 0
    return f.select(
        F.col("Flight_ID").alias("FlightNumber"), F.col("Airline").alias("carrier"),
        F.date_format("Scheduled_Time", "yyyy-MM-dd HH:mm:ss").alias("Scheduled Departure"),
        F.col("Origin").alias("from"), F.col("Destination").alias("DEST"),
        F.when(bad, F.lit("n/a")).otherwise(F.col("Delay_Minutes").cast("string")).alias("delay"),
        F.col("Runway").alias("RWY"))


@register("s07_map_columns", sql=with_views("""SELECT Flight_ID, Airline, strftime(Scheduled_Time, '%Y-%m-%d %H:%M:%S') AS Scheduled_Time,
  Runway, Origin, Destination,
  CASE WHEN CAST(substr(Flight_ID, 3) AS BIGINT) % 50 = 0 THEN 'n/a' ELSE CAST(Delay_Minutes AS VARCHAR) END AS Delay_Minutes FROM flights"""))
def s07(spark, sf):
    m = S.map_columns(_upload(spark, sf))
    return m.select("Flight_ID", "Airline", "Scheduled_Time", "Runway", "Origin", "Destination", "Delay_Minutes")


@register("s13_to_num", sql=with_views("""SELECT Flight_ID, CASE WHEN CAST(substr(Flight_ID, 3) AS BIGINT) % 50 = 0 THEN 0.0 ELSE Delay_Minutes END AS Delay_Minutes
FROM flights"""), floats=("Delay_Minutes",))
def s13(spark, sf):
    m = S.map_columns(_upload(spark, sf))
    return m.select("Flight_ID", S.to_num("Delay_Minutes", 0.0).alias("Delay_Minutes"))


@register("s14_parse_ampm", sql=with_views("""SELECT Flight_ID, hour(Scheduled_Time) * 60 + minute(Scheduled_Time) AS Sched_Min,
  hour(Actual_Time) * 60 + minute(Actual_Time) AS Actual_Min,
  CASE WHEN (hour(Actual_Time) * 60 + minute(Actual_Time)) - (hour(Scheduled_Time) * 60 + minute(Scheduled_Time)) < -720
       THEN (hour(Actual_Time) * 60 + minute(Actual_Time)) - (hour(Scheduled_Time) * 60 + minute(Scheduled_Time)) + 1440
       WHEN (hour(Actual_Time) * 60 + minute(Actual_Time)) - (hour(Scheduled_Time) * 60 + minute(Scheduled_Time)) > 720
       THEN (hour(Actual_Time) * 60 + minute(Actual_Time)) - (hour(Scheduled_Time) * 60 + minute(Scheduled_Time)) - 1440
       ELSE (hour(Actual_Time) * 60 + minute(Actual_Time)) - (hour(Scheduled_Time) * 60 + minute(Scheduled_Time)) END AS Clock_Delay
FROM flights"""), ints=("Sched_Min", "Actual_Min", "Clock_Delay"))
def s14(spark, sf):
    """S14 + S15: clock text such as 'Landed 8:05 PM' parsed to minutes; difference with day wrap."""
    f = flights(spark, sf).select(
        "Flight_ID", F.date_format("Scheduled_Time", "h:mm a").alias("std_text"),
        F.concat(F.lit("Landed "), F.date_format("Actual_Time", "h:mm a")).alias("ata_text"))
    f = f.withColumn("Sched_Min", S.parse_ampm("std_text")).withColumn("Actual_Min", S.parse_ampm("ata_text"))
    return f.select("Flight_ID", "Sched_Min", "Actual_Min", S.clock_diff("Actual_Min", "Sched_Min").alias("Clock_Delay"))


@register("s16_select_departures", sql=with_views("""SELECT Flight_ID, Origin FROM flights WHERE regexp_matches(Origin, '(?i)Mumbai|BOM')"""))
def s16(spark, sf):
    return S.select_departures(flights(spark, sf), col="Origin", required=("Flight_ID", "Scheduled_Time")).select("Flight_ID", "Origin")


@register("s17_profile", sql=with_views("""SELECT count(*) AS rows, 'Delay_Minutes' AS "column",
  count(*) FILTER (WHERE d IS NULL) AS missing, (1 - count(*) FILTER (WHERE d IS NULL) / count(*)) * 100 AS completeness_pct
FROM (SELECT TRY_CAST(CASE WHEN CAST(substr(Flight_ID, 3) AS BIGINT) % 50 = 0 THEN 'n/a' ELSE CAST(Delay_Minutes AS VARCHAR) END AS DOUBLE) AS d FROM flights) x
UNION ALL SELECT count(*), 'Flight_ID', 0, 100.0 FROM flights"""), floats=("completeness_pct",), ints=("rows", "missing"))
def s17(spark, sf):
    m = S.map_columns(_upload(spark, sf))
    m = m.select("Flight_ID", F.expr("try_cast(Delay_Minutes AS DOUBLE)").alias("Delay_Minutes"))
    return S.profile(m)


@register("s18_filter_values", sql=with_views("""SELECT array_to_string(list_sort(list(DISTINCT Airline)), ',') AS Airline,
  array_to_string(list_sort(list(DISTINCT Runway)), ',') AS Runway, array_to_string(list_sort(list(DISTINCT Origin)), ',') AS Origin,
  array_to_string(list_sort(list(DISTINCT Destination)), ',') AS Destination, min(Date) AS min_date, max(Date) AS max_date FROM flights"""))
def s18(spark, sf):
    v = S.filter_values(flights(spark, sf))
    return v.select(*[F.array_join(c, ",").alias(c) for c in ("Airline", "Runway", "Origin", "Destination")], "min_date", "max_date")


def _sheet(spark, sf):
    """A sheet a runway: rows by event number, the flight number only on every seventh row, else blank."""
    n = F.substring("Flight_ID", 3, 12).cast("long")
    return flights(spark, sf).select(
        n.alias("row_idx"), F.col("Runway").alias("Time_Slot"), F.when(F.pmod(n, F.lit(7)) == 0, F.col("Flight_ID")).otherwise(F.lit(" ")).alias("Flight Number"))


@register("s04_fill_flight_number", sql=with_views("""SELECT row_idx, last_value(k IGNORE NULLS) OVER (PARTITION BY Runway ORDER BY row_idx) AS Flight_Number
FROM (SELECT CAST(substr(Flight_ID, 3) AS BIGINT) AS row_idx, Runway, CASE WHEN CAST(substr(Flight_ID, 3) AS BIGINT) % 7 = 0 THEN Flight_ID END AS k FROM flights) s"""),
          ints=("row_idx",))
def s04(spark, sf):
    """Blank flight numbers take the last one above in their sheet."""
    return S.fill_flight_number(_sheet(spark, sf)).select("row_idx", F.col("`Flight Number`").alias("Flight_Number"))


@register("s08_fill_required", sql=with_views("""SELECT n, 'FL' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS Flight_ID,
  regexp_extract('FL' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), '0'), '^([A-Z0-9]{2,3})', 1) AS Airline,
  TIMESTAMP '2024-01-01 06:00:00' + to_minutes(30 * i) AS Scheduled_Time FROM (
  SELECT CAST(substr(Flight_ID, 3) AS BIGINT) AS n, row_number() OVER (ORDER BY CAST(substr(Flight_ID, 3) AS BIGINT)) - 1 AS i FROM flights) s"""), ints=("n",))
def s08(spark, sf):
    """Ids, airlines and times made from a dense row number, over eight partitions."""
    rows = flights(spark, sf).select(F.substring("Flight_ID", 3, 12).cast("long").alias("row_idx"), F.col("Airline").alias("note")).repartition(8)
    return S.fill_required(rows).select(F.col("row_idx").alias("n"), "Flight_ID", "Airline", "Scheduled_Time")


@register("s11_clean_legacy", sql=with_views("""SELECT Flight_ID, date_trunc('minute', Scheduled_Time) AS Scheduled_Time,
  regexp_extract(Flight_ID, '([A-Z]{1,3})', 1) AS Airline, coalesce(TRY_CAST(CASE WHEN n % 50 = 0 THEN 'n/a' ELSE CAST(Delay_Minutes AS VARCHAR) END AS DOUBLE), 0.0) AS Delay_Minutes,
  CASE WHEN n % 9 = 0 THEN 'R1' ELSE Runway END AS Runway, CASE WHEN n % 11 = 0 THEN 180.0 ELSE CAST(Capacity AS DOUBLE) END AS Capacity
FROM (SELECT *, CAST(substr(Flight_ID, 3) AS BIGINT) AS n FROM flights) f"""), floats=("Delay_Minutes", "Capacity"))
def s11(spark, sf):
    """Given delay, runway and capacity are kept, gaps filled."""
    n = F.substring("Flight_ID", 3, 12).cast("long")
    rows = flights(spark, sf).select(
        "Flight_ID", F.col("Date").cast("string").alias("Date"), F.date_format("Scheduled_Time", "H:mm").alias("std"),
        F.when(F.pmod(n, F.lit(50)) == 0, F.lit("n/a")).otherwise(F.col("Delay_Minutes").cast("string")).alias("delay_minutes"),
        F.when(F.pmod(n, F.lit(9)) != 0, F.col("Runway")).alias("runway"), F.when(F.pmod(n, F.lit(11)) != 0, F.col("Capacity").cast("string")).otherwise(F.lit("?")).alias("capacity"))
    return S.clean_legacy(rows).select("Flight_ID", "Scheduled_Time", "Airline", "Delay_Minutes", "Runway", "Capacity")
