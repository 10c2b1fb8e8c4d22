"""Registered queries for scalar functions (C*) and filters (F*)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tarmac.functions import columns as C
from tarmac.operators import filters as FL
from tarmac.plans.catalog import register
from tarmac.plans.sql_views import with_views
from tarmac.sources.fixtures import flights

AS_OF = dt.date(2024, 1, 15)


def _sel(make):
    """Query selecting Flight_ID plus the (name, column) pairs from ``make()``
    (built lazily: Columns need an active session)."""

    def run(spark, sf_dir):
        return flights(spark, sf_dir).select("Flight_ID", *[c.alias(n) for n, c in make()])

    return run


def _named(d: dict):
    return [(k, v) for k, v in d.items()]


register("c01_calendar_parts", sql=with_views("""SELECT Flight_ID, hour(Scheduled_Time) AS Hour,
  isodow(Scheduled_Time) - 1 AS Day_of_Week, month(Scheduled_Time) AS Month, dayofyear(Scheduled_Time) AS Day_of_Year,
  CAST(Scheduled_Time AS DATE) AS Date, dayname(Scheduled_Time) AS Day_Name FROM flights"""),
         ints=("Hour", "Day_of_Week", "Month", "Day_of_Year"))(_sel(lambda: _named(C.calendar_parts("Scheduled_Time"))))

register("c02_peak_flags", sql=with_views("""SELECT Flight_ID,
  CAST(Hour IN (7,8,9,18,19,20) AS BIGINT) AS Is_Peak_Hour_A,
  CAST(Hour IN (6,7,8,9) AS BIGINT) AS Is_Morning_Peak,
  CAST(Hour IN (18,19,20,21) AS BIGINT) AS Is_Evening_Peak,
  CAST(Hour IN (22,23,0,1,2,3,4,5) AS BIGINT) AS Is_Night,
  CAST(Day_of_Week IN (5,6) AS BIGINT) AS Is_Weekend FROM flights"""),
         ints=("Is_Peak_Hour_A", "Is_Morning_Peak", "Is_Evening_Peak", "Is_Night", "Is_Weekend"))(_sel(lambda: [("Is_Peak_Hour_A", C.in_hours("Hour", C.ANOMALY_PEAK_HOURS)),
    ("Is_Morning_Peak", C.in_hours("Hour", C.MORNING_PEAK)),
    ("Is_Evening_Peak", C.in_hours("Hour", C.EVENING_PEAK)),
    ("Is_Night", C.in_hours("Hour", C.NIGHT_HOURS)),
    ("Is_Weekend", C.is_weekend("Day_of_Week"))]))

register("c03_peak_category", sql=with_views("""SELECT Flight_ID, Peak_Category AS Peak4,
  CASE WHEN Hour BETWEEN 6 AND 10 OR Hour BETWEEN 18 AND 22 THEN 'high' WHEN Hour BETWEEN 11 AND 17 THEN 'medium' ELSE 'low' END AS Peak3,
  CASE WHEN Hour = 7 THEN 'Super Peak' WHEN Hour BETWEEN 6 AND 8 THEN 'Peak' WHEN Hour BETWEEN 9 AND 10 THEN 'Moderate' ELSE 'Low' END AS Clock_Class,
  CASE WHEN Hour < 9 THEN '6AM - 9AM' ELSE '9AM - 12PM' END AS Slot_Name FROM flights"""))(_sel(lambda: [("Peak4", C.peak_category4("Hour")),
    ("Peak3", C.peak_category3("Hour")),
    ("Clock_Class", C.clock_peak_class(F.col("Hour") * 60 + F.minute("Scheduled_Time"))),
    ("Slot_Name", C.time_slot_name(F.col("Hour") * 60 + F.minute("Scheduled_Time")))]))

register("c04_delay_category", sql=with_views("""SELECT Flight_ID,
  CASE WHEN Delay_Minutes <= 0 THEN 'On_Time' WHEN Delay_Minutes <= 15 THEN 'Minor' WHEN Delay_Minutes <= 30 THEN 'Moderate'
       WHEN Delay_Minutes <= 60 THEN 'Major' WHEN Delay_Minutes > 60 THEN 'Severe' END AS Delay_Category,
  CASE WHEN Delay_Minutes > -1 AND Delay_Minutes <= 0 THEN 'On Time' WHEN Delay_Minutes > 0 AND Delay_Minutes <= 15 THEN 'Minor'
       WHEN Delay_Minutes > 15 AND Delay_Minutes <= 30 THEN 'Moderate' WHEN Delay_Minutes > 30 AND Delay_Minutes <= 60 THEN 'Major'
       WHEN Delay_Minutes > 60 THEN 'Severe' END AS Delay_Category_B,
  CASE WHEN Delay_Minutes > 0 AND Delay_Minutes <= 15 THEN 'minor' WHEN Delay_Minutes > 15 AND Delay_Minutes <= 30 THEN 'moderate'
       WHEN Delay_Minutes > 30 THEN 'major' END AS Severity3,
  CASE WHEN Delay_Minutes < 0 THEN 'early' WHEN Delay_Minutes <= 5 THEN 'on_time' WHEN Delay_Minutes <= 15 THEN 'minor'
       WHEN Delay_Minutes > 15 THEN 'major' END AS Notebook_Class FROM flights"""))(_sel(lambda: [("Delay_Category", C.delay_category("Delay_Minutes")),
    ("Delay_Category_B", C.delay_category_from_minus1("Delay_Minutes")),
    ("Severity3", C.delay_severity3("Delay_Minutes")),
    ("Notebook_Class", C.delay_class_notebook("Delay_Minutes"))]))

register("c05_risk_level", sql=with_views("""SELECT Flight_ID,
  CASE WHEN r > 0 AND r <= 0.2 THEN 'Low' WHEN r > 0.2 AND r <= 0.4 THEN 'Medium' WHEN r > 0.4 AND r <= 0.6 THEN 'High'
       WHEN r > 0.6 AND r <= 1.0 THEN 'Critical' END AS Risk_Fixed,
  CASE WHEN Delay_Minutes <= 30 THEN 'Low' WHEN Delay_Minutes <= 50 THEN 'Medium' WHEN Delay_Minutes <= 70 THEN 'High'
       WHEN Delay_Minutes > 70 THEN 'Critical' END AS Risk_30_50_70,
  CASE WHEN Delay_Minutes <= 15 THEN 'Low' WHEN Delay_Minutes <= 25 THEN 'Medium' WHEN Delay_Minutes > 25 THEN 'High' END AS Risk_15_25
FROM (SELECT *, least(Delay_Minutes / 100.0, 1.0) AS r FROM flights) AS f"""))(
    lambda spark, sf: flights(spark, sf).withColumn("r", F.least(F.col("Delay_Minutes") / 100.0, F.lit(1.0))).select(
        "Flight_ID",
        C.risk_level_fixed("r").alias("Risk_Fixed"),
        C.risk_level_thresholds("Delay_Minutes", 30, 50, 70).alias("Risk_30_50_70"),
        C.risk_level_thresholds("Delay_Minutes", 15, 25, None).alias("Risk_15_25"),
    )
)

register("c06_capacity_bucket", sql=with_views("""SELECT Flight_ID,
  CASE WHEN Capacity > 0 AND Capacity <= 150 THEN 'Small' WHEN Capacity > 150 AND Capacity <= 200 THEN 'Medium'
       WHEN Capacity > 200 AND Capacity <= 250 THEN 'Large' WHEN Capacity > 250 AND Capacity <= 350 THEN 'XLarge' END AS Capacity_Category,
  CAST(Capacity > 250 AS BIGINT) AS Is_Large_Aircraft FROM flights"""), ints=("Is_Large_Aircraft",))(_sel(lambda: [("Capacity_Category", C.capacity_bucket("Capacity")), ("Is_Large_Aircraft", C.is_large_aircraft("Capacity"))]))

register("c07_clean_identifier", sql=with_views("""SELECT Flight_ID,
  regexp_replace(Runway, '[^A-Za-z0-9_]+', '_', 'g') AS Runway_Clean,
  regexp_replace(Runway, '[^A-Za-z0-9]', '', 'g') AS Runway_Alnum FROM flights"""))(_sel(lambda: [("Runway_Clean", C.clean_identifier("Runway")), ("Runway_Alnum", C.strip_non_alnum("Runway"))]))

register("c08_extract_codes", sql=with_views("""SELECT Flight_ID,
  coalesce(nullif(regexp_extract(regexp_replace(Aircraft_Type, '[^A-Za-z0-9_]+', '_', 'g'), '([A-Za-z0-9]{1,4})', 1), ''), 'UNK') AS Aircraft_Family,
  nullif(regexp_extract(upper(Airline), '^([A-Z0-9]{2})', 1), '') AS Airline_Code,
  nullif(regexp_extract(upper(Airline), '^([A-Z0-9]{2,3})', 1), '') AS Airline_Prefix3 FROM flights"""))(_sel(lambda: [("Aircraft_Family", C.aircraft_family("Aircraft_Type")),
    ("Airline_Code", C.airline_code("Airline")),
    ("Airline_Prefix3", C.airline_code("Airline", "prefix3"))]))


def _c09(spark, sf):
    f = flights(spark, sf).withColumn("fam", C.aircraft_family("Aircraft_Type"))
    return f.select("Flight_ID", *[c.alias(n) for n, c in C.family_flags("fam").items()])


register("c09_family_flags", sql=with_views(
    "SELECT Flight_ID, " + ", ".join(
        [f"CAST(contains(lower(fam), '{x.lower()}') AS BIGINT) AS Is_{x}_Family" for x in C.COMMON_FAMILIES]
        + ["CAST(fam IN (" + ", ".join(f"'{x}'" for x in C.WIDE_BODY) + ") AS BIGINT) AS Is_Wide_Body"]
    ) + " FROM (SELECT Flight_ID, coalesce(nullif(regexp_extract(Aircraft_Type, '([A-Za-z0-9]{1,4})', 1), ''), 'UNK') AS fam FROM flights) AS f"
), ints=tuple([f"Is_{x}_Family" for x in C.COMMON_FAMILIES] + ["Is_Wide_Body"]))(_c09)

register("c10_aircraft_category", sql=with_views("""SELECT Flight_ID,
  CASE WHEN Aircraft_Type IN ('A330','A350','B777','B787') THEN 'Heavy' WHEN Aircraft_Type IN ('A320','A321','B737') THEN 'Medium'
       WHEN Aircraft_Type IN ('ATR72','Q400') THEN 'Light'
       WHEN regexp_matches(upper(Aircraft_Type), '777|787|330|350|747|380') THEN 'Heavy'
       WHEN regexp_matches(upper(Aircraft_Type), 'ATR|Q400|CRJ|ERJ') THEN 'Light' ELSE 'Medium' END AS Aircraft_Category FROM flights"""))(
    _sel(lambda: [("Aircraft_Category", C.aircraft_category("Aircraft_Type"))]))

register("c11_flight_priority", sql=with_views("""SELECT Flight_ID,
  CASE WHEN is_emergency THEN 1 WHEN is_international THEN 2 WHEN Capacity >= 150 THEN 3 WHEN Capacity >= 50 THEN 4 ELSE 5 END AS Priority,
  CASE WHEN is_emergency THEN 'EMERGENCY' WHEN is_international THEN 'INTERNATIONAL' WHEN Capacity >= 150 THEN 'DOMESTIC_MAJOR'
       WHEN Capacity >= 50 THEN 'DOMESTIC_REGIONAL' ELSE 'CARGO' END AS Priority_Label FROM flights"""), ints=("Priority",))(
    lambda spark, sf: flights(spark, sf).withColumn("Priority", C.flight_priority("is_emergency", "is_international", "Capacity")).select(
        "Flight_ID", "Priority", C.priority_label("Priority").alias("Priority_Label")))

register("c12_time_floors", sql=with_views("""SELECT Flight_ID, date_trunc('hour', Scheduled_Time) AS Hour_Floor,
  make_timestamp(CAST(floor(epoch_us(Scheduled_Time) / 1800000000) * 1800000000 AS BIGINT)) AS Slot30,
  make_timestamp(CAST(floor(epoch_us(Scheduled_Time) / 900000000) * 900000000 AS BIGINT)) AS Slot15,
  make_timestamp(CAST(ceil(epoch_us(Scheduled_Time) / 900000000 - 0.5) * 900000000 AS BIGINT)) AS Nearest15 FROM flights"""))(_sel(lambda: [("Hour_Floor", F.date_trunc("hour", "Scheduled_Time").cast("timestamp_ntz")),
    ("Slot30", C.floor_minutes("Scheduled_Time", 30)),
    ("Slot15", C.floor_minutes("Scheduled_Time", 15)),
    ("Nearest15", C.nearest_slot("Scheduled_Time", 15))]))

register("c13_labels", sql=with_views("""SELECT Flight_ID, format('{:02d}:00-{:02d}:00', Hour, (Hour + 1) % 24) AS Hour_Label,
  Origin || ' → ' || Destination AS Route FROM flights"""))(_sel(lambda: [("Hour_Label", C.hour_range_label("Hour")), ("Route", C.route_label("Origin", "Destination"))]))

register("c14_delay_arithmetic", sql=with_views("""SELECT Flight_ID,
  date_diff('second', Scheduled_Time, Actual_Time) / 60.0 AS Delay_From_Times,
  greatest("Delay_Minutes" - 30.0, 0.0) AS Clipped FROM flights"""), floats=("Delay_From_Times", "Clipped"))(_sel(lambda: [("Delay_From_Times", C.delay_from_times("Actual_Time", "Scheduled_Time")),
    ("Clipped", C.clip0(F.col("Delay_Minutes") - 30.0))]))

register("c15_high_impact", sql=with_views("SELECT Flight_ID, Is_High_Impact FROM flights"))(_sel(lambda: [("Is_High_Impact", C.high_impact("Destination", "Aircraft_Type", "Capacity"))]))

register("c16_congestion_flags", sql=with_views(
    "SELECT Flight_ID, CAST(Origin IN ('BOM','DEL') AS BIGINT) AS Is_Congested_Airport, "
    + ", ".join(f"CAST(Destination = '{d}' AS BIGINT) AS Dest_{d}" for d in C.dims.MAJOR_DESTINATIONS)
    + ", CAST(Congestion_Factor > 1.5 AS BIGINT) AS High_Congestion FROM flights"),
    ints=tuple(["Is_Congested_Airport", "High_Congestion"] + [f"Dest_{d}" for d in C.dims.MAJOR_DESTINATIONS]))(
    _sel(lambda: [("Is_Congested_Airport", C.congested_origin("Origin")), *_named(C.destination_onehots("Destination")),
         ("High_Congestion", C.high_congestion("Congestion_Factor"))]))

register("c17_dimension_maps", sql=with_views("""SELECT Flight_ID,
  CASE Peak_Category WHEN 'super_peak' THEN 4 WHEN 'peak' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 2 END AS Peak_Numeric,
  CASE Runway WHEN 'R1' THEN 35 WHEN 'R2' THEN 30 WHEN 'R3' THEN 25 WHEN 'R4' THEN 20 WHEN '09R/27L' THEN 35 WHEN '09L/27R' THEN 30
       WHEN '14/32' THEN 25 ELSE 30 END AS App_Runway_Capacity FROM flights"""), ints=("Peak_Numeric", "App_Runway_Capacity"))(_sel(lambda: [("Peak_Numeric", C.peak_numeric("Peak_Category")), ("App_Runway_Capacity", C.app_runway_capacity("Runway"))]))

register("c19_improvement_factor", sql=with_views("""SELECT Flight_ID, least(0.40, greatest(0.10,
  0.25 + CASE WHEN Is_High_Impact THEN 0.10 ELSE 0.0 END
       + CASE WHEN Congestion_Factor < 1.3 THEN 0.05 WHEN Congestion_Factor > 1.7 THEN -0.05 ELSE 0.0 END
       + CASE WHEN Peak_Category = 'low' THEN 0.08 WHEN Peak_Category = 'super_peak' THEN -0.10 ELSE 0.0 END
       + CASE WHEN Runway_Efficiency > 0.85 THEN 0.03 ELSE 0.0 END)) AS Improvement_Factor FROM flights"""),
         floats=("Improvement_Factor",))(_sel(lambda: [("Improvement_Factor", C.improvement_factor("Is_High_Impact", "Congestion_Factor", "Peak_Category", "Runway_Efficiency"))]))


@register("c20_cascade_impact_score", sql=with_views("""SELECT Flight_ID, Airline, Delay_Minutes, Capacity, Hour, Impact_Score,
  Delay_Factor, Capacity_Factor, Hour_Factor, Aircraft_Factor FROM (
  SELECT *, (Delay_Factor + Capacity_Factor + Hour_Factor + Aircraft_Factor) / 4 AS Impact_Score FROM (
    SELECT *, Delay_Minutes / 60.0 AS Delay_Factor, Capacity / 300.0 AS Capacity_Factor,
      CASE WHEN Hour IN (7,8,18,19,20) THEN 1.5 WHEN Hour IN (22,23,0,1,2,3,4,5) THEN 0.5 ELSE 1.0 END AS Hour_Factor,
      CASE WHEN regexp_matches(upper(Aircraft_Type), 'A330|A350|B777|B787') THEN 1.3 WHEN regexp_matches(upper(Aircraft_Type), 'ATR|Q400') THEN 0.8 ELSE 1.0 END AS Aircraft_Factor
    FROM flights) AS a) AS b ORDER BY Impact_Score DESC, Flight_ID LIMIT 10"""),
          floats=("Delay_Minutes", "Impact_Score", "Delay_Factor", "Capacity_Factor", "Hour_Factor", "Aircraft_Factor"), ints=("Capacity", "Hour"))
def c20(spark, sf):
    """Top-10 flights by the basic cascade impact score."""
    f = flights(spark, sf)
    f = f.select("Flight_ID", "Airline", "Delay_Minutes", "Capacity", "Hour",
                 *[c.alias(n) for n, c in C.cascade_impact_factors("Delay_Minutes", "Capacity", "Hour", "Aircraft_Type").items()])
    return f.orderBy(F.desc("Impact_Score"), "Flight_ID").limit(10)


@register("c20b_cascade_risk_counts", sql=with_views("""SELECT count_if(s > 1.0) AS High_Impact, count_if(s > 0.7 AND s <= 1.0) AS Medium_Impact,
  sum(s) AS Total_Risk FROM (SELECT (Delay_Minutes / 60.0 + Capacity / 300.0
  + CASE WHEN Hour IN (7,8,18,19,20) THEN 1.5 WHEN Hour IN (22,23,0,1,2,3,4,5) THEN 0.5 ELSE 1.0 END
  + CASE WHEN regexp_matches(upper(Aircraft_Type), 'A330|A350|B777|B787') THEN 1.3 WHEN regexp_matches(upper(Aircraft_Type), 'ATR|Q400') THEN 0.8 ELSE 1.0 END) / 4 AS s
  FROM flights) AS x"""), floats=("Total_Risk",), ints=("High_Impact", "Medium_Impact"))
def c20b(spark, sf):
    s = C.cascade_impact_factors("Delay_Minutes", "Capacity", "Hour", "Aircraft_Type")["Impact_Score"]
    f = flights(spark, sf).select(s.alias("s"))
    return f.agg(F.count_if(F.col("s") > 1.0).alias("High_Impact"),
                 F.count_if((F.col("s") > 0.7) & (F.col("s") <= 1.0)).alias("Medium_Impact"),
                 F.sum("s").alias("Total_Risk"))


# ---------------------------------------------------------------- filters
@register("f01_filter_flights", sql=with_views("""SELECT Flight_ID, Airline, Runway, Origin, Destination, Date FROM flights
WHERE Date = DATE '2024-01-15' AND Runway = '09R/27L' AND Origin IN ('BOM','DEL')"""))
def f01(spark, sf):
    f = flights(spark, sf)
    f = FL.filter_flights(f, date="2024-01-15", airline="All", runway="09R/27L", origin=["BOM", "DEL"])
    return f.select("Flight_ID", "Airline", "Runway", "Origin", "Destination", "Date")


_TW_SQL = """SELECT '{code}' AS code, count(*) AS n, sum(Delay_Minutes) AS total_delay FROM flights WHERE {pred}"""
_TW = {
    "today": "Date = DATE '2024-01-15'",
    "tomorrow": "Date = DATE '2024-01-16'",
    "yesterday": "Date = DATE '2024-01-14'",
    "this_week": "Date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'",
    "next_week": "Date BETWEEN DATE '2024-01-22' AND DATE '2024-01-28'",
    "morning": "Hour BETWEEN 6 AND 11",
    "afternoon": "Hour BETWEEN 12 AND 17",
    "evening": "Hour BETWEEN 18 AND 23",
    "night": "Hour BETWEEN 0 AND 5",
    "peak_hours": "Hour IN (7,8,9,18,19,20)",
}


@register("f02_time_windows", sql=with_views("\nUNION ALL\n".join(_TW_SQL.format(code=k, pred=v) for k, v in _TW.items())),
          floats=("total_delay",), ints=("n",))
def f02(spark, sf):
    f = flights(spark, sf)
    parts = [
        f.where(FL.time_window_predicate(code, AS_OF)).agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"), F.sum("Delay_Minutes").alias("total_delay"))
        for code in _TW
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("f03_where_entities", sql=with_views("""SELECT Flight_ID FROM flights WHERE lower(Airline) IN ('vi1','cl2')
AND (Origin IN ('BOM') OR Destination IN ('BOM')) AND Delay_Minutes > 10"""))
def f03(spark, sf):
    return FL.where_entities(flights(spark, sf), airlines=["VI1", "CL2"], airports=["BOM"], delay_gt=10).select("Flight_ID")


@register("f04_delay_flags", sql=with_views("""SELECT count(*) AS n, count_if(Delay_Minutes > 0) AS is_delayed, count_if(Delay_Minutes <= 5) AS within_5,
  count_if(Delay_Minutes <= 15) AS within_15, count_if(Delay_Minutes > 15) AS over_15, count_if(Delay_Minutes > 30) AS over_30,
  count_if(Delay_Minutes > 45) AS over_45, count_if(Delay_Minutes > 60) AS over_60, count_if(Delay_Minutes > 120) AS over_120 FROM flights"""),
          ints=("n", "is_delayed", "within_5", "within_15", "over_15", "over_30", "over_45", "over_60", "over_120"))
def f04(spark, sf):
    return FL.delay_bucket_counts(flights(spark, sf))


@register("f06_relevant_data", sql=with_views("""SELECT Runway, count(Flight_ID) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay,
  sum(Delay_Minutes) AS Total_Delay FROM flights GROUP BY Runway"""), floats=("Avg_Delay", "Total_Delay"), ints=("Flight_Count",))
def f06(spark, sf):
    return FL.relevant_data(flights(spark, sf), "runway")


@register("f06b_top_delays", sql=with_views("""SELECT * FROM flights ORDER BY Delay_Minutes DESC, Flight_ID LIMIT 10"""),
          floats=("Delay_Minutes", "Congestion_Factor", "Runway_Efficiency"),
          ints=("Capacity", "Base_Turnaround", "Runway_Capacity", "Hour", "Day_of_Week"))
def f06b(spark, sf):
    return FL.relevant_data(flights(spark, sf), "delays")
