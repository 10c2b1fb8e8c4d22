"""Registered queries for joins (J*) and ordered/window operators (W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import joins as J
from tarmac.operators import windows as W
from tarmac.plans.catalog import register
from tarmac.plans.sql_views import with_views
from tarmac.sources.fixtures import flights, weather


@register("j01_weather_join", sql=with_views("""SELECT f.Flight_ID, date_trunc('hour', f.Scheduled_Time) AS Weather_Hour,
  coalesce(w.Weather_Condition, 'Clear') AS Weather_Condition,
  coalesce(w.Capacity_Reduction_Factor, 1.0) AS Capacity_Reduction_Factor,
  coalesce(w.Landing_Restrictions, FALSE) AS Landing_Restrictions,
  coalesce(w.Takeoff_Restrictions, FALSE) AS Takeoff_Restrictions,
  coalesce(w.Crosswind_Runway_Closure, FALSE) AS Crosswind_Runway_Closure
FROM flights f LEFT JOIN weather w ON date_trunc('hour', f.Scheduled_Time) = date_trunc('hour', w.Datetime)""", weather=True),
          floats=("Capacity_Reduction_Factor",))
def j01(spark, sf):
    out = J.join_weather(flights(spark, sf), weather(spark, sf))
    return out.select("Flight_ID", "Weather_Hour", *J.WEATHER_DEFAULTS.keys())


@register("j02_group_counts", sql=with_views("""SELECT Flight_ID,
  count(*) OVER (PARTITION BY Date, Hour) AS Hourly_Flight_Count,
  count(*) OVER (PARTITION BY Date, Hour, Runway) AS Runway_Hourly_Count,
  count(*) OVER (PARTITION BY Origin, Hour) AS Hourly_Flights,
  count(*) OVER (PARTITION BY Origin, Hour) / Runway_Capacity AS Runway_Utilization
FROM flights"""), floats=("Runway_Utilization",), ints=("Hourly_Flight_Count", "Runway_Hourly_Count", "Hourly_Flights"), bench=True)
def j02(spark, sf):
    f = flights(spark, sf)
    f = J.with_all_group_counts(f, {"Hourly_Flight_Count": ["Date", "Hour"], "Runway_Hourly_Count": ["Date", "Hour", "Runway"], "Hourly_Flights": ["Origin", "Hour"]})
    return f.select("Flight_ID", "Hourly_Flight_Count", "Runway_Hourly_Count", "Hourly_Flights",
                    F.try_divide("Hourly_Flights", "Runway_Capacity").alias("Runway_Utilization"))


@register("j03_apply_assignment", sql=with_views("""SELECT f.Flight_ID, coalesce(a.Runway, f.Runway) AS Runway,
  CASE WHEN a.Flight_ID IS NULL THEN f.Delay_Minutes * 0.9 ELSE greatest(f.Delay_Minutes - 10.0, 0.0) END AS Optimized_Delay
FROM flights f LEFT JOIN (SELECT Flight_ID, '14/32' AS Runway FROM flights WHERE Delay_Minutes > 60) a ON f.Flight_ID = a.Flight_ID"""),
          floats=("Optimized_Delay",))
def j03(spark, sf):
    f = flights(spark, sf)
    asg = f.where(F.col("Delay_Minutes") > 60).select("Flight_ID", F.lit("14/32").alias("Runway"), F.lit(True).alias("__asg"))
    out = J.apply_assignment(f, asg.select("Flight_ID", "Runway"), ["Runway"])
    out = J.flag_members(out, asg, flag="__asg")
    return out.select(
        "Flight_ID",
        "Runway",
        F.when(F.col("__asg"), F.greatest(F.col("Delay_Minutes") - 10.0, F.lit(0.0))).otherwise(F.col("Delay_Minutes") * 0.9).alias("Optimized_Delay"),
    )


@register("j04_flag_members", sql=with_views("""SELECT f.Flight_ID, f.Flight_ID IN (
  SELECT Flight_ID FROM flights WHERE Hour IN (SELECT Hour FROM flights GROUP BY Hour ORDER BY avg(Delay_Minutes) DESC, Hour LIMIT 3)) AS Is_Member
FROM flights f"""))
def j04(spark, sf):
    f = flights(spark, sf)
    worst = f.groupBy("Hour").agg(F.avg("Delay_Minutes").alias("a")).orderBy(F.desc("a"), "Hour").limit(3)
    ids = J.members_only(f, f.join(F.broadcast(worst.select("Hour")), "Hour", "left_semi").select("Flight_ID"))
    return J.flag_members(f, ids).select("Flight_ID", "Is_Member")


@register("j05_off_peak", sql=with_views("SELECT Flight_ID, Hour FROM flights WHERE Hour NOT IN (7,8,9,18,19,20)"), ints=("Hour",))
def j05(spark, sf):
    return J.off_peak(flights(spark, sf)).select("Flight_ID", "Hour")


@register("j06_candidate_hours", sql=with_views("""SELECT f.Flight_ID, h.hr AS Candidate_Hour, abs(h.hr - f.Hour) AS Shift
FROM flights f CROSS JOIN (SELECT * FROM (VALUES (7), (8), (19), (20)) AS t(hr)) h"""), ints=("Candidate_Hour", "Shift"))
def j06(spark, sf):
    dim = spark.createDataFrame([(h,) for h in (7, 8, 19, 20)], "Candidate_Hour int")
    out = J.candidates(flights(spark, sf).select("Flight_ID", "Hour"), dim)
    return out.select("Flight_ID", "Candidate_Hour", F.abs(F.col("Candidate_Hour") - F.col("Hour")).alias("Shift"))


HUBS_SQL = """hubs AS (
  SELECT Destination AS hub FROM flights GROUP BY Destination HAVING count(*) >= 10
  UNION SELECT Origin AS hub FROM flights GROUP BY Origin HAVING count(*) >= 10)"""


@register("j07_hub_connections", sql=with_views("""SELECT a.Flight_ID AS src, d.Flight_ID AS dst, a.Destination AS hub,
  (epoch_us(d.Scheduled_Time) - epoch_us(a.Scheduled_Time)) / 60000000.0::DOUBLE AS time_buffer
FROM flights a JOIN flights d ON a.Destination = d.Origin
WHERE a.Destination IN (SELECT hub FROM hubs)
  AND (epoch_us(d.Scheduled_Time) - epoch_us(a.Scheduled_Time)) BETWEEN 2700000000 AND 14400000000""", HUBS_SQL),
          floats=("time_buffer",))
def j07(spark, sf):
    return J.hub_connections(flights(spark, sf))


@register("j08_slot_pairs", sql=with_views("""SELECT a.Flight_ID AS src, b.Flight_ID AS dst, a.Runway,
  make_timestamp(CAST(floor(epoch_us(a.Scheduled_Time) / 1800000000) * 1800000000 AS BIGINT)) AS slot,
  (epoch_us(b.Scheduled_Time) - epoch_us(a.Scheduled_Time)) / 60000000.0::DOUBLE AS time_buffer
FROM flights a JOIN flights b ON a.Runway = b.Runway
  AND floor(epoch_us(a.Scheduled_Time) / 1800000000) = floor(epoch_us(b.Scheduled_Time) / 1800000000)
WHERE (a.Scheduled_Time < b.Scheduled_Time OR (a.Scheduled_Time = b.Scheduled_Time AND a.Flight_ID < b.Flight_ID))
  AND (epoch_us(b.Scheduled_Time) - epoch_us(a.Scheduled_Time)) <= 30 * 60000000"""), floats=("time_buffer",))
def j08(spark, sf):
    return J.slot_pairs(flights(spark, sf))


@register("j10_hour_spine", sql=with_views("""SELECT h.Hour, coalesce(s.Avg_Delay, 10.0) AS Avg_Delay, coalesce(s.Flight_Count, 0) AS Flight_Count
FROM range(24) AS h(Hour) LEFT JOIN (SELECT Hour, avg(Delay_Minutes) AS Avg_Delay, count(*) AS Flight_Count FROM flights GROUP BY Hour) s ON h.Hour = s.Hour"""), floats=("Avg_Delay",), ints=("Hour", "Flight_Count"))
def j10(spark, sf):
    f = flights(spark, sf)
    stats = f.groupBy("Hour").agg(F.avg("Delay_Minutes").alias("Avg_Delay"), F.count(F.lit(1)).alias("Flight_Count"))
    return J.hour_spine(stats, {"Avg_Delay": 10.0, "Flight_Count": 0})


# ------------------------------------------------------------------ windows
@register("w01_order_flights", sql=with_views("""SELECT Flight_ID, Runway, Delay_Minutes FROM flights
ORDER BY Runway ASC, Delay_Minutes DESC, Flight_ID"""), floats=("Delay_Minutes",))
def w01(spark, sf):
    return W.order_flights(flights(spark, sf), [("Runway", True), ("Delay_Minutes", False)]).select("Flight_ID", "Runway", "Delay_Minutes")


@register("w02_top_k", sql=with_views("""SELECT Flight_ID, Delay_Minutes FROM flights ORDER BY Delay_Minutes ASC, Flight_ID LIMIT 5"""),
          floats=("Delay_Minutes",))
def w02(spark, sf):
    return W.top_k(flights(spark, sf), "Delay_Minutes", 5, asc=True).select("Flight_ID", "Delay_Minutes")


@register("w02b_top_k_per_runway", sql=with_views("""SELECT Runway, Flight_ID, Delay_Minutes, rank FROM (
  SELECT Runway, Flight_ID, Delay_Minutes, row_number() OVER (PARTITION BY Runway ORDER BY Delay_Minutes DESC, Flight_ID) AS rank FROM flights) q
WHERE rank <= 3"""), floats=("Delay_Minutes",), ints=("rank",))
def w02b(spark, sf):
    return W.top_k_per_group(flights(spark, sf), ["Runway"], "Delay_Minutes", 3).select("Runway", "Flight_ID", "Delay_Minutes", "rank")


@register("w03_union_all", sql=with_views("""SELECT Flight_ID, Hour, NULL::VARCHAR AS Runway FROM flights WHERE Hour < 12
UNION ALL SELECT Flight_ID, NULL::INTEGER AS Hour, Runway FROM flights WHERE Hour >= 12"""), ints=("Hour",))
def w03(spark, sf):
    f = flights(spark, sf)
    return W.union_all([f.where("Hour < 12").select("Flight_ID", "Hour"), f.where("Hour >= 12").select("Flight_ID", "Runway")])


@register("w04_distinct", sql=with_views("""SELECT count(DISTINCT Airline) AS n_Airline, count(DISTINCT Runway) AS n_Runway,
  count(DISTINCT Origin) AS n_Origin, count(DISTINCT Destination) AS n_Destination FROM flights"""),
          ints=("n_Airline", "n_Runway", "n_Origin", "n_Destination"))
def w04(spark, sf):
    return W.nunique(flights(spark, sf), ["Airline", "Runway", "Origin", "Destination"])


ROLL_SQL = """SELECT Flight_ID,
  avg(Delay_Minutes) OVER w AS Rolling_Delay_Mean, coalesce(stddev_samp(Delay_Minutes) OVER w, 0.0) AS Rolling_Delay_Std
FROM flights WINDOW w AS ({part}ORDER BY Scheduled_Time, Flight_ID ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


@register("w05_rolling_delay", sql=with_views(ROLL_SQL.format(part="")), floats=("Rolling_Delay_Mean", "Rolling_Delay_Std"))
def w05(spark, sf):
    return W.rolling_delay(flights(spark, sf)).select("Flight_ID", "Rolling_Delay_Mean", "Rolling_Delay_Std")


@register("w05b_rolling_delay_by_origin", sql=with_views(ROLL_SQL.format(part="PARTITION BY Origin ")),
          floats=("Rolling_Delay_Mean", "Rolling_Delay_Std"))
def w05b(spark, sf):
    return W.rolling_delay(flights(spark, sf), part=["Origin"]).select("Flight_ID", "Rolling_Delay_Mean", "Rolling_Delay_Std")


@register("w06_last_hour_load", sql=with_views("""SELECT Flight_ID, count(*) OVER (PARTITION BY Origin, Runway, Date ORDER BY epoch_us(Scheduled_Time)
  RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS Recent_Flights,
  count(*) OVER (PARTITION BY Origin, Runway, Date ORDER BY epoch_us(Scheduled_Time)
  RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) / Runway_Capacity AS Runway_Load FROM flights"""),
          floats=("Runway_Load",), ints=("Recent_Flights",), bench=True)
def w06(spark, sf):
    return W.last_hour_load(flights(spark, sf)).select("Flight_ID", "Recent_Flights", "Runway_Load")


@register("w09_next_flight", sql=with_views("""SELECT Flight_ID,
  lead(Flight_ID) OVER w AS Next_Flight_ID, lag(Flight_ID) OVER w AS Prev_Flight_ID,
  lead(Origin) OVER w AS Next_Origin FROM flights WINDOW w AS (PARTITION BY Aircraft_ID ORDER BY Scheduled_Time, Flight_ID)"""))
def w09(spark, sf):
    return W.next_flight(flights(spark, sf), "Aircraft_ID", cols=("Flight_ID", "Origin")).select(
        "Flight_ID", "Next_Flight_ID", "Prev_Flight_ID", "Next_Origin")


@register("w10_normalised_scores", sql=with_views("""SELECT Runway, n, n / max(n) OVER () * 100 AS Utilization_Score,
  n / sum(n) OVER () AS Share FROM (SELECT Runway, count(*) AS n FROM flights GROUP BY Runway) q"""),
          floats=("Utilization_Score", "Share"), ints=("n",))
def w10(spark, sf):
    g = flights(spark, sf).groupBy("Runway").agg(F.count(F.lit(1)).alias("n"))
    g = W.max_normalised(g, "n", "Utilization_Score")
    return W.share_of_total(g, "n", "Share")


@register("w11_quantile_flags", sql=with_views("""SELECT Flight_ID, Delay_Minutes > (SELECT quantile_cont(Delay_Minutes, 0.8) FROM flights) AS Above_P80,
  Delay_Minutes > (SELECT quantile_cont(Delay_Minutes, 0.33) FROM flights) AS Above_P33 FROM flights"""))
def w11(spark, sf):
    f = W.quantile_flag(flights(spark, sf), "Delay_Minutes", 0.8, "Above_P80")
    return W.quantile_flag(f, "Delay_Minutes", 0.33, "Above_P33").select("Flight_ID", "Above_P80", "Above_P33")


@register("w12_modal_value", sql=with_views("""SELECT Hour, Peak_Mode FROM (
  SELECT Hour, Runway AS Peak_Mode, row_number() OVER (PARTITION BY Hour ORDER BY count(*) DESC, Runway) AS r
  FROM flights GROUP BY Hour, Runway) q WHERE r = 1"""), ints=("Hour",))
def w12(spark, sf):
    return W.modal_value(flights(spark, sf), ["Hour"], "Runway", "Peak_Mode")


@register("w13_recent_trend", sql=with_views("""SELECT avg(m) AS Recent_Trend FROM (
  SELECT Date, avg(Delay_Minutes) AS m FROM flights GROUP BY Date ORDER BY Date DESC LIMIT 3) q"""), floats=("Recent_Trend",))
def w13(spark, sf):
    return W.recent_trend(flights(spark, sf))


@register("w14_islands", sql=with_views("""SELECT Origin, Flight_ID, sum(nw) OVER (PARTITION BY Origin ORDER BY s, e
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Island FROM (
  SELECT Origin, Flight_ID, s, e, CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END AS nw FROM (
    SELECT Origin, Flight_ID, s, e, max(e) OVER (PARTITION BY Origin ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
    FROM (SELECT Origin, Flight_ID, epoch_us(Scheduled_Time) AS s, epoch_us(Scheduled_Time) + 20 * 60000000 AS e FROM flights) a) b) c"""),
          ints=("Island",))
def w14(spark, sf):
    f = flights(spark, sf).select(
        "Origin", "Flight_ID", F.unix_micros(F.col("Scheduled_Time").cast("timestamp")).alias("s"))
    f = f.withColumn("e", F.col("s") + 20 * 60_000_000)
    return W.islands(f, ["Origin"], "s", "e", bucket_width=3_600_000_000).select("Origin", "Flight_ID", "Island")
