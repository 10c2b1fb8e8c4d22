"""Registered KPI queries (A*) over the fixture flights view."""

from __future__ import annotations

from tarmac.operators import kpi
from tarmac.plans.catalog import register
from tarmac.plans.sql_views import with_views
from tarmac.sources.fixtures import flights


@register(
    "a01_hour_dow_stats",
    sql=with_views(
        """SELECT Hour, Day_of_Week,
  count(Flight_ID) AS Flight_Count,
  avg(Delay_Minutes) AS Avg_Delay,
  stddev_samp(Delay_Minutes) AS Delay_Std,
  max(Delay_Minutes) AS Max_Delay,
  sum(Capacity) AS Total_Passengers,
  count(DISTINCT Runway) AS Active_Runways,
  count(Flight_ID) / count(DISTINCT Runway) AS Flights_per_Runway,
  count(Flight_ID) * 0.4 + avg(Delay_Minutes) * 0.3 + (count(Flight_ID) / count(DISTINCT Runway)) * 0.3 AS Congestion_Score
FROM flights GROUP BY Hour, Day_of_Week"""
    ),
    floats=("Avg_Delay", "Delay_Std", "Max_Delay", "Flights_per_Runway", "Congestion_Score"),
    ints=("Hour", "Day_of_Week", "Flight_Count", "Total_Passengers", "Active_Runways"),
    bench=True,
)
def a01(spark, sf_dir):
    return kpi.hour_dow_stats(flights(spark, sf_dir))


import datetime as _dt  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

AS_OF = _dt.date(2024, 1, 15)
H = "SELECT Hour, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay FROM flights GROUP BY Hour"
A = "SELECT Airline, count(*) AS n, avg(Delay_Minutes) AS a FROM flights GROUP BY Airline"


def q(name, sql, floats=(), ints=(), bench=False, extra_ctes=()):
    return register(name, sql=with_views(sql, *extra_ctes) if sql else None, floats=floats, ints=ints, bench=bench)


@q("a02_hourly_basic", """SELECT Hour, Day_of_Week, count(Flight_ID) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay,
  stddev_samp(Delay_Minutes) AS Delay_Std, max(Delay_Minutes) AS Max_Delay, sum(Capacity) AS Total_Passengers,
  count(DISTINCT Runway) AS Active_Runways, count(Flight_ID) * 0.1 AS Congestion_Score FROM flights GROUP BY Hour, Day_of_Week""",
   ("Avg_Delay", "Delay_Std", "Max_Delay", "Congestion_Score"), ("Hour", "Day_of_Week", "Flight_Count", "Total_Passengers", "Active_Runways"))
def a02(spark, sf):
    return kpi.hourly_basic(flights(spark, sf))


@q("a03_peak_hours", f"""SELECT Hour, Flight_Count FROM ({H}) h WHERE Flight_Count > 1.0 * (SELECT avg(Flight_Count) FROM ({H}) x)""",
   (), ("Hour", "Flight_Count"))
def a03(spark, sf):
    """Hours above the mean (the default factor 1.2 finds none in this evenly spread fixture)."""
    return kpi.peak_hours(flights(spark, sf), 1.0)


@q("a04_delay_summary", """SELECT count(*) AS total_flights, count_if(Delay_Minutes > 0) AS delayed_flights,
  count_if(Delay_Minutes > 0) / count(*) * 100 AS delay_rate, avg(Delay_Minutes) AS avg_delay, max(Delay_Minutes) AS max_delay,
  quantile_cont(Delay_Minutes, 0.5) AS median_delay, count_if(Delay_Minutes > 30) AS over_30, count_if(Delay_Minutes > 60) AS over_60
FROM flights""", ("delay_rate", "avg_delay", "max_delay", "median_delay"), ("total_flights", "delayed_flights", "over_30", "over_60"))
def a04(spark, sf):
    return kpi.delay_summary(flights(spark, sf))


@q("a05_runway_utilization", """SELECT Runway, Flight_Count, Avg_Delay, Total_Passengers, Flight_Count / max(Flight_Count) OVER () * 100 AS Utilization_Score
FROM (SELECT Runway, count(Flight_ID) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay, sum(Capacity) AS Total_Passengers FROM flights GROUP BY Runway) r""",
   ("Avg_Delay", "Utilization_Score"), ("Flight_Count", "Total_Passengers"))
def a05(spark, sf):
    return kpi.runway_utilization(flights(spark, sf))


@q("a06_congestion_breakdown", """SELECT Peak_Category, Flights, Avg_Delay, Total_Delay, Avg_Congestion, Avg_Efficiency,
  Flights / sum(Flights) OVER () * 100 AS Share_Pct FROM (SELECT Peak_Category, count(*) AS Flights, avg(Delay_Minutes) AS Avg_Delay,
  sum(Delay_Minutes) AS Total_Delay, avg(Congestion_Factor) AS Avg_Congestion, avg(Runway_Efficiency) AS Avg_Efficiency FROM flights GROUP BY Peak_Category) g""",
   ("Avg_Delay", "Total_Delay", "Avg_Congestion", "Avg_Efficiency", "Share_Pct"), ("Flights",))
def a06(spark, sf):
    return kpi.congestion_breakdown(flights(spark, sf))


@q("a07_by_hour", f"""SELECT Hour, Avg_Delay, Flight_Count,
  (SELECT Hour FROM ({H}) x ORDER BY Flight_Count DESC, Hour LIMIT 1) AS Peak_Hour,
  (SELECT Hour FROM ({H}) x ORDER BY Avg_Delay DESC, Hour LIMIT 1) AS Worst_Delay_Hour FROM ({H}) h""",
   ("Avg_Delay",), ("Hour", "Flight_Count", "Peak_Hour", "Worst_Delay_Hour"))
def a07(spark, sf):
    return kpi.by_hour(flights(spark, sf))


@q("a08_day_hour_heatmap", "SELECT Day_of_Week, dayname(Scheduled_Time) AS Day, "
   + ", ".join(f'avg(CASE WHEN Hour = {h} THEN Delay_Minutes END) AS "{h}"' for h in range(24))
   + " FROM flights GROUP BY Day_of_Week, dayname(Scheduled_Time)", tuple(str(h) for h in range(24)), ("Day_of_Week",))
def a08(spark, sf):
    return kpi.day_hour_heatmap(flights(spark, sf))


@q("a09_hourly_capacity", """SELECT Hour, Operations, Runways, Passengers, Operations / Runways AS Ops_per_Runway,
  first(Hour ORDER BY Operations DESC, Hour) OVER () AS Peak_Hour FROM (
  SELECT Hour, count(*) AS Operations, count(DISTINCT Runway) AS Runways, sum(Capacity) AS Passengers FROM flights GROUP BY Hour) h""",
   ("Ops_per_Runway",), ("Hour", "Operations", "Runways", "Passengers", "Peak_Hour"))
def a09(spark, sf):
    return kpi.hourly_capacity(flights(spark, sf))


@q("a10_slot_revenue", """SELECT count_if(Hour IN (7,8,9,18,19,20)) AS Business_Flights,
  count_if(Hour IN (7,8,9,18,19,20)) * avg(CASE WHEN Hour IN (7,8,9,18,19,20) THEN Capacity END) * 1.5 AS Business_Revenue_Index,
  count_if(Hour BETWEEN 10 AND 17) AS Leisure_Flights,
  count_if(Hour BETWEEN 10 AND 17) * avg(CASE WHEN Hour BETWEEN 10 AND 17 THEN Capacity END) * 1.0 AS Leisure_Revenue_Index FROM flights""",
   ("Business_Revenue_Index", "Leisure_Revenue_Index"), ("Business_Flights", "Leisure_Flights"))
def a10(spark, sf):
    return kpi.slot_revenue(flights(spark, sf))


@q("a11_best_times", """SELECT Hour, Flight_Count, Avg_Delay, Delay_Std, Min_Delay, Max_Delay,
  1.0 / (Avg_Delay + 1) * Flight_Count / max(Flight_Count) OVER () AS Efficiency_Score FROM (
  SELECT Hour, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay, stddev_samp(Delay_Minutes) AS Delay_Std,
  min(Delay_Minutes) AS Min_Delay, max(Delay_Minutes) AS Max_Delay FROM flights GROUP BY Hour) h""",
   ("Avg_Delay", "Delay_Std", "Min_Delay", "Max_Delay", "Efficiency_Score"), ("Hour", "Flight_Count"))
def a11(spark, sf):
    return kpi.best_times(flights(spark, sf))


@q("a11b_best_times_top5", """SELECT Hour, Efficiency_Score FROM (SELECT Hour, 1.0 / (Avg_Delay + 1) * Flight_Count / max(Flight_Count) OVER () AS Efficiency_Score
  FROM (SELECT Hour, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay FROM flights GROUP BY Hour) h) s
  ORDER BY Efficiency_Score DESC, Hour LIMIT 5""", ("Efficiency_Score",), ("Hour",))
def a11b(spark, sf):
    return kpi.best_times(flights(spark, sf)).orderBy(F.desc("Efficiency_Score"), "Hour").limit(5).select("Hour", "Efficiency_Score")


@q("a12_optimal_hours", f"""SELECT Hour, Avg_Delay, Flight_Count FROM ({H}) h
  WHERE Avg_Delay < (SELECT quantile_cont(Avg_Delay, 0.3) FROM ({H}) x) AND Flight_Count >= 5""", ("Avg_Delay",), ("Hour", "Flight_Count"))
def a12(spark, sf):
    return kpi.optimal_hours(flights(spark, sf))


@q("a13_busiest_congestion", """SELECT Hour, Flight_Count, Avg_Delay, Total_Capacity, Active_Runways,
  Flight_Count * Avg_Delay * Total_Capacity / 10000 AS Congestion_Score, Flight_Count / Active_Runways AS Density FROM (
  SELECT Hour, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay, sum(Capacity) AS Total_Capacity, count(DISTINCT Runway) AS Active_Runways
  FROM flights GROUP BY Hour) h""", ("Avg_Delay", "Congestion_Score", "Density"), ("Hour", "Flight_Count", "Total_Capacity", "Active_Runways"))
def a13(spark, sf):
    return kpi.busiest_congestion(flights(spark, sf))


@q("a14_peaks_to_avoid", f"""SELECT Hour, Avg_Delay, Flight_Count, Score FROM (SELECT *, Flight_Count * Avg_Delay / 100 AS Score FROM ({H}) h) s
  WHERE Score >= (SELECT quantile_cont(Flight_Count * Avg_Delay / 100, 0.7) FROM ({H}) x)""", ("Avg_Delay", "Score"), ("Hour", "Flight_Count"))
def a14(spark, sf):
    return kpi.peaks_to_avoid(flights(spark, sf))


@q("a15_top5_busiest_hours", f"SELECT Hour, Flight_Count FROM ({H}) h ORDER BY Flight_Count DESC, Hour LIMIT 5", (), ("Hour", "Flight_Count"))
def a15(spark, sf):
    from tarmac.operators.windows import top_k
    return top_k(flights(spark, sf).groupBy("Hour").agg(F.count(F.lit(1)).alias("Flight_Count")), "Flight_Count", 5, tie="Hour")


@q("a16_schedule_tuning", f"""SELECT Hour AS Original_Hour, (SELECT min(Hour) FROM ({H}) x WHERE Avg_Delay < 33) AS Recommended_Hour,
  least(Flight_Count // 3, 10) AS Flights_to_Move, Avg_Delay AS Current_Delay, Avg_Delay * 0.7 AS Projected_Delay,
  Avg_Delay * 0.3 AS Delay_Reduction, least(Flight_Count // 3, 10) * Avg_Delay * 0.3 AS Impact_Score
FROM ({H}) h WHERE Avg_Delay > 33 AND (SELECT min(Hour) FROM ({H}) x WHERE Avg_Delay < 33) IS NOT NULL""",
   ("Current_Delay", "Projected_Delay", "Delay_Reduction", "Impact_Score"), ("Original_Hour", "Recommended_Hour", "Flights_to_Move"))
def a16(spark, sf):
    """Limits of 33 minutes on both sides, so that hours of this fixture fall on either."""
    return kpi.schedule_tuning(flights(spark, sf), 33.0, 33.0)


@q("a16b_tuning_impact", f"""SELECT count(*) AS slots, sum(least(Flight_Count // 3, 10)) AS flights_to_move, avg(Avg_Delay * 0.3) AS avg_reduction,
  sum(least(Flight_Count // 3, 10) * Avg_Delay * 0.3) AS projected_savings, (SELECT sum(Delay_Minutes) FROM flights) AS total_delay,
  sum(least(Flight_Count // 3, 10) * Avg_Delay * 0.3) / (SELECT sum(Delay_Minutes) FROM flights) * 100 AS improvement_pct,
  sum(least(Flight_Count // 3, 10) * Avg_Delay * 0.3) * 100 AS cost_savings FROM ({H}) h WHERE Avg_Delay > 33""",
   ("avg_reduction", "projected_savings", "total_delay", "improvement_pct", "cost_savings"), ("slots", "flights_to_move"))
def a16b(spark, sf):
    return kpi.tuning_impact(flights(spark, sf), 33.0, 33.0)


@q("a11c_best_and_worst_times", """SELECT * FROM (WITH hs AS (SELECT Hour, Flight_Count, Avg_Delay, 1.0 / (Avg_Delay + 1) * Flight_Count / max(Flight_Count) OVER () AS e
  FROM (SELECT Hour, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay FROM flights GROUP BY Hour) x),
b AS (SELECT * FROM (SELECT 'best' AS "Group", Hour, Flight_Count, Avg_Delay FROM hs ORDER BY e DESC, Hour LIMIT 5) p
  UNION ALL SELECT * FROM (SELECT 'worst', Hour, Flight_Count, Avg_Delay FROM hs ORDER BY e ASC, Hour LIMIT 3) r)
SELECT *, (SELECT avg(Avg_Delay) FROM b WHERE "Group" = 'worst') - (SELECT avg(Avg_Delay) FROM b WHERE "Group" = 'best') AS Improvement FROM b) z""",
   ("Avg_Delay", "Improvement"), ("Hour", "Flight_Count"))
def a11c(spark, sf):
    return kpi.best_and_worst_times(flights(spark, sf))


@q("a27b_hour_reschedule", f"""SELECT Hour, Avg_Delay, n AS Flights_At_Hour, m AS Delay_At_Hour, n // 3 AS Flights_To_Move
FROM (SELECT Hour, Avg_Delay FROM ({H}) h ORDER BY Avg_Delay, Hour LIMIT 3) b
CROSS JOIN (SELECT count(*) AS n, avg(Delay_Minutes) AS m FROM flights WHERE Hour = 21) t WHERE n > 0""",
   ("Avg_Delay", "Delay_At_Hour"), ("Hour", "Flights_At_Hour", "Flights_To_Move"))
def a27b(spark, sf):
    return kpi.hour_reschedule(flights(spark, sf))


@q("a17_net_revenue", """SELECT sum(rev) AS Total_Revenue, avg(rev) AS Avg_Revenue, sum(Delay_Minutes * 50) AS Total_Delay_Cost,
  count_if(Delay_Minutes * 50 > 1000) AS High_Cost_Flights FROM (SELECT Delay_Minutes, Capacity * 200 *
  CASE WHEN Hour IN (7,8,19,20) THEN 1.4 WHEN Hour IN (6,9,18,21) THEN 1.2 ELSE 1.0 END - Delay_Minutes * 50 AS rev FROM flights) r""",
   ("Total_Revenue", "Avg_Revenue", "Total_Delay_Cost"), ("High_Cost_Flights",))
def a17(spark, sf):
    return kpi.net_revenue_summary(flights(spark, sf))


@q("a18_runway_analysis", """SELECT Runway, count(Flight_ID) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay, sum(Delay_Minutes) AS Total_Delay,
  sum(Capacity) AS Total_Capacity, count(DISTINCT Hour) AS Active_Hours, count(Flight_ID) / count(DISTINCT Hour) AS Flights_per_Hour,
  count(Flight_ID) / (avg(Delay_Minutes) + 1) AS Efficiency FROM flights GROUP BY Runway""",
   ("Avg_Delay", "Total_Delay", "Flights_per_Hour", "Efficiency"), ("Flight_Count", "Total_Capacity", "Active_Hours"))
def a18(spark, sf):
    return kpi.runway_analysis(flights(spark, sf))


@q("a19_runway_delay_table", """SELECT Runway, avg(Delay_Minutes) AS Avg_Delay, sum(Delay_Minutes) AS Total_Delay, count(Flight_ID) AS Flight_Count
FROM flights GROUP BY Runway""", ("Avg_Delay", "Total_Delay"), ("Flight_Count",))
def a19(spark, sf):
    return kpi.runway_delay_table(flights(spark, sf))


@q("a20_airline_analysis", """SELECT Airline, count(Flight_ID) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay, sum(Delay_Minutes) AS Total_Delay,
  stddev_samp(Delay_Minutes) AS Delay_Std, sum(Capacity) AS Total_Capacity, avg(Capacity) AS Avg_Capacity,
  85 - avg(Delay_Minutes) AS On_Time_Performance, count(Flight_ID) / (avg(Delay_Minutes) + 1) AS Efficiency_Score FROM flights GROUP BY Airline""",
   ("Avg_Delay", "Total_Delay", "Delay_Std", "Avg_Capacity", "On_Time_Performance", "Efficiency_Score"), ("Flight_Count", "Total_Capacity"))
def a20(spark, sf):
    return kpi.airline_analysis(flights(spark, sf))


A21_CTE = """a AS (SELECT Airline, Flight_Count, Avg_Delay, 1.0 / (Avg_Delay + 1) * Flight_Count / max(Flight_Count) OVER () * 100 AS Performance_Score
  FROM (SELECT Airline, count(Flight_ID) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay FROM flights GROUP BY Airline) g)"""


@q("a21_airline_comparison", """SELECT a.*, (SELECT Airline FROM a ORDER BY Performance_Score DESC, Airline DESC LIMIT 1) AS Best_Airline,
  (SELECT Airline FROM a ORDER BY Performance_Score ASC, Airline ASC LIMIT 1) AS Worst_Airline,
  (SELECT max(Performance_Score) - min(Performance_Score) FROM a) AS Performance_Gap FROM a""",
   ("Avg_Delay", "Performance_Score", "Performance_Gap"), ("Flight_Count",), extra_ctes=(A21_CTE,))
def a21(spark, sf):
    return kpi.airline_comparison(flights(spark, sf))


@q("a22_airline_delay_rate", """SELECT Airline, count(*) AS Total, count_if(Delay_Minutes > 15) AS Delayed,
  count_if(Delay_Minutes > 15) / count(*) * 100 AS Delay_Rate FROM flights GROUP BY Airline""", ("Delay_Rate",), ("Total", "Delayed"))
def a22(spark, sf):
    return kpi.airline_delay_rate(flights(spark, sf))


A23_CTE = """full_h AS (SELECT s.Hour, coalesce(h.Predicted_Delay, 10.0) AS Predicted_Delay, coalesce(h.Variance, 5.0) AS Variance,
  coalesce(h.Confidence, 50) AS Confidence, coalesce(h.Risk_Level, 'Low') AS Risk_Level FROM range(24) AS s(Hour) LEFT JOIN (
  SELECT Hour, avg(Delay_Minutes) AS Predicted_Delay, stddev_samp(Delay_Minutes) AS Variance, least(95, count(*) * 5) AS Confidence,
  CASE WHEN avg(Delay_Minutes) > 25 THEN 'High' WHEN avg(Delay_Minutes) > 15 THEN 'Medium' ELSE 'Low' END AS Risk_Level
  FROM flights GROUP BY Hour) h ON s.Hour = h.Hour)"""


@q("a23_hourly_forecast", """SELECT *, avg(Predicted_Delay) OVER () AS Daily_Predicted_Delay,
  count_if(Risk_Level = 'High') OVER () AS High_Risk_Hours FROM full_h""",
   ("Predicted_Delay", "Variance", "Daily_Predicted_Delay"), ("Hour", "Confidence", "High_Risk_Hours"), extra_ctes=(A23_CTE,))
def a23(spark, sf):
    return kpi.hourly_forecast(flights(spark, sf))


@q("a24_risk_forecast", f"""SELECT Date, Day, Hour, Expected_Avg_Delay, Expected_Flights, Delay_Risk, Time_Slot,
  CASE WHEN Delay_Risk >= 70 THEN 'Critical' WHEN Delay_Risk >= 50 THEN 'High' WHEN Delay_Risk >= 30 THEN 'Medium' ELSE 'Low' END AS Risk_Level
FROM (SELECT d.Date, dayname(d.Date) AS Day, h.Hour, h.Expected_Avg_Delay, h.Expected_Flights,
  least(h.Expected_Avg_Delay * 0.8 + h.Expected_Flights * 0.3, 100.0)
  * CASE WHEN dayname(d.Date) IN ('Monday','Friday') THEN 1.2 WHEN dayname(d.Date) IN ('Saturday','Sunday') THEN 0.8 ELSE 1.0 END
  * CASE WHEN h.Hour IN (7,8,19,20) THEN 1.4 WHEN h.Hour IN (11,12,13,14) THEN 1.1 ELSE 1.0 END AS Delay_Risk,
  format('{{:02d}}:00-{{:02d}}:00', h.Hour, h.Hour + 1) AS Time_Slot
FROM (SELECT CAST(DATE '{AS_OF}' + INTERVAL (i) DAY AS DATE) AS Date FROM range(7) t(i)) d
CROSS JOIN (SELECT Hour, avg(Delay_Minutes) AS Expected_Avg_Delay, count(*) AS Expected_Flights FROM flights WHERE Hour BETWEEN 6 AND 22 GROUP BY Hour) h) r""",
   ("Expected_Avg_Delay", "Delay_Risk"), ("Hour", "Expected_Flights"))
def a24(spark, sf):
    return kpi.risk_forecast(flights(spark, sf), AS_OF)


@q("a25_cost_estimates", """SELECT sum(Delay_Minutes) * 1000 AS Delay_Cost_1000, sum(Delay_Minutes) * 50 AS Fuel_Cost, sum(Delay_Minutes) * 200 AS Crew_Cost,
  sum(Delay_Minutes) * 100 AS Delay_Cost_100, sum(Delay_Minutes) * 500 AS Delay_Cost_500 FROM flights""",
   ("Delay_Cost_1000", "Fuel_Cost", "Crew_Cost", "Delay_Cost_100", "Delay_Cost_500"))
def a25(spark, sf):
    return kpi.cost_estimates(flights(spark, sf))


@q("a26_general_optimisation", f"""SELECT Worst_Avg, Best_Avg, Worst_Flights, (Worst_Avg - Best_Avg) * Worst_Flights AS Potential_Savings FROM (
  SELECT (SELECT avg(Avg_Delay) FROM (SELECT Avg_Delay FROM ({H}) x ORDER BY Avg_Delay DESC, Hour LIMIT 3)) AS Worst_Avg,
         (SELECT avg(Avg_Delay) FROM (SELECT Avg_Delay FROM ({H}) x ORDER BY Avg_Delay ASC, Hour LIMIT 3)) AS Best_Avg,
         (SELECT sum(Flight_Count) FROM (SELECT Flight_Count FROM ({H}) x ORDER BY Avg_Delay DESC, Hour LIMIT 3)) AS Worst_Flights) s""",
   ("Worst_Avg", "Best_Avg", "Potential_Savings"), ("Worst_Flights",))
def a26(spark, sf):
    return kpi.general_optimisation(flights(spark, sf))


@q("a27_evening_reschedule", f"""SELECT Hour, Flight_Count, Avg_Delay, Flight_Count > (SELECT quantile_cont(Flight_Count, 0.8) FROM ({H}) x) AS Is_Busy,
  Hour = 21 AS Is_Target FROM ({H}) h""", ("Avg_Delay",), ("Hour", "Flight_Count"))
def a27(spark, sf):
    return kpi.evening_reschedule(flights(spark, sf))


@q("a28_top_delayed", """SELECT Flight_ID, Airline, Delay_Minutes FROM flights WHERE Delay_Minutes > 30 ORDER BY Delay_Minutes DESC, Flight_ID LIMIT 10""",
   ("Delay_Minutes",))
def a28(spark, sf):
    from tarmac.operators.windows import top_k
    return top_k(flights(spark, sf).where(F.col("Delay_Minutes") > 30), "Delay_Minutes", 10).select("Flight_ID", "Airline", "Delay_Minutes")


A29_CTE = """r AS (SELECT Runway, Flight_Count, Avg_Delay, Total_Passengers, Flight_Count / max(Flight_Count) OVER () * 100 AS Utilization_Score
FROM (SELECT Runway, count(Flight_ID) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay, sum(Capacity) AS Total_Passengers FROM flights GROUP BY Runway) g),
rs AS (SELECT *, CASE WHEN Utilization_Score > 80 THEN 'over' WHEN Utilization_Score < 50 THEN 'under' ELSE 'balanced' END AS Status FROM r)"""


@q("a29_runway_rebalancing", """SELECT rs.*, (SELECT stddev_samp(Flight_Count) FROM rs) AS Redistribute_Std,
  (SELECT least(sum(CASE WHEN Status = 'over' THEN Flight_Count END) * 0.2, sum(CASE WHEN Status = 'under' THEN Flight_Count END) * 0.5) FROM rs) AS Movable
FROM rs""", ("Avg_Delay", "Utilization_Score", "Redistribute_Std", "Movable"), ("Flight_Count", "Total_Passengers"), extra_ctes=(A29_CTE,))
def a29(spark, sf):
    return kpi.runway_rebalancing(flights(spark, sf))


@q("a29b_peak_offpeak_move", """SELECT peak_mean, offpeak_mean, (peak_mean - offpeak_mean) * 0.15 AS Flights_to_Move FROM
  (SELECT avg(n) AS peak_mean FROM (SELECT count(*) AS n FROM flights GROUP BY Hour ORDER BY n DESC, Hour LIMIT 3)) a,
  (SELECT avg(n) AS offpeak_mean FROM (SELECT count(*) AS n FROM flights GROUP BY Hour ORDER BY n ASC, Hour LIMIT 3)) b""",
   ("peak_mean", "offpeak_mean", "Flights_to_Move"))
def a29b(spark, sf):
    return kpi.peak_offpeak_move(flights(spark, sf))


@q("a30_severity_split", f"""SELECT count(*) AS Total, count_if(Delay_Minutes > 0 AND Delay_Minutes <= 15) AS Minor,
  count_if(Delay_Minutes > 15 AND Delay_Minutes <= 30) AS Moderate, count_if(Delay_Minutes > 30) AS Major,
  (SELECT Hour FROM ({H}) x ORDER BY Avg_Delay DESC, Hour LIMIT 1) AS Worst_Hour,
  (SELECT Hour FROM ({H}) x ORDER BY Avg_Delay ASC, Hour LIMIT 1) AS Best_Hour,
  count_if(Delay_Minutes > 0 AND Delay_Minutes <= 15) / count(*) * 100 AS Minor_Pct,
  count_if(Delay_Minutes > 15 AND Delay_Minutes <= 30) / count(*) * 100 AS Moderate_Pct,
  count_if(Delay_Minutes > 30) / count(*) * 100 AS Major_Pct FROM flights""",
   ("Minor_Pct", "Moderate_Pct", "Major_Pct"), ("Total", "Minor", "Moderate", "Major", "Worst_Hour", "Best_Hour"))
def a30(spark, sf):
    return kpi.severity_split(flights(spark, sf))


@q("a31_overview", """SELECT count(*) AS Total_Flights, count(DISTINCT Airline) AS Airlines, count(DISTINCT Runway) AS Runways,
  count_if(Delay_Minutes > 15) / count(*) * 100 AS Delay_Rate, avg(Delay_Minutes) AS Avg_Delay,
  date_diff('day', min(Date), max(Date)) + 1 AS Day_Span, count(*) / count(DISTINCT Runway) AS Ops_per_Runway,
  (SELECT Runway FROM flights GROUP BY Runway ORDER BY count(*) DESC, Runway LIMIT 1) AS Busiest_Runway,
  (SELECT Airline FROM flights GROUP BY Airline ORDER BY count(*) DESC, Airline LIMIT 1) AS Busiest_Airline,
  (SELECT Hour FROM flights GROUP BY Hour ORDER BY count(*) DESC, Hour LIMIT 1) AS Busiest_Hour FROM flights""",
   ("Delay_Rate", "Avg_Delay", "Ops_per_Runway"), ("Total_Flights", "Airlines", "Runways", "Day_Span", "Busiest_Hour"))
def a31(spark, sf):
    return kpi.overview(flights(spark, sf))


@q("a32_fleet_utilisation", """SELECT * FROM (SELECT Aircraft_Type, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay, avg(Capacity) AS Avg_Capacity,
  count(*) * avg(Capacity) / (avg(Delay_Minutes) + 1) AS Utilization_Score FROM flights GROUP BY Aircraft_Type) a
  ORDER BY Utilization_Score DESC, Aircraft_Type LIMIT 10""", ("Avg_Delay", "Avg_Capacity", "Utilization_Score"), ("Flight_Count",))
def a32(spark, sf):
    from tarmac.operators.windows import top_k
    return top_k(kpi.fleet_utilisation(flights(spark, sf)), "Utilization_Score", 10, tie="Aircraft_Type")


@q("a33_route_impact", """SELECT * FROM (SELECT Destination, avg(Delay_Minutes) AS Avg_Delay, count(*) AS Flight_Count,
  avg(Delay_Minutes) * count(*) / 100 AS Impact FROM flights GROUP BY Destination) a ORDER BY Impact DESC, Destination LIMIT 10""",
   ("Avg_Delay", "Impact"), ("Flight_Count",))
def a33(spark, sf):
    from tarmac.operators.windows import top_k
    return top_k(kpi.route_impact(flights(spark, sf)), "Impact", 10, tie="Destination")


@q("a34_disruption_table", """SELECT Flight_ID, sum(Delay_Minutes) AS Total_Delay, arg_min(Aircraft_ID, Scheduled_Time) AS Aircraft_ID,
  arg_min(Airline, Scheduled_Time) AS Airline FROM flights WHERE Delay_Minutes > 30 GROUP BY Flight_ID ORDER BY Total_Delay DESC, Flight_ID LIMIT 10""",
   ("Total_Delay",))
def a34(spark, sf):
    from tarmac.operators.windows import top_k
    return top_k(kpi.disruption_table(flights(spark, sf)), "Total_Delay", 10)


@q("a35_load_extremes", """SELECT Hour, Flight_Count, CASE WHEN Flight_Count > p80 THEN 'overloaded' WHEN Flight_Count < p30 THEN 'underused' ELSE 'normal' END AS Load
FROM (SELECT Hour, count(*) AS Flight_Count FROM flights GROUP BY Hour) h,
  (SELECT quantile_cont(n, 0.8) AS p80, quantile_cont(n, 0.3) AS p30 FROM (SELECT count(*) AS n FROM flights GROUP BY Hour)) q""",
   (), ("Hour", "Flight_Count"))
def a35(spark, sf):
    return kpi.load_extremes(flights(spark, sf))


@q("a36_describe", """SELECT count(Delay_Minutes) AS count, avg(Delay_Minutes) AS mean, stddev_samp(Delay_Minutes) AS std, min(Delay_Minutes) AS min,
  quantile_cont(Delay_Minutes, 0.25) AS p25, quantile_cont(Delay_Minutes, 0.5) AS p50, quantile_cont(Delay_Minutes, 0.75) AS p75,
  max(Delay_Minutes) AS max FROM flights""", ("mean", "std", "min", "p25", "p50", "p75", "max"), ("count",))
def a36(spark, sf):
    return kpi.describe(flights(spark, sf))


@q("a39_value_share", """SELECT Destination, count(*) AS Count, count(*) / sum(count(*)) OVER () * 100 AS Share_Pct FROM flights GROUP BY Destination""",
   ("Share_Pct",), ("Count",))
def a39(spark, sf):
    return kpi.value_share(flights(spark, sf), "Destination")


@q("a40_slot_comparison", """SELECT Slot, count(*) AS n, avg(Delay_Minutes) AS mean, quantile_cont(Delay_Minutes, 0.5) AS median,
  count_if(Delay_Minutes <= 15) / count(*) * 100 AS on_time_pct, count_if(Delay_Minutes > 60) AS major, stddev_samp(Delay_Minutes) AS std
FROM (SELECT *, CASE WHEN Hour BETWEEN 6 AND 8 THEN '6AM - 9AM' WHEN Hour BETWEEN 9 AND 11 THEN '9AM - 12PM' ELSE 'Other hours' END AS Slot FROM flights) f
GROUP BY Slot""", ("mean", "median", "on_time_pct", "std"), ("n", "major"))
def a40(spark, sf):
    f = flights(spark, sf).withColumn(
        "Slot", F.when(F.col("Hour").between(6, 8), "6AM - 9AM").when(F.col("Hour").between(9, 11), "9AM - 12PM").otherwise("Other hours"))
    return kpi.slot_comparison(f)


@q("a41_top_routes", """SELECT Destination, count(*) AS n, avg(Delay_Minutes) AS mean, count_if(Delay_Minutes <= 15) / count(*) * 100 AS on_time_pct,
  count_if(Delay_Minutes > 60) AS major, stddev_samp(Delay_Minutes) AS std FROM flights
WHERE Destination IN (SELECT Destination FROM flights GROUP BY Destination ORDER BY count(*) DESC, Destination LIMIT 8) GROUP BY Destination""",
   ("mean", "on_time_pct", "std"), ("n", "major"))
def a41(spark, sf):
    return kpi.top_routes(flights(spark, sf))


@q("a42_hourly_performance", """SELECT Hour, n, mean, std, n * mean AS Congestion, 50 / (mean + 1) + 30 / (std + 1) + 20 / (n * mean + 1) AS Performance,
  n * 0.2 AS Move_20pct FROM (SELECT Hour, count(*) AS n, avg(Delay_Minutes) AS mean, stddev_samp(Delay_Minutes) AS std FROM flights GROUP BY Hour) h""",
   ("mean", "std", "Congestion", "Performance", "Move_20pct"), ("Hour", "n"))
def a42(spark, sf):
    return kpi.hourly_performance(flights(spark, sf))


@q("a43_histogram", """SELECT s.Bin, count(b.Bin) AS Count, min(m.lo + s.Bin * (m.hi - m.lo) / 20) AS Bin_Start FROM range(20) AS s(Bin)
CROSS JOIN (SELECT min(Delay_Minutes) AS lo, max(Delay_Minutes) AS hi FROM flights) m LEFT JOIN (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((Delay_Minutes - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS Bin, lo, hi
  FROM flights, (SELECT min(Delay_Minutes) AS lo, max(Delay_Minutes) AS hi FROM flights) m WHERE Delay_Minutes IS NOT NULL) b ON s.Bin = b.Bin GROUP BY s.Bin""",
   ("Bin_Start",), ("Bin", "Count"))
def a43(spark, sf):
    return kpi.histogram(flights(spark, sf))


@q("a37_kpi_context", f"""SELECT 'summary' AS section, 'total_flights' AS key, CAST(count(*) AS DOUBLE) AS value FROM flights
UNION ALL SELECT 'summary', 'avg_delay', avg(Delay_Minutes) FROM flights
UNION ALL SELECT 'summary', 'delay_rate_pct', count_if(Delay_Minutes > 15) / count(*) * 100 FROM flights
UNION ALL SELECT 'summary', 'high_risk_flights', CAST(count_if(Delay_Minutes > 60) AS DOUBLE) FROM flights
UNION ALL SELECT 'hours', 'busiest_hour', CAST((SELECT Hour FROM ({H}) x ORDER BY Flight_Count DESC, Hour LIMIT 1) AS DOUBLE)
UNION ALL SELECT 'hours', 'best_hour', CAST((SELECT Hour FROM ({H}) x ORDER BY Avg_Delay ASC, Hour LIMIT 1) AS DOUBLE)
UNION ALL SELECT 'hours', 'worst_hour', CAST((SELECT Hour FROM ({H}) x ORDER BY Avg_Delay DESC, Hour LIMIT 1) AS DOUBLE)
UNION ALL SELECT * FROM (SELECT 'peak_hours', CAST(Hour AS VARCHAR), CAST(Flight_Count AS DOUBLE) FROM ({H}) x ORDER BY Flight_Count DESC, Hour LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'low_delay_hours', CAST(Hour AS VARCHAR), Avg_Delay FROM ({H}) x ORDER BY Avg_Delay ASC, Hour LIMIT 3)
UNION ALL SELECT 'airline_ranking', Airline, avg(Delay_Minutes) FROM flights GROUP BY Airline
UNION ALL SELECT 'runway_use', Runway, CAST(count(*) AS DOUBLE) FROM flights GROUP BY Runway
UNION ALL SELECT 'summary', 'total_delay_minutes', CAST(sum(Delay_Minutes) AS DOUBLE) FROM flights
UNION ALL SELECT 'summary', 'delayed_flights', CAST(count_if(Delay_Minutes > 0) AS DOUBLE) FROM flights
UNION ALL SELECT 'summary', 'first_day', CAST(strftime(min(Scheduled_Time), '%Y%m%d') AS DOUBLE) FROM flights
UNION ALL SELECT 'summary', 'last_day', CAST(strftime(max(Scheduled_Time), '%Y%m%d') AS DOUBLE) FROM flights
UNION ALL SELECT 'hours', 'busiest_hour_flights', CAST(max(Flight_Count) AS DOUBLE) FROM ({H}) x
UNION ALL SELECT 'airline_flights', Airline, CAST(count(*) AS DOUBLE) FROM flights GROUP BY Airline
UNION ALL SELECT 'runway_delay', Runway, avg(Delay_Minutes) FROM flights GROUP BY Runway
UNION ALL SELECT * FROM (SELECT 'best_airline', Airline, avg(Delay_Minutes) AS a FROM flights GROUP BY Airline ORDER BY a, Airline LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'worst_airline', Airline, avg(Delay_Minutes) AS a FROM flights GROUP BY Airline ORDER BY a DESC, Airline LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'most_efficient_runway', Runway, avg(Delay_Minutes) AS a FROM flights GROUP BY Runway ORDER BY a, Runway LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'busiest_runway', Runway, CAST(count(*) AS DOUBLE) AS n FROM flights GROUP BY Runway ORDER BY n DESC, Runway LIMIT 1)""", ("value",))
def a37(spark, sf):
    return kpi.kpi_context(flights(spark, sf))


@q("a38_data_summary", f"""SELECT count(*) AS total_flights, count_if(Delay_Minutes > 0) AS delayed_flights,
  count_if(Delay_Minutes > 0) / count(*) * 100 AS delayed_pct, avg(Delay_Minutes) AS avg_delay, max(Delay_Minutes) AS max_delay,
  count_if(Delay_Minutes <= 15) / count(*) * 100 AS on_time_rate, count_if(Delay_Minutes > 60) / count(*) * 100 AS severe_delay_rate,
  count_if(Delay_Minutes > 120) AS over_2h,
  (SELECT avg(n) FROM (SELECT count(*) AS n FROM flights GROUP BY Runway)) AS runway_mean_flights,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM flights GROUP BY Runway)) AS runway_max_flights,
  (SELECT max(Avg_Delay) FROM ({H}) x) AS peak_hour_max_delay,
  (SELECT avg(m) FROM (SELECT Date, avg(Delay_Minutes) AS m FROM flights GROUP BY Date ORDER BY Date DESC LIMIT 3)) AS recent_trend,
  CAST(min(Date) AS VARCHAR) AS first_date, CAST(max(Date) AS VARCHAR) AS last_date,
  (SELECT Hour FROM ({H}) x ORDER BY Avg_Delay DESC, Hour LIMIT 1) AS worst_hour, (SELECT Hour FROM ({H}) x ORDER BY Avg_Delay, Hour LIMIT 1) AS best_hour,
  (SELECT min(Avg_Delay) FROM ({H}) x) AS best_hour_delay,
  (SELECT Airline FROM ({A}) x ORDER BY a DESC, Airline LIMIT 1) AS worst_airline, (SELECT max(a) FROM ({A}) x) AS worst_airline_delay,
  (SELECT Airline FROM ({A}) x ORDER BY a, Airline LIMIT 1) AS best_airline, (SELECT min(a) FROM ({A}) x) AS best_airline_delay,
  (SELECT string_agg(Airline || ':' || n, ', ' ORDER BY n DESC, Airline) FROM (SELECT * FROM ({A}) x ORDER BY n DESC, Airline LIMIT 5)) AS top_airlines
FROM flights""", ("best_hour_delay", "worst_airline_delay", "best_airline_delay", "delayed_pct", "avg_delay", "max_delay", "on_time_rate", "severe_delay_rate", "runway_mean_flights", "peak_hour_max_delay",
                  "recent_trend"), ("total_flights", "delayed_flights", "over_2h", "runway_max_flights", "worst_hour", "best_hour"))
def a38(spark, sf):
    return kpi.data_summary(flights(spark, sf))


@q("a38b_top_delayed_routes", """SELECT Origin, Destination, avg(Delay_Minutes) AS Avg_Delay FROM flights GROUP BY Origin, Destination
ORDER BY Avg_Delay DESC, Origin, Destination LIMIT 5""", ("Avg_Delay",))
def a38b(spark, sf):
    return kpi.top_delayed_routes(flights(spark, sf))


@q("a38c_operational_issues", """SELECT * FROM (
  SELECT 'high_delay_rate' AS issue, count_if(Delay_Minutes > 15) / count(*) AS value, count_if(Delay_Minutes > 15) / count(*) > 0.3 AS hit FROM flights
  UNION ALL SELECT 'runway_imbalance', CAST(max(n) AS DOUBLE), max(n) > avg(n) * 2 FROM (SELECT count(*) AS n FROM flights GROUP BY Runway)
  UNION ALL SELECT 'severe_delays', CAST(count_if(Delay_Minutes > 120) AS DOUBLE), count_if(Delay_Minutes > 120) > 0 FROM flights) x
WHERE hit""".replace("SELECT * FROM (", "SELECT issue, value FROM ("), ("value",))
def a38c(spark, sf):
    return kpi.operational_issues(flights(spark, sf))


A50_CTE = f"""recs AS (
  SELECT 1 AS priority, 'redistribute_peak_hours' AS rule, string_agg(CAST(Hour AS VARCHAR), ', ' ORDER BY CAST(Hour AS VARCHAR)) AS detail
  FROM ({H}) h WHERE Flight_Count > 1.2 * (SELECT avg(Flight_Count) FROM ({H}) x) HAVING count(*) > 0
  UNION ALL SELECT 2, 'increase_buffer_times', printf('%.1f', count_if(Delay_Minutes > 0) / count(*) * 100) FROM flights
    HAVING count_if(Delay_Minutes > 0) / count(*) * 100 > 30
  UNION ALL SELECT 3, 'high_runway_utilization', string_agg(Runway, ', ' ORDER BY Runway) FROM (
    SELECT Runway, count(*) / max(count(*)) OVER () * 100 AS u FROM flights GROUP BY Runway) r WHERE u > 80 HAVING count(*) > 0)"""


@q("a50_basic_recommendations", """SELECT * FROM recs
UNION ALL SELECT 4, 'no_major_issues', 'schedule appears well optimized' WHERE NOT EXISTS (SELECT 1 FROM recs)""", (), ("priority",),
   extra_ctes=(A50_CTE,))
def a50(spark, sf):
    return kpi.basic_recommendations(flights(spark, sf))


DELAY_ACTIONS_SQL = "\nUNION ALL ".join(
    f"SELECT 1 AS priority, '{level}: {a}' AS rule, printf('%.1f', avg(Delay_Minutes)) AS detail FROM flights HAVING avg(Delay_Minutes) {when}"
    for when, (_, level, actions) in zip(("> 20", "> 10 AND avg(Delay_Minutes) <= 20", "<= 10"), kpi.PERFORMANCE_ACTIONS) for a in actions)


@q("a50c_performance_recommendations", f"""{DELAY_ACTIONS_SQL}
UNION ALL SELECT 2, 'balance runway utilization', printf('%.1f', stddev_samp(n)) FROM (SELECT count(*) AS n FROM flights GROUP BY Runway) r
  HAVING stddev_samp(n) > avg(n) * 0.3
UNION ALL SELECT * FROM (SELECT 3, 'move flights out of the peak hour', CAST(Hour AS VARCHAR) FROM ({H}) x
  WHERE (SELECT max(Flight_Count) > avg(Flight_Count) * 1.5 FROM ({H}) y) ORDER BY Flight_Count DESC, Hour LIMIT 1)
UNION ALL SELECT * FROM (SELECT 4, 'peak congestion hour', CAST(Hour AS VARCHAR) FROM ({H}) x ORDER BY Flight_Count DESC, Hour LIMIT 1)
UNION ALL SELECT * FROM (SELECT 4, 'best hour for critical flights', CAST(Hour AS VARCHAR) FROM ({H}) x ORDER BY Avg_Delay, Hour LIMIT 1)
UNION ALL SELECT * FROM (SELECT 5, 'share best practices of', Airline FROM ({A}) x ORDER BY a, Airline LIMIT 1)
UNION ALL SELECT * FROM (SELECT 5, 'support operations of', Airline FROM ({A}) x ORDER BY a DESC, Airline LIMIT 1)""", (), ("priority",))
def a50c(spark, sf):
    return kpi.performance_recommendations(flights(spark, sf))


@q("a06b_congestion_summary", """SELECT count_if(Peak_Category = 'super_peak') AS Super_Peak_Flights,
  count_if(Peak_Category = 'super_peak') / count(*) * 100 AS Super_Peak_Pct, avg(Congestion_Factor) AS Avg_Congestion,
  avg(CASE WHEN Peak_Category = 'super_peak' THEN Delay_Minutes END) AS Super_Peak_Avg_Delay, avg(Runway_Efficiency) AS Avg_Runway_Efficiency,
  count_if(Congestion_Factor > 1.5) AS High_Congestion_Flights, count_if(Congestion_Factor > 1.5) / count(*) * 100 AS High_Congestion_Pct FROM flights""",
   ("Super_Peak_Pct", "Avg_Congestion", "Super_Peak_Avg_Delay", "Avg_Runway_Efficiency", "High_Congestion_Pct"),
   ("Super_Peak_Flights", "High_Congestion_Flights"))
def a06b(spark, sf):
    return kpi.congestion_summary(flights(spark, sf))
