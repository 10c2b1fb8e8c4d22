"""Registered queries for scheduling, weather and revenue operators (O*, A44-A48)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import dims
from tarmac.operators import joins as J
from tarmac.operators import schedule as O
from tarmac.plans.catalog import register
from tarmac.plans.sql_views import _q, with_views
from tarmac.sources.fixtures import flights, weather

# at sf0.01 the default runway capacities never bind; the driver's fixture notes use 6 per runway-hour
TIGHT_CAPACITY = {r: 6 for r in dims.RUNWAYS_GREEDY}


def _case(col: str, mapping: dict, default) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + f" ELSE {_q(default)} END"


@register("o01_greedy_reslot", bench=True)
def o01(spark, sf):
    """Greedy re-slotting per airport x time island (rows-only; capacity invariant in pytest)."""
    return O.greedy_reslot(flights(spark, sf), TIGHT_CAPACITY)


@register("o02_optimised_delay")
def o02(spark, sf):
    f = flights(spark, sf)
    return O.optimised_delay(f, O.greedy_reslot(f, TIGHT_CAPACITY)).select(
        "Flight_ID", "Optimized_Time", "Optimized_Runway", "Optimized_Delay", "Optimization_Score")


@register("a46_optimisation_totals")
def a46(spark, sf):
    f = flights(spark, sf)
    return O.optimisation_totals(O.optimised_delay(f, O.greedy_reslot(f, TIGHT_CAPACITY)))


PEAKM = _case("Peak_Category", O.SLOT_PEAK_MULTIPLIER, 1.0)


@register("o03_slot_costs", sql=with_views(f"""SELECT Flight_ID, k AS Slot_Offset,
  make_timestamp(CAST(ceil(epoch_us(Scheduled_Time) / 900000000 - 0.5) * 900000000 + k * 900000000 AS BIGINT)) AS Slot_Time,
  CASE WHEN k = 0 THEN 0 ELSE CAST(trunc(abs(k) * Congestion_Factor * {PEAKM} * CASE WHEN Is_High_Impact THEN 2.5 ELSE 1.0 END
    * (1.0 / Runway_Efficiency)) AS BIGINT) END AS Cost
FROM flights CROSS JOIN range(-4, 5) AS r(k)"""), ints=("Slot_Offset", "Cost"))
def o03(spark, sf):
    return O.slot_costs(flights(spark, sf), 4)


@register("o04_audit_schedule", sql=with_views(f"""SELECT 'runway_capacity' AS Violation, Runway || '@' || CAST(h AS VARCHAR) AS Key, CAST(n AS DOUBLE) AS Value
FROM (SELECT Runway, date_trunc('hour', Scheduled_Time) AS h, count(*) AS n FROM flights GROUP BY 1, 2) x
WHERE n > {_case('Runway', TIGHT_CAPACITY, 1 << 30)}
UNION ALL SELECT 'turnaround', Flight_ID, gap FROM (SELECT Flight_ID, (epoch_us(Scheduled_Time) - epoch_us(lag(Scheduled_Time) OVER
  (PARTITION BY Aircraft_ID ORDER BY Scheduled_Time, Flight_ID))) / 60000000.0::DOUBLE AS gap FROM flights) g WHERE gap < 45
UNION ALL SELECT 'assignment', Flight_ID, CAST(count(*) AS DOUBLE) FROM flights GROUP BY Flight_ID HAVING count(*) <> 1"""),
          floats=("Value",))
def o04(spark, sf):
    return O.audit_schedule(flights(spark, sf), TIGHT_CAPACITY)


@register("o04b_audit_greedy_result")
def o04b(spark, sf):
    """Audit of the re-slotted schedule: every kind of violation."""
    f = flights(spark, sf)
    asg = O.greedy_reslot(f, TIGHT_CAPACITY)
    sched = f.drop("Runway", "Scheduled_Time").join(asg, "Flight_ID").withColumnRenamed("Optimized_Runway", "Runway")
    cap = {r: int(c * 0.85) for r, c in TIGHT_CAPACITY.items()}
    return O.audit_schedule(sched, cap, t="Optimized_Time")


def _suit_sql() -> str:
    rows = []
    for r, (length, _w, _m, cats) in dims.RUNWAYS_ALLOC.items():
        rows.append(f"({_q(r)}, {length}, [{', '.join(_q(c) for c in cats)}])")
    ac = []
    for m, (cat, mn, pref) in dims.AIRCRAFT_ALLOC.items():
        ac.append(f"({_q(m)}, {_q(cat)}, {mn}, [{', '.join(_q(p) for p in pref)}])")
    return f"""SELECT f.Flight_ID, r.Runway, least(1.0, 0.5
  + CASE WHEN a.model IS NOT NULL AND r.length >= a.min_length THEN 0.2 ELSE 0.0 END
  + CASE WHEN a.model IS NOT NULL AND list_contains(a.pref, r.Runway) THEN 0.2 ELSE 0.0 END
  + CASE WHEN list_contains(r.cats, coalesce(a.category, CASE WHEN regexp_matches(upper(f.Aircraft_Type), '777|787|330|350|747|380') THEN 'Heavy'
      WHEN regexp_matches(upper(f.Aircraft_Type), 'ATR|Q400|CRJ|ERJ') THEN 'Light' ELSE 'Medium' END)) THEN 0.1 ELSE 0.0 END) AS Suitability
FROM flights f LEFT JOIN (VALUES {', '.join(ac)}) AS a(model, category, min_length, pref) ON f.Aircraft_Type = a.model
CROSS JOIN (VALUES {', '.join(rows)}) AS r(Runway, length, cats)"""


@register("o05_suitability", sql=with_views(_suit_sql()), floats=("Suitability",))
def o05(spark, sf):
    return O.suitability(flights(spark, sf))


@register("o06_slot_grid", sql=with_views("""SELECT r.Runway, s.Slot_Start FROM (VALUES ('09R/27L'), ('09L/27R'), ('14/32'), ('27/09')) AS r(Runway)
CROSS JOIN (SELECT unnest(generate_series(date_trunc('hour', min(Scheduled_Time)), date_trunc('hour', max(Scheduled_Time)) + INTERVAL 2 HOUR,
  INTERVAL 15 MINUTE)) AS Slot_Start FROM flights) s"""))
def o06(spark, sf):
    f = flights(spark, sf)
    b = f.agg(F.date_trunc("hour", F.min("Scheduled_Time")).cast("timestamp_ntz").alias("a"),
              (F.date_trunc("hour", F.max("Scheduled_Time")) + F.expr("INTERVAL 2 HOURS")).cast("timestamp_ntz").alias("b"))
    rw = spark.createDataFrame([(r,) for r in dims.RUNWAYS_ALLOC], "Runway string")
    slots = b.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 15 MINUTES"))).alias("Slot_Start"))
    return rw.crossJoin(slots)


@register("o07_allocate_runways")
def o07(spark, sf):
    """Runway/slot allocation per airport x time island (rows-only; slot exclusivity in pytest)."""
    return O.allocate_runways(flights(spark, sf))


@register("a47_runway_efficiency")
def a47(spark, sf):
    f = flights(spark, sf)
    return O.runway_efficiency(O.allocate_runways(f), f)


def _fw(spark, sf):
    return J.join_weather(flights(spark, sf), weather(spark, sf))


FW_SQL = """fw AS (SELECT f.*, coalesce(w.Weather_Condition, 'Clear') AS Weather_Condition,
  coalesce(w.Capacity_Reduction_Factor, 1.0) AS Capacity_Reduction_Factor, coalesce(w.Landing_Restrictions, FALSE) AS Landing_Restrictions,
  coalesce(w.Takeoff_Restrictions, FALSE) AS Takeoff_Restrictions, coalesce(w.Crosswind_Runway_Closure, FALSE) AS Crosswind_Runway_Closure
FROM flights f LEFT JOIN weather w ON date_trunc('hour', f.Scheduled_Time) = date_trunc('hour', w.Datetime))"""

RESCHED_SQL = [FW_SQL, f"""fr AS (SELECT *, hour(Scheduled_Time) AS Current_Hour,
  {_case('Weather_Condition', {'Clear': 1.0, 'Light Rain': 1.2, 'Heavy Rain': 1.8, 'Fog': 2.0, 'Storm': 3.0, 'Snow': 2.5}, 1.0)} AS Weather_Impact_Factor,
  {_case('Runway', {'R1': 35, 'R2': 30, 'R3': 25, 'R4': 20, '09R/27L': 35, '09L/27R': 30, '14/32': 25}, 30)} AS App_Runway_Capacity FROM fw)""",
               """fu AS (SELECT *, Delay_Minutes * Weather_Impact_Factor AS Weather_Adjusted_Delay,
  count(*) OVER (PARTITION BY Runway, Current_Hour) AS Current_Usage,
  count(*) OVER (PARTITION BY Runway, Current_Hour) / App_Runway_Capacity * 100 AS Runway_Utilization_Pct FROM fr)""",
               f"""bh AS (SELECT Runway, coalesce(min(CASE WHEN util < 70 THEN Hour END ORDER BY util, Hour),
    arg_min(Hour, usage * 100 + Hour)) AS Best_Hour, min(CASE WHEN util < 70 THEN util END) AS Recommended_Runway_Util FROM (
  SELECT r.Runway, h.Hour, coalesce(u.n, 0) AS usage, coalesce(u.n, 0) / {_case('r.Runway', {'R1': 35, 'R2': 30, 'R3': 25, 'R4': 20, '09R/27L': 35, '09L/27R': 30, '14/32': 25}, 30)} * 100 AS util
  FROM (SELECT DISTINCT Runway FROM fw) r CROSS JOIN (SELECT unnest([6, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 22]) AS Hour) h
  LEFT JOIN (SELECT Runway, hour(Scheduled_Time) AS Hour, count(*) AS n FROM fw GROUP BY 1, 2) u ON r.Runway = u.Runway AND h.Hour = u.Hour) x
  GROUP BY Runway)"""]


@register("o08_needs_reschedule", sql=with_views("""SELECT Flight_ID, Weather_Impact_Factor, Weather_Adjusted_Delay, Current_Usage, Runway_Utilization_Pct,
  (Weather_Adjusted_Delay > 30 OR Runway_Utilization_Pct > 85 OR Delay_Minutes > 45) AS Needs_Reschedule FROM fu""", *RESCHED_SQL, weather=True),
          floats=("Weather_Impact_Factor", "Weather_Adjusted_Delay", "Runway_Utilization_Pct"), ints=("Current_Usage",))
def o08(spark, sf):
    return O.needs_reschedule(_fw(spark, sf)).select(
        "Flight_ID", "Weather_Impact_Factor", "Weather_Adjusted_Delay", "Current_Usage", "Runway_Utilization_Pct", "Needs_Reschedule")


@register("o09_best_hour", sql=with_views("SELECT Runway, Best_Hour, Recommended_Runway_Util FROM bh", *RESCHED_SQL, weather=True),
          floats=("Recommended_Runway_Util",), ints=("Best_Hour",))
def o09(spark, sf):
    return O.best_hour(_fw(spark, sf))


O10_SQL = """SELECT u.Flight_ID, u.Airline, format('{:02d}:00', u.Current_Hour) AS Current_Time,
  format('{:02d}:00', b.Best_Hour) AS Recommended_Time, u.Runway AS Current_Runway, u.Delay_Minutes AS Current_Delay, u.Weather_Condition,
  u.Weather_Impact_Factor AS Weather_Impact, u.Runway_Utilization_Pct AS Current_Runway_Util, b.Recommended_Runway_Util,
  least(u.Delay_Minutes * 0.3 + abs(b.Best_Hour - u.Current_Hour) * 2 * CASE WHEN u.Weather_Condition IN ('Heavy Rain','Storm','Fog') THEN 0.8 ELSE 1.0 END
    + greatest(0.0, (u.Runway_Utilization_Pct - 70) / 100) * 20, u.Delay_Minutes) AS Expected_Delay_Reduction,
  CASE WHEN u.Delay_Minutes > 60 THEN 'High' WHEN u.Delay_Minutes > 30 THEN 'Medium' ELSE 'Low' END AS Priority,
  coalesce(nullif(array_to_string(list_filter([
    CASE WHEN u.Weather_Impact_Factor > 1.5 THEN 'Weather impact (' || u.Weather_Condition || ')' END,
    CASE WHEN u.Runway_Utilization_Pct > 85 THEN 'Runway overcapacity (' || printf('%.1f', u.Runway_Utilization_Pct) || '%)' END,
    CASE WHEN u.Delay_Minutes > 45 THEN 'High delay (' || printf('%.0f', u.Delay_Minutes) || ' min)' END,
    CASE WHEN abs(b.Best_Hour - u.Current_Hour) > 2 THEN 'Peak hour avoidance' END], lambda x: x IS NOT NULL), '; '), ''), 'General optimization') AS Reason
FROM fu u LEFT JOIN bh b ON u.Runway = b.Runway
WHERE u.Weather_Adjusted_Delay > 30 OR u.Runway_Utilization_Pct > 85 OR u.Delay_Minutes > 45"""


@register("o10_reschedule_plan", sql=with_views(O10_SQL, *RESCHED_SQL, weather=True),
          floats=("Current_Delay", "Weather_Impact", "Current_Runway_Util", "Recommended_Runway_Util", "Expected_Delay_Reduction"))
def o10(spark, sf):
    return O.reschedule_plan(_fw(spark, sf))


PLAN_SQL = [*RESCHED_SQL, f"pl AS ({O10_SQL})", """ap AS (SELECT f.Flight_ID, f.Hour, f.Delay_Minutes, p.Flight_ID IS NOT NULL AS Rescheduled,
  coalesce(CAST(substr(p.Recommended_Time, 1, 2) AS BIGINT), f.Hour) AS Optimized_Hour,
  CASE WHEN p.Flight_ID IS NULL THEN f.Delay_Minutes * 0.9 ELSE f.Delay_Minutes - p.Expected_Delay_Reduction END AS Optimized_Delay
FROM flights f LEFT JOIN pl p ON f.Flight_ID = p.Flight_ID)"""]


@register("o10b_apply_plan", sql=with_views("SELECT Flight_ID, Rescheduled, Optimized_Hour, Optimized_Delay FROM ap", *PLAN_SQL, weather=True),
          floats=("Optimized_Delay",), ints=("Optimized_Hour",))
def o10b(spark, sf):
    f = flights(spark, sf)
    return O.apply_plan(f, O.reschedule_plan(_fw(spark, sf))).select("Flight_ID", "Rescheduled", "Optimized_Hour", "Optimized_Delay")


@register("o10c_before_after", sql=with_views("""SELECT avg(Delay_Minutes) AS mean_before, avg(Optimized_Delay) AS mean_after, max(Delay_Minutes) AS max_before,
  max(Optimized_Delay) AS max_after, count_if(Delay_Minutes > 15) AS delayed_before, count_if(Optimized_Delay > 15) AS delayed_after,
  sum(Delay_Minutes) AS total_before, sum(Optimized_Delay) AS total_after, count_if(Rescheduled) AS rescheduled FROM ap""", *PLAN_SQL, weather=True),
          floats=("mean_before", "mean_after", "max_before", "max_after", "total_before", "total_after"), ints=("delayed_before", "delayed_after", "rescheduled"))
def o10c(spark, sf):
    return O.before_after(O.apply_plan(flights(spark, sf), O.reschedule_plan(_fw(spark, sf))))


@register("o10d_hourly_before_after", sql=with_views("""SELECT h.Hour, coalesce(a.n, 0) AS flights_before, a.d AS delay_before, coalesce(b.n, 0) AS flights_after, b.d AS delay_after
FROM range(24) AS h(Hour) LEFT JOIN (SELECT Hour, count(*) AS n, avg(Delay_Minutes) AS d FROM ap GROUP BY 1) a ON h.Hour = a.Hour
LEFT JOIN (SELECT Optimized_Hour AS Hour, count(*) AS n, avg(Optimized_Delay) AS d FROM ap GROUP BY 1) b ON h.Hour = b.Hour""", *PLAN_SQL, weather=True),
          floats=("delay_before", "delay_after"), ints=("Hour", "flights_before", "flights_after"))
def o10d(spark, sf):
    return O.hourly_before_after(O.apply_plan(flights(spark, sf), O.reschedule_plan(_fw(spark, sf))))


@register("a45_reschedule_summary", sql=with_views("""SELECT Weather_Condition, count(*) AS Flights,
  avg(least(u.Delay_Minutes * 0.3 + abs(b.Best_Hour - u.Current_Hour) * 2 * CASE WHEN u.Weather_Condition IN ('Heavy Rain','Storm','Fog') THEN 0.8 ELSE 1.0 END
    + greatest(0.0, (u.Runway_Utilization_Pct - 70) / 100) * 20, u.Delay_Minutes)) AS Avg_Reduction, avg(Weather_Impact_Factor) AS Avg_Weather_Factor
FROM fu u LEFT JOIN bh b ON u.Runway = b.Runway
WHERE u.Weather_Adjusted_Delay > 30 OR u.Runway_Utilization_Pct > 85 OR u.Delay_Minutes > 45 GROUP BY Weather_Condition""", *RESCHED_SQL, weather=True),
          floats=("Avg_Reduction", "Avg_Weather_Factor"), ints=("Flights",))
def a45(spark, sf):
    return O.reschedule_summary(O.reschedule_plan(_fw(spark, sf)))


def _sens(i):
    return _case("Runway", {k: v[i] for k, v in dims.RUNWAY_SENSITIVITY.items()}, 1.0)


WCAP_SQL = f"""wc AS (SELECT *, greatest(CAST(trunc(Runway_Capacity * CASE WHEN r2 < 0.7 THEN r2 * {_sens(3)} ELSE r2 END) AS INTEGER), 5)
  AS Weather_Adjusted_Runway_Capacity FROM (SELECT *, CASE WHEN contains(Weather_Condition, 'Rain') THEN Capacity_Reduction_Factor * (2.0 - {_sens(1)})
  WHEN contains(Weather_Condition, 'Fog') THEN Capacity_Reduction_Factor * (2.0 - {_sens(2)})
  WHEN contains(Weather_Condition, 'Wind') THEN Capacity_Reduction_Factor * (2.0 - {_sens(0)}) ELSE Capacity_Reduction_Factor END AS r2 FROM fw) a)"""
WDEL_SQL = f"""wd AS (SELECT *, Delay_Minutes + wdm AS Total_Delay_Minutes, (Runway = '14/32' AND Crosswind_Runway_Closure) AS Needs_Runway_Reassignment
FROM (SELECT *, {_case('Weather_Condition', {k: v[7] for k, v in dims.WEATHER.items()}, 0.0)} * 1.0
  * CASE WHEN Landing_Restrictions OR Takeoff_Restrictions THEN 1.5 ELSE 1.0 END AS wdm FROM wc) b)"""


@register("o11_weather_capacity", sql=with_views("SELECT Flight_ID, Weather_Condition, Weather_Adjusted_Runway_Capacity FROM wc", FW_SQL, WCAP_SQL, weather=True),
          ints=("Weather_Adjusted_Runway_Capacity",))
def o11(spark, sf):
    return O.weather_capacity(_fw(spark, sf)).select("Flight_ID", "Weather_Condition", "Weather_Adjusted_Runway_Capacity")


@register("o12_weather_delay", sql=with_views("""SELECT Flight_ID, wdm AS Weather_Delay_Minutes, Total_Delay_Minutes, Needs_Runway_Reassignment FROM wd""",
                                              FW_SQL, WCAP_SQL, WDEL_SQL, weather=True), floats=("Weather_Delay_Minutes", "Total_Delay_Minutes"))
def o12(spark, sf):
    return O.weather_delay(O.weather_capacity(_fw(spark, sf))).select(
        "Flight_ID", "Weather_Delay_Minutes", "Total_Delay_Minutes", "Needs_Runway_Reassignment")


@register("a44_weather_impact", sql=with_views("""SELECT count(*) AS Total_Flights, count_if(Weather_Condition <> 'Clear') AS Weather_Affected,
  count_if(Weather_Condition <> 'Clear') / count(*) * 100 AS Affected_Pct, 1 - avg(Capacity_Reduction_Factor) AS Avg_Capacity_Loss,
  sum(wdm) AS Total_Weather_Delay, avg(wdm) AS Avg_Weather_Delay, count_if(Crosswind_Runway_Closure) AS Closure_Flights,
  count_if(Needs_Runway_Reassignment) AS Reassignments FROM wd""", FW_SQL, WCAP_SQL, WDEL_SQL, weather=True),
          floats=("Affected_Pct", "Avg_Capacity_Loss", "Total_Weather_Delay", "Avg_Weather_Delay"),
          ints=("Total_Flights", "Weather_Affected", "Closure_Flights", "Reassignments"))
def a44(spark, sf):
    return O.weather_impact_analysis(O.weather_delay(O.weather_capacity(_fw(spark, sf))))


@register("a44b_weather_distribution", sql=with_views("SELECT Weather_Condition, count(*) AS Flights FROM wd GROUP BY Weather_Condition", FW_SQL, WCAP_SQL, WDEL_SQL, weather=True), ints=("Flights",))
def a44b(spark, sf):
    return O.weather_distribution(O.weather_delay(O.weather_capacity(_fw(spark, sf))))


@register("a44c_weather_hourly_impact", sql=with_views("""SELECT Hour, avg(wdm) AS Avg_Weather_Delay, avg(Capacity_Reduction_Factor) AS Avg_Capacity_Factor,
  count_if(Weather_Condition <> 'Clear') AS Affected_Flights FROM wd GROUP BY Hour""", FW_SQL, WCAP_SQL, WDEL_SQL, weather=True),
          floats=("Avg_Weather_Delay", "Avg_Capacity_Factor"), ints=("Hour", "Affected_Flights"))
def a44c(spark, sf):
    return O.weather_hourly_impact(O.weather_delay(O.weather_capacity(_fw(spark, sf))))


def _rev_sql(hour: str, peak: str) -> str:
    rh = dims.REVENUE_HOURS
    dem = _case(hour, {h: v[0] for h, v in rh.items()}, rh[12][0])
    mul = _case(hour, {h: v[1] for h, v in rh.items()}, rh[12][1])
    br = _case(hour, {h: v[3] for h, v in rh.items()}, rh[12][3])
    price = f"({_case('Destination_Priority', dims.BASE_PRICES, None)} * {mul} * (1 + {_case(peak, dims.PEAK_PREMIUMS, None)}))"
    load = f"least(0.95, 0.75 * {dem})"
    return (f"(Capacity * {load} * (1 - {br} * 0.15) * {price} + Capacity * {load} * ({br} * 0.15) * {price} * 2.8)")


@register("o13_flight_revenue", sql=with_views(f"SELECT Flight_ID, {_rev_sql('Hour', 'Peak_Category')} AS Current_Revenue FROM flights"),
          floats=("Current_Revenue",))
def o13(spark, sf):
    return O.flight_revenue(flights(spark, sf)).select("Flight_ID", "Current_Revenue")


def _moves_sql() -> str:
    cur = _rev_sql("Hour", "Peak_Category")
    expr_h, expr_r = "CAST(NULL AS INTEGER)", cur
    for h in O.REVENUE_ALT_HOURS:
        alt = _rev_sql(str(h), "'super_peak'")
        take = f"(Hour <> {h} AND {alt} > ({expr_r}) * 1.05)"
        expr_h, expr_r = f"CASE WHEN {take} THEN {h} ELSE {expr_h} END", f"CASE WHEN {take} THEN {alt} ELSE {expr_r} END"
    return f"""SELECT Flight_ID, Hour AS Current_Hour, rh AS Recommended_Hour, cr AS Current_Revenue, pr AS Projected_Revenue,
  pr - cr AS Revenue_Increase, (pr - cr) / cr * 100 AS Percentage_Increase FROM (
  SELECT Flight_ID, Hour, {cur} AS cr, {expr_h} AS rh, {expr_r} AS pr FROM flights) x WHERE rh IS NOT NULL"""


@register("o14_revenue_moves", sql=with_views(_moves_sql()),
          floats=("Current_Revenue", "Projected_Revenue", "Revenue_Increase", "Percentage_Increase"), ints=("Current_Hour", "Recommended_Hour"))
def o14(spark, sf):
    return O.revenue_moves(flights(spark, sf))


@register("a48_revenue_by_hour", sql=with_views(f"""SELECT Hour, sum(r) AS Total_Revenue, avg(r) AS Avg_Revenue, sum(r) / sum(Capacity) AS Revenue_per_Seat,
  count(*) AS Flights FROM (SELECT Hour, Capacity, {_rev_sql('Hour', 'Peak_Category')} AS r FROM flights) x GROUP BY Hour"""),
          floats=("Total_Revenue", "Avg_Revenue", "Revenue_per_Seat"), ints=("Hour", "Flights"))
def a48(spark, sf):
    return O.revenue_by_hour(flights(spark, sf))


@register("a48b_revenue_consolidation", sql=with_views(f"""SELECT sp AS current_super_peak_flights, n AS total_flights, s AS current_total_revenue,
  m * 0.6 * a * 0.6 AS potential_additional_revenue, sp / n * 100 AS peak_utilization_percentage, m * 0.6 * a * 0.6 / s * 100 AS revenue_increase_percentage
FROM (SELECT count_if(Hour IN (7, 8, 19, 20)) AS sp, count(*) AS n, sum(r) AS s, avg(r) AS a, count_if(Hour NOT IN (7, 8, 19, 20, 6, 9, 18, 21)) AS m
  FROM (SELECT Hour, {_rev_sql('Hour', 'Peak_Category')} AS r FROM flights) x) y"""),
          floats=("current_total_revenue", "potential_additional_revenue", "peak_utilization_percentage", "revenue_increase_percentage"),
          ints=("current_super_peak_flights", "total_flights"))
def a48b(spark, sf):
    return O.revenue_consolidation(flights(spark, sf))


@register("a50c_weather_recommendations", sql=with_views("""SELECT 'Weather Alert' AS type, Hour, arg_min(Weather_Condition, epoch_us(Scheduled_Time)) AS condition,
  count(*) AS affected_flights, (1 - avg(Capacity_Reduction_Factor)) * 100 AS capacity_reduction_pct, NULL::VARCHAR AS detail
FROM wd WHERE Capacity_Reduction_Factor < 0.7 GROUP BY Hour
UNION ALL SELECT 'Runway Reassignment', NULL, NULL, count_if(Needs_Runway_Reassignment), NULL, '09R/27L, 09L/27R' FROM wd
  HAVING count_if(Needs_Runway_Reassignment) > 0
UNION ALL SELECT 'Schedule Optimization', NULL, NULL, NULL, NULL, string_agg(CAST(Hour AS VARCHAR), ', ' ORDER BY Hour) FROM (
  SELECT Hour, sum(wdm) AS d FROM wd GROUP BY Hour) h WHERE d > (SELECT quantile_cont(d, 0.8) FROM (SELECT sum(wdm) AS d FROM wd GROUP BY Hour))
  HAVING count(*) > 0""", FW_SQL, WCAP_SQL, WDEL_SQL, weather=True), floats=("capacity_reduction_pct",), ints=("Hour", "affected_flights"))
def a50c(spark, sf):
    return O.weather_recommendations(O.weather_delay(O.weather_capacity(_fw(spark, sf))))
