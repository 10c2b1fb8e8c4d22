"""DuckDB-dialect CTEs for the oracle side: the same fixture mapping as
``tarmac.sources.fixtures`` written independently in SQL over the
pre-registered tables (FIXTURES.md §2)."""

from __future__ import annotations

from tarmac import dims


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return repr(v) + "::DOUBLE"
    return str(v)


def _lst(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _case_in(col: str, mapping: dict[str, list], default: str) -> str:
    parts = [f"WHEN {col} IN ({', '.join(map(str, hours))}) THEN '{name}'" for name, hours in mapping.items()]
    return "CASE " + " ".join(parts) + f" ELSE '{default}' END"


def flights_cte() -> str:
    ap = dims.AIRPORT_ORDER
    ac = dims.AIRCRAFT_FIXTURE
    rw = dims.RUNWAY_ORDER
    peak = {k: dims.PEAK_PATTERNS[k] for k in ["super_peak", "peak", "moderate"]}
    return f"""flights AS (
  SELECT *,
    hour(Scheduled_Time)::INTEGER AS Hour,
    (isodow(Scheduled_Time) - 1)::INTEGER AS Day_of_Week,
    CAST(Scheduled_Time AS DATE) AS Date,
    {_case_in('hour(Scheduled_Time)', peak, 'low')} AS Peak_Category,
    Scheduled_Time + to_microseconds(CAST(round(Delay_Minutes * 60000000.0) AS BIGINT)) AS Actual_Time,
    hour(Scheduled_Time) IN ({', '.join(map(str, dims.GENERATOR_PEAK_HOURS))}) AS Is_Peak_Hour,
    (Destination IN ({', '.join(_q(a) for a in dims.MAJOR_DESTINATIONS)})
      OR Aircraft_Type IN ({', '.join(_q(a) for a in dims.LARGE_AIRCRAFT)})
      OR Capacity > 250) AS Is_High_Impact
  FROM (
    SELECT
      'FL' || CAST(event_id AS VARCHAR) AS Flight_ID,
      upper(substr(event_type, 1, 2)) || CAST(user_id % 40 AS VARCHAR) AS Airline,
      'AC' || CAST(user_id AS VARCHAR) AS Aircraft_ID,
      {_lst([a[0] for a in ac])}[(user_id % 9) + 1] AS Aircraft_Type,
      CAST({_lst([a[1] for a in ac])}[(user_id % 9) + 1] AS INTEGER) AS Capacity,
      CAST({_lst([a[2] for a in ac])}[(user_id % 9) + 1] AS INTEGER) AS Base_Turnaround,
      ts AS Scheduled_Time,
      greatest("value" - 20.0, 0.0) AS Delay_Minutes,
      {_lst(ap)}[((event_id * 7 + user_id) % 12) + 1] AS Origin,
      {_lst(ap)}[((event_id * 5 + 3) % 12) + 1] AS Destination,
      {_lst([dims.AIRPORTS[a][1] for a in ap])}[((event_id * 5 + 3) % 12) + 1] AS Destination_Priority,
      {_lst([dims.AIRPORTS[a][0] for a in ap])}[((event_id * 5 + 3) % 12) + 1] AS Congestion_Factor,
      {_lst(rw)}[(event_id % 3) + 1] AS Runway,
      CAST({_lst([dims.RUNWAYS_OPS[r][0] for r in rw])}[(event_id % 3) + 1] AS INTEGER) AS Runway_Capacity,
      {_lst([dims.RUNWAYS_OPS[r][1] for r in rw])}[(event_id % 3) + 1] AS Runway_Efficiency,
      (event_id % 97 = 0) AS is_emergency,
      (event_id % 5 = 0) AS is_international
    FROM events
  ) AS base
)"""


def weather_cte() -> str:
    w = [dims.WEATHER[c] for c in dims.WEATHER_ORDER]
    idx = "((h * 7 + h // 24) % 8) + 1"
    return f"""weather AS (
  SELECT Datetime, hour(Datetime)::INTEGER AS Hour,
    {_lst(dims.WEATHER_ORDER)}[{idx}] AS Weather_Condition,
    {_lst([x[0] for x in w])}[{idx}] AS Visibility_km,
    CAST({_lst([x[1] for x in w])}[{idx}] AS INTEGER) AS Wind_Speed_kts,
    {_lst([x[2] for x in w])}[{idx}] AS Precipitation_mm,
    {_lst([x[3] for x in w])}[{idx}] AS Capacity_Reduction_Factor,
    {_lst([x[4] for x in w])}[{idx}] AS Landing_Restrictions,
    {_lst([x[5] for x in w])}[{idx}] AS Takeoff_Restrictions,
    {_lst([x[6] for x in w])}[{idx}] AS Crosswind_Runway_Closure
  FROM (
    SELECT DISTINCT date_trunc('hour', ts) AS Datetime,
      CAST((epoch(date_trunc('hour', ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 3600 AS BIGINT) AS h
    FROM events
  ) AS hrs
)"""


def with_views(body: str, *extra_ctes: str, weather: bool = False) -> str:
    """``WITH flights AS (...)[, weather AS (...)][, extra...] <body>``."""
    ctes = [flights_cte()]
    if weather:
        ctes.append(weather_cte())
    ctes.extend(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body
