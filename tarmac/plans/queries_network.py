"""Registered queries for the delay-propagation network (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import network as G
from tarmac.plans.catalog import register
from tarmac.plans.queries_joins import HUBS_SQL
from tarmac.plans.sql_views import with_views
from tarmac.sources.fixtures import flights

US = "60000000.0::DOUBLE"

EDGE_CTES = [
    HUBS_SQL,
    f"""seq_a AS (SELECT Flight_ID, Destination, Scheduled_Time,
  lead(Flight_ID) OVER w AS nid, lead(Origin) OVER w AS norig, lead(Scheduled_Time) OVER w AS nt
  FROM flights WINDOW w AS (PARTITION BY Aircraft_ID ORDER BY Scheduled_Time, Flight_ID))""",
    f"""aircraft_e AS (SELECT Flight_ID AS src, nid AS dst, 'aircraft' AS connection_type,
  CASE WHEN b < 60 THEN 0.9 WHEN b < 120 THEN 0.7 WHEN b < 180 THEN 0.4 ELSE 0.1 END AS propagation_factor, b AS time_buffer
  FROM (SELECT *, (epoch_us(nt) - epoch_us(Scheduled_Time)) / {US} AS b FROM seq_a) x WHERE nid IS NOT NULL AND Destination = norig)""",
    f"""seq_c AS (SELECT Flight_ID, Scheduled_Time, lead(Flight_ID) OVER w AS nid, lead(Scheduled_Time) OVER w AS nt
  FROM flights WINDOW w AS (PARTITION BY Airline ORDER BY Scheduled_Time, Flight_ID))""",
    f"""crew_e AS (SELECT Flight_ID AS src, nid AS dst, 'crew' AS connection_type, 0.3 AS propagation_factor, b AS time_buffer
  FROM (SELECT *, (epoch_us(nt) - epoch_us(Scheduled_Time)) / {US} AS b FROM seq_c) x WHERE nid IS NOT NULL AND b BETWEEN 90 AND 480)""",
    f"""runway_e AS (SELECT a.Flight_ID AS src, b.Flight_ID AS dst, 'runway' AS connection_type, 0.6 AS propagation_factor,
  (epoch_us(b.Scheduled_Time) - epoch_us(a.Scheduled_Time)) / {US} AS time_buffer
  FROM flights a JOIN flights b ON a.Runway = b.Runway
   AND floor(epoch_us(a.Scheduled_Time) / 1800000000) = floor(epoch_us(b.Scheduled_Time) / 1800000000)
  WHERE (a.Scheduled_Time < b.Scheduled_Time OR (a.Scheduled_Time = b.Scheduled_Time AND a.Flight_ID < b.Flight_ID))
   AND epoch_us(b.Scheduled_Time) - epoch_us(a.Scheduled_Time) <= 1800000000)""",
    f"""passenger_e AS (SELECT a.Flight_ID AS src, d.Flight_ID AS dst, 'passenger' AS connection_type, 0.2 AS propagation_factor,
  (epoch_us(d.Scheduled_Time) - epoch_us(a.Scheduled_Time)) / {US} AS time_buffer
  FROM flights a JOIN flights d ON a.Destination = d.Origin WHERE a.Destination IN (SELECT hub FROM hubs)
   AND epoch_us(d.Scheduled_Time) - epoch_us(a.Scheduled_Time) BETWEEN 2700000000 AND 14400000000)""",
    """all_e AS (SELECT *, 1 AS prec FROM aircraft_e UNION ALL SELECT *, 2 FROM crew_e UNION ALL SELECT *, 3 FROM runway_e
  UNION ALL SELECT *, 4 FROM passenger_e)""",
    """net AS (SELECT src, dst, arg_max(connection_type, prec) AS connection_type, arg_max(propagation_factor, prec) AS propagation_factor,
  arg_max(time_buffer, prec) AS time_buffer FROM all_e GROUP BY src, dst)""",
]


def cascade_ctes(rounds: int = 5) -> list[str]:
    out = ["d0 AS (SELECT Flight_ID, Delay_Minutes AS delay FROM flights)"]
    for i in range(1, rounds + 1):
        p = "d.delay * e.propagation_factor"
        out.append(f"""i{i} AS (SELECT dst, max(p) AS inc FROM (SELECT e.dst,
  CASE WHEN e.time_buffer > {p} THEN greatest(0.0, {p} - e.time_buffer * 0.1) ELSE {p} END AS p
  FROM d{i - 1} d JOIN net e ON d.Flight_ID = e.src WHERE d.delay > 0) x WHERE p > 0 GROUP BY dst)""")
        out.append(f"d{i} AS (SELECT d.Flight_ID, d.delay + coalesce(i.inc, 0.0) AS delay FROM d{i - 1} d LEFT JOIN i{i} i ON d.Flight_ID = i.dst)")
    return out


EDGE_FLOATS = ("propagation_factor", "time_buffer")


@register("g01_vertices", sql=with_views("""SELECT Flight_ID, Airline, Aircraft_ID, Scheduled_Time, Origin, Destination, Delay_Minutes, Capacity, Runway
FROM flights"""), floats=("Delay_Minutes",), ints=("Capacity",))
def g01(spark, sf):
    return G.vertices(flights(spark, sf))


@register("g02_aircraft_edges", sql=with_views("SELECT * FROM aircraft_e", *EDGE_CTES), floats=EDGE_FLOATS)
def g02(spark, sf):
    return G.aircraft_edges(flights(spark, sf))


@register("g03_crew_edges", sql=with_views("SELECT * FROM crew_e", *EDGE_CTES), floats=EDGE_FLOATS)
def g03(spark, sf):
    return G.crew_edges(flights(spark, sf))


@register("g04_runway_edges", sql=with_views("SELECT * FROM runway_e", *EDGE_CTES), floats=EDGE_FLOATS)
def g04(spark, sf):
    return G.runway_edges(flights(spark, sf))


@register("g05_hubs", sql=with_views("SELECT hub FROM hubs", HUBS_SQL))
def g05(spark, sf):
    return G.hubs(flights(spark, sf))


@register("g06_passenger_edges", sql=with_views("SELECT * FROM passenger_e", *EDGE_CTES), floats=EDGE_FLOATS, bench=True)
def g06(spark, sf):
    return G.passenger_edges(flights(spark, sf))


@register("g07_build_network", sql=with_views("SELECT * FROM net", *EDGE_CTES), floats=EDGE_FLOATS)
def g07(spark, sf):
    return G.build_network(flights(spark, sf))


def _cascade(spark, sf):
    f = flights(spark, sf)
    net = G.build_network(f)
    init = f.select("Flight_ID", F.col("Delay_Minutes").alias("delay"))
    return f, init, G.simulate_cascade(net, init, f.select("Flight_ID"), 5)


@register("g08_cascade", sql=with_views("SELECT Flight_ID, delay FROM d5", *EDGE_CTES, *cascade_ctes()), floats=("delay",), bench=True)
def g08(spark, sf):
    return _cascade(spark, sf)[2]


@register("g08w_cascade_by_windows", sql=with_views("SELECT Flight_ID, delay FROM d5", *EDGE_CTES, *cascade_ctes()), floats=("delay",))
def g08w(spark, sf):
    """The same cascade from maxima over windows: no pair of the passenger and runway rules is made."""
    f = flights(spark, sf)
    return G.window_cascade(f, f.select("Flight_ID", F.col("Delay_Minutes").alias("delay")), max_iter=5)


@register("g09_cascade_impact", sql=with_views("""SELECT sum(d.delay) AS total_propagated_delay, count_if(d.delay > 0) AS affected_flights_count,
  count_if(d.delay > 0 AND d.delay <= 15) AS minor, count_if(d.delay > 15 AND d.delay <= 30) AS moderate, count_if(d.delay > 30) AS severe,
  sum(CASE WHEN d.delay > 0 THEN f.Capacity * d.delay END) / 60 AS estimated_passenger_delay_hours,
  (SELECT sum(Delay_Minutes) FROM flights) AS initial_delay_minutes,
  sum(d.delay) / (SELECT sum(Delay_Minutes) FROM flights) AS amplification_factor
FROM d5 d LEFT JOIN flights f ON d.Flight_ID = f.Flight_ID""", *EDGE_CTES, *cascade_ctes()),
          floats=("total_propagated_delay", "estimated_passenger_delay_hours", "initial_delay_minutes", "amplification_factor"),
          ints=("affected_flights_count", "minor", "moderate", "severe"))
def g09(spark, sf):
    f, init, fin = _cascade(spark, sf)
    return G.cascade_impact(fin, init, f)


@register("g10_degrees", sql=with_views("""SELECT f.Flight_ID, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM flights f
LEFT JOIN (SELECT src, count(*) AS n FROM net GROUP BY src) o ON f.Flight_ID = o.src
LEFT JOIN (SELECT dst, count(*) AS n FROM net GROUP BY dst) i ON f.Flight_ID = i.dst""", *EDGE_CTES), ints=("out_degree", "in_degree"))
def g10(spark, sf):
    f = flights(spark, sf)
    return G.window_degrees(f)


@register("g11_pagerank")
def g11(spark, sf):
    """PageRank over the flight network (iterative; rows-only + pytest invariants)."""
    f = flights(spark, sf)
    return G.pagerank(G.build_network(f), f)


# G12-G15 (betweenness and the rankings built on it) are not registered: exact
# Brandes needs one BFS per flight over ~100 time-ordered levels, too slow for
# a whole-table check; they are tested against brute force on small graphs in
# tests/test_network.py (see README).


@register("g16_network_metrics", sql=with_views("""SELECT (SELECT count(*) FROM flights) AS total_nodes, (SELECT count(*) FROM net) AS total_edges,
  (SELECT count(*) FROM net) / ((SELECT count(*) FROM flights) * ((SELECT count(*) FROM flights) - 1)) AS density,
  (SELECT coalesce(sum(c), 0) FROM cl) / (SELECT count(*) FROM flights) AS avg_clustering""", *EDGE_CTES,
    """und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM net WHERE src <> dst)""",
    """adj AS (SELECT a AS x, b AS y FROM und UNION ALL SELECT b, a FROM und)""",
    """deg AS (SELECT x, count(*) AS deg FROM adj GROUP BY x)""",
    """tri AS (SELECT a1.x AS x, count(*) AS t FROM adj a1 JOIN adj a2 ON a1.x = a2.x AND a1.y < a2.y
  JOIN und u ON u.a = least(a1.y, a2.y) AND u.b = greatest(a1.y, a2.y) GROUP BY a1.x)""",
    """cl AS (SELECT CASE WHEN d.deg < 2 THEN 0.0 ELSE 2.0 * coalesce(t.t, 0) / (d.deg * (d.deg - 1)) END AS c
  FROM deg d LEFT JOIN tri t ON d.x = t.x)"""),
          floats=("density", "avg_clustering"), ints=("total_nodes", "total_edges"))
def g16(spark, sf):
    f = flights(spark, sf)
    return G.network_metrics(G.build_network(f), f)


@register("g17_network_table", sql=with_views("""SELECT n.*, d.delay AS dst_delay,
  CASE WHEN d.delay > 30 THEN 'severe' WHEN d.delay > 15 THEN 'moderate' WHEN d.delay > 0 THEN 'minor' ELSE 'none' END AS delay_tier
FROM net n LEFT JOIN d0 d ON n.dst = d.Flight_ID""", *EDGE_CTES, *cascade_ctes(0)), floats=("propagation_factor", "time_buffer", "dst_delay"))
def g17(spark, sf):
    f = flights(spark, sf)
    return G.network_table(G.build_network(f), f.select("Flight_ID", F.col("Delay_Minutes").alias("delay")))
