"""Registered queries for question tagging (N*) over the conversations table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tarmac.operators import nlq as N
from tarmac.plans.catalog import register
from tarmac.plans.sql_views import _q, with_views
from tarmac.sources.fixtures import flights, read_table

AS_OF = dt.date(2024, 1, 15)


def questions(spark, sf):
    """Every turn and every document as a question (documents: conv_id = -1 - doc_id, turn 0)."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    docs = read_table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    return turns.unionByName(docs)


Q_CTE = """qs AS (SELECT conv_id, turn, text, lower(text) AS q FROM (
  SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1 - doc_id, 0, text FROM documents) a)"""


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(q, {_q(w)})" for w in words) + ")"


def _action_sql() -> str:
    parts = [f"WHEN {_any(p)} THEN {_q(i)}" for i, p in N.INTENT_PATTERNS.items()]
    return ("CASE " + " ".join(parts) + f" WHEN {_any(['what', 'which', 'who', 'where', 'when'])} THEN 'show'"
            f" WHEN {_any(['how to', 'can you', 'should i'])} THEN 'optimize' ELSE 'show' END")


def _entity_sql() -> str:
    sc = {e: "(" + " + ".join(f"CAST(contains(q, {_q(p)}) AS INTEGER)" for p in pats) + ")" for e, pats in N.ENTITY_PATTERNS.items()}
    best = "greatest(" + ", ".join(sc.values()) + ")"
    return "CASE " + " ".join(f"WHEN {s} = {best} AND {s} > 0 THEN {_q(e)}" for e, s in sc.items()) + " ELSE 'flights' END"


def _conf_sql() -> str:
    a = " OR ".join(f"(action = {_q(i)} AND {_any(p)})" for i, p in N.INTENT_PATTERNS.items())
    e = " OR ".join(f"(entity = {_q(x)} AND {_any(p)})" for x, p in N.ENTITY_PATTERNS.items())
    return f"least(1.0, 0.5 + CASE WHEN {a} THEN 0.2 ELSE 0.0 END + CASE WHEN {e} THEN 0.2 ELSE 0.0 END + CASE WHEN contains(q, '?') THEN 0.1 ELSE 0.0 END)"


@register("n01_tag_action_entity", sql=with_views(f"""SELECT conv_id, turn, action, entity, {_conf_sql()} AS confidence FROM (
  SELECT *, {_action_sql()} AS action, {_entity_sql()} AS entity FROM qs) t""", Q_CTE), floats=("confidence",), ints=("conv_id", "turn"))
def n01(spark, sf):
    return N.tag_questions(questions(spark, sf)).select("conv_id", "turn", "action", "entity", "confidence")


def _time_sql() -> str:
    pat = r"(\d{1,2})(?::|\s)?(am|pm|:\d{2})"
    parts = [f"WHEN contains(q, {_q(k)}) THEN {_q(v)}" for k, v in N.TIME_PATTERNS.items()]
    return ("CASE " + " ".join(parts)
            + f" WHEN regexp_extract(q, '{pat}', 0) <> '' THEN 'specific_time_(''' || regexp_extract(q, '{pat}', 1) || ''', ''' || regexp_extract(q, '{pat}', 2) || ''')'"
            + r" WHEN regexp_matches(q, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}') THEN 'specific_date' END")


def _qty_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(q, {_q(p)}) THEN {_q(k)}" for k, p in N.QUANTITY_PATTERNS.items()) + " END"


@register("n03_extract_filters", sql=with_views(f"""SELECT conv_id, turn, {_time_sql()} AS time,
  TRY_CAST(nullif(regexp_extract(q, '(\\d+)\\s*(?:minute|min|hour|hr)', 1), '') AS INTEGER) AS delay_threshold,
  {_qty_sql()} AS quantity,
  CASE WHEN len(list_filter(regexp_split_to_array(upper(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{3}}') AND list_contains({'[' + ', '.join(_q(a) for a in N.dims.AIRPORT_ORDER) + ']'}, w))) > 0
    THEN array_to_string(list_filter(regexp_split_to_array(upper(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{3}}') AND list_contains({'[' + ', '.join(_q(a) for a in N.dims.AIRPORT_ORDER) + ']'}, w)), ',') END AS airports
FROM qs""", Q_CTE), ints=("conv_id", "turn", "delay_threshold"))
def n03(spark, sf):
    t = N.tag_questions(questions(spark, sf))
    return t.select("conv_id", "turn", F.col("filters.time").alias("time"), F.col("filters.delay_threshold").cast("long").alias("delay_threshold"),
                    F.col("filters.quantity").alias("quantity"), F.array_join(F.col("filters.airports"), ",").alias("airports"))


@register("n04_modifiers", sql=with_views("SELECT conv_id, turn, "
    + ", ".join(f"regexp_matches(q, {_q(p)}) AS {m}" for m, p in N.MODIFIER_PATTERNS.items()) + " FROM qs", Q_CTE), ints=("conv_id", "turn"))
def n04(spark, sf):
    t = N.tag_questions(questions(spark, sf))
    return t.select("conv_id", "turn", *[F.array_contains("modifiers", m).alias(m) for m in N.MODIFIER_PATTERNS])


@register("n05_route_topic", sql=with_views("SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN {_any(w)} THEN {_q(n)}" for n, w in N.TOPIC_GROUPS) + " ELSE 'general_optimization' END AS topic FROM qs", Q_CTE),
          ints=("conv_id", "turn"))
def n05(spark, sf):
    return N.route_topic(questions(spark, sf)).select("conv_id", "turn", "topic")


def _tags_sql() -> str:
    return ", ".join("CASE " + " ".join(f"WHEN {_any(w)} THEN {_q(v)}" for v, w in lists) + f" ELSE {_q(default)} END AS {name}"
                     for name, (lists, default) in N.INTENT_TAGS.items())


@register("n05b_intent_tags", sql=with_views(f"SELECT conv_id, turn, {_tags_sql()} FROM qs", Q_CTE), ints=("conv_id", "turn"))
def n05b(spark, sf):
    return N.intent_tags(questions(spark, sf)).select("conv_id", "turn", *N.INTENT_TAGS)


@register("n06_run_intent", sql=with_views("""SELECT Runway, count(Flight_ID) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay, sum(Capacity) AS Total_Passengers
FROM flights WHERE Hour BETWEEN 6 AND 11 AND Delay_Minutes > 15 GROUP BY Runway ORDER BY Avg_Delay DESC, Runway LIMIT 10"""),
          floats=("Avg_Delay",), ints=("Flight_Count", "Total_Passengers"))
def n06(spark, sf):
    return N.run_intent(flights(spark, sf), "runways", "morning", delay_gt=15, quantity="most", as_of=AS_OF)


@register("n07_intent_sql", sql=with_views("""SELECT Airline, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay FROM flights
WHERE Hour BETWEEN 18 AND 23 AND Delay_Minutes > 30.0 GROUP BY Airline ORDER BY Avg_Delay DESC, Airline LIMIT 10"""),
          floats=("Avg_Delay",), ints=("Flight_Count",))
def n07(spark, sf):
    flights(spark, sf).createOrReplaceTempView("tarmac_flights")
    return N.intent_sql(spark, "tarmac_flights", "airlines", "evening", 30, "most")


@register("n07b_intent_sql_airports", sql=with_views("""SELECT Destination, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay FROM flights
WHERE Hour IN (7, 8, 9, 18, 19, 20) AND (Origin IN ('BOM', 'DEL') OR Destination IN ('BOM', 'DEL')) GROUP BY Destination"""),
          floats=("Avg_Delay",), ints=("Flight_Count",))
def n07b(spark, sf):
    flights(spark, sf).createOrReplaceTempView("tarmac_flights")
    return N.intent_sql(spark, "tarmac_flights", "airports", "peak_hours", airports=["BOM", "DEL"])


@register("n07c_intent_sql_day", sql=with_views("""SELECT Flight_ID, Airline, Delay_Minutes FROM flights
WHERE Date = DATE '2024-01-16' ORDER BY Delay_Minutes ASC, Flight_ID LIMIT 10"""), floats=("Delay_Minutes",))
def n07c(spark, sf):
    flights(spark, sf).createOrReplaceTempView("tarmac_flights")
    return N.intent_sql(spark, "tarmac_flights", "flights", "tomorrow", quantity="least", as_of=AS_OF).select("Flight_ID", "Airline", "Delay_Minutes")


@register("n08_suggest")
def n08(spark, sf):
    """Template suggestions (first 5) for every user question."""
    return N.suggest(questions(spark, sf))


@register("n09_intent_metrics")
def n09(spark, sf):
    """Matching-flight count, mean delay and x1.1 forecast per parsed (time, delay, entity) combination."""
    return N.intent_metrics(flights(spark, sf), N.tag_questions(questions(spark, sf)), AS_OF)
