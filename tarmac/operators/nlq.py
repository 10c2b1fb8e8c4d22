"""Keyword question tagging re-aimed as Spark jobs over a table of questions.

Every rule is an ordered list of substring / regex tests, so a question is
tagged with native column expressions (``contains``, ``rlike``,
``regexp_extract_all``) -- the table of questions is processed in parallel
like any other fact table.  Running an intent against flights joins the
distinct parsed filter combinations (bounded by the keyword tables) to the
facts and aggregates.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac import dims
from tarmac.operators.filters import time_window_predicate
from tarmac.session import cut_lineage

# FIXED VALUES (must equal the reference's constants) -------------------------
INTENT_PATTERNS = {
    "analyze": ["analyze", "examine", "study", "investigate", "review", "assess", "what", "how"],
    "optimize": ["optimize", "improve", "enhance", "maximize", "minimize", "efficient", "best"],
    "plan": ["plan", "schedule", "allocate", "assign", "distribute", "organize"],
    "predict": ["predict", "forecast", "estimate", "expect", "anticipate", "project"],
    "manage": ["manage", "control", "handle", "coordinate", "supervise", "oversee"],
}
ENTITY_PATTERNS = {
    "operations": ["operations", "operational", "ops", "management", "control"],
    "capacity": ["capacity", "utilization", "throughput", "volume", "load", "efficiency"],
    "revenue": ["revenue", "profit", "income", "earnings", "pricing", "cost"],
    "delays": ["delay", "delays", "delayed", "late", "lateness", "behind schedule"],
    "runways": ["runway", "runways", "strip", "landing strip", "takeoff strip", "ground"],
    "schedule": ["schedule", "timetable", "time", "timing", "slot", "slots", "allocation"],
    "fleet": ["aircraft", "fleet", "plane", "airplane", "turnaround", "utilization"],
    "disruption": ["disruption", "cascade", "impact", "critical", "risk", "chain"],
    "optimization": ["optimize", "optimization", "improve", "efficiency", "best", "optimal"],
    "resources": ["resource", "allocation", "assignment", "distribution", "planning"],
}
TIME_PATTERNS = {
    "tomorrow": "tomorrow", "today": "today", "yesterday": "yesterday", "next week": "next_week", "this week": "this_week",
    "morning": "morning", "afternoon": "afternoon", "evening": "evening", "night": "night",
    "peak": "peak_hours", "rush": "peak_hours", "busy": "peak_hours",
}
AIRLINE_NAMES = ["indigo", "spicejet", "air india", "vistara", "go air", "alliance air"]
AIRCRAFT_NAMES = ["a320", "a321", "a330", "a350", "b737", "b777", "b787", "atr72", "q400"]
QUANTITY_PATTERNS = {"most": "most|highest|maximum|top|greatest", "least": "least|lowest|minimum|bottom|smallest", "all": "all|every|each"}
MODIFIER_PATTERNS = {
    "urgent": "urgent|emergency|critical|immediate",
    "frequent": "frequent|often|regular|repeated",
    "international": "international|overseas|foreign",
    "domestic": "domestic|local|national",
    "heavy_traffic": "heavy traffic|congested|busy|crowded",
    "efficiency": "efficient|optimal|best|improved",
}
TOPIC_GROUPS = [
    ("ai_analysis", ["analyze", "analysis", "ai", "data", "information"]),
    ("best_time", ["best time", "optimal time", "when to", "schedule time", "takeoff", "landing"]),
    ("busiest_time", ["busiest", "congestion", "avoid", "peak", "heavy traffic", "crowded"]),
    ("schedule_tuning", ["tune", "reschedule", "optimize", "move flight", "schedule impact", "delay impact"]),
    ("cascading_impact", ["cascade", "cascading", "ripple effect", "domino", "chain reaction", "biggest impact"]),
    ("revenue", ["revenue", "profit", "cost", "money", "financial"]),
    ("runway", ["runway", "runways", "capacity"]),
    ("airline", ["airline", "airlines", "carrier"]),
    ("prediction", ["predict", "forecast", "tomorrow", "future", "expect"]),
]
# FIXED VALUES (must equal the reference's word lists): intent tags, first hit wins
INTENT_TAGS = {
    "intent_type": (
        [
            ("optimization", ["optimize", "improve", "better", "enhance", "reschedule"]),
            ("comparison", ["compare", "vs", "versus", "difference", "better than"]),
            ("prediction", ["predict", "forecast", "future", "will", "expect"]),
            ("recommendation", ["recommend", "suggest", "should", "advice", "what to do"]),
            ("analysis", ["analyze", "analysis", "pattern", "trend", "insight"]),
        ],
        "general",
    ),
    "subject": (
        [
            ("runways", ["runway", "runways"]),
            ("airlines", ["airline", "airlines"]),
            ("delays", ["delay", "delays"]),
            ("schedule", ["schedule", "time", "timing"]),
            ("revenue", ["revenue", "profit", "money", "cost"]),
            ("weather", ["weather", "rain", "fog", "storm"]),
        ],
        "flights",
    ),
    "time_frame": (
        [
            ("today", ["today", "now", "current"]),
            ("future", ["tomorrow", "next"]),
            ("week", ["week", "weekly"]),
            ("peak", ["peak", "busy", "rush"]),
        ],
        "current",
    ),
    "insight": (
        [
            ("optimization", ["optim"]),
            ("delay", ["delay"]),
            ("revenue", ["revenue"]),
            ("runway", ["runway"]),
            ("risk", ["risk"]),
        ],
        "general",
    ),
}
TEMPLATES = [
    "What's our runway utilization during peak hours?",
    "How can I optimize 7-9 AM slots for maximum revenue?",
    "Which flights have highest cascade delay impact?",
    "What's the optimal runway assignment strategy?",
    "How can we reduce operational costs during peak times?",
    "Which aircraft should we prioritize for turnaround efficiency?",
    "What time slots have lowest delay risk for scheduling?",
    "How can we maximize capacity during business hours?",
    "Which flights cause most disruption to our operations?",
    "What's the best scheduling strategy for weather contingency?",
]
# -----------------------------------------------------------------------------


def _any(q: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | q.contains(w)
    return out


SHOW_WORDS = ["what", "which", "who", "where", "when"]
HOW_WORDS = ["how to", "can you", "should i"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` reads it inside a lambda of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def found_words(q: Column, words) -> Column:
    """Which of the words ``q`` contains; each is searched for once a row, however many rules ask for it."""
    return _let(q, lambda text: F.filter(_words(dict.fromkeys(words)), lambda w: text.contains(w)))


# N01
def action_col(found: Column) -> Column:
    out = F.when(F.arrays_overlap(found, _words(SHOW_WORDS)), "show").when(F.arrays_overlap(found, _words(HOW_WORDS)), "optimize").otherwise("show")
    for intent, pats in reversed(list(INTENT_PATTERNS.items())):
        out = F.when(F.arrays_overlap(found, _words(pats)), intent).otherwise(out)
    return out


# N02
def entity_col(found: Column) -> Column:
    """The entity with the most words found, the first of equals."""
    scores = F.array(*[F.size(F.filter(_words(pats), lambda w: F.array_contains(found, w))) for pats in ENTITY_PATTERNS.values()])

    def first_best(s):
        at = F.array_position(s, F.array_max(s)).cast("int")
        return F.when(F.array_max(s) > 0, F.element_at(_words(ENTITY_PATTERNS), at)).otherwise(F.lit("flights"))

    return _let(scores, first_best)


# N03
def time_code_col(q: Column) -> Column:
    pat = r"(\d{1,2})(?::|\s)?(am|pm|:\d{2})"
    # the reference formats the first match tuple: specific_time_('7', 'am')
    out = F.when(F.regexp_extract(q, pat, 0) != "",
                 F.concat(F.lit("specific_time_('"), F.regexp_extract(q, pat, 1), F.lit("', '"), F.regexp_extract(q, pat, 2), F.lit("')"))) \
        .when(q.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"), "specific_date")
    said = F.array(*[F.struct(F.lit(phrase).alias("phrase"), F.lit(code).alias("code")) for phrase, code in TIME_PATTERNS.items()])
    first = _let(q, lambda text: F.get(F.filter(said, lambda x: text.contains(x["phrase"])), F.lit(0))["code"])
    return F.coalesce(first, out)


def filters_col(q: Column, raw: Column) -> Column:
    """Struct of parsed filters; airport codes are 3-letter words that are known airports (Q9 fixed)."""
    words = F.regexp_extract_all(F.upper(raw), F.lit(r"\b([A-Z]{3})\b"), 1)
    known = F.array(*[F.lit(a) for a in dims.AIRPORT_ORDER])
    airports = F.filter(words, lambda w: F.array_contains(known, w))
    airlines = F.filter(F.array(*[F.lit(a) for a in AIRLINE_NAMES]), lambda a: F.instr(q, a) > 0)
    aircraft = F.filter(F.array(*[F.lit(a) for a in AIRCRAFT_NAMES]), lambda a: F.instr(q, a) > 0)
    delay = F.regexp_extract(q, r"(\d+)\s*(?:minute|min|hour|hr)", 1)
    qty = F.lit(None).cast("string")
    for name, pat in reversed(list(QUANTITY_PATTERNS.items())):
        qty = F.when(q.rlike(pat), name).otherwise(qty)
    return F.struct(
        time_code_col(q).alias("time"),
        F.when(F.size(airports) > 0, airports).alias("airports"),
        F.when(F.size(airlines) > 0, airlines).alias("airlines"),
        F.when(F.size(aircraft) > 0, aircraft).alias("aircraft_types"),
        F.when(delay != "", delay.try_cast("int")).alias("delay_threshold"),
        qty.alias("quantity"),
    )


# N04
def modifiers_col(q: Column) -> Column:
    return F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(m)) for m, p in MODIFIER_PATTERNS.items()]))


def confidence_col(found: Column, entity: Column) -> Column:
    # an intent's or entity's name is only given by words of its own list, so any word of any list tells
    a = F.arrays_overlap(found, _words(w for pats in INTENT_PATTERNS.values() for w in pats))
    c = F.lit(0.5) + F.when(a, 0.2).otherwise(0.0) + F.when(entity != "flights", 0.2).otherwise(0.0) + F.when(F.array_contains(found, "?"), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), c)


def tag_questions(df: DataFrame, col: str = "text") -> DataFrame:
    """N01-N04 on every row of a question table."""
    words = [w for lists in (INTENT_PATTERNS, ENTITY_PATTERNS) for pats in lists.values() for w in pats]
    out = df.withColumn("__found", found_words(F.lower(F.col(col)), [*words, *SHOW_WORDS, *HOW_WORDS, "?"]))
    out = out.withColumns({"action": action_col(F.col("__found")), "entity": entity_col(F.col("__found"))})
    q = F.lower(F.col(col))
    out = out.withColumns({"filters": filters_col(q, F.col(col)), "modifiers": modifiers_col(q)})
    return out.withColumn("confidence", confidence_col(F.col("__found"), F.col("entity"))).drop("__found")


# N05
def route_topic(df: DataFrame, col: str = "text") -> DataFrame:
    q = F.lower(F.col(col))
    out = F.lit("general_optimization")
    for name, words in reversed(TOPIC_GROUPS):
        out = F.when(_any(q, words), name).otherwise(out)
    return df.withColumn("topic", out)


def intent_tags(df: DataFrame, col: str = "text") -> DataFrame:
    """Query type, subject, time frame and the insight router's target, each by the first word list that hits."""
    q = F.lower(F.col(col))
    out = df
    for name, (lists, default) in INTENT_TAGS.items():
        tag = F.lit(default)
        for value, words in reversed(lists):
            tag = F.when(_any(q, words), value).otherwise(tag)
        out = out.withColumn(name, tag)
    return out


# N06 / N09
def intent_metrics(flights: DataFrame, tagged: DataFrame, as_of: _dt.date) -> DataFrame:
    """Per distinct (time code, delay threshold, entity): matching flights, mean delay, forecast (x1.1).

    Thresholds and clock times come from free text, so combinations are not
    broadcast against the facts.  The facts are summed once per (date, hour,
    delay): the time codes of the keyword table select among those sums, sums and
    thresholds are put in one order per code and a running sum from the top gives
    every threshold's count and total.
    """
    combos = tagged.select(F.col("filters.time").alias("time"), F.col("filters.delay_threshold").alias("delay_gt"), "entity").distinct()
    combos = cut_lineage(combos)  # read twice below, and the texts are long
    codes = sorted(set(TIME_PATTERNS.values()))
    known = F.col("time").isin(codes)
    combos = combos.withColumn("code", F.when(known, F.col("time")).otherwise(F.lit("all"))).withColumn(
        "least", F.greatest(F.coalesce(F.col("delay_gt").cast("double"), F.lit(float("-inf"))), F.when(F.col("entity") == "delays", 0.0).otherwise(float("-inf"))))
    sums = flights.where(F.col("Delay_Minutes").isNotNull()).groupBy("Date", "Hour", F.col("Delay_Minutes").alias("delay")).agg(F.count(F.lit(1)).alias("n"))
    pairs = [(c, time_window_predicate(c, as_of, date=F.col("Date"))) for c in codes]
    member = F.array_compact(F.array(F.lit("all"), *[F.when(p if p is not None else F.lit(True), F.lit(c)) for c, p in pairs]))
    sums = sums.withColumn("code", F.explode(member)).groupBy("code", "delay").agg(F.sum("n").alias("n"))
    marks = combos.select("code", F.col("least").alias("delay")).distinct().select("code", "delay", F.lit(0).cast("long").alias("n"), F.lit(True).alias("mark"))
    both = sums.withColumn("mark", F.lit(False)).unionByName(marks)
    # strictly greater delays: at equal values the mark comes first when read from the top
    band = Window.partitionBy("code", "band").orderBy(F.col("delay").desc(), F.col("mark").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("band", F.floor(F.least(F.greatest(F.col("delay"), F.lit(-1.0)), F.lit(1e6)) / 60))
    per = both.groupBy("code", "band").agg(F.sum("n").alias("bn"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("delay"))).alias("bs"))
    above = Window.partitionBy("code").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a band
    per = per.select("code", "band", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.coalesce(F.sum("bs").over(above), F.lit(0.0)).alias("as"))
    run = both.withColumn("rn", F.sum("n").over(band)).withColumn("rs", F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("delay"))).over(band), F.lit(0.0)))
    got = run.where("mark").join(per, ["code", "band"]).select(
        "code", F.col("delay").alias("least"), (F.col("rn") + F.col("an")).alias("flight_count"), (F.col("rs") + F.col("as")).alias("total"))
    out = combos.join(got, ["code", "least"], "left")
    mean = F.try_divide(F.col("total"), F.col("flight_count"))
    return out.select("time", "delay_gt", "entity", F.coalesce("flight_count", F.lit(0)).alias("flight_count"), mean.alias("avg_delay"), (mean * 1.1).alias("forecast_delay"))


def run_intent(flights: DataFrame, entity: str, time_code: str | None = None, airlines=None, airports=None, delay_gt=None,
               quantity: str | None = None, as_of: _dt.date | None = None) -> DataFrame:
    """Execute one parsed intent: filters, entity aggregation, most/least 10."""
    f = flights
    if time_code and as_of:
        p = time_window_predicate(time_code, as_of)
        if p is not None:
            f = f.where(p)
    if airlines:
        f = f.where(F.lower("Airline").isin([a.lower() for a in airlines]))
    if airports:
        f = f.where(F.col("Origin").isin(airports) | F.col("Destination").isin(airports))
    if delay_gt is not None:
        f = f.where(F.col("Delay_Minutes") > delay_gt)
    if entity == "delays":
        f = f.where(F.col("Delay_Minutes") > 0)
        key = "Delay_Minutes"
    elif entity in ("runways", "airlines"):
        k = "Runway" if entity == "runways" else "Airline"
        f = f.groupBy(k).agg(F.count("Flight_ID").alias("Flight_Count"), F.avg("Delay_Minutes").alias("Avg_Delay"),
                             F.sum("Capacity").alias("Total_Passengers"))
        key = "Avg_Delay"
    else:
        return f
    tie = "Flight_ID" if entity == "delays" else ("Runway" if entity == "runways" else "Airline")
    if quantity == "most":
        return f.orderBy(F.desc(key), tie).limit(10)
    if quantity == "least":
        return f.orderBy(F.asc(key), tie).limit(10)
    return f


# N07
def intent_sql(spark, view: str, entity: str, time_code: str | None = None, delay_gt: float | None = None,
               quantity: str | None = None, airlines: list[str] | None = None, airports: list[str] | None = None,
               as_of: _dt.date | None = None, limit: int = 10) -> DataFrame:
    """Parameterised SQL over a temp view (named parameters, no splicing of values).

    Time codes: the day parts, peak_hours, today, tomorrow.  ``quantity`` most or
    least sorts down or up and takes ``limit`` rows; without it every row is returned.
    """
    where, args = ["1 = 1"], {}
    parts = {"morning": (6, 11), "afternoon": (12, 17), "evening": (18, 23), "night": (0, 5)}
    if time_code in parts:
        where.append("Hour BETWEEN :lo AND :hi")
        args.update(lo=parts[time_code][0], hi=parts[time_code][1])
    elif time_code == "peak_hours":
        where.append("Hour IN (7, 8, 9, 18, 19, 20)")
    elif time_code in ("today", "tomorrow") and as_of:
        where.append("Date = :day")
        args["day"] = as_of + _dt.timedelta(days=time_code == "tomorrow")
    if delay_gt is not None:
        where.append("Delay_Minutes > :d")
        args["d"] = float(delay_gt)
    if airlines:
        where.append("array_contains(:airlines, lower(Airline))")
        args["airlines"] = F.array(*[F.lit(a.lower()) for a in airlines])
    if airports:
        where.append("(array_contains(:airports, Origin) OR array_contains(:airports, Destination))")
        args["airports"] = F.array(*[F.lit(a) for a in airports])
    w = " AND ".join(where)
    group = {"runways": "Runway", "airlines": "Airline", "airports": "Destination"}.get(entity)
    if group:
        sql, key, tie = f"SELECT {group}, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay FROM {view} WHERE {w} GROUP BY {group}", "Avg_Delay", group
    else:
        extra = " AND Delay_Minutes > 0" if entity == "delays" else ""
        sql, key, tie = f"SELECT * FROM {view} WHERE {w}{extra}", "Delay_Minutes", "Flight_ID"
    if quantity in ("most", "least"):
        sql += f" ORDER BY {key} {'DESC' if quantity == 'most' else 'ASC'}, {tie} LIMIT :lim"
        args["lim"] = int(limit)
    return spark.sql(sql, args=args)


# N08
def suggest(partials: DataFrame, col: str = "text", k: int = 5) -> DataFrame:
    """For every row of partial queries, the first k templates containing it or any of its words (equal rows each get theirs)."""
    templates = F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(s).alias("template"), F.lit(s.lower()).alias("low")) for i, s in enumerate(TEMPLATES)])
    p = F.lower(F.col(col))
    joined = F.lit("\n".join(TEMPLATES).lower())  # a word holds no line end, so it lies in this text if it lies in a template
    words = F.filter(F.array_distinct(F.split(F.trim(p), r"\s+")), lambda x: (x != "") & (F.instr(joined, x) > 0))

    def hits(x):
        hit = lambda t: (F.instr(t["low"], x["p"]) > 0) | F.exists(x["words"], lambda w: F.instr(t["low"], w) > 0)
        return F.slice(F.filter(templates, hit), 1, k)

    found = partials.select(*partials.columns, F.posexplode(_let(F.struct(p.alias("p"), words.alias("words")), hits)).alias("__at", "__hit"))
    return found.select(*partials.columns, "__hit.template_id", "__hit.template", (F.col("__at") + 1).alias("rank"))
