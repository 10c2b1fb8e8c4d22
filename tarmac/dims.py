"""Dimension tables.

Everything in the FIXED VALUES block must equal the reference's constants for
results to match; it is stated plainly, in natural order.  Operators use these
either as literal map expressions (tiny, fixed lookups that stay inside
whole-stage codegen and need no join at all) or as small DataFrames that are
broadcast: their size is fixed by this file, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's constants)
# ---------------------------------------------------------------------------

# airport code -> (congestion_factor, priority)
AIRPORTS = {
    "BOM": (1.8, "high"),
    "DEL": (1.9, "high"),
    "BLR": (1.6, "high"),
    "MAA": (1.4, "medium"),
    "CCU": (1.3, "medium"),
    "HYD": (1.5, "medium"),
    "AMD": (1.1, "normal"),
    "COK": (1.2, "normal"),
    "GOI": (0.9, "normal"),
    "PNQ": (1.3, "medium"),
    "JAI": (1.0, "normal"),
    "LKO": (1.1, "normal"),
}
MAJOR_DESTINATIONS = ["BOM", "DEL", "BLR", "MAA", "CCU", "HYD"]
LARGE_AIRCRAFT = ["B777", "A350", "B787"]

# runway -> (capacity per hour, efficiency), operations view
RUNWAYS_OPS = {
    "09R/27L": (35, 0.85),
    "09L/27R": (32, 0.90),
    "14/32": (28, 0.80),
}
# runway -> capacity per hour, greedy re-slotting view
RUNWAYS_GREEDY = {"09R/27L": 30, "09L/27R": 30, "14/32": 25}
# runway -> (length m, width m, max ops per hour, preferred aircraft categories), allocation view
RUNWAYS_ALLOC = {
    "09R/27L": (4430, 60, 35, ["Heavy", "Medium"]),
    "09L/27R": (4430, 60, 35, ["Heavy", "Medium"]),
    "14/32": (2925, 45, 25, ["Medium", "Light"]),
    "27/09": (3445, 45, 28, ["Medium", "Light"]),
}
# runway -> (wind, rain, fog sensitivity, length advantage)
RUNWAY_SENSITIVITY = {
    "09R/27L": (0.8, 0.9, 1.0, 1.1),
    "09L/27R": (0.8, 0.9, 1.0, 1.1),
    "14/32": (1.3, 1.2, 1.1, 0.9),
}

# aircraft type -> (seats, turnaround minutes), operations view
# aircraft model -> (category, minimum runway length m, preferred runways), allocation view
AIRCRAFT_ALLOC = {
    "A320": ("Medium", 2400, ["09R/27L", "09L/27R", "14/32"]),
    "A321": ("Medium", 2500, ["09R/27L", "09L/27R", "14/32"]),
    "A330": ("Heavy", 2500, ["09R/27L", "09L/27R"]),
    "A350": ("Heavy", 2600, ["09R/27L", "09L/27R"]),
    "B737": ("Medium", 2100, ["09R/27L", "09L/27R", "14/32", "27/09"]),
    "B777": ("Heavy", 2600, ["09R/27L", "09L/27R"]),
    "B787": ("Heavy", 2600, ["09R/27L", "09L/27R"]),
    "ATR72": ("Light", 1200, ["14/32", "27/09"]),
    "Q400": ("Light", 1425, ["14/32", "27/09"]),
}

# hour lists of the four-tier peak category
PEAK_PATTERNS = {
    "super_peak": [7, 8, 9, 19, 20, 21],
    "peak": [6, 10, 18, 22],
    "moderate": [5, 11, 12, 13, 14, 17, 23],
    "low": [0, 1, 2, 3, 4, 15, 16],
}
GENERATOR_PEAK_HOURS = [6, 7, 8, 9, 18, 19, 20, 21]

# hour -> (demand, revenue multiplier, willingness to pay, business ratio)
REVENUE_HOURS = {
    0: (0.5, 0.7, 0.6, 0.1),
    1: (0.5, 0.7, 0.6, 0.1),
    2: (0.5, 0.7, 0.6, 0.1),
    3: (0.6, 0.8, 0.7, 0.2),
    4: (0.7, 0.9, 0.8, 0.3),
    5: (0.8, 1.3, 1.2, 0.6),
    6: (1.4, 1.6, 1.4, 0.7),
    7: (1.8, 1.8, 1.5, 0.8),
    8: (1.9, 1.7, 1.4, 0.8),
    9: (1.6, 1.5, 1.3, 0.7),
    10: (1.2, 1.2, 1.1, 0.5),
    11: (1.1, 1.1, 1.0, 0.4),
    12: (1.3, 1.3, 1.2, 0.5),
    13: (1.4, 1.3, 1.1, 0.5),
    14: (1.2, 1.2, 1.0, 0.4),
    15: (1.0, 1.0, 0.9, 0.3),
    16: (1.1, 1.1, 1.0, 0.4),
    17: (1.5, 1.4, 1.3, 0.6),
    18: (1.8, 1.7, 1.5, 0.7),
    19: (2.0, 1.8, 1.5, 0.8),
    20: (1.9, 1.7, 1.4, 0.7),
    21: (1.6, 1.5, 1.3, 0.6),
    22: (1.3, 1.3, 1.2, 0.5),
    23: (0.7, 0.9, 0.8, 0.2),
}
# destination priority -> base ticket price
BASE_PRICES = {"high": 12000.0, "medium": 8500.0, "normal": 6200.0}
# peak category -> premium
PEAK_PREMIUMS = {"super_peak": 0.35, "peak": 0.20, "moderate": 0.05, "low": -0.15}

# weather condition -> (visibility km, wind kts, precipitation mm, capacity factor,
#                       landing restriction, takeoff restriction, crosswind closure, base delay minutes)
WEATHER = {
    "Clear": (10.0, 5, 0.0, 1.0, False, False, False, 0.0),
    "Light Rain": (8.0, 8, 2.5, 0.90, False, False, False, 2.0),
    "Moderate Rain": (5.0, 12, 7.5, 0.75, True, False, False, 8.0),
    "Heavy Rain": (2.0, 15, 15.0, 0.60, True, True, True, 15.0),
    "Fog": (0.8, 3, 0.0, 0.50, True, True, False, 20.0),
    "Thunderstorm": (3.0, 25, 20.0, 0.30, True, True, True, 30.0),
    "Strong Winds": (10.0, 30, 0.0, 0.70, True, False, True, 10.0),
    "Snow": (1.5, 10, 8.0, 0.40, True, True, True, 25.0),
}

# ---------------------------------------------------------------------------
# Values chosen here (fixture mapping, FIXTURES.md §2.1), not the reference's
# ---------------------------------------------------------------------------
AIRPORT_ORDER = list(AIRPORTS)
RUNWAY_ORDER = list(RUNWAYS_OPS)
# aircraft order for the fixture mapping; the last three extend the ops view
AIRCRAFT_FIXTURE = [
    ("A320", 180, 45),
    ("B737", 160, 40),
    ("A321", 220, 50),
    ("B777", 300, 90),
    ("A350", 280, 85),
    ("B787", 250, 80),
    ("A330", 260, 75),
    ("ATR72", 70, 30),
    ("Q400", 78, 30),
]
WEATHER_ORDER = list(WEATHER)


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------
def lit_map(mapping: dict) -> Column:
    """A literal MAP column for a fixed lookup (no join, stays in codegen)."""
    parts = []
    for k, v in mapping.items():
        parts += [F.lit(k), F.lit(v)]
    return F.create_map(*parts)


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """mapping[key] with a default for unknown keys."""
    val = lit_map(mapping)[key]
    return val if default is None else F.coalesce(val, F.lit(default))


def pick(index: Column, values: list) -> Column:
    """values[index] for a 0-based integer index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def peak_category_col(hour: Column) -> Column:
    """Four-tier peak category of an hour (first list containing it; else low)."""
    out = F.lit("low")
    for name in ["moderate", "peak", "super_peak"]:
        out = F.when(hour.isin(PEAK_PATTERNS[name]), F.lit(name)).otherwise(out)
    return out




def runways_alloc_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, v[0], v[1], v[2], v[3]) for k, v in RUNWAYS_ALLOC.items()],
        "Runway string, length int, width int, max_ops int, preferred_categories array<string>",
    )


def aircraft_alloc_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, v[0], v[1], v[2]) for k, v in AIRCRAFT_ALLOC.items()],
        "model string, category string, min_length int, preferred_runways array<string>",
    )


