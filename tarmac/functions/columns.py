"""Scalar column functions: every one is ``Column -> Column``
built from native Spark expressions, so it runs inside whole-stage codegen.

Bins follow pandas ``cut`` semantics: right-closed, open on the left edge, so
a value equal to the lowest edge gets NULL (quirk Q2, kept).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac import dims

# FIXED VALUES (must equal the reference's constants) -----------------------
ANOMALY_PEAK_HOURS = [7, 8, 9, 18, 19, 20]
MORNING_PEAK = [6, 7, 8, 9]
EVENING_PEAK = [18, 19, 20, 21]
NIGHT_HOURS = [22, 23, 0, 1, 2, 3, 4, 5]
WEEKEND_DAYS = [5, 6]
COMMON_FAMILIES = ["A320", "A330", "A350", "B737", "B747", "B777", "B787"]
WIDE_BODY = ["A330", "A350", "A380", "B747", "B767", "B777", "B787"]
HEAVY_FRAGMENTS = ["777", "787", "330", "350", "747", "380"]
LIGHT_FRAGMENTS = ["ATR", "Q400", "CRJ", "ERJ"]
CONGESTED_ORIGINS = ["BOM", "DEL"]
PEAK_NUMERIC = {"super_peak": 4, "peak": 3, "moderate": 2, "low": 1}
WEATHER_IMPACT_FACTOR = {"Clear": 1.0, "Light Rain": 1.2, "Heavy Rain": 1.8, "Fog": 2.0, "Storm": 3.0, "Snow": 2.5}
APP_RUNWAY_CAPACITY = {"R1": 35, "R2": 30, "R3": 25, "R4": 20, "09R/27L": 35, "09L/27R": 30, "14/32": 25}
PRIORITY_LABELS = {1: "EMERGENCY", 2: "INTERNATIONAL", 3: "DOMESTIC_MAJOR", 4: "DOMESTIC_REGIONAL", 5: "CARGO"}
CASCADE_PEAK_HOURS = [7, 8, 18, 19, 20]
CASCADE_LARGE = ["A330", "A350", "B777", "B787"]
CASCADE_SMALL = ["ATR", "Q400"]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# C01 calendar parts
def calendar_parts(ts) -> dict[str, Column]:
    t = _c(ts)
    return {
        "Hour": F.hour(t),
        "Day_of_Week": F.weekday(t),
        "Month": F.month(t),
        "Day_of_Year": F.dayofyear(t),
        "Date": F.to_date(t),
        "Day_Name": F.date_format(t, "EEEE"),
    }


# C02 flags (hour sets are parameters; the defaults are the reference's)
def in_hours(hour, hours) -> Column:
    return _c(hour).isin(list(hours)).cast("int")


def is_weekend(dow) -> Column:
    return _c(dow).isin(WEEKEND_DAYS).cast("int")


# C03 peak categories
def peak_category4(hour) -> Column:
    return dims.peak_category_col(_c(hour))


def peak_category3(hour) -> Column:
    h = _c(hour)
    return (
        F.when(h.between(6, 10) | h.between(18, 22), "high").when(h.between(11, 17), "medium").otherwise("low")
    )


def clock_peak_class(minutes) -> Column:
    """Clock-range class of a time of day given in minutes after midnight."""
    h = F.floor(_c(minutes) / 60)
    return (
        F.when(h == 7, "Super Peak").when(h.between(6, 8), "Peak").when(h.between(9, 10), "Moderate").otherwise("Low")
    )


def time_slot_name(minutes) -> Column:
    return F.when(F.floor(_c(minutes) / 60) < 9, "6AM - 9AM").otherwise("9AM - 12PM")


# C04 delay categories (right-closed bins)
def delay_category(delay) -> Column:
    d = _c(delay)
    return (
        F.when(d <= 0, "On_Time")
        .when(d <= 15, "Minor")
        .when(d <= 30, "Moderate")
        .when(d <= 60, "Major")
        .when(d > 60, "Severe")
    )


def delay_category_from_minus1(delay) -> Column:
    d = _c(delay)
    return (
        F.when((d > -1) & (d <= 0), "On Time")
        .when((d > 0) & (d <= 15), "Minor")
        .when((d > 15) & (d <= 30), "Moderate")
        .when((d > 30) & (d <= 60), "Major")
        .when(d > 60, "Severe")
    )


def delay_severity3(delay) -> Column:
    d = _c(delay)
    return F.when((d > 0) & (d <= 15), "minor").when((d > 15) & (d <= 30), "moderate").when(d > 30, "major")


def delay_class_notebook(delay) -> Column:
    d = _c(delay)
    return F.when(d < 0, "early").when(d <= 5, "on_time").when(d <= 15, "minor").when(d > 15, "major")


# C05 risk levels
def risk_level_fixed(risk) -> Column:
    r = _c(risk)
    return (
        F.when((r > 0) & (r <= 0.2), "Low")
        .when((r > 0.2) & (r <= 0.4), "Medium")
        .when((r > 0.4) & (r <= 0.6), "High")
        .when((r > 0.6) & (r <= 1.0), "Critical")
    )


def risk_level_thresholds(x, lo: float, mid: float, hi: float | None = None, labels=("Low", "Medium", "High", "Critical")) -> Column:
    v = _c(x)
    out = F.when(v <= lo, labels[0]).when(v <= mid, labels[1])
    if hi is None:
        return out.when(v > mid, labels[2])
    return out.when(v <= hi, labels[2]).when(v > hi, labels[3])


# C06 capacity bucket
def capacity_bucket(cap) -> Column:
    c = _c(cap)
    return (
        F.when((c > 0) & (c <= 150), "Small")
        .when((c > 150) & (c <= 200), "Medium")
        .when((c > 200) & (c <= 250), "Large")
        .when((c > 250) & (c <= 350), "XLarge")
    )


def is_large_aircraft(cap) -> Column:
    return (_c(cap) > 250).cast("int")


# C07 identifier cleaning
def clean_identifier(x) -> Column:
    return F.regexp_replace(_c(x).cast("string"), r"[^\p{Alnum}_]+", "_")


def strip_non_alnum(x) -> Column:
    return F.regexp_replace(_c(x).cast("string"), r"[^A-Za-z0-9]", "")


# C08 extraction
def aircraft_family(aircraft_type) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(clean_identifier(aircraft_type), r"([A-Za-z0-9]{1,4})", 1), F.lit("")), F.lit("UNK"))


def airline_code(flight_no, mode: str = "iata2") -> Column:
    """Airline code from a flight number; mode='prefix3' keeps the greedy 2-3 char quirk (Q16)."""
    pat = r"^([A-Z0-9]{2,3})" if mode == "prefix3" else r"^([A-Z0-9]{2})"
    return F.nullif(F.regexp_extract(F.upper(_c(flight_no)), pat, 1), F.lit(""))


# C09 family flags
def family_flags(family) -> dict[str, Column]:
    f = F.lower(_c(family))
    out = {f"Is_{fam}_Family": f.contains(fam.lower()).cast("int") for fam in COMMON_FAMILIES}
    out["Is_Wide_Body"] = _c(family).isin(WIDE_BODY).cast("int")
    return out


# C10 aircraft category: dimension first, then name fragments
def aircraft_category(model) -> Column:
    m = _c(model)
    known = dims.lookup(m, {k: v[0] for k, v in dims.AIRCRAFT_ALLOC.items()})
    up = F.upper(m)
    heavy = F.lit(False)
    for frag in HEAVY_FRAGMENTS:
        heavy = heavy | up.contains(frag)
    light = F.lit(False)
    for frag in LIGHT_FRAGMENTS:
        light = light | up.contains(frag)
    return F.coalesce(known, F.when(heavy, "Heavy").when(light, "Light").otherwise("Medium"))


# C11 flight priority
def flight_priority(is_emergency, is_international, capacity) -> Column:
    c = F.coalesce(_c(capacity), F.lit(0))
    return (
        F.when(F.coalesce(_c(is_emergency), F.lit(False)), 1)
        .when(F.coalesce(_c(is_international), F.lit(False)), 2)
        .when(c >= 150, 3)
        .when(c >= 50, 4)
        .otherwise(5)
    )


def priority_label(priority) -> Column:
    return dims.lookup(_c(priority), PRIORITY_LABELS)


# C12 time floors
def floor_minutes(ts, minutes: int) -> Column:
    us = F.unix_micros(_c(ts).cast("timestamp"))
    step = minutes * 60_000_000
    return F.timestamp_micros(F.floor(us / step) * step).cast("timestamp_ntz")


def nearest_slot(ts, minutes: int = 15) -> Column:
    """Nearest slot start; a time exactly half-way goes to the earlier slot."""
    us = F.unix_micros(_c(ts).cast("timestamp"))
    step = minutes * 60_000_000
    return F.timestamp_micros(F.ceil(us / step - F.lit(0.5)) * step).cast("timestamp_ntz")


# C13 labels
def hour_range_label(hour) -> Column:
    h = _c(hour)
    return F.format_string("%02d:00-%02d:00", h, (h + 1) % 24)


def route_label(origin, dest) -> Column:
    return F.concat_ws(" → ", _c(origin), _c(dest))


# C14 delay arithmetic
def delay_from_times(actual, scheduled) -> Column:
    secs = F.unix_seconds(_c(actual).cast("timestamp")) - F.unix_seconds(_c(scheduled).cast("timestamp"))
    return secs / 60.0


def add_minutes(ts, minutes) -> Column:
    micros = F.unix_micros(_c(ts).cast("timestamp")) + F.round(_c(minutes) * F.lit(60_000_000.0)).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def clip0(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


# C15 high impact
def high_impact(dest, aircraft_type, capacity) -> Column:
    return (
        _c(dest).isin(dims.MAJOR_DESTINATIONS) | _c(aircraft_type).isin(dims.LARGE_AIRCRAFT) | (_c(capacity) > 250)
    )


# C16 congestion flags
def congested_origin(origin) -> Column:
    return _c(origin).isin(CONGESTED_ORIGINS).cast("int")


def destination_onehots(dest) -> dict[str, Column]:
    return {f"Dest_{d}": (_c(dest) == d).cast("int") for d in dims.MAJOR_DESTINATIONS}


def high_congestion(factor) -> Column:
    return (F.coalesce(_c(factor), F.lit(1.0)) > 1.5).cast("int")


# C17 dimension maps with defaults
def weather_impact_factor(cond) -> Column:
    return dims.lookup(_c(cond), WEATHER_IMPACT_FACTOR, 1.0)


def app_runway_capacity(runway) -> Column:
    return dims.lookup(_c(runway), APP_RUNWAY_CAPACITY, 30).cast("int")


def peak_numeric(cat) -> Column:
    return dims.lookup(_c(cat), PEAK_NUMERIC, 2)


# C18 reason text
def reschedule_reason(weather_factor, weather_cond, util_pct, delay, best_hour, cur_hour) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(_c(weather_factor) > 1.5, F.format_string("Weather impact (%s)", _c(weather_cond))),
            F.when(_c(util_pct) > 85, F.format_string("Runway overcapacity (%.1f%%)", F.bround(_c(util_pct), 1))),
            F.when(_c(delay) > 45, F.format_string("High delay (%d min)", F.bround(_c(delay), 0).cast("long"))),
            F.when(F.abs(_c(best_hour) - _c(cur_hour)) > 2, F.lit("Peak hour avoidance")),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("General optimization"))


# C19 improvement factor
def improvement_factor(is_high_impact, congestion, peak_cat, efficiency) -> Column:
    cf = F.coalesce(_c(congestion), F.lit(1.0))
    pc = F.coalesce(_c(peak_cat), F.lit("moderate"))
    eff = F.coalesce(_c(efficiency), F.lit(1.0))
    base = (
        F.lit(0.25)
        + F.when(F.coalesce(_c(is_high_impact), F.lit(False)), 0.10).otherwise(0.0)
        + F.when(cf < 1.3, 0.05).when(cf > 1.7, -0.05).otherwise(0.0)
        + F.when(pc == "low", 0.08).when(pc == "super_peak", -0.10).otherwise(0.0)
        + F.when(eff > 0.85, 0.03).otherwise(0.0)
    )
    return F.least(F.lit(0.40), F.greatest(F.lit(0.10), base))


# C20 basic cascade impact score
def cascade_impact_factors(delay, capacity, hour, aircraft_type) -> dict[str, Column]:
    up = F.upper(F.coalesce(_c(aircraft_type).cast("string"), F.lit("")))
    large = F.lit(False)
    for t in CASCADE_LARGE:
        large = large | up.contains(t)
    small = F.lit(False)
    for t in CASCADE_SMALL:
        small = small | up.contains(t)
    out = {
        "Delay_Factor": _c(delay) / 60.0,
        "Capacity_Factor": F.coalesce(_c(capacity), F.lit(150)) / 300.0,
        "Hour_Factor": F.when(_c(hour).isin(CASCADE_PEAK_HOURS), 1.5).when(_c(hour).isin(NIGHT_HOURS), 0.5).otherwise(1.0),
        "Aircraft_Factor": F.when(large, 1.3).when(small, 0.8).otherwise(1.0),
    }
    out["Impact_Score"] = (out["Delay_Factor"] + out["Capacity_Factor"] + out["Hour_Factor"] + out["Aircraft_Factor"]) / 4
    return out
