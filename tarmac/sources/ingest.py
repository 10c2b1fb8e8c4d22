"""Sources, sinks, ingest and cleaning.

Schedules are read as all-string columns with a declared schema and cast
with ``try_cast`` / ``try_to_timestamp`` (ANSI-safe).  Binary workbooks are
out of scope: each sheet arrives as one CSV/parquet file.  Ordered fills
(hierarchical sheets, blank flight numbers) are windows partitioned by sheet
and ordered by the row index written with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.session import cut_lineage

# FIXED VALUES (must equal the reference's constants): canonical column -> accepted spellings
ALIASES = {
    "Flight_ID": ["flight_id", "flightid", "flight_number", "flightnumber", "flight_no", "flightno", "flight", "id", "flight_code"],
    "Airline": ["airline", "carrier", "airline_code", "operator", "company"],
    "Scheduled_Time": ["scheduled_time", "scheduledtime", "departure_time", "departuretime", "std", "scheduled_departure", "dep_time", "time", "scheduled"],
    "Destination": ["destination", "dest", "arrival_airport", "to", "airport", "destination_code"],
    "Aircraft_Type": ["aircraft_type", "aircrafttype", "aircraft", "plane_type", "equipment", "ac_type"],
    "Runway": ["runway", "rwy", "runway_id"],
    "Delay_Minutes": ["delay_minutes", "delayminutes", "delay", "delay_mins", "actual_delay"],
}
# Further columns of the upload format, kept beside the table above
EXTRA_ALIASES = {
    "Actual_Time": ["actual_time", "actual_departure", "atd"],
    "Scheduled_Arrival": ["scheduled_arrival", "sta"],
    "Actual_Arrival": ["actual_arrival", "ata"],
    "Origin": ["origin", "from"],
    "Capacity": ["capacity", "seats"],
}
ID_HINTS = ("flight", "number", "code", "id")
TIME_HINTS = ("time", "departure", "arrival", "schedule")
POSITIONAL = ["Date", "from", "to", "aircraft", "flight time", "std", "atd", "sta", "ata_status", "ata"]


def _col(name: str) -> Column:
    """Column by exact name (sheet headers contain dots and spaces)."""
    return F.col(f"`{name}`")


def _norm(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


# S01
def read_schedule(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    return r.csv(path)


# S02 / W03
def read_sheets(spark: SparkSession, sheets: dict[str, str], fmt: str = "csv") -> DataFrame:
    parts = [dense_index(read_schedule(spark, p, fmt)).withColumn("Time_Slot", F.lit(name)) for name, p in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# S03 / S04
def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(F.translate(c, " ", " ")), F.lit(""))


BLOCK_ROWS = 10_000


def fill_down(df: DataFrame, cols: list[str], order_col: str = "row_idx", part_col: str = "Time_Slot", block: int = BLOCK_ROWS) -> DataFrame:
    """Each blank cell takes the last non-blank value above it in its sheet.

    The sheet is cut into blocks of ``block`` row numbers; a window fills inside a
    block, and a table of one row a block carries the last values of earlier blocks.
    """
    b = df.withColumn("__block", F.floor(F.col(order_col) / block))
    for c in cols:
        b = b.withColumn(c, _blank_to_null(_col(c)))
    last = [F.max_by(_col(c), F.when(_col(c).isNotNull(), F.col(order_col))).alias(f"__l{i}") for i, c in enumerate(cols)]
    above = Window.partitionBy(part_col).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy(part_col, "__block").agg(*last).select(
        part_col, "__block", *[F.last(f"__l{i}", ignorenulls=True).over(above).alias(f"__c{i}") for i in range(len(cols))])
    w = Window.partitionBy(part_col, "__block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(carry, [part_col, "__block"], "left")
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.coalesce(F.last(_col(c), ignorenulls=True).over(w), F.col(f"__c{i}")))
    return out.select(*[_col(c) for c in df.columns])


def flatten_hierarchy(df: DataFrame, key_cols: list[str], order_col: str = "row_idx", part_col: str = "Time_Slot",
                      detail_required: tuple[str, ...] = ("Date", "from")) -> DataFrame:
    """Header rows carry S.No / flight number; detail rows inherit them (forward fill per sheet)."""
    cond = reduce(lambda a, b: a & b, [_blank_to_null(_col(c)).isNotNull() for c in detail_required])
    return fill_down(df, key_cols, order_col, part_col).where(cond)


def fill_flight_number(df: DataFrame, col: str = "Flight Number", order_col: str = "row_idx", part_col: str = "Time_Slot") -> DataFrame:
    return fill_down(df, [col], order_col, part_col)


# S05
def rename_positional(df: DataFrame, names: list[str] = POSITIONAL, start: int = 2) -> DataFrame:
    cols = df.columns
    new = list(cols)
    for i, n in enumerate(names):
        if start + i < len(new):
            new[start + i] = n
    return df.toDF(*new)


# S06
def drop_empty(df: DataFrame) -> DataFrame:
    """Drop all-empty columns (one aggregate), all-empty rows and duplicate column names (first kept)."""
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(i)
    df = df.select(*[F.col(f"`{df.columns[i]}`") for i in keep]) if len(keep) != len(df.columns) else df
    cnt = df.agg(*[F.count(_blank_to_null(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns]).first()
    nonempty = [c for c in df.columns if cnt[c] > 0]
    return df.select(*[F.col(f"`{c}`") for c in nonempty]).na.drop("all")


# S07
def map_columns(df: DataFrame, aliases: dict = ALIASES | EXTRA_ALIASES) -> DataFrame:
    """Rename by normalised alias; several source columns for one target coalesce left to right."""
    norm = {c: _norm(c) for c in df.columns}
    used, sel = set(), []
    for target, names in aliases.items():
        cands = [c for c in df.columns if norm[c] in names or norm[c] == _norm(target)]
        if cands:
            used.update(cands)
            sel.append(F.coalesce(*[F.col(f"`{c}`") for c in cands]).alias(target))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in aliases]
    return df.select(*sel, *rest)


# S12 / S08
def ensure_time(df: DataFrame, base_date: str = "2024-01-01", src: str = "std") -> DataFrame:
    """Scheduled_Time from a clock text on ``base_date`` (never the wall clock), or from a full timestamp text."""
    t = F.trim(F.regexp_replace(_col(src).cast("string"), r"\s+", " "))
    on_base = F.concat_ws(" ", F.lit(base_date), t)
    clock = F.coalesce(F.try_to_timestamp(on_base, F.lit("yyyy-MM-dd H:mm:ss")), F.try_to_timestamp(on_base, F.lit("yyyy-MM-dd H:mm")))
    ts = F.when(t.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), clock).otherwise(F.try_to_timestamp(t))
    cur = F.col("Scheduled_Time") if "Scheduled_Time" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.withColumn("Scheduled_Time", F.coalesce(cur, ts.cast("timestamp_ntz")))


def dense_index(df: DataFrame, order: list[str] | None = None, name: str = "row_idx") -> DataFrame:
    """``df`` with a gapless row number from 0, in the order of ``order`` or, without it, of the stored rows.

    Rows are numbered inside their partition and shifted by the counts of the
    partitions before it (one row a partition); no window holds the whole table.
    """
    cut = df.repartitionByRange(*order) if order else df
    cut = cut_lineage(cut.withColumn("__m", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__m", 33)))
    counts = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select("__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__m")) - 1 if order else F.col("__m") - F.col("__first")
    numbered = cut.join(F.broadcast(shift), "__part").withColumn(name, (F.col("__before") + within).cast("long"))
    return numbered.drop("__m", "__part", "__first", "__before")


def fill_required(df: DataFrame, order_col: str | None = "row_idx", base: str = "2024-01-01 06:00:00") -> DataFrame:
    """Missing columns: Flight_ID from the first column whose name hints at one, else FL + dense row number (4 digits);
    Airline from the id's first 2-3 capitals or digits, else AA; Scheduled_Time from the first time-like column with any
    valid value, else 06:00 + 30 min x row number."""
    out = dense_index(df, [order_col] if order_col and order_col in df.columns else None, "__idx")
    names = [c for c in df.columns if c != order_col]
    if "Flight_ID" not in out.columns:
        hints = [c for c in names if any(h in c.lower() for h in ID_HINTS)]
        made = F.concat(F.lit("FL"), F.lpad(F.col("__idx").cast("string"), F.greatest(F.lit(4), F.length(F.col("__idx").cast("string"))), F.lit("0")))
        out = out.withColumn("Flight_ID", _col(hints[0]).cast("string") if hints else made)
    if "Airline" not in out.columns:
        out = out.withColumn("Airline", F.coalesce(F.nullif(F.regexp_extract("Flight_ID", r"^([A-Z0-9]{2,3})", 1), F.lit("")), F.lit("AA")))
    if "Scheduled_Time" not in out.columns:
        hints = [c for c in names if any(h in c.lower() for h in TIME_HINTS)]
        read = {c: F.try_to_timestamp(_col(c).cast("string")).cast("timestamp_ntz") for c in hints}
        some = out.agg(*[F.count(t).alias(f"n{i}") for i, t in enumerate(read.values())]).first() if hints else []
        good = [t for t, n in zip(read.values(), some) if n]
        # minutes as a bounded interval: whole days and the rest, so a long table cannot overflow
        days, rest = F.floor(F.col("__idx") / 48).cast("int"), (F.pmod("__idx", F.lit(48)) * 30).cast("int")
        made = F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(days=days, mins=rest)
        out = out.withColumn("Scheduled_Time", good[0] if good else made)
    return out.drop("__idx")


# S09 / S10
def derive_columns(df: DataFrame) -> DataFrame:
    from tarmac.functions import columns as C

    h = F.hour("Scheduled_Time")
    out = df.withColumn("Hour", h).withColumn("Day_of_Week", F.weekday("Scheduled_Time")).withColumn("Date", F.to_date("Scheduled_Time"))
    out = out.withColumn("Peak_Category", C.peak_category3(h))
    if "Actual_Time" not in out.columns:
        out = out.withColumn("Actual_Time", C.add_minutes("Scheduled_Time", F.col("Delay_Minutes")))
    return out


def clean_standard(df: DataFrame, default_origin: str = "BOM") -> DataFrame:
    from tarmac.functions import columns as C

    out = df.withColumn("Scheduled_Time", F.coalesce(F.col("Scheduled_Time").cast("timestamp_ntz"),
                                                     F.try_to_timestamp(F.col("Scheduled_Time").cast("string")).cast("timestamp_ntz")))
    out = out.na.drop(subset=["Flight_ID", "Scheduled_Time"])
    if "Origin" not in out.columns:
        out = out.withColumn("Origin", F.lit(default_origin))
    if "Delay_Minutes" not in out.columns and "Actual_Time" in out.columns:
        out = out.withColumn("Delay_Minutes", C.delay_from_times(F.col("Actual_Time").cast("timestamp_ntz"), "Scheduled_Time"))
    return out.withColumn("Delay_Minutes", to_num("Delay_Minutes", 0.0))


# S11
def clean_legacy(df: DataFrame, base_date: str = "2024-01-01") -> DataFrame:
    """Date + STD combine, ATD defaults to STD, STA to STD + 2 h; given delay, capacity and runway are kept and only
    their gaps filled (delay from the times, clipped at 0; 180; R1); airline from the flight number's first capitals, else XX."""
    from tarmac.functions import columns as C

    lower = {c.lower(): c for c in df.columns}
    given = lambda name: _col(lower[name]) if name in lower else F.lit(None).cast("string")
    d = F.coalesce(given("date").cast("string"), F.lit(base_date))
    clock = lambda name: F.try_to_timestamp(F.concat_ws(" ", d, given(name)), F.lit("yyyy-MM-dd H:mm")).cast("timestamp_ntz")
    std = clock("std")
    delay, capacity, runway = (given(c) for c in ("delay_minutes", "capacity", "runway"))
    timed = F.greatest(F.coalesce((F.unix_micros(F.coalesce(clock("atd"), std).cast("timestamp")) - F.unix_micros(std.cast("timestamp"))) / 60_000_000.0, F.lit(0.0)), F.lit(0.0))
    code = F.nullif(F.regexp_extract(given("flight_id").cast("string"), r"([A-Z]{1,3})", 1), F.lit(""))
    made = {
        "Scheduled_Time": std, "Actual_Time": F.coalesce(clock("atd"), std), "Scheduled_Arrival": F.coalesce(clock("sta"), C.add_minutes(std, F.lit(120.0))),
        "Airline": F.coalesce(code, F.lit("XX")),
        "Delay_Minutes": F.coalesce(delay.cast("string").try_cast("double"), F.lit(0.0)) if "delay_minutes" in lower else timed,
        "Capacity": F.coalesce(capacity.cast("string").try_cast("double"), F.lit(180.0)), "Runway": F.coalesce(runway, F.lit("R1")),
    }
    rest = [_col(c) for c in df.columns if c.lower() not in {m.lower() for m in made}]
    return df.select(*rest, *[v.alias(k) for k, v in made.items()])


# S13
def to_num(col, default: float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.expr(f"try_cast(`{col}` AS DOUBLE)") if isinstance(col, str) else c.try_cast("double"), F.lit(float(default)))


# S14
def parse_ampm(col) -> Column:
    """'Landed 8:05 PM' -> minutes after midnight (12 AM = 0 h, 12 PM = 12 h)."""
    c = F.col(col) if isinstance(col, str) else col
    pat = r"(?i)(\d{1,2}):(\d{2})\s*(AM|PM)"
    h = F.regexp_extract(c, pat, 1)
    m = F.regexp_extract(c, pat, 2)
    ap = F.upper(F.regexp_extract(c, pat, 3))
    hh = h.try_cast("int") % 12 + F.when(ap == "PM", 12).otherwise(0)
    return F.when(h != "", hh * 60 + m.try_cast("int"))


# S15
def clock_diff(actual_min, sched_min) -> Column:
    a = F.col(actual_min) if isinstance(actual_min, str) else actual_min
    s = F.col(sched_min) if isinstance(sched_min, str) else sched_min
    d = a - s
    return F.when(d < -720, d + 1440).when(d > 720, d - 1440).otherwise(d)


# S16
def select_departures(df: DataFrame, pattern: str = "(?i)Mumbai|BOM", col: str = "from", required=("std", "atd")) -> DataFrame:
    return df.na.drop(subset=list(required)).where(_col(col).rlike(pattern))


# S17
def profile(df: DataFrame) -> DataFrame:
    n = len(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    out = row.selectExpr("__rows", f"stack({n}, {stack}) as (column, missing)")
    return out.withColumn("completeness_pct", (1 - F.col("missing") / F.col("__rows")) * 100).withColumnRenamed("__rows", "rows")


# S18
def filter_values(df: DataFrame) -> DataFrame:
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("Airline", "Runway", "Origin", "Destination")],
                  F.min("Date").alias("min_date"), F.max("Date").alias("max_date"))


# S19
def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "Date", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
