"""Sorts, top-k, set ops and ordered/window operators.

Every window here is partitioned: a window without ``partitionBy`` would pull
all rows into one task.  Where the reference orders the whole table (rolling
delay) we split the order into equal-count time buckets and repair the first
rows of each bucket from a tiny halo table (SURVEY §7.3 R2).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.quantiles import exact_quantile


def _us(c) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


# W01
def order_flights(df: DataFrame, keys: list[tuple[str, bool]], tie: str = "Flight_ID") -> DataFrame:
    """Global sort by (col, ascending) pairs; the id breaks ties (Q18)."""
    cols = [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in keys]
    if tie and tie in df.columns and tie not in [k for k, _ in keys]:
        cols.append(F.col(tie).asc())
    return df.orderBy(*cols)


# W02
def top_k(df: DataFrame, col: str, k: int, asc: bool = False, tie: str | None = "Flight_ID") -> DataFrame:
    """Top/bottom-k (planned as TakeOrderedAndProject: k rows per task, then k overall)."""
    o = [F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()]
    if tie and tie in df.columns and tie != col:
        o.append(F.col(tie).asc())
    return df.orderBy(*o).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], col: str, k: int, asc: bool = False, tie: str = "Flight_ID") -> DataFrame:
    o = F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()
    w = Window.partitionBy(*group).orderBy(o, F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# W03
def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# W04
def nunique(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


# W05
def rolling_delay(df: DataFrame, n: int = 5, part: list[str] | None = None, buckets: int | None = None,
                  t: str = "Scheduled_Time", key: str = "Flight_ID", col: str = "Delay_Minutes") -> DataFrame:
    """Rolling mean/std of ``col`` over the previous ``n`` rows in time order (min 1 row).

    ``part`` given: window per partition.  ``part=None`` reproduces the
    reference's single global order without a single-task window: rows go to
    equal-count time buckets (boundaries from ``percentile_approx``), the
    window runs per bucket, and the first n-1 rows of every bucket are
    recomputed from the bucket heads plus the previous buckets' last n-1 rows
    (at most 2(n-1) rows per bucket, so the repair table is tiny).
    The bucket count is that of the shuffle partitions unless given.
    """
    order = [F.col("__t"), F.col(key)]
    base = df.withColumn("__t", _us(t))

    def roll(w):
        return (
            F.avg(col).over(w).alias("Rolling_Delay_Mean"),
            F.coalesce(F.stddev_samp(col).over(w), F.lit(0.0)).alias("Rolling_Delay_Std"),
        )

    if part:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(n - 1), 0)
        out = base.select("*", *roll(w))
    else:
        buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        probs = [i / buckets for i in range(1, buckets)]
        bounds = base.agg(F.percentile_approx("__t", probs, 10000).alias("__bounds"))
        b = base.crossJoin(F.broadcast(bounds)).withColumn(
            "__b", F.expr("size(filter(__bounds, x -> x <= __t))")
        ).drop("__bounds")
        w = Window.partitionBy("__b").orderBy(*order)
        wr = w.rowsBetween(-(n - 1), 0)
        b = b.select("*", *roll(wr), F.row_number().over(w).alias("__rn"),
                     F.row_number().over(Window.partitionBy("__b").orderBy(F.col("__t").desc(), F.col(key).desc())).alias("__rr"))
        edge = b.where((F.col("__rn") < n) | (F.col("__rr") < n)).select(key, "__t", col, "__rn")
        # global window over <= 2(n-1) rows per bucket: bounded by buckets, not by data
        fix = edge.select(
            key, "__rn", *roll(Window.orderBy(*order).rowsBetween(-(n - 1), 0))
        ).where(F.col("__rn") < n).select(
            key, F.col("Rolling_Delay_Mean").alias("__m"), F.col("Rolling_Delay_Std").alias("__s")
        )
        out = (
            b.join(F.broadcast(fix), key, "left")
            .withColumn("Rolling_Delay_Mean", F.coalesce("__m", "Rolling_Delay_Mean"))
            .withColumn("Rolling_Delay_Std", F.coalesce("__s", "Rolling_Delay_Std"))
            .drop("__m", "__s", "__rn", "__rr", "__b")
        )
    return out.drop("__t")


# W06
def last_hour_load(df: DataFrame, part: tuple[str, ...] = ("Origin", "Runway", "Date"), cap_col: str = "Runway_Capacity") -> DataFrame:
    """Flights on the same airport's runway and day in [t - 1 h, t] (ties included) and the load ratio.

    Range window per (airport, runway, day, hour) with a one-hour halo: each row is
    also copied into the next hour's partition as context, so no task ever
    holds more than two clock hours of one runway.
    """
    hr = F.hour("Scheduled_Time")
    rows = df.withColumn("__t", _us("Scheduled_Time")).withColumn("__h", hr).withColumn("__halo", F.lit(False))
    halo = rows.where(F.col("__h") < 23).withColumn("__h", F.col("__h") + 1).withColumn("__halo", F.lit(True))
    both = rows.unionByName(halo)
    w = Window.partitionBy(*part, "__h").orderBy("__t").rangeBetween(-3_600_000_000, 0)
    out = both.withColumn("Recent_Flights", F.count(F.lit(1)).over(w)).where(~F.col("__halo"))
    out = out.withColumn("Runway_Load", F.try_divide(F.col("Recent_Flights"), F.col(cap_col)))
    return out.drop("__t", "__h", "__halo")


# W09
def next_flight(df: DataFrame, key: str, t: str = "Scheduled_Time", cols=("Flight_ID", "Scheduled_Time", "Origin")) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(t), F.col("Flight_ID"))
    out = df
    for c in cols:
        out = out.withColumn(f"Next_{c}", F.lead(c).over(w)).withColumn(f"Prev_{c}", F.lag(c).over(w))
    return out


# W10
def max_normalised(df: DataFrame, col: str, name: str, scale: float = 100.0) -> DataFrame:
    """col / max(col) * scale, max taken from a one-row aggregate (broadcast)."""
    m = df.agg(F.max(col).alias("__max"))
    return df.crossJoin(F.broadcast(m)).withColumn(name, F.try_divide(F.col(col), F.col("__max")) * scale).drop("__max")


def share_of_total(df: DataFrame, col: str, name: str) -> DataFrame:
    s = df.agg(F.sum(col).alias("__sum"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, F.try_divide(F.col(col), F.col("__sum"))).drop("__sum")


# W11
def quantile_flag(df: DataFrame, col: str, q: float, name: str, exact: bool = True, op: str = ">") -> DataFrame:
    """Flag rows above (or below) the q-quantile of ``col``; the threshold is exact unless ``exact`` is off."""
    th = F.lit(exact_quantile(df, col, q) if exact else df.agg(F.percentile_approx(col, q, 10000)).first()[0])
    return df.withColumn(name, F.col(col) > th if op == ">" else (F.col(col) < th if op == "<" else F.col(col) >= th))


# W12
def modal_value(df: DataFrame, group: list[str], col: str, name: str) -> DataFrame:
    """Most frequent value per group; ties -> smallest value."""
    cnt = df.groupBy(*group, col).count()
    w = Window.partitionBy(*group).orderBy(F.desc("count"), F.asc(col))
    return cnt.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*group, F.col(col).alias(name))


# W13
def recent_trend(df: DataFrame, col: str = "Delay_Minutes", date_col: str = "Date", days: int = 3) -> DataFrame:
    daily = df.groupBy(date_col).agg(F.avg(col).alias("daily_mean"))
    return daily.orderBy(F.desc(date_col)).limit(days).agg(F.avg("daily_mean").alias("Recent_Trend"))


# W14
def islands(df: DataFrame, part: list[str], start: str, end: str, name: str = "Island", bucket_width: int | None = None) -> DataFrame:
    """Number overlapping [start, end] intervals into islands per partition.

    A new island starts where the interval begins after every earlier
    interval in the partition has ended (running max of ends).

    With ``bucket_width`` the ordered scan is split by start bucket so no task
    holds a whole partition (a busy airport): a small per-(partition, bucket)
    table carries the max end and the island count of all earlier buckets,
    and the windows run per (partition, bucket).  Same numbering either way.
    """
    order = [F.col(start), F.col(end)]
    if bucket_width is None:
        w = Window.partitionBy(*part).orderBy(*order)
        prev_end = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        flag = F.when(prev_end.isNull() | (F.col(start) > prev_end), 1).otherwise(0)
        return df.withColumn("__new", flag).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    b = df.withColumn("__b", F.floor(F.col(start) / bucket_width))
    keys = [*part, "__b"]
    # buckets table: (partition x bucket) rows, bounded by the time span, not by the data
    wb = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy(*keys).agg(F.max(end).alias("__bmax")).withColumn("__carry", F.max("__bmax").over(wb)).drop("__bmax")
    b = b.join(carry, keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    local_prev = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    prev_end = F.greatest(local_prev, F.col("__carry"))  # greatest skips nulls
    b = b.withColumn("__new", F.when(prev_end.isNull() | (F.col(start) > prev_end), 1).otherwise(0))
    b = b.withColumn("__local", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    offs = b.groupBy(*keys).agg(F.sum("__new").alias("__n")).withColumn(
        "__off", F.coalesce(F.sum("__n").over(wb), F.lit(0))).drop("__n")
    return b.join(offs, keys).withColumn(name, F.col("__local") + F.col("__off")).drop("__b", "__carry", "__new", "__local", "__off")
