"""KPI aggregate tables.

All are hash aggregates: Spark plans them as partial (map-side) + final
aggregation, so the shuffle carries one row per group per task, not the facts.
Group keys are low-cardinality (hour, day, runway, airline ...); ratios use
``try_divide`` so ANSI mode never raises on empty groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.quantiles import exact_quantile


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


# A01 -------------------------------------------------------------------------
def hour_dow_stats(flights: DataFrame) -> DataFrame:
    """Hour x day-of-week congestion statistics (flagship).

    Congestion_Score = .4*count + .3*avg delay + .3*flights per runway.
    """
    g = flights.groupBy("Hour", "Day_of_Week").agg(
        F.count("Flight_ID").alias("Flight_Count"),
        F.avg("Delay_Minutes").alias("Avg_Delay"),
        F.stddev_samp("Delay_Minutes").alias("Delay_Std"),
        F.max("Delay_Minutes").alias("Max_Delay"),
        F.sum("Capacity").alias("Total_Passengers"),
        F.countDistinct("Runway").alias("Active_Runways"),
    )
    fpr = _div(F.col("Flight_Count"), F.col("Active_Runways"))
    return g.withColumn("Flights_per_Runway", fpr).withColumn(
        "Congestion_Score",
        F.col("Flight_Count") * 0.4 + F.col("Avg_Delay") * 0.3 + F.col("Flights_per_Runway") * 0.3,
    )


def _cnt() -> Column:
    return F.count(F.lit(1))


# A02
def hourly_basic(flights: DataFrame) -> DataFrame:
    """Hour x weekday basic stats with the simple score count * 0.1."""
    return flights.groupBy("Hour", "Day_of_Week").agg(
        F.count("Flight_ID").alias("Flight_Count"),
        F.avg("Delay_Minutes").alias("Avg_Delay"),
        F.stddev_samp("Delay_Minutes").alias("Delay_Std"),
        F.max("Delay_Minutes").alias("Max_Delay"),
        F.sum("Capacity").alias("Total_Passengers"),
        F.countDistinct("Runway").alias("Active_Runways"),
    ).withColumn("Congestion_Score", F.col("Flight_Count") * 0.1)


def hourly(flights: DataFrame) -> DataFrame:
    """Shared per-hour base: count, mean/std/min/max delay, seats, runways."""
    return flights.groupBy("Hour").agg(
        F.count("Flight_ID").alias("Flight_Count"),
        F.avg("Delay_Minutes").alias("Avg_Delay"),
        F.stddev_samp("Delay_Minutes").alias("Delay_Std"),
        F.min("Delay_Minutes").alias("Min_Delay"),
        F.max("Delay_Minutes").alias("Max_Delay"),
        F.sum("Delay_Minutes").alias("Total_Delay"),
        F.sum("Capacity").alias("Total_Capacity"),
        F.avg("Capacity").alias("Avg_Capacity"),
        F.countDistinct("Runway").alias("Active_Runways"),
    )


def _over_all(df: DataFrame, **aggs: Column) -> DataFrame:
    """Attach whole-table aggregates of a small agg result (one-row broadcast)."""
    one = df.agg(*[v.alias(k) for k, v in aggs.items()])
    return df.crossJoin(F.broadcast(one))


# A03
def peak_hours(flights: DataFrame, factor: float = 1.2) -> DataFrame:
    h = flights.groupBy("Hour").agg(_cnt().alias("Flight_Count"))
    h = _over_all(h, __mean=F.avg("Flight_Count"))
    return h.where(F.col("Flight_Count") > F.col("__mean") * factor).select("Hour", "Flight_Count")


# A04
def delay_summary(flights: DataFrame) -> DataFrame:
    d = F.col("Delay_Minutes")
    return flights.agg(
        _cnt().alias("total_flights"),
        F.count_if(d > 0).alias("delayed_flights"),
        (F.count_if(d > 0) / _cnt() * 100).alias("delay_rate"),
        F.avg(d).alias("avg_delay"),
        F.max(d).alias("max_delay"),
        F.lit(exact_quantile(flights, "Delay_Minutes", 0.5)).alias("median_delay"),
        F.count_if(d > 30).alias("over_30"),
        F.count_if(d > 60).alias("over_60"),
    )


# A05
def runway_utilization(flights: DataFrame) -> DataFrame:
    r = flights.groupBy("Runway").agg(
        F.count("Flight_ID").alias("Flight_Count"),
        F.avg("Delay_Minutes").alias("Avg_Delay"),
        F.sum("Capacity").alias("Total_Passengers"),
    )
    r = _over_all(r, __max=F.max("Flight_Count"))
    return r.withColumn("Utilization_Score", _div(F.col("Flight_Count"), F.col("__max")) * 100).drop("__max")


# A06
def congestion_breakdown(flights: DataFrame) -> DataFrame:
    g = flights.groupBy("Peak_Category").agg(
        _cnt().alias("Flights"),
        F.avg("Delay_Minutes").alias("Avg_Delay"),
        F.sum("Delay_Minutes").alias("Total_Delay"),
        F.avg("Congestion_Factor").alias("Avg_Congestion"),
        F.avg("Runway_Efficiency").alias("Avg_Efficiency"),
    )
    g = _over_all(g, __n=F.sum("Flights"))
    return g.withColumn("Share_Pct", F.col("Flights") / F.col("__n") * 100).drop("__n")


# A07
def by_hour(flights: DataFrame) -> DataFrame:
    h = flights.groupBy("Hour").agg(F.avg("Delay_Minutes").alias("Avg_Delay"), _cnt().alias("Flight_Count"))
    one = h.agg(F.max_by("Hour", F.struct("Flight_Count", -F.col("Hour"))).alias("Peak_Hour"),
                F.max_by("Hour", F.struct("Avg_Delay", -F.col("Hour"))).alias("Worst_Delay_Hour"))
    return h.crossJoin(F.broadcast(one))


# A08
def day_hour_heatmap(flights: DataFrame) -> DataFrame:
    """Weekday x hour mean-delay matrix (explicit pivot values: 24 hours)."""
    return (
        flights.groupBy("Day_of_Week", F.date_format("Scheduled_Time", "EEEE").alias("Day"))
        .pivot("Hour", list(range(24)))
        .agg(F.avg("Delay_Minutes"))
    )


# A09
def hourly_capacity(flights: DataFrame) -> DataFrame:
    h = flights.groupBy("Hour").agg(
        _cnt().alias("Operations"), F.countDistinct("Runway").alias("Runways"), F.sum("Capacity").alias("Passengers"))
    h = h.withColumn("Ops_per_Runway", _div(F.col("Operations"), F.col("Runways")))
    one = h.agg(F.max_by("Hour", F.struct("Operations", -F.col("Hour"))).alias("Peak_Hour"))
    return h.crossJoin(F.broadcast(one))


# A10
BUSINESS_HOURS = [7, 8, 9, 18, 19, 20]


def slot_revenue(flights: DataFrame) -> DataFrame:
    h = F.col("Hour")
    bus = h.isin(BUSINESS_HOURS)
    lei = h.between(10, 17)
    return flights.agg(
        F.count_if(bus).alias("Business_Flights"),
        (F.count_if(bus) * F.avg(F.when(bus, F.col("Capacity"))) * 1.5).alias("Business_Revenue_Index"),
        F.count_if(lei).alias("Leisure_Flights"),
        (F.count_if(lei) * F.avg(F.when(lei, F.col("Capacity"))) * 1.0).alias("Leisure_Revenue_Index"),
    )


# A11
def best_times(flights: DataFrame) -> DataFrame:
    h = hourly(flights)
    h = _over_all(h, __max=F.max("Flight_Count"))
    return h.withColumn(
        "Efficiency_Score", (1.0 / (F.col("Avg_Delay") + 1)) * _div(F.col("Flight_Count"), F.col("__max"))
    ).drop("__max").select("Hour", "Flight_Count", "Avg_Delay", "Delay_Std", "Min_Delay", "Max_Delay", "Efficiency_Score")


def best_and_worst_times(flights: DataFrame, best: int = 5, worst: int = 3) -> DataFrame:
    """The best and worst hours by efficiency, and the mean delay that lies between the two groups."""
    h = best_times(flights)  # 24 rows
    top = h.orderBy(F.desc("Efficiency_Score"), "Hour").limit(best).withColumn("Group", F.lit("best"))
    low = h.orderBy(F.asc("Efficiency_Score"), "Hour").limit(worst).withColumn("Group", F.lit("worst"))
    both = top.unionByName(low).select("Group", "Hour", "Flight_Count", "Avg_Delay")
    return _over_all(both, Improvement=F.avg(F.when(F.col("Group") == "worst", F.col("Avg_Delay"))) - F.avg(F.when(F.col("Group") == "best", F.col("Avg_Delay"))))


# A12
def optimal_hours(flights: DataFrame, q: float = 0.3, min_count: int = 5) -> DataFrame:
    h = flights.groupBy("Hour").agg(F.avg("Delay_Minutes").alias("Avg_Delay"), _cnt().alias("Flight_Count"))
    h = _over_all(h, __q=F.percentile("Avg_Delay", q))
    return h.where((F.col("Avg_Delay") < F.col("__q")) & (F.col("Flight_Count") >= min_count)).drop("__q")


# A13
def busiest_congestion(flights: DataFrame) -> DataFrame:
    h = hourly(flights)
    return h.select(
        "Hour", "Flight_Count", "Avg_Delay", "Total_Capacity", "Active_Runways",
        (F.col("Flight_Count") * F.col("Avg_Delay") * F.col("Total_Capacity") / 10000).alias("Congestion_Score"),
        _div(F.col("Flight_Count"), F.col("Active_Runways")).alias("Density"),
    )


# A14
def peaks_to_avoid(flights: DataFrame, q: float = 0.7) -> DataFrame:
    h = flights.groupBy("Hour").agg(F.avg("Delay_Minutes").alias("Avg_Delay"), _cnt().alias("Flight_Count"))
    h = h.withColumn("Score", F.col("Flight_Count") * F.col("Avg_Delay") / 100)
    h = _over_all(h, __q=F.percentile("Score", q))
    return h.where(F.col("Score") >= F.col("__q")).drop("__q")


# A16
def schedule_tuning(flights: DataFrame, high: float = 20.0, good: float = 15.0) -> DataFrame:
    """Hours with mean delay > high get the first hour whose mean delay < good; move min(n // 3, 10)."""
    h = flights.groupBy("Hour").agg(_cnt().alias("Current_Flights"), F.avg("Delay_Minutes").alias("Current_Delay"))
    best = h.where(F.col("Current_Delay") < good).agg(F.min("Hour").alias("Recommended_Hour"))
    out = h.where(F.col("Current_Delay") > high).crossJoin(F.broadcast(best)).where(F.col("Recommended_Hour").isNotNull())
    out = out.select(
        F.col("Hour").alias("Original_Hour"), "Recommended_Hour",
        F.least(F.floor(F.col("Current_Flights") / 3), F.lit(10)).alias("Flights_to_Move"),
        "Current_Delay", (F.col("Current_Delay") * 0.7).alias("Projected_Delay"),
        (F.col("Current_Delay") * 0.3).alias("Delay_Reduction"),
    )
    return out.withColumn("Impact_Score", F.col("Flights_to_Move") * F.col("Delay_Reduction"))


# A17
def net_revenue(flights: DataFrame) -> DataFrame:
    h = F.col("Hour")
    mult = F.when(h.isin(7, 8, 19, 20), 1.4).when(h.isin(6, 9, 18, 21), 1.2).otherwise(1.0)
    base = F.coalesce(F.col("Capacity"), F.lit(150)) * 200
    return flights.select(
        "Flight_ID", "Hour", base.alias("Base_Revenue"), mult.alias("Revenue_Multiplier"),
        (F.col("Delay_Minutes") * 50).alias("Delay_Cost"),
        (base * mult - F.col("Delay_Minutes") * 50).alias("Projected_Revenue"),
    )


def net_revenue_summary(flights: DataFrame) -> DataFrame:
    r = net_revenue(flights)
    return r.agg(
        F.sum("Projected_Revenue").alias("Total_Revenue"),
        F.avg("Projected_Revenue").alias("Avg_Revenue"),
        F.sum("Delay_Cost").alias("Total_Delay_Cost"),
        F.count_if(F.col("Delay_Cost") > 1000).alias("High_Cost_Flights"),
    )


# A18
def runway_analysis(flights: DataFrame) -> DataFrame:
    r = flights.groupBy("Runway").agg(
        F.count("Flight_ID").alias("Flight_Count"), F.avg("Delay_Minutes").alias("Avg_Delay"),
        F.sum("Delay_Minutes").alias("Total_Delay"), F.sum("Capacity").alias("Total_Capacity"),
        F.countDistinct("Hour").alias("Active_Hours"),
    )
    return r.withColumn("Flights_per_Hour", _div(F.col("Flight_Count"), F.col("Active_Hours"))).withColumn(
        "Efficiency", F.col("Flight_Count") / (F.col("Avg_Delay") + 1))


# A19
def runway_delay_table(flights: DataFrame) -> DataFrame:
    return flights.groupBy("Runway").agg(
        F.avg("Delay_Minutes").alias("Avg_Delay"), F.sum("Delay_Minutes").alias("Total_Delay"), F.count("Flight_ID").alias("Flight_Count"))


# A20
def airline_analysis(flights: DataFrame) -> DataFrame:
    a = flights.groupBy("Airline").agg(
        F.count("Flight_ID").alias("Flight_Count"), F.avg("Delay_Minutes").alias("Avg_Delay"),
        F.sum("Delay_Minutes").alias("Total_Delay"), F.stddev_samp("Delay_Minutes").alias("Delay_Std"),
        F.sum("Capacity").alias("Total_Capacity"), F.avg("Capacity").alias("Avg_Capacity"),
    )
    return a.withColumn("On_Time_Performance", 85 - F.col("Avg_Delay")).withColumn(
        "Efficiency_Score", F.col("Flight_Count") / (F.col("Avg_Delay") + 1))


# A21
def airline_comparison(flights: DataFrame) -> DataFrame:
    a = flights.groupBy("Airline").agg(F.count("Flight_ID").alias("Flight_Count"), F.avg("Delay_Minutes").alias("Avg_Delay"))
    a = _over_all(a, __max=F.max("Flight_Count"))
    a = a.withColumn("Performance_Score", (1.0 / (F.col("Avg_Delay") + 1)) * _div(F.col("Flight_Count"), F.col("__max")) * 100).drop("__max")
    one = a.agg(
        F.max_by("Airline", F.struct("Performance_Score", F.col("Airline"))).alias("Best_Airline"),
        F.min_by("Airline", F.struct("Performance_Score", F.col("Airline"))).alias("Worst_Airline"),
        (F.max("Performance_Score") - F.min("Performance_Score")).alias("Performance_Gap"),
    )
    return a.crossJoin(F.broadcast(one))


# A22
def airline_delay_rate(flights: DataFrame, threshold: float = 15.0) -> DataFrame:
    a = flights.groupBy("Airline").agg(_cnt().alias("Total"), F.count_if(F.col("Delay_Minutes") > threshold).alias("Delayed"))
    return a.withColumn("Delay_Rate", F.col("Delayed") / F.col("Total") * 100)


# A23
def hourly_forecast(flights: DataFrame) -> DataFrame:
    from tarmac.operators.joins import hour_spine

    h = flights.groupBy("Hour").agg(
        F.avg("Delay_Minutes").alias("Predicted_Delay"), F.stddev_samp("Delay_Minutes").alias("Variance"), _cnt().alias("Sample_Size"))
    h = h.withColumn("Confidence", F.least(F.lit(95), F.col("Sample_Size") * 5).cast("long"))
    h = h.withColumn("Risk_Level", F.when(F.col("Predicted_Delay") > 25, "High").when(F.col("Predicted_Delay") > 15, "Medium").otherwise("Low"))
    full = hour_spine(h.drop("Sample_Size"), {"Predicted_Delay": 10.0, "Confidence": 50, "Risk_Level": "Low", "Variance": 5.0})
    one = full.agg(F.avg("Predicted_Delay").alias("Daily_Predicted_Delay"), F.count_if(F.col("Risk_Level") == "High").alias("High_Risk_Hours"))
    return full.crossJoin(F.broadcast(one))


# A24
def risk_forecast(flights: DataFrame, as_of, days: int = 7) -> DataFrame:
    """7-day x hours 6-22 risk table from the hourly history (confidence noise dropped, Q15)."""
    spark = flights.sparkSession
    h = flights.where(F.col("Hour").between(6, 22)).groupBy("Hour").agg(
        F.avg("Delay_Minutes").alias("Expected_Avg_Delay"), _cnt().alias("Expected_Flights"))
    dates = spark.range(days).select(F.date_add(F.lit(as_of), F.col("id").cast("int")).alias("Date"))
    g = dates.crossJoin(F.broadcast(h))
    day = F.date_format("Date", "EEEE")
    base = F.least(F.col("Expected_Avg_Delay") * 0.8 + F.col("Expected_Flights") * 0.3, F.lit(100.0))
    base = base * F.when(day.isin("Monday", "Friday"), 1.2).when(day.isin("Saturday", "Sunday"), 0.8).otherwise(1.0)
    base = base * F.when(F.col("Hour").isin(7, 8, 19, 20), 1.4).when(F.col("Hour").isin(11, 12, 13, 14), 1.1).otherwise(1.0)
    g = g.withColumn("Day", day).withColumn("Delay_Risk", base)
    lvl = F.when(F.col("Delay_Risk") >= 70, "Critical").when(F.col("Delay_Risk") >= 50, "High").when(F.col("Delay_Risk") >= 30, "Medium").otherwise("Low")
    return g.withColumn("Risk_Level", lvl).withColumn("Time_Slot", F.format_string("%02d:00-%02d:00", F.col("Hour"), F.col("Hour") + 1))


# A25
def cost_estimates(flights: DataFrame) -> DataFrame:
    d = F.sum("Delay_Minutes")
    return flights.agg(
        (d * 1000).alias("Delay_Cost_1000"), (d * 50).alias("Fuel_Cost"), (d * 200).alias("Crew_Cost"),
        (d * 100).alias("Delay_Cost_100"), (d * 500).alias("Delay_Cost_500"))


# A26
def general_optimisation(flights: DataFrame) -> DataFrame:
    h = flights.groupBy("Hour").agg(_cnt().alias("Flight_Count"), F.avg("Delay_Minutes").alias("Avg_Delay"), F.sum("Delay_Minutes").alias("Total_Delay"))
    w_worst = Window.orderBy(F.desc("Avg_Delay"), "Hour")
    w_best = Window.orderBy(F.asc("Avg_Delay"), "Hour")
    # the per-hour table has at most 24 rows: an unpartitioned window over it is bounded
    r = h.withColumn("worst_rank", F.row_number().over(w_worst)).withColumn("best_rank", F.row_number().over(w_best))
    return r.agg(
        F.avg(F.when(F.col("worst_rank") <= 3, F.col("Avg_Delay"))).alias("Worst_Avg"),
        F.avg(F.when(F.col("best_rank") <= 3, F.col("Avg_Delay"))).alias("Best_Avg"),
        F.sum(F.when(F.col("worst_rank") <= 3, F.col("Flight_Count"))).alias("Worst_Flights"),
    ).withColumn("Potential_Savings", (F.col("Worst_Avg") - F.col("Best_Avg")) * F.col("Worst_Flights"))


def tuning_impact(flights: DataFrame, high: float = 20.0, good: float = 15.0) -> DataFrame:
    """System-wide figures of the tuning table: slots, flights to move, minutes saved, share of all delay, cost at 100 a minute."""
    t = schedule_tuning(flights, high, good).agg(
        _cnt().alias("slots"), F.coalesce(F.sum("Flights_to_Move"), F.lit(0)).alias("flights_to_move"), F.avg("Delay_Reduction").alias("avg_reduction"),
        F.coalesce(F.sum("Impact_Score"), F.lit(0.0)).alias("projected_savings"))
    total = flights.agg(F.sum("Delay_Minutes").alias("total_delay"))
    return t.crossJoin(F.broadcast(total)).withColumn("improvement_pct", _div(F.col("projected_savings"), F.col("total_delay")) * 100).withColumn(
        "cost_savings", F.col("projected_savings") * 100)


def hour_reschedule(flights: DataFrame, hour: int = 21, k: int = 3) -> DataFrame:
    """The k hours of least mean delay to move one hour's flights to, with its count, mean and a third of its flights each."""
    h = flights.groupBy("Hour").agg(F.avg("Delay_Minutes").alias("Avg_Delay"))
    at = flights.where(F.col("Hour") == hour).agg(_cnt().alias("Flights_At_Hour"), F.avg("Delay_Minutes").alias("Delay_At_Hour"))
    best = h.orderBy("Avg_Delay", "Hour").limit(k)
    return best.crossJoin(F.broadcast(at)).where("Flights_At_Hour > 0").withColumn("Flights_To_Move", F.floor(F.col("Flights_At_Hour") / 3))


# A27
def evening_reschedule(flights: DataFrame, hour: int = 21, q: float = 0.8) -> DataFrame:
    h = flights.groupBy("Hour").agg(_cnt().alias("Flight_Count"), F.avg("Delay_Minutes").alias("Avg_Delay"))
    h = _over_all(h, __q=F.percentile("Flight_Count", q))
    return h.withColumn("Is_Busy", F.col("Flight_Count") > F.col("__q")).withColumn("Is_Target", F.col("Hour") == hour).drop("__q")


# A29
def runway_rebalancing(flights: DataFrame) -> DataFrame:
    r = runway_utilization(flights)
    r = r.withColumn("Status", F.when(F.col("Utilization_Score") > 80, "over").when(F.col("Utilization_Score") < 50, "under").otherwise("balanced"))
    one = r.agg(
        F.sum(F.when(F.col("Status") == "over", F.col("Flight_Count"))).alias("__o"),
        F.sum(F.when(F.col("Status") == "under", F.col("Flight_Count"))).alias("__u"),
        F.stddev_samp("Flight_Count").alias("Redistribute_Std"),
    ).withColumn("Movable", F.least(F.col("__o") * 0.2, F.col("__u") * 0.5)).drop("__o", "__u")
    return r.crossJoin(F.broadcast(one))


def peak_offpeak_move(flights: DataFrame) -> DataFrame:
    h = flights.groupBy("Hour").agg(_cnt().alias("n"))
    # <= 24 rows: global ordering is bounded
    top = h.orderBy(F.desc("n"), "Hour").limit(3).agg(F.avg("n").alias("peak_mean"))
    low = h.orderBy(F.asc("n"), "Hour").limit(3).agg(F.avg("n").alias("offpeak_mean"))
    return top.crossJoin(low).withColumn("Flights_to_Move", (F.col("peak_mean") - F.col("offpeak_mean")) * 0.15)


# A30
def severity_split(flights: DataFrame) -> DataFrame:
    d = F.col("Delay_Minutes")
    s = flights.agg(
        _cnt().alias("Total"),
        F.count_if((d > 0) & (d <= 15)).alias("Minor"),
        F.count_if((d > 15) & (d <= 30)).alias("Moderate"),
        F.count_if(d > 30).alias("Major"),
    )
    h = flights.groupBy("Hour").agg(F.avg("Delay_Minutes").alias("a"))
    hh = h.agg(F.max_by("Hour", F.struct("a", -F.col("Hour"))).alias("Worst_Hour"), F.min_by("Hour", F.struct("a", F.col("Hour"))).alias("Best_Hour"))
    s = s.crossJoin(hh)
    for c in ("Minor", "Moderate", "Major"):
        s = s.withColumn(f"{c}_Pct", F.col(c) / F.col("Total") * 100)
    return s


# A31
def overview(flights: DataFrame) -> DataFrame:
    d = F.col("Delay_Minutes")
    base = flights.agg(
        _cnt().alias("Total_Flights"),
        F.countDistinct("Airline").alias("Airlines"),
        F.countDistinct("Runway").alias("Runways"),
        (F.count_if(d > 15) / _cnt() * 100).alias("Delay_Rate"),
        F.avg(d).alias("Avg_Delay"),
        (F.datediff(F.max("Date"), F.min("Date")) + 1).alias("Day_Span"),
    ).withColumn("Ops_per_Runway", _div(F.col("Total_Flights"), F.col("Runways")))

    def modal(col):
        g = flights.groupBy(col).agg(_cnt().alias("n"))
        w = Window.orderBy(F.desc("n"), F.asc(col))
        # a per-key count table (runways / airlines / 24 hours) is bounded by the dimension
        return g.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col(col).alias(f"Busiest_{col}"))

    out = base
    for c in ("Runway", "Airline", "Hour"):
        out = out.crossJoin(modal(c))
    return out


# A32
def fleet_utilisation(flights: DataFrame) -> DataFrame:
    a = flights.groupBy("Aircraft_Type").agg(
        _cnt().alias("Flight_Count"), F.avg("Delay_Minutes").alias("Avg_Delay"), F.avg("Capacity").alias("Avg_Capacity"))
    return a.withColumn("Utilization_Score", F.col("Flight_Count") * F.col("Avg_Capacity") / (F.col("Avg_Delay") + 1))


# A33
def route_impact(flights: DataFrame, key: str = "Destination") -> DataFrame:
    a = flights.groupBy(key).agg(F.avg("Delay_Minutes").alias("Avg_Delay"), _cnt().alias("Flight_Count"))
    return a.withColumn("Impact", F.col("Avg_Delay") * F.col("Flight_Count") / 100)


# A34
def disruption_table(flights: DataFrame, threshold: float = 30.0) -> DataFrame:
    d = flights.where(F.col("Delay_Minutes") > threshold)
    return d.groupBy("Flight_ID").agg(
        F.sum("Delay_Minutes").alias("Total_Delay"),
        F.min_by("Aircraft_ID", F.struct("Scheduled_Time", "Airline")).alias("Aircraft_ID"),
        F.min_by("Airline", F.struct("Scheduled_Time", "Airline")).alias("Airline"),
    )


# A35
def load_extremes(flights: DataFrame, hi: float = 0.8, lo: float = 0.3) -> DataFrame:
    h = flights.groupBy("Hour").agg(_cnt().alias("Flight_Count"))
    h = _over_all(h, __hi=F.percentile("Flight_Count", hi), __lo=F.percentile("Flight_Count", lo))
    return h.withColumn("Load", F.when(F.col("Flight_Count") > F.col("__hi"), "overloaded").when(F.col("Flight_Count") < F.col("__lo"), "underused").otherwise("normal")).drop("__hi", "__lo")


# A36
def describe(flights: DataFrame, col: str = "Delay_Minutes") -> DataFrame:
    c = F.col(col)
    return flights.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        *[F.lit(exact_quantile(flights, col, q / 100)).alias(f"p{q}") for q in (25, 50, 75)], F.max(c).alias("max"))


# A39
def value_share(flights: DataFrame, col: str) -> DataFrame:
    g = flights.groupBy(col).agg(_cnt().alias("Count"))
    g = _over_all(g, __n=F.sum("Count"))
    return g.withColumn("Share_Pct", F.col("Count") / F.col("__n") * 100).drop("__n")


# A40
def slot_comparison(flights: DataFrame, slot_col: str = "Slot") -> DataFrame:
    d = F.col("Delay_Minutes")
    slots = [r[0] for r in flights.select(slot_col).distinct().orderBy(slot_col).collect()]  # the few slots of a day
    median = {s: exact_quantile(flights.where(F.col(slot_col).eqNullSafe(F.lit(s))), "Delay_Minutes", 0.5) for s in slots}
    pick = F.coalesce(*[F.when(F.col(slot_col).eqNullSafe(F.lit(s)), F.lit(m)) for s, m in median.items()], F.lit(None).cast("double"))
    return flights.groupBy(slot_col).agg(
        _cnt().alias("n"), F.avg(d).alias("mean"), pick.alias("median"),
        (F.count_if(d <= 15) / _cnt() * 100).alias("on_time_pct"), F.count_if(d > 60).alias("major"), F.stddev_samp(d).alias("std"))


# A41
def top_routes(flights: DataFrame, k: int = 8) -> DataFrame:
    top = flights.groupBy("Destination").agg(_cnt().alias("c")).orderBy(F.desc("c"), "Destination").limit(k)
    f = flights.join(F.broadcast(top.select("Destination")), "Destination", "left_semi")
    d = F.col("Delay_Minutes")
    return f.groupBy("Destination").agg(
        _cnt().alias("n"), F.avg(d).alias("mean"), (F.count_if(d <= 15) / _cnt() * 100).alias("on_time_pct"),
        F.count_if(d > 60).alias("major"), F.stddev_samp(d).alias("std"))


# A42
def hourly_performance(flights: DataFrame) -> DataFrame:
    h = flights.groupBy("Hour").agg(_cnt().alias("n"), F.avg("Delay_Minutes").alias("mean"), F.stddev_samp("Delay_Minutes").alias("std"))
    h = h.withColumn("Congestion", F.col("n") * F.col("mean"))
    return h.withColumn(
        "Performance",
        50 / (F.col("mean") + 1) + 30 / (F.col("std") + 1) + 20 / (F.col("Congestion") + 1),
    ).withColumn("Move_20pct", F.col("n") * 0.2)


# A43
def histogram(flights: DataFrame, col: str = "Delay_Minutes", bins: int = 20, by: str | None = None) -> DataFrame:
    """Equal-width histogram between the column's min and max (max lands in the last bin)."""
    mm = flights.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    f = flights.crossJoin(F.broadcast(mm))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.least(F.floor((F.col(col) - F.col("__lo")) / width), F.lit(bins - 1)))
    keys = ([by] if by else [])
    f = f.where(F.col(col).isNotNull()).withColumn("Bin", b.cast("int"))
    counted = f.groupBy(*keys, "Bin").agg(_cnt().alias("Count"))
    spine = mm.where(F.col("__lo").isNotNull()).select("__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("Bin"))
    if by:
        spine = f.select(by).distinct().crossJoin(F.broadcast(spine))  # ``bins`` rows
    starts = spine.select(*keys, "Bin", (F.col("__lo") + F.col("Bin") * width).alias("Bin_Start"))
    return starts.join(counted, [*keys, "Bin"], "left").select(*keys, "Bin", F.coalesce("Count", F.lit(0)).alias("Count"), "Bin_Start")


def _kv(section: str, key: str, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.cast("double").alias("value"))


# A37
def kpi_context(flights: DataFrame) -> DataFrame:
    """Context bundle as (section, key, value) rows: summary (counts, airlines, runways, delay totals, first and last day as
    yyyymmdd), busiest/best/worst hour, 3 busiest and 3 lowest-delay hours, mean delay and flights of every airline and
    runway, best and worst airline, busiest and most efficient runway, high-risk count.  Ties go to the smaller name or hour;
    an empty table has no hours, airlines and runways."""
    d = F.col("Delay_Minutes")
    day = lambda x: F.date_format(x, "yyyyMMdd")
    rows = lambda agg: agg.select(F.explode("kv").alias("r")).select("r.*")
    summary = rows(flights.agg(F.array(
        _kv("summary", "total_flights", _cnt()), _kv("summary", "avg_delay", F.avg(d)),
        _kv("summary", "delay_rate_pct", F.count_if(d > 15) / _cnt() * 100), _kv("summary", "high_risk_flights", F.count_if(d > 60)),
        _kv("summary", "total_delay_minutes", F.sum(d)), _kv("summary", "delayed_flights", F.count_if(d > 0)),
        _kv("summary", "first_day", day(F.min("Scheduled_Time"))), _kv("summary", "last_day", day(F.max("Scheduled_Time"))),
    ).alias("kv")))
    h = flights.groupBy("Hour").agg(_cnt().alias("n"), F.avg("Delay_Minutes").alias("a"))
    one = rows(h.agg(F.array(
        _kv("hours", "busiest_hour", F.max_by("Hour", F.struct("n", -F.col("Hour")))), _kv("hours", "busiest_hour_flights", F.max("n")),
        _kv("hours", "best_hour", F.min_by("Hour", F.struct("a", "Hour"))),
        _kv("hours", "worst_hour", F.max_by("Hour", F.struct("a", -F.col("Hour")))),
    ).alias("kv")))
    # <= 24 hourly rows: ordering them globally is bounded
    busy = h.orderBy(F.desc("n"), "Hour").limit(3).select(F.lit("peak_hours").alias("section"), F.col("Hour").cast("string").alias("key"),
                                                         F.col("n").cast("double").alias("value"))
    calm = h.orderBy(F.asc("a"), "Hour").limit(3).select(F.lit("low_delay_hours").alias("section"), F.col("Hour").cast("string").alias("key"),
                                                        F.col("a").alias("value"))
    out = summary.unionByName(one).unionByName(busy).unionByName(calm)
    pair = lambda section, key, value: F.struct(F.lit(section).alias("section"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    for col, delay, use, names in (("Airline", "airline_ranking", "airline_flights", ("best_airline", "worst_airline")),
                                   ("Runway", "runway_delay", "runway_use", ("most_efficient_runway", "busiest_runway"))):
        g = flights.groupBy(col).agg(_cnt().alias("n"), F.avg("Delay_Minutes").alias("a"))
        out = out.unionByName(rows(g.select(F.array(pair(delay, col, "a"), pair(use, col, "n")).alias("kv"))))
        # two rows out of a partial aggregate, however many names there are
        last = F.struct(-F.col("a"), col) if col == "Airline" else F.struct(-F.col("n"), col)
        picks = g.agg(F.count_if(F.col(col).isNotNull()).alias("names"), F.min(F.struct("a", col)).alias("lo"),
                      F.min_by(F.struct(F.col(col).alias("key"), F.col("a" if col == "Airline" else "n").cast("double").alias("value")), last).alias("hi"))
        out = out.unionByName(rows(picks.where("names > 0").select(F.array(
            F.struct(F.lit(names[0]).alias("section"), F.col(f"lo.{col}").alias("key"), F.col("lo.a").alias("value")),
            F.struct(F.lit(names[1]).alias("section"), F.col("hi.key").alias("key"), F.col("hi.value").alias("value"))).alias("kv"))))
    return out


# A38
def data_summary(flights: DataFrame) -> DataFrame:
    """One row of headline figures: rates, date range, five busiest airlines as name:flights, worst and best hour and airline
    by mean delay, flights per runway, mean delay of the last three days.  Ties go to the smaller hour or name."""
    d = F.col("Delay_Minutes")
    base = flights.agg(
        _cnt().alias("total_flights"), F.count_if(d > 0).alias("delayed_flights"), (F.count_if(d > 0) / _cnt() * 100).alias("delayed_pct"),
        F.avg(d).alias("avg_delay"), F.max(d).alias("max_delay"), (F.count_if(d <= 15) / _cnt() * 100).alias("on_time_rate"),
        (F.count_if(d > 60) / _cnt() * 100).alias("severe_delay_rate"), F.count_if(d > 120).alias("over_2h"),
        F.min("Date").cast("string").alias("first_date"), F.max("Date").cast("string").alias("last_date"))
    rw = flights.groupBy("Runway").agg(_cnt().alias("n")).agg(F.avg("n").alias("runway_mean_flights"), F.max("n").alias("runway_max_flights"))
    hr = flights.groupBy("Hour").agg(F.avg("Delay_Minutes").alias("a")).agg(
        F.max("a").alias("peak_hour_max_delay"), F.min_by("Hour", F.struct(-F.col("a"), "Hour")).alias("worst_hour"),
        F.min_by("Hour", F.struct("a", "Hour")).alias("best_hour"), F.min("a").alias("best_hour_delay"))
    per = flights.groupBy("Airline").agg(_cnt().alias("n"), F.avg("Delay_Minutes").alias("a"))
    air = per.agg(F.min_by("Airline", F.struct(-F.col("a"), "Airline")).alias("worst_airline"), F.max("a").alias("worst_airline_delay"),
                  F.min_by("Airline", F.struct("a", "Airline")).alias("best_airline"), F.min("a").alias("best_airline_delay"))
    top = per.orderBy(F.desc("n"), "Airline").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "Airline"))).alias("t")).select(
        F.array_join(F.transform("t", lambda x: F.concat(x["Airline"], F.lit(":"), (-x["m"]).cast("string"))), ", ").alias("top_airlines"))
    trend = flights.groupBy("Date").agg(F.avg("Delay_Minutes").alias("m")).orderBy(F.desc("Date")).limit(3).agg(F.avg("m").alias("recent_trend"))
    # every side is one row
    return base.crossJoin(rw).crossJoin(hr).crossJoin(air).crossJoin(top).crossJoin(trend)


def top_delayed_routes(flights: DataFrame, k: int = 5) -> DataFrame:
    r = flights.groupBy("Origin", "Destination").agg(F.avg("Delay_Minutes").alias("Avg_Delay"))
    return r.orderBy(F.desc("Avg_Delay"), "Origin", "Destination").limit(k)


def operational_issues(flights: DataFrame) -> DataFrame:
    """Rule hits as (issue, value): delay rate > 30 %, busiest runway > 2 x mean, flights delayed > 2 h."""
    d = F.col("Delay_Minutes")
    r15 = flights.agg((F.count_if(d > 15) / _cnt()).alias("v")).select(F.lit("high_delay_rate").alias("issue"), F.col("v").alias("value"),
                                                                       (F.col("v") > 0.3).alias("__hit"))
    rw = flights.groupBy("Runway").agg(_cnt().alias("n")).agg(F.max("n").alias("mx"), F.avg("n").alias("mean"))
    rwi = rw.select(F.lit("runway_imbalance").alias("issue"), F.col("mx").cast("double").alias("value"), (F.col("mx") > F.col("mean") * 2).alias("__hit"))
    sev = flights.agg(F.count_if(d > 120).alias("n")).select(F.lit("severe_delays").alias("issue"), F.col("n").cast("double").alias("value"),
                                                            (F.col("n") > 0).alias("__hit"))
    return r15.unionByName(rwi).unionByName(sev).where("__hit").drop("__hit")


# A50 (basic rules)
def basic_recommendations(flights: DataFrame) -> DataFrame:
    """Rule table: peak hours to redistribute, high delay rate (> 30 % delayed > 0), runways above 80 % of the busiest;
    a 'well optimized' row when no rule fires."""
    ph = peak_hours(flights).agg(F.array_join(F.array_sort(F.collect_list(F.col("Hour").cast("string"))), ", ").alias("v"))
    r1 = ph.where(F.col("v") != "").select(F.lit(1).alias("priority"), F.lit("redistribute_peak_hours").alias("rule"), F.col("v").alias("detail"))
    ds = delay_summary(flights)
    r2 = ds.where(F.col("delay_rate") > 30).select(F.lit(2).alias("priority"), F.lit("increase_buffer_times").alias("rule"),
                                                   F.format_string("%.1f", F.col("delay_rate")).alias("detail"))
    ru = runway_utilization(flights).where(F.col("Utilization_Score") > 80).agg(
        F.array_join(F.array_sort(F.collect_list("Runway")), ", ").alias("v"))
    r3 = ru.where(F.col("v") != "").select(F.lit(3).alias("priority"), F.lit("high_runway_utilization").alias("rule"), F.col("v").alias("detail"))
    out = r1.unionByName(r2).unionByName(r3)
    none = out.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(4).alias("priority"), F.lit("no_major_issues").alias("rule"), F.lit("schedule appears well optimized").alias("detail"))
    return out.unionByName(none)


# A50 (rules of the application)
PERFORMANCE_ACTIONS = [
    (20.0, "high", ["implement immediate delay reduction measures", "increase buffer time between flights", "review ground operations efficiency"]),
    (10.0, "medium", ["optimize current schedule", "analyze peak hour distribution", "improve turnaround time management"]),
    (None, "maintenance", ["continue current best practices", "focus on preventing delay increases", "share best practices across operations"]),
]


def performance_recommendations(flights: DataFrame) -> DataFrame:
    """(priority, rule, detail): three actions by mean delay (> 20, > 10, else), runways to balance when the sample deviation of
    flights per runway exceeds 30 % of their mean, the peak hour to thin out when it has over 1.5 times the mean hour, then the
    busiest and the best hour, best and worst airline.  Ties go to the smaller hour or name; an empty table has no rows."""
    base = flights.agg(F.avg("Delay_Minutes").alias("delay"), _cnt().alias("total"))
    rw = flights.groupBy("Runway").agg(_cnt().alias("n")).agg(F.stddev_samp("n").alias("rs"), F.avg("n").alias("rm"))
    hr = flights.groupBy("Hour").agg(_cnt().alias("n"), F.avg("Delay_Minutes").alias("a")).agg(
        F.max("n").alias("hx"), F.avg("n").alias("hm"), F.min_by("Hour", F.struct(-F.col("n"), "Hour")).cast("string").alias("busiest"),
        F.min_by("Hour", F.struct("a", "Hour")).cast("string").alias("calmest"))
    air = flights.groupBy("Airline").agg(F.avg("Delay_Minutes").alias("a")).agg(
        F.min_by("Airline", F.struct("a", "Airline")).alias("best"), F.min_by("Airline", F.struct(-F.col("a"), "Airline")).alias("worst"))
    one = base.where("total > 0").crossJoin(rw).crossJoin(hr).crossJoin(air)  # every side is one row

    def row(priority, rule, detail, when):
        return F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(rule).alias("rule"), detail.alias("detail")))

    rules, above = [], F.lit(False)
    for limit, level, actions in PERFORMANCE_ACTIONS:
        hit = ~above & (F.col("delay") > limit if limit is not None else F.col("delay").isNotNull())
        rules += [row(1, f"{level}: {a}", F.format_string("%.1f", "delay"), hit) for a in actions]
        above = above | (F.col("delay") > limit) if limit is not None else above
    rules += [row(2, "balance runway utilization", F.format_string("%.1f", "rs"), F.col("rs") > F.col("rm") * 0.3),
              row(3, "move flights out of the peak hour", F.col("busiest"), F.col("hx") > F.col("hm") * 1.5),
              row(4, "peak congestion hour", F.col("busiest"), F.lit(True)), row(4, "best hour for critical flights", F.col("calmest"), F.lit(True)),
              row(5, "share best practices of", F.col("best"), F.lit(True)), row(5, "support operations of", F.col("worst"), F.lit(True))]
    return one.select(F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("r")).select("r.*")


def congestion_summary(flights: DataFrame) -> DataFrame:
    """A06 headline figures: super-peak share and delay, mean congestion and efficiency, congested-route share."""
    sp = F.col("Peak_Category") == "super_peak"
    hc = F.col("Congestion_Factor") > 1.5
    return flights.agg(
        F.count_if(sp).alias("Super_Peak_Flights"), (F.count_if(sp) / _cnt() * 100).alias("Super_Peak_Pct"),
        F.avg("Congestion_Factor").alias("Avg_Congestion"), F.avg(F.when(sp, F.col("Delay_Minutes"))).alias("Super_Peak_Avg_Delay"),
        F.avg("Runway_Efficiency").alias("Avg_Runway_Efficiency"), F.count_if(hc).alias("High_Congestion_Flights"),
        (F.count_if(hc) / _cnt() * 100).alias("High_Congestion_Pct"))
