"""Structured Streaming twins of batch operators (re-aimed, SURVEY §2.11).

The reference has no streams; these run the same definitions incrementally
over a file stream of events: watermark + event-time windows (ST1, ST2), and a
stream-static join against batch thresholds with an idempotent alert sink (ST4).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import columns as C
from tarmac.operators import ml as M
from tarmac.operators.quantiles import exact_quantile, grouped_quantiles
from tarmac.session import cut_lineage
from tarmac.sources.fixtures import flights_from_events


def event_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def flight_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return flights_from_events(event_stream(spark, path, schema))


# ST1
def runway_slot_counts(fl: DataFrame, watermark: str = "2 hours") -> DataFrame:
    fl = fl.withColumn("event_time", F.col("Scheduled_Time").cast("timestamp"))  # watermarks need TIMESTAMP
    return (fl.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "30 minutes"), "Runway")
            .agg(F.count(F.lit(1)).alias("flights"), F.avg("Delay_Minutes").alias("avg_delay")))


# ST2
def sliding_runway_load(fl: DataFrame, watermark: str = "2 hours") -> DataFrame:
    fl = fl.withColumn("event_time", F.col("Scheduled_Time").cast("timestamp"))
    return (fl.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "1 hour", "15 minutes"), "Runway")
            .agg(F.count(F.lit(1)).alias("flights")))


# ST4
def alert_stream(fl: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stream-static join: flag flights above the static per-runway p80 delay."""
    return (fl.join(F.broadcast(thresholds), "Runway", "left")
            .where(F.col("Delay_Minutes") > F.col("p80"))
            .select("Flight_ID", "Runway", "Delay_Minutes", "p80",
                    F.when(F.col("Delay_Minutes") > 60, "Critical").when(F.col("Delay_Minutes") > 30, "High")
                    .when(F.col("Delay_Minutes") > 15, "Medium").otherwise("Low").alias("Severity")))


def runway_p80(flights: DataFrame) -> DataFrame:
    return grouped_quantiles(flights, ["Runway"], "Delay_Minutes", [0.8]).select("Runway", F.col("value").alias("p80"))


@dataclass
class AlertBaseline:
    """What alerts compare a flight with, taken from past flights: delay mean and deviation, the limits of runway use, seats
    and confidence, and the traffic of every runway and hour of day (runways times 24 rows)."""

    mean: float
    deviation: float
    busy: float
    large: float
    confidence: float
    traffic: DataFrame

    def alerts(self, flights: DataFrame) -> DataFrame:
        """Alerts on flights as ``ml.alerts`` gives them over the z-score of the delay, flagged above 1.  Null delay, seats and
        congestion count as 0, 150 and 1; a runway or hour that the past does not know has no traffic."""
        f = flights.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in (("Delay_Minutes", 0.0), ("Capacity", 150.0), ("Congestion_Factor", 1.0))})
        f = f.withColumns({"Is_Peak_Hour_I": C.in_hours("Hour", C.ANOMALY_PEAK_HOURS), "High_Congestion": C.high_congestion("Congestion_Factor")})
        f = f.join(self.traffic, ["Runway", "Hour"], "left")
        f = f.withColumn("decision", (F.col("Delay_Minutes") - F.lit(self.mean)) / F.lit(self.deviation))
        f = f.withColumn("Combined_Anomaly", F.col("decision") > 1).withColumn("Anomaly_Confidence", F.abs("decision"))
        return M.alerts(M.anomaly_type(f, limits=(self.busy, self.large)), limit=self.confidence)


def alert_baseline(flights: DataFrame) -> AlertBaseline:
    f = M.anomaly_features(flights)
    traffic = cut_lineage(f.groupBy("Runway", "Hour").agg(F.count(F.lit(1)).alias("Runway_Utilization")))
    mean, deviation = f.agg(F.avg("Delay_Minutes"), F.stddev_pop("Delay_Minutes")).first()
    f = f.withColumn("__c", F.abs((F.col("Delay_Minutes") - F.lit(mean)) / F.lit(deviation)))
    return AlertBaseline(mean, deviation, exact_quantile(f, "Runway_Utilization", 0.95), exact_quantile(f, "Capacity", 0.95),
                         exact_quantile(f, "__c", 0.8), traffic)


def alert_sink(base: AlertBaseline, path: str):
    """``foreachBatch`` function: the alerts of a micro-batch, stored under its number in ``path``.

    A batch that Spark replays after a failure overwrites its own folder, so
    alerts appear once; readers see them as one table with a column ``batch``.
    """

    def write(batch: DataFrame, number: int) -> None:
        base.alerts(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def write_alerts(fl: DataFrame, base: AlertBaseline, path: str, checkpoint: str):
    """Start the alert stream over the files that are there; both folders lie on a file system that all executors share."""
    return fl.writeStream.foreachBatch(alert_sink(base, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
