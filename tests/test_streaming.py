import os
import tempfile

from pyspark.sql import functions as F

from paths import SF
from tarmac.sources.fixtures import flights, read_table
from tarmac.streaming import streams as ST


def test_stream_slot_counts_match_batch(spark):
    ev = read_table(spark, SF, "events")
    d = tempfile.mkdtemp(prefix="tarmac-stream-")
    src = os.path.join(d, "src")
    ev.repartition(10, F.pmod("event_id", F.lit(10))).write.parquet(src)
    fl = ST.flight_stream(spark, src, ev.schema)
    q = (ST.runway_slot_counts(fl, "100 days").writeStream.outputMode("complete").format("memory")
         .queryName("st1_test").option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.window.start, r.Runway): r.flights for r in spark.table("st1_test").collect()}
    b = flights(spark, SF).groupBy(F.window(F.col("Scheduled_Time").cast("timestamp"), "30 minutes"), "Runway").count().collect()
    exp = {(r.window.start, r.Runway): r["count"] for r in b}
    assert got == exp


def test_alert_stream_static_join(spark):
    ev = read_table(spark, SF, "events")
    d = tempfile.mkdtemp(prefix="tarmac-stream-")
    src = os.path.join(d, "src")
    ev.write.parquet(src)
    th = ST.runway_p80(flights(spark, SF))
    q = (ST.alert_stream(ST.flight_stream(spark, src, ev.schema), th).writeStream.format("memory").queryName("st4_test")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    n = spark.table("st4_test").count()
    f = flights(spark, SF).join(th, "Runway").where(F.col("Delay_Minutes") > F.col("p80")).count()
    assert n == f


def test_sliding_load_matches_batch(spark):
    ev = read_table(spark, SF, "events")
    d = tempfile.mkdtemp(prefix="tarmac-stream-")
    src = os.path.join(d, "src")
    ev.repartition(4).write.parquet(src)
    q = (ST.sliding_runway_load(ST.flight_stream(spark, src, ev.schema), "100 days").writeStream.outputMode("complete")
         .format("memory").queryName("st2_test").option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.window.start, r.Runway): r.flights for r in spark.table("st2_test").collect()}
    b = flights(spark, SF).groupBy(F.window(F.col("Scheduled_Time").cast("timestamp"), "1 hour", "15 minutes"), "Runway").count().collect()
    assert got == {(r.window.start, r.Runway): r["count"] for r in b}


def test_alert_sink_matches_m22_and_replays_add_nothing(spark):
    from tarmac.plans.queries_ml import m22

    ev = read_table(spark, SF, "events")
    d = tempfile.mkdtemp(prefix="tarmac-stream-")
    src, out = os.path.join(d, "src"), os.path.join(d, "alerts")
    ev.repartition(3).write.parquet(src)
    base = ST.alert_baseline(flights(spark, SF))
    q = ST.write_alerts(ST.flight_stream(spark, src, ev.schema), base, out, os.path.join(d, "ck"))
    q.awaitTermination()
    keep = ("Flight_ID", "Runway", "Anomaly_Type", "Severity", "Recommended_Action")
    rows = lambda df: sorted(tuple(r[c] for c in keep) for r in df.collect())
    want = rows(m22(spark, SF))
    assert want and rows(spark.read.parquet(out)) == want
    part = ST.flights_from_events(spark.read.parquet(src)).where("Delay_Minutes > 30")
    sink = ST.alert_sink(base, os.path.join(d, "again"))
    sink(part, 0)
    sink(part, 0)
    assert rows(spark.read.parquet(os.path.join(d, "again"))) == rows(base.alerts(part))
