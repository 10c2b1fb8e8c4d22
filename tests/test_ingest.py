import os
import tempfile

from pyspark.sql import functions as F

from tarmac.sources import ingest as S


def _sheet(spark):
    # S.No / flight number only on header rows; blanks, a non-breaking space and an empty row
    rows = [
        ("1", "AI101", "2024-01-15", "Mumbai (BOM)", "DEL", "A320", "135 min", "6:05", "6:20", "8:20", "Landed", "Landed 8:31 AM", 0),
        ("", "", "2024-01-16", "Mumbai (BOM)", "DEL", "A320", "135 min", "6:05", "6:10", "8:20", "Landed", "Landed 8:15 AM", 1),
        ("2", "6E234", "2024-01-15", "Mumbai (BOM)", "BLR", "A321", "100 min", "7:00", "", "8:40", "Landed", "Landed 8:40 AM", 2),
        ("", " ", "2024-01-16", "Chennai", "BLR", "A321", "100 min", "7:00", "7:30", "8:40", "Landed", "Landed 9:05 AM", 3),
        ("", "", "", "", "", "", "", "", "", "", "", "", 4),
    ]
    cols = ["S.No", "Flight Number", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "c9", "c10", "c11", "row_idx"]
    return spark.createDataFrame(rows, cols).withColumn("Time_Slot", F.lit("6AM - 9AM"))


def test_hierarchical_sheet_flatten(spark):
    df = S.rename_positional(_sheet(spark))
    assert df.columns[2:12] == S.POSITIONAL
    flat = S.flatten_hierarchy(df, ["S.No", "Flight Number"]).orderBy("row_idx").collect()
    assert [r["Flight Number"] for r in flat] == ["AI101", "AI101", "6E234", "6E234"]
    assert [r["S.No"] for r in flat] == ["1", "1", "2", "2"]


def test_clean_legacy_defaults(spark):
    df = S.flatten_hierarchy(S.rename_positional(_sheet(spark)), ["S.No", "Flight Number"])
    out = {r.row_idx: r for r in S.clean_legacy(df).collect()}
    assert out[0].Delay_Minutes == 15.0
    assert out[1].Delay_Minutes == 5.0
    assert out[2].Delay_Minutes == 0.0 and out[2].Actual_Time == out[2].Scheduled_Time  # ATD defaults to STD
    assert out[0].Capacity == 180 and out[0].Runway == "R1"


def test_drop_empty_and_duplicates(spark):
    df = spark.createDataFrame([("a", None, "x"), (None, None, None)], "k string, empty string, v string")
    out = S.drop_empty(df)
    assert out.columns == ["k", "v"] and out.count() == 1


def test_select_departures_and_profile(spark):
    df = S.rename_positional(_sheet(spark))
    dep = S.select_departures(df, col="from", required=("std",))
    assert dep.count() == 3  # the Chennai row and the empty row are dropped
    prof = {r.column: r for r in S.profile(df.select("std", "atd")).collect()}
    assert prof["std"].missing == 0 and prof["std"].rows == 5


def test_sheets_roundtrip_and_sink(spark):
    d = tempfile.mkdtemp(prefix="tarmac-ingest-")
    a, b = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    spark.createDataFrame([("AI101", "09R/27L", "5")], "flight_no string, rwy string, delay string").coalesce(1).write.option("header", True).csv(a)
    spark.createDataFrame([("6E234", "14/32")], "FlightNumber string, Runway string").coalesce(1).write.option("header", True).csv(b)
    u = S.map_columns(S.read_sheets(spark, {"6AM - 9AM": a, "9AM - 12PM": b}))
    got = sorted((r.Flight_ID, r.Runway, r.Time_Slot) for r in u.collect())
    assert got == [("6E234", "14/32", "9AM - 12PM"), ("AI101", "09R/27L", "6AM - 9AM")]
    f = S.fill_required(u.drop("Scheduled_Time") if "Scheduled_Time" in u.columns else u)
    f = f.withColumn("Delay_Minutes", S.to_num("Delay_Minutes", 0.0)) if "Delay_Minutes" in f.columns else f.withColumn("Delay_Minutes", F.lit(0.0))
    f = S.derive_columns(f)
    out = os.path.join(d, "out")
    S.write_table(f, out)
    assert spark.read.parquet(out).count() == 2


def test_ensure_time_from_std(spark):
    df = spark.createDataFrame([("08:05",), ("junk",)], "std string")
    got = [r.Scheduled_Time for r in S.ensure_time(df, "2024-01-15").collect()]
    assert str(got[0]) == "2024-01-15 08:05:00" and got[1] is None


def test_dense_index_over_partitions(spark):
    df = spark.range(1000).repartition(8).withColumn("v", F.col("id") * 2)
    got = sorted((r.row_idx, r.id) for r in S.dense_index(df, ["id"]).collect())
    assert got == [(i, i) for i in range(1000)]
    stored = S.dense_index(spark.range(100, numPartitions=9)).collect()
    assert sorted((r.row_idx, r.id) for r in stored) == [(i, i) for i in range(100)]


def test_fill_required_rules(spark):
    df = spark.createDataFrame([(i, "x") for i in range(120)], "row_idx long, note string").repartition(8)
    got = {r.row_idx: r for r in S.fill_required(df).collect()}
    assert got[7].Flight_ID == "FL0007" and got[7].Airline == "FL0" and str(got[7].Scheduled_Time) == "2024-01-01 09:30:00"
    assert str(got[119].Scheduled_Time) == "2024-01-03 17:30:00"
    hinted = spark.createDataFrame([(0, "zz9", None, "2024-02-03 10:00:00"), (1, "6E21", "bad", "2024-02-03 11:00:00")],
                                   "row_idx long, `Vehicle Number` string, `Arrival A` string, `Other time` string")
    got = {r.row_idx: r for r in S.fill_required(hinted).collect()}
    assert got[1].Flight_ID == "6E21" and got[1].Airline == "6E2" and got[0].Airline == "AA"
    assert str(got[0].Scheduled_Time) == "2024-02-03 10:00:00"




def test_fill_down_over_blocks_equals_one_pass(spark):
    import random

    rng = random.Random(3)
    rows, want, last = [], {}, {}
    for i in range(400):
        sheet = "AB"[i % 2]
        v = rng.choice(["", " ", None, None, f"v{i}"])
        rows.append((i, sheet, v))
        if v and v.strip():
            last[sheet] = v
        want[i] = last.get(sheet)
    df = spark.createDataFrame(rows, "row_idx long, Time_Slot string, k string")
    assert {r.row_idx: r.k for r in S.fill_down(df, ["k"], block=16).collect()} == want


def test_clean_legacy_keeps_given_values(spark):
    df = spark.createDataFrame([("AI101", "2024-01-15", "6:05", "6:20", "30", "14/32", "220"), ("77", "2024-01-15", "7:00", None, None, None, "?")],
                               "Flight_ID string, Date string, std string, atd string, delay_minutes string, runway string, capacity string")
    a, b = sorted(S.clean_legacy(df).collect(), key=lambda r: r.Flight_ID, reverse=True)
    assert (a.Delay_Minutes, a.Runway, a.Capacity, a.Airline) == (30.0, "14/32", 220.0, "AI")
    assert (b.Delay_Minutes, b.Runway, b.Capacity, b.Airline) == (0.0, "R1", 180.0, "XX")


def test_every_alias_maps(spark):
    for target, names in S.ALIASES.items():
        for n in names:
            spelt = n.replace("_", " ").title()
            assert target in S.map_columns(spark.createDataFrame([("v",)], f"`{spelt}` string")).columns, n
