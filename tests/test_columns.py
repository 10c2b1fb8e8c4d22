from pyspark.sql import functions as F

from tarmac.functions import columns as C
from tarmac.sources import ingest as S


def test_delay_bins_right_closed(spark):
    vals = [-5.0, 0.0, 5.0, 15.0, 15.01, 30.0, 45.0, 60.0, 60.01, None]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r[0] for r in df.select(C.delay_category("d")).collect()]
    assert got == ["On_Time", "On_Time", "Minor", "Minor", "Moderate", "Moderate", "Major", "Major", "Severe", None]


def test_capacity_bucket_edges(spark):
    caps = [0, 49, 50, 149, 150, 151, 200, 250, 251, 350, 351]
    df = spark.createDataFrame([(c,) for c in caps], "c int")
    got = [r[0] for r in df.select(C.capacity_bucket("c")).collect()]
    assert got == [None, "Small", "Small", "Small", "Small", "Medium", "Medium", "Large", "XLarge", "XLarge", None]
    pri = [r[0] for r in df.select(C.flight_priority(F.lit(False), F.lit(False), F.col("c"))).collect()]
    assert pri == [5, 5, 4, 4, 3, 3, 3, 3, 3, 3, 3]


def test_clock_parse_and_wrap(spark):
    df = spark.createDataFrame([("12:10 AM",), ("12:10 PM",), ("Landed 8:05 PM",), ("n/a",)], "t string")
    got = [r[0] for r in df.select(S.parse_ampm("t")).collect()]
    assert got == [10, 730, 1205, None]
    d = spark.createDataFrame([(20, 23 * 60 + 50), (23 * 60 + 55, 5)], "a int, s int")
    assert [r[0] for r in d.select(S.clock_diff("a", "s")).collect()] == [30, -10]


def test_to_num_lenient(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,)], "x string")
    assert [r[0] for r in df.select(S.to_num("x", 0.0)).collect()] == [1.5, 0.0, 0.0]


def test_map_columns_coalesce_left_to_right(spark):
    df = spark.createDataFrame([(None, "A1"), ("B2", "X")], "`Flight Number` string, flight_id string")
    got = [r[0] for r in S.map_columns(df).select("Flight_ID").collect()]
    assert got == ["A1", "B2"]
