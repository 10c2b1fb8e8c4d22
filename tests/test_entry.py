import __spark_entry__ as E
from paths import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "Congestion_Score" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 150


def test_every_query_builds_a_plan(spark):
    # building (not running) each plan catches schema errors cheaply; iterative ones act while building
    skip = ("g08", "g09", "g11", "m0", "m1", "m2", "a49", "a52", "a53", "o0", "a46", "a47")
    for name, fn in E.queries().items():
        if name.startswith(skip):
            continue
        fn(spark, SF).schema
