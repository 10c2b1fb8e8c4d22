"""Physical-plan shape checks: joins stay equi-joins, filters and columns reach the scan."""

import re

import __spark_entry__ as E
from paths import SF


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_range_joins_are_equi_joins(spark):
    for name in ("g06_passenger_edges", "j08_slot_pairs", "g07_build_network"):
        p = _plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
    # triangle closing is an equi-join; the only nested-loop joins left combine one-row totals
    assert "CartesianProduct" not in _plan(spark, "g16_network_metrics")


def test_flight_view_prunes_scan_columns(spark):
    p = _plan(spark, "a01_hour_dow_stats")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "props" not in schema and "event_type" not in schema


def test_date_filter_pushed_to_parquet(spark):
    p = _plan(spark, "f01_filter_flights")
    pushed = re.search(r"PushedFilters: \[([^\]]*)", p).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_group_counts_do_not_sort_facts_per_key(spark):
    p = _plan(spark, "j02_group_counts")
    assert "HashAggregate" in p and p.count("FileScan") == 2  # windows run over the groups, not over the facts


def test_anomaly_features_scan_bound(spark):
    assert _plan(spark, "m18_anomaly_features").count("FileScan") <= 6


def test_no_exact_percentile_over_facts(spark):
    for name in ("a04_delay_summary", "a36_describe", "w11_quantile_flags"):
        assert "percentile(" not in _plan(spark, name), name
