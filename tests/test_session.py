"""The cut of loops: true sizes, constant time a round, files of earlier rounds removed."""

import time

import pytest
from pyspark.sql import functions as F

from tarmac.operators.components import components
from tarmac.session import cut_lineage, drop_cuts


def _files(spark):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    return {f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}


@pytest.mark.parametrize("n", [500, 5000])
def test_long_integer_path_is_one_component(spark, n):
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(10**6, 10**6 + 1)], "a long, b long"))
    before, t = _files(spark), time.perf_counter()
    got = components(edges).groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("least")).collect()
    assert time.perf_counter() - t < 60
    assert sorted((r["least"], r["n"]) for r in got) == [(0, n + 1), (10**6, 2)]
    assert len([f for f in _files(spark) - before if f.startswith("cut-")]) <= 2  # the labels, and the last (empty) edges


def test_self_joins_with_cuts_take_constant_time_a_round(spark):
    df = cut_lineage(spark.range(300).select("id", F.col("id").alias("v")))
    times, sizes = [], []
    for _ in range(12):
        t = time.perf_counter()
        df = cut_lineage(df.join(df.select("id", F.col("v").alias("w")), "id").select("id", F.greatest("v", "w").alias("v")), df)
        times.append(time.perf_counter() - t)
        sizes.append(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert df.count() == 300 and max(sizes) < 10 * min(sizes) < 10**6
    assert sorted(times)[-3] < 5 * sorted(times)[2] + 0.5


def test_cut_keeps_rows_types_and_empty_tables(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS i, array(1.5D, NULL) AS a, named_struct('x', TIMESTAMP_NTZ '2024-01-01 00:00:00') AS s, binary('z') AS `odd name`")
    cut = cut_lineage(df)
    assert cut.collect() == df.collect() and cut.dtypes == df.dtypes
    assert cut_lineage(df.where("i = 1")).count() == 0
    drop_cuts(cut, df, None)
    drop_cuts(cut)


def test_settings_of_a_block_end_with_it(spark):
    from tarmac import session as S

    keys = ("spark.sql.codegen.hugeMethodLimit", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    with S.wide_rows(spark), S.partitions_for(spark, 1_000_000):
        assert [spark.conf.get(k) for k in keys] == ["8000", "20"]
    assert [spark.conf.get(k) for k in keys] == before
