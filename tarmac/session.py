"""Session helpers: one place for the Spark settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC, AQE and Arrow enabled.

    On a cluster the master, memory and checkpoint folder come from the
    submit configuration; locally we only fill what is unset.
    """
    builder = SparkSession.builder.appName("tarmac")
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Settings that the operators' results depend on (applied to any session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets this to a shared file system and is refused without it; a
    single-JVM master (local tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if not local and not conf_dir:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="tarmac-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, *replaces: DataFrame | None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Like a reliable checkpoint the files survive lost executors, but the frame
    read back has the true size of its rows: ``checkpoint()`` keeps the size
    *estimate* of the plan it cuts, which squares with every self-join of a
    loop.  Files are neither compressed nor dictionary-coded, so that a size on
    disk is also a fair size in memory (broadcast decisions rest on it).

    ``replaces``: earlier cuts that nothing reads once this one is written;
    their files are removed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    drop_cuts(*replaces)
    return out


def drop_cuts(*frames: DataFrame | None) -> None:
    """Remove the files of cuts that nothing reads any more (frames that are no cuts are passed over)."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            df._cut_path = None


ROWS_A_TASK, BYTES_A_TASK = 50_000, "16m"


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans run inside have a shuffle partition for every ``ROWS_A_TASK`` of ``rows``, if that is more than the session's number,
    and adaptive execution joins them up to ``BYTES_A_TASK`` only, so that a task's memory does not grow with the table."""
    count = "spark.sql.shuffle.partitions"
    with _set(spark, {count: str(max(int(spark.conf.get(count)), -(-rows // ROWS_A_TASK))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": BYTES_A_TASK}):
        yield


@contextmanager
def wide_rows(spark: SparkSession) -> Iterator[None]:
    """Plans run inside compute many columns at once: generated methods too long for the JVM to compile are cut by operator."""
    with _set(spark, {"spark.sql.codegen.hugeMethodLimit": "8000"}):
        yield


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
