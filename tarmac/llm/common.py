"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.session import cut_lineage, ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """Session settings of the operators: a shared checkpoint folder and small Arrow batches.

    A batch of documents holds whole texts, so the row count of a batch bounds
    a Python worker's memory.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def ship_package(spark: SparkSession) -> None:
    """Sends the package's modules to the executors' Python workers, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tarmac_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tarmac-"), "tarmac_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._tarmac_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    return cut_lineage(df)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words of lower-cased bytes: bytes.split() cuts at exactly \\x20 and \\x09-\\x0D, lower() changes only A-Z."""
    return text.lower().split()


def word_count(column: str) -> F.Column:
    """Number of words of a text column (null: 0), JVM side."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def doc_crc_mod(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the id written as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def shards_for(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


def places(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` among the rows of ``key``: range-sorted, counted by partition."""
    cut = keep(rows.repartitionByRange(*key, *order).withColumn("__part", F.spark_partition_id()))
    counts = cut.groupBy("__part", *key).agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select("__part", *key, F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy("__part", *key).orderBy(*order))
    return cut.withColumn("__within", within).join(ahead, ["__part", *key]).withColumn(name, (F.col("__ahead") + F.col("__within")).cast("long")).drop("__part", "__within", "__ahead")
