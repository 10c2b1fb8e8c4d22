"""Corpus pipeline: five stages over documents, each one operator of ``tarmac.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared checkpoint folder and rereads it for the
next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import exact_dedup, mixing, packing, simhash, toxicity
from tarmac.llm.common import prepare, table
from tarmac.session import ensure_checkpoint_dir


def _stage(fn):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, docs, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


STAGES = [
    ("toxicity", _stage(toxicity.stage_toxicity)),
    ("exact_dedup", _stage(exact_dedup.stage_exact_dedup)),
    ("simhash_near_dedup", _stage(simhash.stage_simhash_near_dedup)),
    ("mixing", _stage(mixing.stage_mixing)),
    ("packing", _stage(packing.stage_packing)),
]

#: Mixing and packing are randomised or model-based, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    prepare(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
