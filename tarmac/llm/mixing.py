"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``SHARE`` = 150 % of all words; a target stops at ``CAP`` = 2 times its source's
words, the excess is reshared by weight until none is above.  A document's rate
is target / source words: its whole part is copied for certain, its fraction is
a copy probability.

Rounding: two documents with fractional probabilities p, q and sizes a, b move
mass so that a p + b q stays: with a chance that keeps both expectations, p gains
and q loses or the reverse, until one of them is 0 or 1.  The other goes on to
the next pair.  A task rounds one bucket of about ``NODE_ROWS`` rows of a source
and leaves at most one fractional document; these residuals go up a tree of
fan-in ``FAN_IN`` until one is left per source, which a fair draw settles.  So a
source's words differ from its target by less than one document.

Draws are seeded by ids, so reruns agree.  Rows whose doc_id is null or repeated
are dealt by (doc_id, row number), so that no node holds all of them and equal
ids have draws of their own.  Edge cases: null text: size 0; empty
texts are copied by an independent draw at their source's rate and take no
words; a null source is a source of its own, last in order; null doc_ids and rows
repeated whole are ordinary rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import keep, table, word_count

SHARE = 1.5
CAP = 2.0
WEIGHTS = (5, 2, 1)
NODE_ROWS = 4096
FAN_IN = 256


def ranked(df: DataFrame, column: str) -> DataFrame:
    """``df`` with rank (from 0) in the order of ``column``, null last: range partitions, then counts before each."""
    order = F.col(column).asc_nulls_last()
    cut = keep(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    counts = cut.groupBy("__part").count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # one row a partition
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return cut.withColumn("__nth", nth).join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + F.col("__nth") - 1).drop("__part", "__before", "__nth")


def source_targets(rows: DataFrame) -> DataFrame:
    """source, rank, source_rows, source_size, target of every source."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("rank", F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = keep(ranked(per, "source").withColumn("weight", weight))
    top, level, capped = F.col("source_size") * F.lit(CAP), 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > top
        s = per.agg(
            F.sum("source_size").alias("size"), F.sum(F.when(over, top).otherwise(0.0)).alias("full"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(over).alias("capped"),
        ).first()
        if not s["size"] or not s["free"] or s["capped"] == capped:
            break
        capped, level = s["capped"], (SHARE * s["size"] - s["full"]) / s["free"]
    return per.select("source", "rank", "source_rows", "source_size", F.least(F.col("weight") * F.lit(level), top).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds probabilities pairwise, keeping sum(size * p); returns them and the index left fractional (-1: none)."""
    p, draws, held = p.tolist(), rng.random(len(p)).tolist(), -1
    size = size.tolist()
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        ratio = size[held] / size[i]
        up = min(1.0 - p[held], p[i] / ratio)
        down = min(p[held], (1.0 - p[i]) / ratio)
        if draws[i] * (up + down) < down:
            filled, emptied = up == 1.0 - p[held], up == p[i] / ratio
            p[held] = 1.0 if filled else p[held] + up
            p[i] = 0.0 if emptied else p[i] - up * ratio
        else:
            emptied, filled = down == p[held], down == (1.0 - p[i]) / ratio
            p[held] = 0.0 if emptied else p[held] - down
            p[i] = 1.0 if filled else p[i] + down * ratio
        if not 0.0 < p[held] < 1.0:
            held = i if 0.0 < p[i] < 1.0 else -1
    return np.array(p), held


ROW = "row_id long, doc_id long, salt long, size long, source_size long, target double, rank long, node long, whole long, p double, h long"


def _round_nodes(rows: DataFrame, level: int) -> DataFrame:
    """Every node rounds its rows in hash order of the ids; a row left fractional keeps 0 < p < 1."""

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort([t[c].to_numpy() for c in ("row_id", "size", "h")])
        t = t.take(pa.array(order))
        rng = np.random.default_rng([level, t["rank"][0].as_py(), t["node"][0].as_py()])
        p, _ = pivot(t["p"].to_numpy(), t["size"].to_numpy().astype(float), rng)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))

    return keep(rows.groupBy("rank", "node").applyInArrow(run, ROW))


def mix(rows: DataFrame) -> DataFrame:
    """rows (row_id, doc_id, source, size) with source_size, target and copies."""
    rows = keep(rows)
    targets = source_targets(rows)
    many = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__id"))
    salt = F.when(F.col("__id").isNotNull() | F.col("doc_id").isNull(), F.col("row_id") + 1).otherwise(F.lit(0))
    rows = keep(rows.join(many, F.col("doc_id") == F.col("__id"), "left").withColumn("salt", salt.cast("long")).drop("__id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(SHARE))
    seat = F.pmod(F.xxhash64("doc_id", "salt", F.lit(11)), F.ceil(F.col("source_rows") / F.lit(NODE_ROWS)))
    full = rows.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    full = full.withColumn("rate", F.least(rate, F.lit(CAP))).select(
        "row_id", "doc_id", "salt", "size", "source_size", "target", "rank", seat.cast("long").alias("node"),
        F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
        F.xxhash64("doc_id", "salt").alias("h"),
    )
    # texts without words move no mass: an independent draw
    draw = (F.pmod(F.xxhash64("doc_id", "salt", F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("p")).cast("double")
    done = [full.where("size = 0").withColumn("p", draw), full.where("size > 0 AND p = 0")]
    open_rows, level = full.where("size > 0 AND p > 0"), 0
    while True:
        rounded = _round_nodes(open_rows, level)
        done.append(rounded.where("p = 0 OR p = 1"))
        left = rounded.where("p > 0 AND p < 1")
        last = left.agg(F.max("node")).first()[0]
        if not last:  # one residual a source at most
            settle = (F.pmod(F.xxhash64("doc_id", "salt", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("p")).cast("double")
            done.append(left.withColumn("p", settle))
            break
        open_rows, level = left.withColumn("node", F.floor(F.col("node") / F.lit(FAN_IN)).cast("long")), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("row_id", "doc_id", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def op3_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows = table(spark, sf_dir, "documents").select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size")
    )
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document appears as often as the mix takes it (0, 1 or 2 times), with all its columns."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = numbered.select(F.col("__row").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"))
    taken = mix(rows).where("copies > 0").select(F.col("row_id").alias("__row"), F.col("copies").cast("int").alias("__copies"))
    return numbered.join(taken, "__row").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*[f"`{c}`" for c in docs.columns])
