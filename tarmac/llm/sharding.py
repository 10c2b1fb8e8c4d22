"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Items are groups of equal texts.  A group larger than 1/``PARTS`` of a shard in
any dimension is split by row (there are at most 3 x ``PARTS`` x shards of them),
so no hot group falls into one task or one shard.  Items are dealt by hash to
nodes of about ``NODE_ITEMS``; a node places its items, largest first, each into
the bin whose residual capacity has the highest dot product with the item.  The
bins of ``FAN_IN`` nodes are then items of a parent node, packed the same way, up
to one root: what a node leaves uneven its parent evens out.

The law is `bytes`: shard sizes are near equal.

Edge cases: a null text counts as empty (size 16); null doc_ids and rows repeated
whole are ordinary rows; ties go to the bin of the lower number; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import keep, shards_for, table, word_count

SHARDS = 40
PARTS = 32
NODE_ITEMS = 20_000
FAN_IN = 64
SLOT_ROWS = 20_000
DIMS = ("bytes", "tokens", "rows")
WEIGHTS = np.array([4.0, 1.0, 1.0])


def place(vectors: np.ndarray, bins: int) -> np.ndarray:
    """Bin of every item; items largest first, each to the highest dot product with residual capacity."""
    total = vectors.sum(axis=0)
    v = vectors * (bins / np.maximum(total, 1))
    weighted = v * WEIGHTS
    residual = np.ones((bins, v.shape[1]))
    out = np.zeros(len(v), np.int32)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        out[i] = b = int(np.argmax(residual @ weighted[i]))
        residual[b] -= v[i]
    return out


def _pack(items: DataFrame, shards: int) -> DataFrame:
    """items (node, id columns, dims) with the bin of each inside its node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in pdf.columns if c not in DIMS], kind="stable")
        return pdf.assign(bin=place(pdf[list(DIMS)].to_numpy(float), shards))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", bin int"
    return items.groupBy("node").applyInPandas(run, schema)


def place_items(items: DataFrame, n_items: int, shards: int) -> DataFrame:
    """(key, part, shard) for items (key, part, bytes, tokens, rows)."""
    nodes = shards_for(n_items, NODE_ITEMS)
    level = keep(_pack(items.withColumn("node", F.pmod(F.xxhash64("key", "part"), F.lit(nodes)).cast("long")), shards))
    placed = level.select("key", "part", "node", "bin")
    while nodes > 1:
        bins = level.groupBy("node", "bin").agg(*[F.sum(c).alias(c) for c in DIMS])
        nodes = shards_for(nodes, FAN_IN)
        up = bins.select(F.pmod("node", F.lit(nodes)).alias("node"), F.col("node").alias("child"), F.col("bin").alias("child_bin"), *DIMS)
        level = keep(_pack(up, shards))
        placed = placed.withColumnsRenamed({"node": "child", "bin": "child_bin"}).join(level.select("child", "child_bin", "node", "bin"), ["child", "child_bin"])
        placed = keep(placed.select("key", "part", "node", "bin"))
    return placed.select("key", "part", F.col("bin").alias("shard"))


def shard_rows(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (row_id, doc_id, key, bytes, tokens) with shard and a gapless slot inside it; ``key`` names the group."""
    rows = keep(rows.withColumn("rows", F.lit(1).cast("long")))
    sums = [F.sum(c).alias(c) for c in DIMS]
    groups = keep(rows.groupBy("key").agg(*sums))
    total = groups.agg(*sums, F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = [F.col(c) * F.lit(shards * PARTS) / F.lit(max(1, int(total[c]))) for c in DIMS]
    heavy = groups.select("key", F.ceil(F.greatest(*share)).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(F.broadcast(heavy), "key", "left")  # at most 3 x PARTS x shards groups exceed the share
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row_id"), F.col("parts"))).cast("int")
    rows = rows.withColumn("part", part).drop("parts")
    placed = place_items(rows.groupBy("key", "part").agg(*sums), int(total["n"]), shards)
    out = keep(rows.join(placed, ["key", "part"]))
    subs = shards_for(int(total["rows"]), shards * SLOT_ROWS)
    out = out.withColumn("sub", F.pmod(F.xxhash64("row_id"), F.lit(subs)))
    counts = out.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "sub", F.coalesce(before, F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "row_id"))
    return out.withColumn("nth", rank).join(offsets, ["shard", "sub"]).withColumn("slot", F.col("first") + F.col("nth") - 1).drop("first", "nth", "sub")


def op10_vector_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("key"), (F.octet_length(text) + 16).cast("long").alias("bytes"),
        word_count("text").alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard_rows(rows)
    return out.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
