"""Connections that are time windows, without lists of pairs.

A rule links a source to every point of its key whose time lies in a window
after the source's time.  Points are ranked inside (key, block of time), and a
source's window is a range of ranks in at most a few blocks, found by counting
points and window ends in one ordered pass.  Counts of links are differences of
ranks.  The largest weight over all sources whose range holds a point comes from
dyadic pieces: a range is at most two pieces a level, a point lies in one piece
a level, so both sides are equi-joins whose size grows with rows, not pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def ranked(points: DataFrame, ends: DataFrame, group: list[str]) -> DataFrame:
    """Rows of both with ``rank``: how many points of the group stand before (a point: itself not counted).

    ``points`` and ``ends`` share their columns, ``group`` and time ``t`` among them; ``side`` orders equal times:
    0 window starts, 1 points, 2 window ends.
    """
    rows = points.unionByName(ends)
    w = Window.partitionBy(*group).orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum((F.col("side") == 1).cast("long")).over(w)
    return rows.withColumn("rank", count - (F.col("side") == 1).cast("long"))


def window_ranges(points: DataFrame, sources: DataFrame, low: int, high: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Points (id, key, block, t, rank) and ranges (id, key, block, a, b): points of ranks a to b - 1 lie low to high after the source.

    ``points``, ``sources``: (id, key, t in microseconds).
    """
    p = points.select("id", "key", F.floor(F.col("t") / block).alias("block"), "t", F.lit(1).alias("side"))
    blocks = F.explode(F.sequence(F.floor((F.col("t") + low) / block), F.floor((F.col("t") + high) / block)))
    per = sources.withColumn("block", blocks)
    two = F.explode(F.array(F.struct((F.col("t") + low).alias("t"), F.lit(0).alias("side")), F.struct((F.col("t") + high).alias("t"), F.lit(2).alias("side"))))
    ends = per.select("id", "key", "block", two.alias("e")).select("id", "key", "block", "e.t", "e.side")
    rows = ranked(p, ends, ["key", "block"])
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("rank")))
    ranges = rows.where("side <> 1").groupBy("id", "key", "block").agg(at(0).alias("a"), at(2).alias("b")).where("a < b")
    return rows.where("side = 1").select("id", "key", "block", "t", "rank"), ranges


def pieces(a: Column, b: Column, levels: int) -> Column:
    """The dyadic pieces (level, n) of ranks a to b - 1, as an array of structs."""
    out = []
    for k in range(levels):
        left, right = F.ceil(a / (1 << k)), F.floor(b / (1 << k))
        piece = lambda n: F.struct(F.lit(k).alias("level"), n.cast("long").alias("n"))
        out.append(F.when((left % 2 == 1) & (left < right), piece(left)))
        out.append(F.when((right % 2 == 1) & (left < right), piece(right - 1)))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def point_pieces(rank: Column, levels: int) -> Column:
    return F.transform(F.array(*[F.lit(k) for k in range(levels)]), lambda k: F.struct(k.alias("level"), F.floor(rank / F.pow(F.lit(2.0), k)).alias("n")))
