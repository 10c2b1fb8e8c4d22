"""Connected components of an edge table by contraction: each round ends with the local minima as the new nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import cut_lineage, drop_cuts


def _to_roots(parent: DataFrame) -> DataFrame:
    """Pointer jumping over a cut (node, parent) until every node names its root; the depth halves each time."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = cut_lineage(parent.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("next"), "parent"), parent)
        if step.where(F.col("next") != F.col("parent")).isEmpty():
            return step
        parent = step.select("node", F.col("next").alias("parent"))
        parent._cut_path = step._cut_path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is some node of its component.

    A node points to its neighbour with the least hash if that is less than its
    own, so pointer chains stay short whatever the numbering.  Contracted edges
    join the roots; at least half of the nodes with edges vanish each round, and
    rounds go on until no edge is left.
    """
    labels, mine = None, None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        key = lambda c: F.struct(F.xxhash64(c, F.lit(7)).alias("h"), F.col(c).alias("v"))
        least = both.groupBy("node").agg(F.min(key("to")).alias("best"))
        parent = least.select("node", F.when(F.col("best") < key("node"), F.col("best.v")).otherwise(F.col("node")).alias("parent"))
        roots = _to_roots(cut_lineage(parent))
        if labels is None:
            labels = cut_lineage(roots.select("node", F.col("parent").alias("root")))
        else:
            up = roots.select(F.col("node").alias("root"), F.col("parent").alias("top"))
            labels = cut_lineage(labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), labels)
        a = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        joined = edges.join(a, "a").join(b, "b").where("ra <> rb")
        mine = cut_lineage(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), mine)
        drop_cuts(roots)
        edges = mine
        if edges.isEmpty():
            return labels
