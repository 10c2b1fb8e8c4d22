"""Hard-negative mining by Fagin's threshold algorithm.

Anchors meet candidates in cells: first an anchor's positives (the best rows of its own label) are searched among the
cells of that label, then every positive's window of scores is searched among all cells.  A cell holds a bounded number
of rows and, for each dimension, the rows sorted by that component.  For one anchor the lists are read side by side, from
the top where the anchor's component is positive and from the bottom where it is negative (sorted access).  Every row met
for the first time is scored whole, in integers (random access).  The threshold is the score that a row standing at the
present depth of every list would have; no unseen row can exceed it.  A window's search ends once the threshold falls
strictly below the score of its last wanted row (equal scores go by id, so they must have been seen), or below the
window's lower end where it has fewer rows.  The cells' answers are merged by a limited window.

A label of any size is cut in cells of rows, its anchors in groups, so neither a hot label nor a hot vector meets one
task.  Scores are integers, exact in float64 below 2^52; beyond, a cell falls back to Python integers and scores every
row.  A score that no 64-bit integer holds counts as the nearest one.

Edge cases: rows with a null id, null label, null vector or a null or non-finite component take no part; an empty vector
and missing trailing components count as zeros; rows that repeat a vec_id are rows of their own (anchors, positives and
negatives each); ties go to the smaller vec_id; an anchor without positives, or a positive of negative score (its window
is empty), gives no row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import keep, shards_for, table
from tarmac.llm.topk import packed_vectors, stack

ANCHOR_EVERY = 50
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # a negative's score in percent of its positive's
CELL_VALUES = 1 << 19  # rows x dimensions of a cell
CELL_ANCHORS = 1024
DEPTH = 16  # first depth of sorted access; doubles
I64 = np.iinfo(np.int64)


def sorted_lists(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of every dimension in ascending order of value (dimension by row)."""
    order = np.argsort(c.T, axis=1, kind="stable").astype(np.int32)
    return order, np.take_along_axis(np.ascontiguousarray(c.T), order, axis=1)


def threshold_search(anchor: np.ndarray, c: np.ndarray, order: np.ndarray, values: np.ndarray, done) -> tuple[np.ndarray, np.ndarray]:
    """Rows seen and their scores when ``done(scores, rows, threshold)`` first holds, or all rows.

    ``c`` in float64 holding integers; ``order`` and ``values`` of ``sorted_lists``.
    """
    n = len(c)
    use = np.flatnonzero(anchor)
    if not len(use):  # every score is zero
        return np.arange(n), np.zeros(n)
    weight, up = anchor[use], anchor[use] > 0
    order, values = order[use], values[use]
    seen = np.zeros(n, bool)
    rows, scores = np.empty(0, np.int64), np.empty(0)
    at, depth = 0, DEPTH
    while True:
        to = min(n, depth)
        read = np.concatenate([order[up, n - to:n - at].ravel(), order[~up, at:to].ravel()])
        fresh = np.zeros(n, bool)
        fresh[read] = True
        fresh &= ~seen
        new = np.flatnonzero(fresh)
        seen |= fresh
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, c[new] @ anchor])
        if to == n or len(rows) == n:
            return rows, scores
        last = np.where(up, values[:, n - to], values[:, to - 1])
        if done(scores, rows, float(weight @ last)):
            return rows, scores
        at, depth = to, depth * 2


def kth(scores: np.ndarray, k: int, otherwise: float) -> float:
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else otherwise


class Cell:
    """Candidate rows of one cell with their lists; scores an anchor by the threshold algorithm."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, row_ids: np.ndarray, vectors: np.ndarray, anchors: np.ndarray):
        dims = max(vectors.shape[1], anchors.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
        vectors, self.anchors = pad(vectors), pad(anchors)
        self.ids, self.labels, self.row_ids = ids, labels, row_ids
        top = [max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0 for m in (vectors, anchors)]
        self.exact = vectors.astype(object) if dims * top[0] * top[1] >= 1 << 52 else None
        if self.exact is None:
            self.c, (self.order, self.values) = vectors.astype(np.float64), sorted_lists(vectors)

    def search(self, i: int, done) -> tuple[np.ndarray, np.ndarray]:
        """(rows, their int64 scores) that the i-th anchor has to look at."""
        if self.exact is not None:
            scores = [max(I64.min, min(I64.max, int(s))) for s in self.exact @ self.anchors[i].astype(object)] if self.exact.shape[1] else [0] * len(self.ids)
            return np.arange(len(self.ids)), np.array(scores, np.int64)
        rows, scores = threshold_search(self.anchors[i].astype(np.float64), self.c, self.order, self.values, done)
        return rows, scores.astype(np.int64)

    def positives(self, i: int, own_row: int) -> Iterator[tuple[int, int, int]]:
        """(vec_id, row_id, score) of the anchor's best rows in a cell of its label."""

        def done(scores, rows, threshold):
            return threshold < kth(scores[self.row_ids[rows] != own_row], POSITIVES, -np.inf)

        rows, scores = self.search(i, done)
        other = self.row_ids[rows] != own_row
        rows, scores = rows[other], scores[other]
        for j in np.lexsort((self.row_ids[rows], self.ids[rows], -scores.astype(object) if self.exact is not None else -scores))[:POSITIVES]:
            yield int(self.ids[rows[j]]), int(self.row_ids[rows[j]]), int(scores[j])

    def negatives(self, i: int, label: int, positive_scores: list[int]) -> Iterator[tuple[int, int, int]]:
        """(number of the positive, row, score) of the best rows of other labels in each positive's window."""
        windows = [(-(-LOW * p // 100), HIGH * p // 100) for p in positive_scores]

        def inside(scores, rows, low, high):
            return (scores >= low) & (scores <= high) & (self.labels[rows] != label)

        def done(scores, rows, threshold):
            return all(low > high or threshold < kth(scores[inside(scores, rows, low, high)], NEGATIVES, low) for low, high in windows)

        if all(low > high for low, high in windows):
            return
        rows, scores = self.search(i, done)
        for n, (low, high) in enumerate(windows):
            on = np.flatnonzero(inside(scores, rows, low, high))
            for j in on[np.lexsort((self.row_ids[rows[on]], self.ids[rows[on]], -scores[on]))[:NEGATIVES]]:
                yield n, int(rows[j]), int(scores[j])


def labelled_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """row_id, vec_id, v (packed integers), label (long) of the rows that take part."""
    return packed_vectors(rows.where(F.col(label_col).isNotNull()), id_col, vector_col, F.col(label_col).cast("long").alias("label"))


def _pieces(n: int) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _split(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Cell] | None:
    ask = pdf["ask"].to_numpy(bool)
    if not ask.any() or ask.all():
        return None
    anchors, c = pdf[ask].reset_index(drop=True), pdf[~ask].sort_values("vec_id", kind="stable")
    return anchors, Cell(c["vec_id"].to_numpy(np.int64), c["label"].to_numpy(np.int64), c["row_id"].to_numpy(np.int64), stack(c["v"].to_numpy()), stack(anchors["v"].to_numpy()))


def positives(vectors: DataFrame, anchors: DataFrame, cell_rows: int, cell_anchors: int = CELL_ANCHORS) -> DataFrame:
    """anchor_row, positive_id, positive_row, positive_score, nth: the best other rows of each anchor's label."""
    hashed = lambda n, salt: F.pmod(F.xxhash64("row_id", F.lit(salt)), n)
    cut = lambda rows, per, name: rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(per)).cast("long").alias(name))
    cells = cut(anchors, cell_anchors, "groups").join(cut(vectors, cell_rows, "cells"), "label")  # labels with anchors only
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    candidates = vectors.join(cells, "label").withColumn("cell", hashed(F.col("cells"), 1)).withColumn("grp", upto("groups")).withColumn("ask", F.lit(False))
    asking = anchors.join(cells, "label").withColumn("grp", hashed(F.col("groups"), 2)).withColumn("cell", upto("cells")).withColumn("ask", F.lit(True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got, split = [], _split(pdf)
        if split:
            for i, row in enumerate(split[0]["row_id"].tolist()):
                got += [(row, *p) for p in split[1].positives(i, row)]
        return pd.DataFrame(got, columns=["anchor_row", "positive_id", "positive_row", "positive_score"], dtype="int64")

    found = candidates.unionByName(asking).groupBy("label", "cell", "grp").applyInPandas(run, "anchor_row long, positive_id long, positive_row long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.col("positive_score").desc(), "positive_id", "positive_row"))
    return found.withColumn("nth", place).where(F.col("nth") <= POSITIVES)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, cell_rows: int | None = None, cell_anchors: int = CELL_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for cut tables (row_id, vec_id, v, label)."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), (F.max(F.octet_length("v")) / 8).cast("long").alias("dims")).first()
    cell_rows = cell_rows or max(256, min(8192, CELL_VALUES // max(1, size["dims"] or 1)))
    found = keep(positives(vectors, anchors, cell_rows, cell_anchors))
    per = found.groupBy(F.col("anchor_row").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("windows"))  # at most five
    asking = keep(anchors.join(per, "row_id"))
    across, down = shards_for(asking.count(), cell_anchors), shards_for(size["n"], cell_rows)
    deal = lambda n, salt: F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(n)).cast("int")
    nothing = F.lit(None).cast(asking.schema["windows"].dataType)
    left = vectors.withColumn("windows", nothing).withColumn("cell", deal(down, 3)).withColumn("grp", _pieces(across)).withColumn("ask", F.lit(False))
    right = asking.withColumn("grp", deal(across, 4)).withColumn("cell", _pieces(down)).withColumn("ask", F.lit(True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got, split = [], _split(pdf)
        if split:
            rows, cell = split
            for i, (row, anchor, label, windows) in enumerate(zip(rows["row_id"].tolist(), rows["vec_id"].tolist(), rows["label"].tolist(), rows["windows"])):
                scores = [int(w["positive_score"]) for w in windows]
                for n, j, score in cell.negatives(i, label, scores):
                    got.append((row, anchor, int(windows[n]["nth"]), int(windows[n]["positive_id"]), scores[n], int(cell.ids[j]), int(cell.row_ids[j]), score))
        return pd.DataFrame(got, columns=["anchor_row", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_row", "negative_score"], dtype="int64")

    schema = "anchor_row long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_row long, negative_score long"
    best = left.unionByName(right).groupBy("cell", "grp").applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "nth").orderBy(F.col("negative_score").desc(), "negative_id", "negative_row"))
    return best.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Three hard negatives for every 50th vector and each of its five positives, against all rows."""
    rows = labelled_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vectors = keep(rows.withColumn("label", moved))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % ANCHOR_EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, c.rid AS crid, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.rid <> c.rid WHERE a.vec_id % 50 = 0
), p AS (
  SELECT arid, anchor_id, crid AS prid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.arid, p.prid ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
