"""Exact top-k inner products by columnar branch-and-bound.

Queries and candidates are dealt to a grid of cells of at most about
``CELL_CANDIDATES`` candidates and ``CELL_QUERIES`` queries, so every query meets
every candidate once and a cell's memory is bounded.  In a cell the candidates
lie dimension by dimension (vertical layout).  For one query the inner product is
accumulated block of dimensions by block; after each block the partial sum plus or
minus |rest of query| * |rest of candidate| (the most that the remaining dimensions
can change) bounds every candidate.  The k-th best lower bound raises the query's
floor, and only candidates whose upper bound reaches the floor survive and are
compacted.  Each cell gives its k best a query; the k best of those are the answer.

The floors start from a first pass over the ``CELL_CANDIDATES`` longest vectors, so
all cells share them.  A candidate shorter than floor / |query| for every query of a
group cannot reach any of them and is not copied to that group.

Scores are integers, exact in float64 below 2^52; beyond, a cell falls back to
Python integers without bounds.  A score that no 64-bit integer holds is given as
the nearest one.

Edge cases: vectors null, without id, or with null or non-finite components take
no part; rows that repeat a vec_id are rows of their own, as queries and as
candidates; shorter vectors count as padded with zeros; ties go to the smaller
vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import keep, shards_for, table

TOP = 5
QUERY_EVERY = 50
SCALE = 256
CELL_CANDIDATES = 8192
CELL_QUERIES = 1024
BLOCKS = (16, 16, 32)


def blocks_of(dims: int) -> list[slice]:
    """Dimension blocks; the last width repeats over wider vectors."""
    out, at, i = [], 0, 0
    while at < dims:
        width = BLOCKS[min(i, len(BLOCKS) - 1)]
        out.append(slice(at, min(dims, at + width)))
        at, i = at + width, i + 1
    return out


def packed_vectors(rows: DataFrame, id_col: str, vector_col: str, *extra: F.Column) -> DataFrame:
    """row_id, vec_id, v (floor(SCALE * x) of each component as int64 bytes) and ``extra`` of every row that takes part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))
    good = rows.where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
    one = good.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), *extra)
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'v' else f.dataType.simpleString()}" for f in one.schema.fields)

    def pack(batches):
        for b in batches:
            w = b.column(2)
            flat, at = w.flatten().to_numpy(zero_copy_only=False).astype("<i8"), np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            packed = pa.array([flat[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == 2 else c for i, c in enumerate(b.columns)], b.schema.names)

    return one.mapInArrow(pack, schema)


def stack(packed) -> np.ndarray:
    """int64 matrix of the packed vectors, zero-padded to the longest."""
    rows = [np.frombuffer(b, "<i8") for b in packed]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def raised(floor: float, lower: np.ndarray, top: int) -> float:
    """The floor after ``top`` candidates are sure of their lower bounds."""
    return max(floor, float(np.partition(lower, len(lower) - top)[len(lower) - top])) if len(lower) >= top else floor


def cell_top(q_rows: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray, top: int = TOP):
    """(query row, candidate id, candidate row, score) of each query's best ``top`` candidates of the cell that reach its floor."""
    dims = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, c))
    order = np.lexsort((c_rows, c_ids))
    c_ids, c_rows, c = c_ids[order], c_rows[order], c[order]
    largest = [int(max(abs(int(m.max())), abs(int(m.min())))) if m.size else 0 for m in (q, c)]
    if dims * largest[0] * largest[1] >= 1 << 52:
        exact = c.astype(object)
        for own, row in zip(q_rows, q.astype(object)):
            best = sorted((-int(x), int(k), int(r)) for x, k, r in zip(exact @ row, c_ids, c_rows) if r != own)[:top]
            yield from ((int(own), k, r, max(-(1 << 63), min((1 << 63) - 1, -x))) for x, k, r in best)
        return
    cuts = blocks_of(dims)
    columns = [np.ascontiguousarray(c[:, b].T, dtype=np.float64) for b in cuts]
    qf = q.astype(np.float64)
    rest = lambda m: np.sqrt(np.stack([(m[:, b.stop:] ** 2).sum(axis=1) for b in cuts]))
    c_rest, q_rest = rest(c.astype(np.float64)) if cuts else None, rest(qf) if cuts else None
    for n, own in enumerate(q_rows):
        floor, alive = floors[n], np.flatnonzero(c_rows != own)
        part = np.zeros(len(alive))
        for k, b in enumerate(cuts):
            part += qf[n, b] @ (columns[k][:, alive] if len(alive) < len(c_ids) else columns[k])
            swing = q_rest[k, n] * c_rest[k, alive] * (1 + 1e-9) + 1e-3
            floor = raised(floor, part - swing, top)
            on = part + swing >= floor
            alive, part = alive[on], part[on]
        best = np.lexsort((c_rows[alive], c_ids[alive], -part))[:top]
        yield from ((int(own), int(c_ids[alive[j]]), int(c_rows[alive[j]]), int(part[j])) for j in best)


def norm(vector_col: str) -> F.Column:
    """Length of the integer vector, a little more than exact."""
    square = lambda x: F.pow(F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"), F.lit(2.0))
    return (F.sqrt(F.aggregate(F.col(vector_col), F.lit(0.0), lambda s, x: s + square(x))) * (1 + 1e-9) + 1e-3).alias("norm")


def _cells(candidates: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """query_row, vec_id, row_id, score: the best ``top`` of every cell (r, g) for its queries."""
    left = candidates.select("row_id", "vec_id", "v", F.lit(None).cast("double").alias("floor"), "r", "g", F.lit(False).alias("ask"))
    right = queries.select("row_id", "vec_id", "v", "floor", "r", "g", F.lit(True).alias("ask"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["ask"].to_numpy(bool)
        ids, rows, v = pdf["vec_id"].to_numpy(np.int64), pdf["row_id"].to_numpy(np.int64), pdf["v"].to_numpy()
        got = []
        if ask.any() and not ask.all():
            got = list(cell_top(rows[ask], stack(v[ask]), pdf["floor"].to_numpy(float)[ask], ids[~ask], rows[~ask], stack(v[~ask]), top))
        return pd.DataFrame(got, columns=["query_row", "vec_id", "row_id", "score"], dtype="int64")

    return left.unionByName(right).groupBy("r", "g").applyInPandas(run, "query_row long, vec_id long, row_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``top`` of ``vectors`` for each row of ``queries`` (cuts of row_id, vec_id, v, norm), its own row left out."""
    across = shards_for(queries.count(), CELL_QUERIES)
    down = shards_for(vectors.count(), CELL_CANDIDATES)
    deal = lambda n, salt: F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = queries.withColumn("g", deal(across, 2))
    # first pass: the longest vectors give every query a floor
    heads = vectors.orderBy(F.col("norm").desc(), "row_id").limit(CELL_CANDIDATES).withColumn("r", F.lit(0)).withColumn("g", every(across))
    first = _cells(heads, asking.withColumn("floor", F.lit(float("-inf"))).withColumn("r", F.lit(0)), top)
    floors = first.groupBy(F.col("query_row").alias("row_id")).agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).cast("double").alias("floor"))
    asking = keep(asking.join(floors, "row_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    least = F.min(F.when(F.col("floor") > 0, F.col("floor") / F.col("norm")).otherwise(0.0)).alias("least")
    reach = asking.groupBy("g").agg(least)  # one row a group of queries
    left = vectors.withColumn("r", deal(down, 1)).withColumn("g", every(across)).join(F.broadcast(reach), "g").where(F.col("norm") >= F.col("least"))
    best = _cells(left, asking.withColumn("r", every(down)), top)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    named = asking.select(F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(named, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """Five best vectors for every 50th vector, against all."""
    vectors = keep(packed_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", norm("embedding")))
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5
"""
