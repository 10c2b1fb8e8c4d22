"""Exact quantiles of a numeric column without gathering it.

A quantile is bracketed by approximate ones, the rows below the bracket are
counted, and only the rows inside it are looked at again, until few are left;
those few are ranked by value.  The result is linearly interpolated between the
two neighbouring ranks, as ``percentile`` does.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import cut_lineage, drop_cuts

FEW = 50_000


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """The q-quantile of the non-null values of ``col``; None if there are none."""
    # the column is read several times: its values are stored once, so ``df`` is computed once
    inside = stored = cut_lineage(df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull()))
    n = inside.count()
    if not n:
        drop_cuts(stored)
        return None
    position = q * (n - 1)
    ranks, below, left = (floor(position), ceil(position)), 0, n
    while left > FEW:
        near = [min(1.0, max(0.0, (r - below) / left + d)) for r, d in zip(ranks, (-0.002, 0.002))]
        low, high = inside.agg(F.percentile_approx("v", near, 10_000)).first()[0]
        s = inside.agg(F.count_if(F.col("v") < low).alias("under"), F.count_if(F.col("v").between(low, high)).alias("within")).first()
        if not (below + s["under"] <= ranks[0] and ranks[1] < below + s["under"] + s["within"]) or s["within"] == left:
            break
        inside, below, left = inside.where(F.col("v").between(low, high)), below + s["under"], s["within"]
    found, at = {}, below
    for r in inside.groupBy("v").count().orderBy("v").toLocalIterator():
        for k in ranks:
            if at <= k < at + r["count"]:
                found[k] = r["v"]
        at += r["count"]
        if ranks[1] in found:
            break
    drop_cuts(stored)
    return found[ranks[0]] + (found[ranks[1]] - found[ranks[0]]) * (position - ranks[0])


SMALL_GROUP = 10_000


def grouped_quantiles(df: DataFrame, by: list[str], col: str, qs: list[float]) -> DataFrame:
    """(by..., q, value): exact interpolated quantiles of the non-null values of ``col`` in every group, all in one plan.

    One aggregate brackets every quantile of every group by approximate ones
    (a sketch a group), a second counts the rows below each bracket, and only
    values inside a bracket are counted and ranked.  A bracket reaches 0.2 % of
    the group's rows to either side, more than the sketch can be off from
    ``SMALL_GROUP`` rows on; smaller groups are bracketed whole.  Null keys form
    a group; a group without values has no row.
    """
    rows = df.select(*by, F.col(col).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    ends = [min(1.0, max(0.0, q + d)) for q in qs for d in (-0.002, 0.002)]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
                                   F.percentile_approx("__v", ends, 10_000).alias("__ends"))
    small = F.col("__n") < SMALL_GROUP
    brackets = F.array(*[F.struct(
        F.lit(i).alias("i"), F.when(small, F.col("__lo")).otherwise(F.col("__ends")[2 * i]).alias("lo"),
        F.when(small, F.col("__hi")).otherwise(F.col("__ends")[2 * i + 1]).alias("hi")) for i in range(len(qs))])
    sketch = sketch.select(*[F.col(c).alias(f"__{c}") for c in by], "__n", brackets.alias("__b"))
    same = lambda x, y: [F.col(f"{x}{c}").eqNullSafe(F.col(f"{y}{c}")) for c in by]
    met = rows.join(sketch, same("", "__"))
    below = met.groupBy(*by).agg(F.max("__n").alias("n"), F.array(*[
        F.count_if(F.col("__v") < F.col("__b")[i]["lo"]) for i in range(len(qs))]).alias("under"))
    below = below.select(*[F.col(c).alias(f"__{c}") for c in by], "n", F.posexplode("under").alias("__i", "under"))
    inside = met.select(*by, "__v", F.explode(F.filter("__b", lambda b: (F.col("__v") >= b["lo"]) & (F.col("__v") <= b["hi"]))["i"]).alias("i"))
    counted = inside.groupBy(*by, "i", "__v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).join(below, [*same("", "__"), F.col("i") == F.col("__i")])
    position = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), (F.col("i") + 1).cast("int")) * (F.col("n") - 1)
    ranked = ranked.withColumns({"__at": position, "__last": F.col("under") + F.col("upto")})
    holds = lambda r: (r >= F.col("__last") - F.col("c")) & (r < F.col("__last"))
    ends = ranked.groupBy(*by, "i").agg(F.max("__at").alias("at"), F.max(F.when(holds(F.floor("__at")), F.col("__v"))).alias("lo"),
                                        F.max(F.when(holds(F.ceil("__at")), F.col("__v"))).alias("hi"))
    q = F.element_at(F.array(*[F.lit(float(x)) for x in qs]), (F.col("i") + 1).cast("int"))
    return ends.select(*by, q.alias("q"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value"))
