"""Degrees and triangles of the network of ``build_network``, counted from its windows: none of its pairs is made.

Rules.  P (passenger): a leads to c if c leaves the hub where a lands 45 to 240 minutes later.  R (runway): flights of one
runway and slot are all linked.  S (sequence): the crew and aircraft edges that P and R do not cover, at most two each way a
flight.  P, R and S never link the same two flights, so degrees add up, and a triangle is one of

* RRR: three flights of a slot.  RRP does not exist: two R links of a flight lie in one slot, whose flights R links.
* PPR: two flights of a slot that land at the hub of a third (or leave it), both in its window.
* PPP: a, b, c at one hub, where b both lands and leaves; c lies in the windows of a and b.
* one S: flights that P or R links to both ends: a range of times among the points of one key (``_ends``).
* two or three S: paths of two S edges, at most six a flight, whose ends are looked at.

PPR and PPP are counted hub by hub in blocks of 240 minutes.  Ranges of a later flight start and end later, so
what two flights share is the earlier one's end less the later one's start, and sums over all partners are running sums.
Ids must be unique.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators import spans as S

LOW, HIGH, SLOT = 45 * S.MINUTE, 240 * S.MINUTE, 30 * S.MINUTE
COUNTS = "id string, deg long, tri long"


def _whole(at: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Sums of the whole numbers ``times`` by place."""
    return np.rint(np.bincount(at, weights=times, minlength=n)).astype(np.int64)


def _partners(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in time order reach ``n`` others from lo to hi - 1: what each shares with the other rows of its group (-1: none),
    summed, and for each of the others how many pairs of one group reach it."""
    order = np.argsort(group, kind="stable")
    g, low, high = group[order], lo[order], hi[order]
    i = np.arange(len(g))
    first, last = np.searchsorted(g, g, "left"), np.searchsorted(g, g, "right")
    before, after = np.where(g < 0, 0, i - first), np.where(g < 0, 0, last - i - 1)
    lows, highs = np.append(0, np.cumsum(low)), np.append(0, np.cumsum(high))
    both = after * high - (lows[last] - lows[i + 1]) + (highs[i] - highs[first]) - before * low
    own = np.zeros(len(g), np.int64)
    own[order] = np.where(g < 0, 0, both)
    return own, np.cumsum(_whole(low, before, n + 1) - _whole(high, after, n + 1))[:n]


def _hub(t):
    """Degrees and triangles by P, PPR and PPP of one hub and block: its points (departures) and the sources that reach them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    t = t.sort_by([("t", "ascending")])
    at, source, loop = (t.column(c).to_numpy() for c in ("t", "source", "loop"))
    runway = pc.fill_null(t.column("r").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    slot = at // SLOT
    group = np.where(runway < 0, -1, (slot - slot.min()) * (runway.max() + 2) + runway)
    p, s = np.where(~source)[0], np.where(source)[0]
    points, starts = at[p], at[s]
    lo, hi = np.searchsorted(points, starts + LOW, "left"), np.searchsorted(points, starts + HIGH, "right")
    back_lo, back_hi = np.searchsorted(starts, points - HIGH, "left"), np.searchsorted(starts, points - LOW, "right")
    by_source, of_point = _partners(group[s], lo, hi, len(p))
    by_point, of_source = _partners(group[p], back_lo, back_hi, len(s))
    # a leads to b and c, b (a loop) to c
    b = np.where(loop[s])[0]
    middle = starts[b]
    b_from, b_to = np.searchsorted(middle, starts + LOW, "left"), np.searchsorted(middle, starts + HIGH - LOW, "right")
    a_from, a_to = np.searchsorted(starts, middle - HIGH + LOW, "left"), np.searchsorted(starts, middle - LOW, "right")
    lows, highs = np.append(0, np.cumsum(lo[b])), np.append(0, np.cumsum(hi))
    of_a = (b_to - b_from) * hi - (lows[b_to] - lows[b_from])
    of_b = highs[a_to] - highs[a_from] - (a_to - a_from) * lo[b]
    of_c = np.cumsum(_whole(lo[b], a_to - a_from, len(p) + 1) - _whole(hi, b_to - b_from, len(p) + 1))[: len(p)]
    tri_s = by_source + of_source + of_a
    tri_s[b] += of_b
    ids = t.column("id").take(pa.array(np.concatenate([s, p])))
    return pa.table({"id": ids, "deg": np.concatenate([hi - lo, back_hi - back_lo]).astype(np.int64), "tri": np.concatenate([tri_s, by_point + of_point + of_c]).astype(np.int64)})


def _ends(t):
    """Triangles with one S edge (id, id2), found in ranges t to until of the points (id2 null) of its k2, in one k1 and block."""
    import pyarrow as pa
    import pyarrow.compute as pc

    key = pc.fill_null(t.column("k2").combine_chunks().dictionary_encode().indices, 0).to_numpy().astype(np.int64) * (2 * HIGH)
    begin = t.column("block").to_numpy() * HIGH
    at, until = (key + np.clip(pc.fill_null(t.column(c), 0).to_numpy() - begin, -1, HIGH) for c in ("t", "until"))
    order = np.argsort(at, kind="stable")
    t, at, until = t.take(pa.array(order)), at[order], until[order]
    edge = t.column("id2").is_valid().to_numpy()
    p, e = np.where(~edge)[0], np.where(edge)[0]
    if not len(e) or not len(p):
        return pa.table({"id": pa.array([], pa.string()), "deg": pa.array([], pa.int64()), "tri": pa.array([], pa.int64())})
    lo = np.searchsorted(at[p], at[e], "left")
    hi = np.maximum(lo, np.searchsorted(at[p], until[e], "right"))
    one = np.ones(len(e))
    cover = np.cumsum(_whole(lo, one, len(p) + 1) - _whole(hi, one, len(p) + 1))[: len(p)]
    ids = pa.chunked_array([*t.column("id").take(pa.array(p)).chunks, *t.column("id").take(pa.array(e)).chunks, *t.column("id2").take(pa.array(e)).chunks], pa.string())
    tri = np.concatenate([cover, hi - lo, hi - lo]).astype(np.int64)
    return pa.table({"id": ids, "deg": np.zeros(len(tri), np.int64), "tri": tri}).filter(pa.array(tri > 0))


def _start(t: Column) -> Column:
    return F.floor(t / SLOT) * SLOT


def _by_hub(places: DataFrame) -> DataFrame:
    t = F.col("t")
    row = lambda key, block, source: [F.col(key).alias("key"), block.alias("block"), "id", "t", F.lit(source).alias("source"), "r", F.coalesce(F.col("at") == F.col("to"), F.lit(False)).alias("loop")]
    reach = F.explode(F.sequence(F.floor((t + LOW) / HIGH), F.floor((t + HIGH) / HIGH)))
    rows = places.where("at IS NOT NULL").select(*row("at", F.floor(t / HIGH), False)).unionByName(places.where("to IS NOT NULL").select(*row("to", reach, True)))
    return rows.groupBy("key", "block").applyInArrow(_hub, COUNTS)


def _by_slot(places: DataFrame) -> DataFrame:
    rows = places.where("r IS NOT NULL").select("id", "r", F.floor(F.col("t") / SLOT).alias("slot"))
    n = F.col("n")
    sizes = rows.groupBy("r", "slot").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, ["r", "slot"]).select("id", (n - 1).alias("deg"), F.expr("(n - 1) * (n - 2) DIV 2").alias("tri"))


def _one_s(places: DataFrame, ended: DataFrame) -> DataFrame:
    """``ended``: S edges (u, v) with the places of both ends; u is not later than v, so other pairs of sides have empty ranges."""
    t = F.col("t")
    none = F.lit(None).cast("string")

    def point(kind, a, b=None):
        keys = [F.lit(kind).alias("kind"), F.col(a).alias("k1"), (none if b is None else F.col(b)).alias("k2")]
        rows = places.where(F.col(a).isNotNull() & (F.lit(True) if b is None else F.col(b).isNotNull()))
        return rows.select(*keys, F.floor(t / HIGH).alias("block"), "id", none.alias("id2"), "t", F.lit(None).cast("long").alias("until"))

    points = point("out out", "at").unionByName(point("in in", "to")).unionByName(point("out in", "at", "to"))
    points = points.unionByName(point("out slot", "at", "r")).unionByName(point("slot in", "to", "r"))
    tu, tv = F.col("u.t"), F.col("v.t")
    out_u, in_v = (tu + LOW, tu + HIGH), (tv - HIGH, tv - LOW)
    slot_u, slot_v = ((_start(x), _start(x) + SLOT - 1) for x in (tu, tv))

    def common(kind, k1, k2, one, two, given=None):
        lo, hi = F.greatest(one[0], two[0]), F.least(one[1], two[1])
        found = (F.lit(True) if given is None else given) & k1.isNotNull() & (F.lit(True) if k2 is None else k2.isNotNull()) & (lo <= hi)
        return F.when(found, F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), (none if k2 is None else k2).alias("k2"), lo.cast("long").alias("t"), hi.cast("long").alias("until")))

    c = lambda side, name: F.col(f"{side}.{name}")
    ranges = F.array(
        common("out out", c("u", "to"), None, out_u, (tv + LOW, tv + HIGH), c("u", "to") == c("v", "to")),
        common("in in", c("u", "at"), None, (tu - HIGH, tu - LOW), in_v, c("u", "at") == c("v", "at")),
        common("out in", c("u", "to"), c("v", "at"), out_u, in_v),
        common("out slot", c("u", "to"), c("v", "r"), out_u, slot_v),
        common("slot in", c("v", "at"), c("u", "r"), slot_u, in_v),
    )
    asked = ended.select(c("u", "id").alias("id"), c("v", "id").alias("id2"), F.explode(F.filter(ranges, lambda x: x.isNotNull())).alias("q")).select("id", "id2", "q.*")
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(t / HIGH), F.floor(F.col("until") / HIGH))))
    return points.unionByName(asked).groupBy("kind", "k1", "block").applyInArrow(_ends, COUNTS)


def _more_s(places: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triangles of two and of three S edges, from the paths y, x, z of two."""
    sides = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
    paths = sides.join(sides.withColumnRenamed("y", "z"), "x").where("y < z")
    side = lambda name: places.select(F.col("id").alias(name), F.struct("t", "at", "to", "r").alias(f"p{name}"))
    placed = paths.join(side("y"), "y").join(side("z"), "z")
    gap = F.col("pz.t") - F.col("py.t")
    slot = lambda name: F.floor(F.col(f"p{name}.t") / SLOT)
    p = ((F.col("py.to") == F.col("pz.at")) & gap.between(LOW, HIGH), (F.col("pz.to") == F.col("py.at")) & (-gap).between(LOW, HIGH))
    r = (F.col("py.r") == F.col("pz.r")) & (slot("y") == slot("z"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    closed = placed.where(p[0] | p[1] | r).select(F.explode(F.array("x", "y", "z")).alias("id"))
    whole = paths.join(sides.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"]).select(F.col("x").alias("id"))  # found once from each corner
    return closed.unionByName(whole).select("id", none.alias("deg"), one.alias("tri")).unionByName(sides.select(F.col("x").alias("id"), one.alias("deg"), none.alias("tri")))


def link_counts(places: DataFrame, sequence: DataFrame) -> DataFrame:
    """(id, deg, tri) of every linked flight; ``places`` (id, t, at, to, r: keys of the rules, null where none) and the S edges
    (src, dst) are stored."""
    pairs = sequence.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    side = lambda name: places.select(F.struct("*").alias(name))
    ended = pairs.withColumnRenamed("u", "a").withColumnRenamed("v", "b").join(side("u"), F.col("a") == F.col("u.id")).join(side("v"), F.col("b") == F.col("v.id")).select("u", "v")
    parts = _by_hub(places).unionByName(_by_slot(places)).unionByName(_one_s(places, ended)).unionByName(_more_s(places, pairs))
    return parts.groupBy("id").agg(F.sum("deg").alias("deg"), F.sum("tri").alias("tri")).where("deg > 0")
