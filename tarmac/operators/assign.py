"""Capacity-limited assignment in rounds (deferred acceptance).

All slots rank claimants by one common order and every claimant has a fixed list
of options, so the assignment that a one-by-one pass in that order would make is
the unique stable one.  A round looks only at slots with new claims: each keeps
its best claimants up to its limit (a limited window), which sets the cutoff of a
full slot.  Cutoffs only get better, so a claimant turned away goes straight to its
first further option whose cutoff still admits it; its option list is one array,
looked up by key, and the rows of a round are narrow.  Rounds go on until nobody is turned away.  No group is ever held
by one Python task.

``tiled_assignment`` is the same for slots along a line (hours, quarters): the line
is cut into tiles, and one pass over a tile's claimants by rank, streamed, settles every
claim inside it.  Only claimants whose next option lies in another tile go to the next
round, whose tiles are shifted by half a tile; it looks again only at the tiles they claim.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import cut_lineage, drop_cuts

MERGE_EVERY = 4
BROADCAST_ROWS = 50_000  # of a key and a number


def _latest(rounds: list[DataFrame], slot: list[str], only: DataFrame | None = None) -> DataFrame:
    """The winners of every slot (of ``only``) by the last round that looked at it."""
    rows = reduce(DataFrame.unionByName, [w.withColumn("__round", F.lit(i)) for i, w in enumerate(rounds)])
    if only is not None:
        rows = rows.join(only, slot, "left_semi")
    last = F.max("__round").over(Window.partitionBy(*slot))  # a slot's winners are at most its limit a round
    return rows.withColumn("__last", last).where("__round = __last").drop("__round", "__last")


def stable_assignment(claimants: DataFrame, key: str, slot: list[str], most: int, log: list[int] | None = None) -> DataFrame:
    """The option each claimant ends with (``key`` and the option's fields); claimants that run out of options are absent.

    ``claimants``: one row per ``key`` with ``rank`` (a struct, least first, no two
    equal) and ``options``, an array of structs in order of preference that hold the
    ``slot`` columns, ``limit`` (the slot's capacity, from 1 to ``most``) and any
    further columns; slot columns common to all options may stand beside the array.
    ``log`` receives the number of claims of every round.
    """
    own = [c for c in slot if c in claimants.columns]  # slot columns that a claimant's options share
    lists = cut_lineage(claimants.select(key, "rank", *own, "options"))
    fields = claimants.schema["options"].dataType.elementType.names
    current = lambda df: df.select(key, "rank", "at", *own, *[F.element_at("options", F.col("at") + 1)[c].alias(c) for c in fields])
    claims = cut_lineage(current(lists.where(F.size("options") > 0).withColumn("at", F.lit(0))))
    rounds = []
    while True:
        n = claims.count()
        if log is not None:
            log.append(n)
        if not n:
            break
        pool = claims
        if rounds:
            pool = pool.unionByName(_latest(rounds, slot, claims.select(*slot).distinct()).drop("place"))
        place = F.row_number().over(Window.partitionBy(*slot).orderBy("rank"))
        won = pool.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= F.col("limit"))  # the constant bound limits before the shuffle
        won = cut_lineage(won)
        full = lambda df: df.where("place = limit").select(*slot, F.col("rank").alias("cutoff"))
        # no more are turned away than claim: a slot never ends a round with fewer winners
        lost = pool.join(full(won), slot).where(F.col("rank") > F.col("cutoff")).select(key, "at")
        lost = F.broadcast(lost) if n <= BROADCAST_ROWS else lost
        rounds.append(won)
        cutoffs = reduce(DataFrame.union, [full(w) for w in rounds]).groupBy(*slot).agg(F.min("cutoff").alias("cutoff"))
        further = lists.join(lost, key).select(key, "rank", "at", *own, F.posexplode("options").alias("to", "o")).where(F.col("to") > F.col("at"))
        further = further.select(key, "rank", "to", "o", *[c if c in own else F.col(f"o.{c}").alias(c) for c in slot]).join(cutoffs, slot, "left")
        admitting = further.where(F.col("cutoff").isNull() | (F.col("rank") < F.col("cutoff")))
        first = admitting.groupBy(key, "rank", *own).agg(F.min(F.struct("to", "o")).alias("first"))
        claims = cut_lineage(first.select(key, "rank", F.col("first.to").alias("at"), *own, *[F.col(f"first.o.{c}").alias(c) for c in fields]), claims)
        if len(rounds) > MERGE_EVERY:
            merged = cut_lineage(_latest(rounds, slot), *rounds)
            rounds = [merged]
    if not rounds:  # nobody has an option
        return claims.select(key, *own, *fields)
    drop_cuts(claims, lists)
    return _latest(rounds, slot).select(key, *own, *fields)


def _settle(lanes: int, tile: int, shift: int, own: list[str]):
    """One pass over tiles sorted by rank: a claimant takes its first option with room or leaves at the first one in another tile.

    Holds the seats taken in the tile at hand, never its claimants.  Equal rows that follow each other claim the same
    slot; those that find no room there have no claim of their own."""

    def run(batches):
        place, taken, before, first = None, {}, None, False
        for b in batches:
            keep, ats, lines, wins = [], [], [], []
            ends, codes = b["codes"].offsets.to_pylist(), b["codes"].values.to_pylist()
            # both arrays stem from one list, but a slice of a batch may start elsewhere
            at_limit, limits = b["limits"].offsets[0].as_py(), b["limits"].values.to_pylist()
            drift = at_limit - ends[0]
            places = zip(*(b[c].to_pylist() for c in [*own, "tile"]))
            for i, (here, at, same) in enumerate(zip(places, b["at"].to_pylist(), b["same"].to_pylist())):
                if here != place:
                    place, taken, before = here, {}, None
                twin, before = same == before, same
                if twin and not first:
                    continue
                low, high, first = ends[i] + at, ends[i + 1], False
                for j in range(low, low + 1 if twin else high):
                    code = codes[j]
                    line = code // lanes
                    won = False
                    if here[-1] is None or (line + shift) // tile == here[-1]:
                        n = taken.get(code, 0)
                        if n >= limits[j + drift]:
                            continue
                        taken[code] = n + 1
                        won, first = True, j == low
                    keep.append(i)
                    ats.append(j - ends[i])
                    lines.append(None if here[-1] is None else line)
                    wins.append(won)
                    break
            rest = b.drop_columns(["codes", "limits", "tile", "same", "at"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(ats, pa.int32()), pa.array(lines, pa.int64()), pa.array(wins, pa.bool_())],
                                             [*rest.schema.names, "at", "line", "won"])

    return run


def tiled_assignment(claimants: DataFrame, key: str, own: list[str], build, lanes: int, tile: int, log: list[int] | None = None) -> DataFrame:
    """``stable_assignment`` for slots (``own`` columns, lane, line): ``key``, ``own`` and the fields of the option each ends with.

    ``claimants``: one row per ``key`` with ``rank``, the ``own`` columns that all its options share and ``options``, a
    narrow struct from which ``build`` makes the array of options in order of preference: structs with ``lane`` (below
    ``lanes``), ``line`` (a number along the line), ``limit`` and any further fields.  The array is built where it is read and
    neither stored nor shuffled.  ``tile``: how much of the line is settled at once, best twice what a claimant's options span.
    A claimant without ``key`` or ``own``, or whose line is unknown, tries its first option only.  ``log`` receives the number of tiles of every further round.
    """
    # narrow rows are dealt before each becomes a list, so that few files or small shuffles still use every core
    parts = int(claimants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = cut_lineage(claimants.select(key, "rank", *own, "options").repartition(parts, key))
    lists = stored.withColumnRenamed("options", "of")
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [key, *own]])
    number = lambda shift: F.floor((F.col("line") + shift) / tile).alias("tile")
    carried = [key, "rank", *own, "of"]
    schema = lists.select(*carried, F.lit(0).alias("at"), F.lit(None).cast("long").alias("line"), F.lit(True).alias("won")).schema

    def settled(rows: DataFrame, shift: int) -> DataFrame:
        dealt = rows.select(*carried, "at", number(shift)).repartition(parts, *own, "tile").sortWithinPartitions(*own, "tile", "rank")
        made = dealt.select("*", build(F.col("of")).alias("list")).select("*", F.when(known & F.get("list", F.lit(0))["line"].isNotNull(), F.col("list")).otherwise(F.slice("list", 1, 1)).alias("open"))
        codes = F.transform("open", lambda o: (F.coalesce(o["line"], F.lit(0)) * lanes + o["lane"]).cast("long")).alias("codes")
        made = made.select(*carried, "at", "tile", F.xxhash64(key, "rank", "of", "at").alias("same"), codes, F.transform("open", lambda o: o["limit"]).alias("limits"))
        return made.mapInArrow(_settle(lanes, tile, shift, own), schema)

    first = lists.select("*", F.try_element_at(build(F.col("of")), F.lit(1)).alias("o")).where("o IS NOT NULL")
    rows = first.select(*carried, F.lit(0).alias("at"), F.col("o.line").alias("line"))
    winners, old, claims = [], [], None
    for n in count():
        shift, after = (n % 2 * (tile // 2), (n + 1) % 2 * (tile // 2))
        out = cut_lineage(settled(rows, shift))
        claims = cut_lineage(out.where("NOT won").drop("won"), claims, stored)
        winners.append(out.where("won").drop("won"))
        touched = cut_lineage(claims.select(*own, number(after)).distinct())  # places x tiles at most
        looked = touched.count()
        if log is not None:
            log.append(looked)
        if not looked:
            break
        near = lambda df, how: df.withColumn("tile", number(after)).join(touched, [*own, "tile"], how).select(*carried, "at", "line")
        rows = reduce(DataFrame.unionByName, [near(w, "left_semi") for w in winners], claims.select(*carried, "at", "line"))
        winners = [near(w, "left_anti") for w in winners]
        old += [out, touched]
        if len(winners) > MERGE_EVERY:
            kept = cut_lineage(reduce(DataFrame.unionByName, winners))
            rows = cut_lineage(rows, claims)
            drop_cuts(*old)
            winners, old, claims = [kept], [kept, rows], None
    drop_cuts(claims, touched)
    got = reduce(DataFrame.unionByName, [w.select(key, *own, "of", "at") for w in winners])
    return got.select(key, *own, F.element_at(build(F.col("of")), F.col("at") + 1).alias("o")).select(key, *own, "o.*")
