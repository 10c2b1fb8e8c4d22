"""Prefix trie of conversations in adaptive radix trees.

Turns.  Every (role, text) is named by a fixed-width big-endian number, the first 128 bits of a SHA-256, so a conversation
is a byte key of 16 bytes a turn and texts leave the data before the first shuffle.  Turns are numbered inside their
conversation by range-sorted partitions and the counts before them, so no conversation has to fit one task.

Tiles.  A key is cut in segments of ``SEGMENT_TURNS`` turns.  A segment lies in the tile named by the digest of all
turns before it (XOR of hashes of turn and position, which running sums give), so the trie is a forest of tiles of
bounded depth and a conversation of any length is many small rows.  Equal segments are counted first.  Rows are
range-sorted by (tile, key) and each task builds adaptive radix trees over its stretch: node layouts of 4, 16, 48 and
256 children that grow, path compression, and a node emitted only where a byte depth ends a turn.  A prefix that lies
in several stretches is added up by its digest.

Sums over subtrees need no walk from tile to tile.  A conversation c is the smallest member of the nodes of its path from
some depth on; call the words of that part own(c).  Summed over the nodes x below v, n_convs(x) words(x) is the words of
all members from v on, and words(x) is own(c) over the members, with the smallest member's words from v on in place
of its own part.  A childless node is counted by its smallest member.  So a first pass over the trees gives members
and children, and a second one the sums of own(c) and of childless ends.

Digests of ends are streamed over chunks of joined ids, never held whole.

Edge cases: a null conv_id takes no part; null role and text are empty; turns tie by role, then by their number (a null
turn comes first); a repeated row is a turn of its own; conversations rebuilt to nothing are members of the root alone;
an empty table gives an empty result; other columns are not looked at.  Digests are 128 bits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import keep, places, shards_for, table, word_count
from tarmac.session import drop_cuts

WIDTH = 16  # bytes of a turn's number
SEGMENT_TURNS = 64
SUPER = 1024  # segments, or turns, of a block in running sums and joins
TASK_ROWS = 20_000
CHUNK_IDS = 4096
BATCH = 8192


class Node:
    """An inner node or leaf: compressed path, the row whose key ends here (or -1), and its children in one of four layouts."""

    __slots__ = ("path", "row", "keys", "kids")

    def __init__(self, path: bytes, row: int = -1):
        self.path, self.row, self.keys, self.kids = path, row, bytearray(), []

    def layout(self) -> int:
        return 256 if self.keys is None else 48 if len(self.keys) == 256 else 4 if len(self.keys) <= 4 else 16

    def child(self, byte: int) -> Node | None:
        if self.keys is None:
            return self.kids[byte]
        if len(self.keys) == 256:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> None:
        """Adds or replaces a child; 4 and 16 hold sorted bytes, 48 an index by byte, 256 the children by byte."""
        if self.keys is None:
            self.kids[byte] = node
        elif len(self.keys) == 256:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.keys[byte] = len(self.kids)
            else:
                self.kids = [self.kids[at - 1] if at else None for at in self.keys]
                self.keys = None
                self.kids[byte] = node
        else:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = node
            elif len(self.keys) < 16:
                self.keys.insert(at, byte)
                self.kids.insert(at, node)
            else:
                index = bytearray(256)
                for i, b in enumerate(self.keys):
                    index[b] = i + 1
                self.keys = index
                self.put(byte, node)

    def children(self) -> list[Node]:
        return self.kids if self.keys is not None else [k for k in self.kids if k is not None]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def insert(root: Node, key: bytes, row: int) -> None:
    """Adds a key that is not in the tree yet; the root's path is empty."""
    node, rest = root, key
    while rest:
        below = node.child(rest[0])
        if below is None:
            node.put(rest[0], Node(rest, row))
            return
        n = shared(below.path, rest)
        if n < len(below.path):
            middle = Node(below.path[:n])
            below.path = below.path[n:]
            middle.put(below.path[0], below)
            node.put(middle.path[0], middle)
            below = middle
        node, rest = below, rest[n:]
    node.row = row


def tile_nodes(keys: list[bytes], values: list[list[int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(turns, a row below, sums) of every turn-aligned prefix of the keys; values are [n, least, further sums...] a row."""
    root = Node(b"")
    for row, key in enumerate(keys):
        insert(root, key, row)
    stack, got = [(k, 0, False) for k in root.children()], []
    while stack:
        node, depth, back = stack.pop()
        end = depth + len(node.path)
        kids = node.children()
        if not back and kids:
            stack.append((node, depth, True))
            stack += [(k, end, False) for k in kids]
            continue
        # the sums of the children lie on top, one each
        parts = got[len(got) - len(kids):] if kids else []
        del got[len(got) - len(parts):]
        if node.row >= 0:
            parts.append((node.row, values[node.row]))
        row, total = parts[0][0], list(parts[0][1])
        for _, v in parts[1:]:
            least = min(total[1], v[1])
            total = [a + b for a, b in zip(total, v)]
            total[1] = least
        got.append((row, total))
        for turns in range(depth // WIDTH + 1, end // WIDTH + 1):
            yield turns, row, total


def trie_nodes(segments: DataFrame, sums: list[str]) -> DataFrame:
    """Nodes (depth, x1, x2) with p1, p2 (the parent's digest), before (words of the turns above), n, least and ``sums``.

    ``segments``: a row per conversation and segment with k, t1, t2, before, key, words, x1s, x2s (arrays by turn), conv_id and ``sums``.
    """
    same = ["k", "t1", "t2", "key"]
    rows = keep(segments.groupBy(*same).agg(
        *[F.any_value(c).alias(c) for c in ("before", "words", "x1s", "x2s")],
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), *[F.sum(c).cast("long").alias(c) for c in sums]))
    spark = segments.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards_for(rows.count(), TASK_ROWS))
    dealt = rows.repartitionByRange(parts, *same).sortWithinPartitions(*same)
    columns = ["k", "t1", "t2", "before", "key", "words", "x1s", "x2s", "n", "least", *sums]
    out = ["depth", "x1", "x2", "p1", "p2", "before", "n", "least", *sums]
    schema = pa.schema([(c, pa.int64()) for c in out])

    def emit(tile, rows) -> Iterator[tuple]:
        k, t1, t2, before = tile
        above = {}  # a row's running digests and words
        for turns, row, total in tile_nodes([r[0] for r in rows], [list(r[4:]) for r in rows]):
            if row not in above:
                a, b, w = [t1], [t2], [before]
                for x, y, z in zip(rows[row][2], rows[row][3], rows[row][1]):
                    a.append(a[-1] ^ x), b.append(b[-1] ^ y), w.append(w[-1] + z)
                above[row] = a, b, w
            a, b, w = above[row]
            yield (k * SEGMENT_TURNS + turns, a[turns], b[turns], a[turns - 1], b[turns - 1], w[turns - 1], *total)

    def tiles(batches) -> Iterator[tuple]:
        now, held = None, []
        for batch in batches:
            for k, t1, t2, before, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (k, t1, t2) != (now or ())[:3]:
                    if held:
                        yield from emit(now, held)
                    now, held = (k, t1, t2, before), []
                held.append(row)
        if held:
            yield from emit(now, held)

    def run(batches):
        held = []
        for node in tiles(batches):
            held.append(node)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=schema)

    found = dealt.select(*columns).mapInArrow(run, ", ".join(f"{c} long" for c in out))
    same_node = [F.any_value(c).alias(c) for c in ("p1", "p2", "before")]
    merged = keep(found.groupBy("depth", "x1", "x2").agg(*same_node, F.sum("n").alias("n"), F.min("least").alias("least"), *[F.sum(c).alias(c) for c in sums]))
    drop_cuts(rows)
    return merged


def by_blocks(rows: DataFrame, per_key: DataFrame, key: str, block: Column, blocks: Column) -> DataFrame:
    """``rows`` joined to the one row of ``per_key`` that has their ``key``, repeated for each block of rows so that no key is hot."""
    many = per_key.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long"))))
    return rows.withColumn("__block", block.cast("long")).join(many, [key, "__block"]).drop("__block")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, p, tid, words) of every rebuilt conversation, and conversations (conv_id, length) with the turnless ones."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    number = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    base = turns.where(F.col("conv_id").isNotNull()).withColumn("text", text)
    t = base.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), number.alias("tid"), word_count("text").alias("words"))
    own = keep(places(t, ["conv_id"], ["turn", "role", "tid"], "pos").drop("turn", "role"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    heads = own.where((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "tid", "words"))).alias("head"))  # at most three
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = keep(convs.withColumn("taken", F.size("head").cast("long")).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    kept = by_blocks(own, convs.select("conv_id", "h", "taken", "n"), "conv_id", F.floor(F.col("pos") / SUPER), F.floor(F.col("n") / SUPER))
    kept = kept.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("p"), "tid", "words")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("p"), "t.tid", "t.words")
    return kept.unionByName(first), convs.select("conv_id", "length")


def segment_rows(turns: DataFrame) -> DataFrame:
    """conv_id, k, t1, t2, before, key, words, x1s, x2s and x1, x2, total (of the segment) for turns (conv_id, p, tid, words)."""
    turn = F.struct("p", "tid", "words", F.xxhash64("p", "tid").alias("x1"), F.xxhash64("tid", "p", F.lit(1)).alias("x2"))
    k = F.floor((F.col("p") - 1) / SEGMENT_TURNS)
    seg = turns.groupBy("conv_id", k.alias("k")).agg(F.array_sort(F.collect_list(turn)).alias("t"))  # at most SEGMENT_TURNS
    fold = lambda c: F.aggregate(f"t.{c}", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    seg = seg.select(
        "conv_id", "k", F.floor(F.col("k") / SUPER).alias("block"), F.unhex(F.array_join("t.tid", "")).alias("key"), F.col("t.words").alias("words"),
        F.col("t.x1").alias("x1s"), F.col("t.x2").alias("x2s"), fold("x1").alias("x1"), fold("x2").alias("x2"),
        F.aggregate("t.words", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
    seg = keep(seg)
    parts = {"t1": F.bit_xor("x1"), "t2": F.bit_xor("x2"), "before": F.sum("total")}
    ahead = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"x1": F.bit_xor("x1").alias("x1"), "x2": F.bit_xor("x2").alias("x2"), "total": F.sum("total").alias("total")}
    blocks = seg.groupBy("conv_id", "block").agg(*sums.values())
    outer = blocks.select("conv_id", "block", *[F.coalesce(e.over(ahead("conv_id").orderBy("block")), F.lit(0)).alias(f"{c}_far") for c, e in parts.items()])
    near = seg.select("*", *[F.coalesce(e.over(ahead("conv_id", "block").orderBy("k")), F.lit(0)).alias(f"{c}_near") for c, e in parts.items()])
    out = near.join(outer, ["conv_id", "block"])
    return out.select(*seg.columns, F.col("t1_near").bitwiseXOR(F.col("t1_far")).alias("t1"), F.col("t2_near").bitwiseXOR(F.col("t2_far")).alias("t2"), (F.col("before_near") + F.col("before_far")).alias("before"))


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids (conv_id) that end at each node (depth, x1, x2), streamed over chunks of ids."""
    node = ["depth", "x1", "x2"]
    placed = places(ends.select(*node, "conv_id"), node, ["conv_id"], "place").withColumn("chunk", F.floor((F.col("place") - 1) / CHUNK_IDS))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = placed.groupBy(*node, "chunk").agg(text.alias("ids"))
    sorted_chunks = chunks.repartition(*node).sortWithinPartitions(*node, "chunk")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in [*node, "ids"])):
                if at == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = at, hashlib.sha256(ids.encode())
            if done:
                yield _digests(done)
        if now:
            yield _digests([(*now, digest.hexdigest())])

    return sorted_chunks.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["depth", "x1", "x2", "ends_sha256"])


def conversation_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations for turns (conv_id, turn, role, text)."""
    rows, convs = rebuilt(turns)
    seg = keep(segment_rows(keep(rows)))
    whole = seg.groupBy("conv_id").agg(F.sum("total").alias("sum_words"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    convs = convs.join(whole, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("sum_words", F.lit(0)).alias("sum_words"), F.coalesce("x1", F.lit(0)).alias("x1"), F.coalesce("x2", F.lit(0)).alias("x2"))
    convs = keep(convs)
    per = lambda columns: by_blocks(seg.withColumnRenamed("total", "__own").drop("x1", "x2", "block"), columns, "conv_id", F.floor(F.col("k") / SUPER), F.floor(F.col("length") / (SUPER * SEGMENT_TURNS)))
    zero = F.lit(0).cast("long")
    root = lambda *sums: [zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), *sums]

    # first pass: members, their words, parents and children
    members = trie_nodes(per(convs.select("conv_id", "length", "sum_words")), ["sum_words"])
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.sum("sum_words").alias("sum_words")).where("n > 0")
    none = F.lit(None).cast("long")
    nodes = members.unionByName(top.select(*root(none.alias("p1"), none.alias("p2"), zero.alias("before"), "n", "least", "sum_words")))
    kids = members.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = keep(nodes.join(kids, ["depth", "x1", "x2"], "left").fillna(0, ["n_children"]))

    # what a conversation owns: the nodes of which it is the smallest member
    owned = nodes.groupBy(F.col("least").alias("conv_id")).agg(F.min_by("before", "depth").alias("above"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owned = convs.join(owned, "conv_id", "left").select(
        "conv_id", "length", "x1", "x2", "sum_words", F.coalesce(F.col("sum_words") - F.col("above"), zero).alias("own"), F.coalesce("leaf", zero).alias("leaf"))
    owned = keep(owned)

    # second pass: childless nodes and distinct words below
    below = trie_nodes(per(owned.select("conv_id", "length", "own", "leaf")), ["own", "leaf"]).select("depth", "x1", "x2", F.col("own").alias("sum_own"), F.col("leaf").alias("n_leaves"))
    below = below.unionByName(owned.agg(F.sum("own").alias("o"), F.sum("leaf").alias("l"), F.count(F.lit(1)).alias("n")).where("n > 0").select(*root(F.col("o").alias("sum_own"), F.col("l").alias("n_leaves"))))
    smallest = owned.select(F.col("conv_id").alias("least"), F.col("sum_words").alias("least_words"), F.col("own").alias("least_own"))
    ends = end_digests(owned.withColumnRenamed("length", "depth"))
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("least").alias("parent_conv_id"))
    out = nodes.join(below, ["depth", "x1", "x2"]).join(ends, ["depth", "x1", "x2"], "left").join(smallest, "least").join(parent, ["depth", "p1", "p2"], "left")
    distinct = F.col("sum_own") - F.col("least_own") + F.col("least_words") - F.col("before")
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("sum_words") - F.col("n") * F.col("before") - distinct).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, length(role) || ':' || role || text AS body, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos FROM t
), c0 AS (
  SELECT DISTINCT conv_id FROM t
), bits AS (
  SELECT conv_id, crc, i FROM (SELECT conv_id, 4294967295::BIGINT AS crc, 0 AS i FROM c0)
), crc AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, length(conv_id::VARCHAR)), lambda j: ascii(substr(conv_id::VARCHAR, j, 1))::BIGINT)),
    lambda s, ch: list_reduce(list_prepend(xor(s, ch), generate_series(1::BIGINT, 8::BIGINT)), lambda r, _: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS s FROM c0
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(s, 4294967295) % 4 AS h FROM crc
), heads AS (
  SELECT c.conv_id, o.pos AS p, o.body, o.w FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
), taken AS (
  SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id
), r AS (
  SELECT * FROM heads
  UNION ALL SELECT o.conv_id, o.pos - c.h + coalesce(taken.n, 0), o.body, o.w FROM o JOIN c USING (conv_id) LEFT JOIN taken USING (conv_id) WHERE o.pos > c.h
), pre AS (
  SELECT conv_id, p, w, list(sha256(body)) OVER (PARTITION BY conv_id ORDER BY p) AS path FROM r
), k AS (
  SELECT conv_id, p AS depth, w, sha256(list_aggregate(path, 'string_agg', ',')) AS id,
         CASE WHEN p = 1 THEN '' ELSE sha256(list_aggregate(path[:p - 1], 'string_agg', ',')) END AS up FROM pre
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
), last AS (
  SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id
), node AS (
  SELECT id, any_value(up) AS up, k.depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (k.depth = last.depth), '')) AS ends_sha256
  FROM k JOIN last USING (conv_id) GROUP BY id, k.depth
), kids AS (
  SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up
), whole AS (
  SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.up = node.id
), sub AS (
  SELECT a.id, sum((x.n_convs - 1) * x.w) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
  FROM whole x JOIN k a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY a.id
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, sub.leaves AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM whole n JOIN sub USING (id) LEFT JOIN node p ON p.id = n.up
"""
