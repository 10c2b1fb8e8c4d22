"""N-gram Jaccard join by grouped prefixes, with the components of its links.

Sets.  A document's set holds the 64-bit hashes of its distinct shingles; equal sets are found by digest and go on as
one document.  Two sets reach ``percent`` only if they share a shingle among the first n - ceil(percent n / 100) + 1 of
a common order.  The order is by the count of a shingle's bucket in a sketch of the whole corpus, rare ones first, so it
keeps frequent shingles out of the prefixes; whatever the counts, the result is exact.

Groups.  Shingles that stand in one prefix only cannot match and are left out; documents with the same remaining prefix
and the same size form one group.  Groups meet in the buckets of their prefix shingles.  A pair of groups is filtered by
size and by the most overlap that their prefixes leave possible, then expanded to members, which are filtered by the
parity bits of their sets and verified by counting the common hashes.

Hubs.  Neither the pairs of a bucket nor those of a group are written out.  A round compares every group of a bucket
with the bucket's first groups (largest first) and every document of a group with the group's first documents, and
members of a pair of groups with the first documents of the larger.  Documents that verified links have joined are not compared again, so a
large family of near copies costs a few comparisons each.  The next round takes ``GROWTH`` times as many firsts, and
rounds go on until every bucket, group and pair is one component or wholly compared; so no link between components is lost.

Sets are made from the texts whenever needed (a few numpy operations a text), never stored: they take more room than the
texts.

Edge cases: null and empty texts and those of white space have no shingles and are linked with nothing (component_id is
the row's own doc_id); one or two words make one shingle; null doc_ids never give the component_id (it is null if a
component has no other); repeated rows each get their row; an empty table gives an empty result; other columns are not
looked at.  Shingles are told apart by 64-bit hashes of their words' 64-bit hashes, sets by 128 bits of BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import keep, places, table
from tarmac.operators.components import components
from tarmac.session import cut_lineage, drop_cuts

SHINGLE = 3
PERCENT = 90
SEED = 42
SKETCH_LOAD = 256  # shingles a bucket, until the sketch has its largest size
SKETCH_BITS = (12, 22)
SKETCH_BLOCK = 1 << 12
PARITY_LONGS = 16
GROWTH = 8
BATCH_BYTES = 4 << 20
CHUNK_BYTES = 1 << 18  # of texts hashed at once


def _letters() -> np.ndarray:
    """A random 64-bit number for each byte, the same for A-Z and a-z."""
    numbers = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)
    numbers[65:91] = numbers[97:123]
    return numbers


LETTER = _letters()
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``BASE`` and of its inverse modulo 2^64, at least ``n``."""
    if len(_powers.held[0]) < n:
        size = 1 << max(20, n.bit_length())
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers.held = tuple(both)
    return _powers.held


_powers.held = (np.empty(0, np.uint64),) * 2


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the words of texts that lie end to end, and the number of words before each text (one more entry)."""
    power, inverse = _powers(len(data))
    inside = ~SPACE[data]
    fresh = np.ones(len(data), bool)  # the byte before is a space or of another text
    fresh[1:] = ~inside[:-1]
    fresh[cuts[cuts < len(data)]] = True
    start = np.flatnonzero(inside & fresh)
    last = np.ones(len(data), bool)
    last[:-1] = fresh[1:] | ~inside[1:]
    end = np.flatnonzero(inside & last) + 1
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[data] * power[: len(data)], dtype=np.uint64)])
    return (upto[end] - upto[start]) * inverse[start], np.searchsorted(start, cuts)


def mixed(w: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes, in which place and word both count."""
    h = np.full(max(0, len(w) - width + 1), width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:i + len(h)]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def all_shingles(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text (null: empty) the hashes of its shingles in order; a text of fewer words is one shingle."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        w, first = word_hashes(data[at[i]:at[j]], at[i:j + 1] - at[i])
        whole = mixed(w, shingle)
        for a, b in zip(first.tolist(), first[1:].tolist()):
            yield whole[a:b - shingle + 1] if b - a >= shingle else mixed(w[a:b], b - a) if b > a else w[:0]
        i = j


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for h in all_shingles(texts, shingle):
        h = np.sort(h)
        yield h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def set_digests(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row_id, doc_id, n (size) and digest of every row's set."""

    def run(batches):
        for b in batches:
            n, digest = [], []
            for h in shingle_sets(b.column(2), shingle):
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], ["row_id", "doc_id", "n", "digest"])

    return texts.mapInArrow(run, "row_id long, doc_id long, n long, digest binary")


def sketch(texts: DataFrame, tokens: int, shingle: int = SHINGLE) -> np.ndarray:
    """Counts of all shingles by their low bits: at least 2^12 and at most 2^22 buckets, so at most 16 MB on the driver."""
    low, high = SKETCH_BITS
    size = 1 << min(high, max(low, (tokens // SKETCH_LOAD).bit_length()))

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for h in all_shingles(b.column(0), shingle):
                h = h & np.uint64(size - 1)
                if len(h) > size // 8:
                    total += np.bincount(h.astype(np.int64), minlength=size)
                else:
                    np.add.at(total, h.astype(np.int64), 1)
        blocks = total.reshape(-1, min(size, SKETCH_BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array([x.astype("<u4").tobytes() for x in blocks])], ["block", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in t["counts"])
        return pa.table({"block": t["block"][:1], "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()])})

    parts = texts.select("text").mapInArrow(count, "block long, counts binary").groupBy("block").applyInArrow(add, "block long, counts binary")
    blocks = sorted((r["block"], r["counts"]) for r in parts.collect())
    return np.frombuffer(b"".join(c for _, c in blocks), "<u4") if blocks else np.zeros(size, "<u4")


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(texts: DataFrame, counts, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row_id, n, prefix (rarest shingles first), parity (bits of the set, as longs); ``counts`` is a broadcast sketch."""

    def run(batches):
        rare = counts.value
        mask = np.uint64(len(rare) - 1)
        for b in batches:
            ids, sizes, prefix, parity = [], [], [], []
            for row, u in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), shingle)):
                if not len(u):
                    continue
                ids.append(row), sizes.append(len(u))
                seen, k = rare[(u & mask).astype(np.int64)], prefix_length(len(u), percent)
                bound = np.partition(seen, k - 1)[k - 1]
                few = np.flatnonzero(seen <= bound)  # no rarer one outside; only these need sorting
                prefix.append(u[few[np.lexsort((u[few], seen[few]))[:k]]].view(np.int64))
                odd = np.bincount((u >> np.uint64(32)).astype(np.int64) % (64 * PARITY_LONGS), minlength=64 * PARITY_LONGS) & 1
                parity.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            at = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefix) if prefix else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(parity, pa.list_(pa.int64()))], ["row_id", "n", "prefix", "parity"])

    return texts.select("row_id", "text").mapInArrow(run, "row_id long, n long, prefix array<long>, parity array<long>")


def grouped(pre: DataFrame) -> DataFrame:
    """row_id, n, parity, gid, tokens, place: documents with a shared prefix shingle, by group and by place in it."""
    tokens = pre.select("row_id", F.explode("prefix").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    per = tokens.join(common, "token").groupBy("row_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))  # at most a prefix
    named = F.unhex(F.md5(F.array_join(F.concat(F.array("n"), "tokens"), ",").cast("binary")))
    members = pre.drop("prefix").join(per, "row_id").withColumn("gid", named)
    ordered = members.withColumn("h", F.xxhash64("row_id"))
    return places(ordered, ["gid"], ["h", "row_id"], "place").drop("h")


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Common shingles that sets of these sizes need."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def sets_of(texts: DataFrame, ids: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row_id, hashes (sorted uint64 bytes) of the rows in ``ids``, made again from the texts: sets of all rows are never stored."""

    def run(batches):
        for b in batches:
            rows, h, held = [], [], 0
            for row, found in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), shingle)):
                rows.append(row)
                h.append(found.tobytes())
                held += len(h[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(h, pa.binary())], ["row_id", "hashes"])
                    rows, h, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(h, pa.binary())], ["row_id", "hashes"])

    return texts.select("row_id", "text").join(ids, "row_id", "left_semi").mapInArrow(run, "row_id long, hashes binary")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a, b (the distinct components joined) of the pairs (x, y, cx, cy; a cut) whose sets reach ``percent``."""
    sets = keep(sets_of(texts, pairs.select(F.col("x").alias("row_id")).union(pairs.select("y")).distinct(), shingle))
    of = lambda name: sets.select(F.col("row_id").alias(name), F.col("hashes").alias(f"h{name}"))
    both = pairs.join(of("x"), "x").join(of("y"), "y").select("cx", "cy", "hx", "hy")

    def run(batches):
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3)):
                a, c = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(c):
                    a, c = c, a
                at = np.searchsorted(c, a)
                inter = int((c[np.minimum(at, len(c) - 1)] == a).sum())
                linked.append(100 * inter >= percent * (len(a) + len(c) - inter))
            keep_rows = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep_rows), b.column(1).filter(keep_rows)], ["cx", "cy"])

    found = both.mapInArrow(run, "cx long, cy long")
    links = keep(found.select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b")).distinct())
    drop_cuts(sets)
    return links


def linked_components(members: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row_id, comp: the components of the verified links among ``members`` (cut of row_id, n, parity, gid, tokens, place)."""
    groups = keep(members.groupBy("gid").agg(F.any_value("n").alias("n"), F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("m")))
    postings = groups.select("gid", "n", F.explode("tokens").alias("token"), (-F.col("m")).alias("__m"))
    buckets = keep(places(postings, ["token"], ["__m", "gid"], "at").drop("__m"))
    members = keep(members.select("row_id", "n", "parity", "gid", "place", F.col("row_id").alias("comp")))
    several = keep(groups.where("m > 1").select("gid", "m"))
    most = max([1, *(x for x in (groups.agg(F.max("m")).first()[0], buckets.agg(F.max("at")).first()[0]) if x)])
    pairs, done, upto = None, 0, 1
    while True:
        state = keep(members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
        # pairs of groups not met yet, from buckets that are not one component
        lively = buckets.join(state, "gid")
        torn = lively.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("u")).where("l < u").select("token")
        lively = lively.join(torn, "token")
        hubs = lively.where((F.col("at") > done) & (F.col("at") <= upto)).select("token", *[F.col(c).alias(f"h{c}") for c in ("gid", "n", "at", "lo", "hi")])
        apart = ~((F.col("lo") == F.col("hi")) & (F.col("hlo") == F.col("hhi")) & (F.col("lo") == F.col("hlo")))
        near = (100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")) & (F.col("at") > F.col("hat")) & apart
        met = lively.join(hubs, "token").where(near).select("gid", "hgid").distinct()
        # the most overlap: common prefix shingles and what lies behind the prefixes
        rest = lambda n: F.ceil(F.lit(percent) * F.col(n) / 100) - 1
        side = lambda *names: groups.select(*[F.col(a).alias(b) for a, b in zip(("gid", "n", "tokens", "m"), names)])
        full = met.join(side("gid", "n", "tokens", "m"), "gid").join(side("hgid", "hn", "htokens", "hm"), "hgid")
        reach = F.size(F.array_intersect("tokens", "htokens")) + F.greatest(rest("n"), rest("hn"))
        fresh = full.where(reach >= least_overlap(F.col("n"), F.col("hn"), percent)).select("gid", "hgid", "hm", F.lit(0).cast("long").alias("seen"))
        if pairs is not None:
            fresh = fresh.unionByName(pairs.where(F.col("hm") > done).withColumn("seen", F.lit(done).cast("long")))
        old, pairs = pairs, keep(fresh)
        drop_cuts(old)
        # documents of a group with its first ones, documents of a pair with the first ones of the larger group
        x = members.select("gid", F.col("row_id").alias("x"), F.col("n").alias("nx"), F.col("parity").alias("px"), F.col("comp").alias("cx"), F.col("place").alias("at"))
        y = members.where(F.col("place") <= upto).select(F.col("gid").alias("hgid"), F.col("row_id").alias("y"), F.col("n").alias("ny"), F.col("parity").alias("py"), F.col("comp").alias("cy"), F.col("place").alias("hat"))
        mixed = state.where("lo < hi").join(several, "gid").select("gid")
        inner = x.join(mixed, "gid").join(y.where(F.col("hat") > done).withColumnRenamed("hgid", "gid"), "gid").where("at > hat AND cx <> cy")
        outer = pairs.select("gid", "hgid", "seen").join(y, "hgid").where("hat > seen").join(x.drop("at"), "gid").where("cx <> cy")
        tried = inner.select("x", "y", "nx", "ny", "px", "py", "cx", "cy").unionByName(outer.select("x", "y", "nx", "ny", "px", "py", "cx", "cy"))
        bits = lambda i: F.bit_count(F.col("px")[i].bitwiseXOR(F.col("py")[i]))
        apart_bits = sum((bits(i) for i in range(1, PARITY_LONGS)), bits(0))
        tried = tried.where(apart_bits <= F.col("nx") + F.col("ny") - 2 * least_overlap(F.col("nx"), F.col("ny"), percent))
        tried = keep(tried.select("x", "y", "cx", "cy").distinct())
        links = verified(tried, texts, shingle, percent)
        if not links.isEmpty():
            roots = components(links).select(F.col("node").alias("comp"), "root")
            members = cut_lineage(members.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"), members)
        drop_cuts(tried, links, state)
        if upto >= most:
            return members.select("row_id", "comp")
        done, upto = upto, upto * GROWTH
        if not _open(members, buckets, several, pairs, done):
            return members.select("row_id", "comp")


def _open(members: DataFrame, buckets: DataFrame, several: DataFrame, pairs: DataFrame, done: int) -> bool:
    """Whether a bucket, a group or a pair of groups has rows beyond ``done`` and more than one component."""
    state = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    if not state.join(several.where(F.col("m") > done), "gid").where("lo < hi").isEmpty():
        return True
    per = buckets.join(state, "gid").groupBy("token").agg(F.max("at").alias("m"), F.min("lo").alias("l"), F.max("hi").alias("u"))
    if not per.where((F.col("m") > done) & (F.col("l") < F.col("u"))).isEmpty():
        return True
    large = pairs.where(F.col("hm") > done).join(state, "gid").join(state.select(F.col("gid").alias("hgid"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi")), "hgid")
    return not large.where(F.least("lo", "hlo") < F.greatest("hi", "hhi")).isEmpty()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row_id, doc_id, n, component_id of every row."""
    texts = texts_of(docs, id_col, text_col)
    rows = keep(set_digests(texts, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    classes = keep(rows.where("n > 0").groupBy("digest").agg(first, F.max("n").alias("n")))
    tokens = classes.agg(F.sum("n")).first()[0]
    if not tokens:
        return rows.select("row_id", "doc_id", "n", F.col("doc_id").alias("component_id"))
    counts = docs.sparkSession.sparkContext.broadcast(sketch(texts, tokens, shingle))
    ids = classes.select(F.col("first.row_id").alias("row_id"))
    members = keep(grouped(keep(prefixes(texts, counts, shingle, percent).join(ids, "row_id", "left_semi"))))
    comps = linked_components(members, texts, shingle, percent)
    drop_cuts(members)
    named = classes.select("digest", "first", F.col("first.row_id").alias("row_id")).join(comps, "row_id", "left").select("digest", "first", F.coalesce("comp", "row_id").alias("comp"))
    named = keep(named)
    top = named.groupBy("comp").agg(F.min("first").alias("top"))
    label = named.join(top, "comp").select("digest", F.col("top.doc_id").alias("least"), F.lit(True).alias("found"))
    out = rows.select("row_id", "doc_id", "n", "digest").join(label, "digest", "left")
    return out.select("row_id", "doc_id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    out = jaccard_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
