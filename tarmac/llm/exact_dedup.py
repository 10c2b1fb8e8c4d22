"""Exact dedup by a minimal perfect hash over the distinct historical digests.

A text's identity is the SHA-256 of its bytes after lower-casing A-Z.  The
history is one row per distinct digest with the locator of its winner (largest
doc_id, then largest row number) and its group size.  Distinct digests are dealt
to buckets of about ``BUCKET_KEYS`` keys; inside a bucket a minimal perfect hash
is built: keys fall into sub-buckets, each sub-bucket gets the first pilot number
that sends its keys to free slots, and the m keys fill the slots 0..m-1.  A slot
holds the full digest and the winner's locator.

Lookup: a row takes its bucket's pilots, computes its slot, takes the slot and
compares all 32 bytes.  Equal: the row repeats a historical text.  Unequal: it is
no member; nonmembers are grouped by digest on their own.

Nothing but one bucket is ever in one task's memory.  The history is a map-side
combined aggregate, so a hot digest costs a row per map task; the two lookups are
shuffled equi-joins whose row side adaptive execution may split.

Edge cases: a null text counts as empty; null doc_ids lose to any other and stay
null as keep_id; rows repeated whole are told apart by their row number, so
exactly one row of a group stays; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import keep, shards_for, table, text_bytes

BUCKET_KEYS = 256
SUB_KEYS = 4
LOW = (1 << 31) - 1
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, digest (32 bytes) of every row; narrow, one pass over the texts."""

    def run(batches):
        for b in batches:
            d = [hashlib.sha256(t.lower()).digest() for t in text_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.binary())], ["row_id", "doc_id", "digest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return rows.mapInArrow(run, "row_id long, doc_id long, digest binary")


def history_of(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: winner's locator (win_doc, win_row) and group_size."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row_id")).alias("best")
    return (
        rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("win_doc"), F.col("best.row_id").alias("win_row"), "group_size")
    )


def with_hashes(df: DataFrame, buckets: int) -> DataFrame:
    """bucket, and two 64-bit hashes of the digest for the sub-bucket and the slot."""
    return df.withColumns({
        "bucket": F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(buckets)),
        "h_sub": F.xxhash64("digest", F.lit(2)),
        "h_slot": F.xxhash64("digest", F.lit(3)),
    })


def _slot_hash(h: np.ndarray, pilot: np.ndarray) -> np.ndarray:
    """Multiply-shift hash of int64 ``h`` under a pilot; products stay under 2^62. `slot_of` is the same in Spark columns."""
    a, b = pilot * MULTIPLIERS[0] & LOW | 1, pilot * MULTIPLIERS[1] & LOW | 1
    return (((h & LOW) * a ^ (h >> 31 & LOW) * b) >> 20) & LOW


def slot_of(h: F.Column, pilot: F.Column, m: F.Column) -> F.Column:
    low = lambda c: c.bitwiseAND(F.lit(LOW))
    a, b = (low(pilot.cast("long") * F.lit(k)).bitwiseOR(F.lit(1)) for k in MULTIPLIERS)
    mixed = (low(h) * a).bitwiseXOR(low(F.shiftright(h, 31)) * b)
    return F.pmod(low(F.shiftright(mixed, 20)), m.cast("long"))


def build_bucket(h_sub: np.ndarray, h_slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of the sub-buckets and the slot of every key: a bijection onto 0..m-1."""
    m = len(h_sub)
    subs = max(1, -(-m // SUB_KEYS))
    sub = np.mod(h_sub, subs)
    hs = h_slot
    order = np.argsort(sub, kind="stable")
    bounds = np.searchsorted(sub[order], np.arange(subs + 1))
    pilots, slots, free = np.zeros(subs, np.int32), np.zeros(m, np.int64), np.ones(m, bool)
    for g in np.argsort(-np.diff(bounds), kind="stable"):
        keys = order[bounds[g]:bounds[g + 1]]
        if not len(keys):
            break
        if len(np.unique(hs[keys])) < len(keys):
            raise ValueError("two digests share a 64-bit slot hash; rebuild with another hash number")
        start, step = 0, 64
        while True:
            p = np.arange(start, start + step)
            s = _slot_hash(hs[keys][None, :], p[:, None]) % m
            ok = free[s].all(axis=1)
            if len(keys) > 1:
                t = np.sort(s, axis=1)
                ok &= (t[:, 1:] != t[:, :-1]).all(axis=1)
            hit = np.flatnonzero(ok)
            if len(hit):
                pilots[g], slots[keys] = p[hit[0]], s[hit[0]]
                free[s[hit[0]]] = False
                break
            if start > 1 << 24:
                raise ValueError("no pilot places a sub-bucket; rebuild with another hash number")
            start, step = start + step, min(step * 2, 4096)
    return pilots, slots


def build_mph(history: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(pilots: bucket, m, pilots), (slots: bucket, slot, slot_digest, locator, group_size), number of buckets."""
    history = keep(history)
    buckets = shards_for(history.count(), BUCKET_KEYS)

    def build(t: pa.Table) -> pa.Table:
        pilots, slots = build_bucket(t["h_sub"].to_numpy(), t["h_slot"].to_numpy())
        one = pa.array([pilots.tolist()] + [None] * (len(t) - 1), pa.list_(pa.int32()))
        t = t.drop_columns(["h_sub", "h_slot"]).append_column("slot", pa.array(slots))
        return t.append_column("m", pa.array(np.full(len(t), len(t), np.int32))).append_column("pilots", one)

    schema = "bucket long, digest binary, win_doc long, win_row long, group_size long, slot long, m int, pilots array<int>"
    built = with_hashes(history, buckets).select(
        "bucket", "digest", "win_doc", "win_row", "group_size", "h_sub", "h_slot"
    ).groupBy("bucket").applyInArrow(build, schema)
    built = keep(built)
    pilots = built.where("pilots IS NOT NULL").select("bucket", "m", "pilots")
    slots = built.select("bucket", "slot", F.col("digest").alias("slot_digest"), "win_doc", "win_row", "group_size")
    return pilots, slots, buckets


def lookup(rows: DataFrame, pilots: DataFrame, slots: DataFrame, buckets: int) -> DataFrame:
    """rows with `member` and, for members, the slot's locator and group size."""
    r = with_hashes(rows, buckets).join(pilots, "bucket", "left")
    pilot = F.element_at("pilots", (F.pmod("h_sub", F.size("pilots")) + 1).cast("int"))
    r = r.select("row_id", "doc_id", "digest", "bucket", slot_of(F.col("h_slot"), pilot, F.col("m")).alias("slot"))
    r = r.join(slots, ["bucket", "slot"], "left").withColumn("member", F.coalesce(F.col("slot_digest") == F.col("digest"), F.lit(False)))
    known = [F.when(F.col("member"), F.col(c)).alias(c) for c in ("win_doc", "win_row", "group_size")]
    return r.select("row_id", "doc_id", "digest", "member", *known)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """row_id, doc_id, digest, member, keep_id, group_size, kept for every row of ``docs``.

    Without ``history`` the table is its own history: winners stay, repeats go.
    With an earlier ``history`` (as ``history_of`` returns it) members are all
    repeats, and the nonmembers' own winners stay.
    """
    rows = keep(digests(docs))
    pilots, slots, buckets = build_mph(history_of(rows) if history is None else history)
    found = keep(lookup(rows, pilots, slots, buckets))
    known = found.where("member").select(
        "row_id", "doc_id", "digest", "member", F.col("win_doc").alias("keep_id"), "group_size",
        (F.col("win_row") == F.col("row_id") if history is None else F.lit(False)).alias("kept"),
    )
    new = found.where(~F.col("member")).select("row_id", "doc_id", "digest", "member")
    if new.isEmpty():
        return known
    grouped = new.join(history_of(new), "digest").select(
        "row_id", "doc_id", "digest", "member", F.col("win_doc").alias("keep_id"), "group_size", (F.col("win_row") == F.col("row_id")).alias("kept")
    )
    return known.unionByName(grouped)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays of its group of equal texts."""
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage_exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts stays, with all its columns."""
    stay = exact_dedup(docs).where("kept").select(F.col("row_id").alias("__row"))
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(stay, "__row", "left_semi").drop("__row")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
