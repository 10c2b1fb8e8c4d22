"""Packing along a space-filling curve.

A document's vector counts its byte pairs hashed to ``BUCKETS`` places; a fixed
+-1 projection brings it to ``DIMS`` dimensions, each standardised over all
documents and cut to ``BITS`` bits, and the Hilbert index of that grid point,
followed by bits of the id's hash, is the sort key (the hash lets copies spread
over tasks).  Documents are dealt to ranges of the curve; a task reads its range
in order and fills sequences of ``LENGTH`` ids with neighbours, cutting a document
where a sequence is full.  What is left at a range's end becomes sequences whose
lengths are powers of two, so nothing is padded.

The first pass makes only keys; the second tokenises and shuffles the ids once.
A task holds one batch of rows and one sequence.

Edge cases: a null or empty text is the one end id; null doc_ids and rows
repeated whole are ordinary rows; ties of the key go by row number; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import keep, shards_for, table, text_bytes

LENGTH = 1024
END_ID = 0
BUCKETS = 256
DIMS = 4
BITS = 10
TIE_BITS = 22
RANGE_BYTES = 16 << 20
VOCABULARY = "byte_bpe_50k.tiktoken"


@cache
def encoder(path: str):
    """Ids of a text, as the `tokenizers` library gives them for the same vocabulary's .json file.

    The rank file holds that vocabulary; its library encodes about three times
    as fast.  A test compares the two over texts and over every code point.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def projection() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, DIMS))


def vector(text: bytes) -> np.ndarray:
    """The projected document vector."""
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(b) < 2:
        return np.zeros(DIMS)
    counts = np.bincount((b[:-1] * 31 + b[1:]) % BUCKETS, minlength=BUCKETS)
    return counts @ projection() / np.sqrt((counts ** 2).sum())


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims): undo excess rotations bit by bit, Gray-decode, interleave."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_key(vectors: np.ndarray, mean: np.ndarray, spread: np.ndarray, tie: np.ndarray) -> np.ndarray:
    z = (vectors - mean) / spread
    cell = np.minimum((1 << BITS) - 1, (1 / (1 + np.exp(-1.7 * z)) * (1 << BITS)).astype(np.int64))
    return hilbert(cell, BITS) << TIE_BITS | (tie & ((1 << TIE_BITS) - 1))


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.xxhash64("doc_id", F.lit(19)).alias("tie"),
    )


def curve_ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of each dimension over all documents, and the first key of each range."""

    def project(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            v = np.array([vector(t) for t in texts]).reshape(len(texts), DIMS)
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("tie"), size, *(pa.array(v[:, i]) for i in range(DIMS))], ["tie", "size", *names])

    names = [f"v{i}" for i in range(DIMS)]
    points = keep(rows.mapInArrow(project, "tie long, size long, " + ", ".join(f"{n} double" for n in names)))
    s = points.agg(F.sum("size").alias("size"), *[F.avg(n).alias("m" + n) for n in names], *[F.stddev_pop(n).alias("s" + n) for n in names]).first()
    mean = np.array([s["m" + n] or 0.0 for n in names])
    spread = np.array([s["s" + n] or 1.0 for n in names])

    def key(batches):
        for b in batches:
            v = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names])
            yield pa.RecordBatch.from_arrays([pa.array(curve_key(v, mean, spread, b.column("tie").to_numpy()))], ["key"])

    ranges = shards_for(s["size"] or 0, RANGE_BYTES)
    if ranges == 1:
        return mean, spread, np.zeros(0, np.int64)
    cut = points.select("tie", *names).mapInArrow(key, "key long").repartitionByRange(ranges, "key")
    firsts = cut.groupBy(F.spark_partition_id()).agg(F.min("key").alias("key")).select("key").collect()  # one a range
    return mean, spread, np.array(sorted(r["key"] for r in firsts), np.int64)


def tokenised(rows: DataFrame, mean, spread, firsts, path: str) -> DataFrame:
    """range, key, row_id, doc_id, ids (little-endian unsigned 16- or 32-bit, with the end id)."""

    def run(batches):
        encode = encoder(path)
        for b in batches:
            raw = text_bytes(b.column("text"))
            v = np.array([vector(t) for t in raw]).reshape(len(raw), DIMS)
            key = curve_key(v, mean, spread, b.column("tie").to_numpy())
            packed = [packed_ids(encode(t.decode("utf-8", "replace")) + [END_ID]) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(firsts, key, "right").astype(np.int64)), pa.array(key), b.column("row_id"), b.column("doc_id"), pa.array(packed, pa.binary())],
                ["range", "key", "row_id", "doc_id", "ids"],
            )

    return rows.mapInArrow(run, "range long, key long, row_id long, doc_id long, ids binary")


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 16-bit ids; an odd length marks 32-bit ids."""
    return np.array(ids, "<u2").tobytes() if max(ids) < 1 << 16 else b"\0" + np.array(ids, "<u4").tobytes()


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4", offset=1) if len(ids) % 2 else np.frombuffer(ids, "<u2").astype("<u4")


class Filler:
    """Fills sequences with pieces in order; finished pieces gather in ``rows``."""

    def __init__(self, range_id: int):
        self.next_id, self.open, self.fill, self.rows = range_id << 32, [], 0, []

    def add(self, row_id: int, doc_id: int | None, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(LENGTH - self.fill, n - at)
            self.open.append((row_id, doc_id, at, ids[at:at + take], n))
            self.fill, at = self.fill + take, at + take
            if self.fill == LENGTH:
                self.close(self.open)
                self.open, self.fill = [], 0

    def close(self, pieces: list) -> None:
        offset = 0
        for row_id, doc_id, at, ids, n in pieces:
            self.rows.append((doc_id, at, len(ids), ids.tobytes(), n, self.next_id, offset, row_id))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Cuts the unfilled sequence into lengths that are powers of two."""
        pieces, left = self.open, self.fill
        for bit in range(left.bit_length() - 1, -1, -1):
            room, part = left & (1 << bit), []
            while room:
                row_id, doc_id, at, ids, n = pieces[0]
                take = min(room, len(ids))
                part.append((row_id, doc_id, at, ids[:take], n))
                pieces = pieces[1:] if take == len(ids) else [(row_id, doc_id, at + take, ids[take:], n), *pieces[1:]]
                room -= take
            if part:
                self.close(part)
        self.open, self.fill = [], 0


PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, row_id long"


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = numbered(docs)
    mean, spread, firsts = curve_ranges(rows)
    names = [c.split()[0] for c in PIECE.split(", ")]
    types = {"ids": pa.binary()}

    def run(batches):
        filler, current = None, None
        for b in batches:
            for rng, row_id, doc_id, ids in zip(*(b.column(c).to_pylist() for c in ("range", "row_id", "doc_id", "ids"))):
                if rng != current:
                    done = filler.finish() or filler.rows if filler else []
                    filler, current = Filler(rng), rng
                    filler.rows = done
                filler.add(row_id, doc_id, unpack(ids))
            yield batch(filler.rows)
            filler.rows = []
        if filler:
            filler.finish()
            yield batch(filler.rows)

    def batch(out):
        columns = zip(*out) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, columns)], names)

    dealt = tokenised(rows, mean, spread, firsts, path).repartition(max(1, len(firsts)), "range")
    return dealt.sortWithinPartitions("range", "key", "row_id").mapInArrow(run, PIECE).drop("row_id")


def op7_curve_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences."""
    return stage_packing(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces in sequences instead of documents."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
