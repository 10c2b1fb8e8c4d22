"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 values (seed 42)
of the text's 3-word shingles.  Two fingerprints link at ``MAX_BITS`` = 3 or
fewer differing bits.

Search: the 64 bits are cut in three segments of 21, 21 and 22 bits, each a word
of the perfect binary Golay code [23, 12, 7] with its high bits zero.  Three
errors over three segments leave at least two segments with at most one error
each (pigeonhole).  A word x lies within 3 bits of exactly one codeword c(x); the
codewords within 4 bits of x are c(x) and, where x is 3 bits off, five more.  If
x and y differ in at most one bit, c(x) is within 4 bits of y.  So a stored
fingerprint has one key for each of the three segment pairs, (c(x_i), c(x_j)),
and a probing one up to 6 x 6; every linked pair meets on a key, from both
sides.  Keys are joined by equality and candidates verified by the bit count of
the xor.  Only distinct fingerprints are searched, so copies make no pairs.

Links go through connected components; component_id is the least doc_id.

Edge cases: a null or empty text, or one of white space, has fingerprint 0 and is
linked like any other; one or two words make one shingle; null doc_ids never give
the component_id (it is null if a component has no other); repeated rows each
get their row; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import keep, table, text_bytes, words
from tarmac.operators.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 divides x^23 + 1
CHUNK = 1 << 14


def fingerprint(tokens: list[bytes], shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a word list; shingles are hashed in chunks, so memory follows the text."""
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[shingle - 1:] - 1).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i:i + CHUNK], last[i:i + CHUNK])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """row_id, doc_id, fp (the 64 bits as a long) of every row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(words(t), shingle) for t in text_bytes(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["row_id", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return rows.mapInArrow(run, "row_id long, doc_id long, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


@cache
def error_table() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight 3 or less, and the five of weight 4 (or -1)."""
    bits = 1 << np.arange(23)
    i, j, k, m = np.indices((23,) * 4).reshape(4, -1)
    four = bits[np.array([i, j, k, m])[:, (i < j) & (j < k) & (k < m)]].sum(axis=0)
    i, j, k = np.indices((23,) * 3).reshape(3, -1)
    three = bits[np.array([i, j, k])[:, (i < j) & (j < k)]].sum(axis=0)
    i, j = np.indices((23,) * 2).reshape(2, -1)
    two = bits[np.array([i, j])[:, i < j]].sum(axis=0)
    leader, more = np.zeros(2048, np.int64), np.full((2048, 5), -1, np.int64)
    for e in (three, two, bits):
        leader[syndrome(e)] = e
    leader[0] = 0
    deep = syndrome(three)
    s = syndrome(four)
    pick = np.isin(s, deep)
    s, four = s[pick], four[pick]
    order = np.argsort(s, kind="stable")
    s, four = s[order], four[order]
    at = np.arange(len(s)) - np.searchsorted(s, s)
    more[s, at] = four
    return leader, more


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit index of the nearest codeword, and of the other codewords within 4 bits (-1: none)."""
    leader, more = error_table()
    s = syndrome(x)
    others = more[s]
    return (x ^ leader[s]) >> 11, np.where(others < 0, -1, (x[:, None] ^ others) >> 11)


def golay_keys(fps: DataFrame, probe: bool) -> DataFrame:
    """(key, fp) for each segment pair: one key a pair if stored, every near key if probing."""
    name = "probe" if probe else "fp"

    def run(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).astype(np.int64)
            u = fp.view(np.uint64)
            near = []
            for at, width in SEGMENTS:
                c, others = decode(((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
                near.append(np.column_stack([c, others]) if probe else c[:, None])
            for p, (i, j) in enumerate(PAIRS):
                a, c = near[i][:, :, None], near[j][:, None, :]
                key = np.where((a >= 0) & (c >= 0), (p << 24) | (a << 12) | c, -1).reshape(len(fp), -1)
                row, _ = np.nonzero(key >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[key >= 0].astype(np.int32)), pa.array(fp[row])], ["key", name])

    return fps.select("fp").mapInArrow(run, f"key int, {name} long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a < b) between distinct fingerprints at most ``MAX_BITS`` bits apart; each may appear under several keys."""
    stored, probes = golay_keys(fps, False), golay_keys(fps, True)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= MAX_BITS
    return probes.join(stored, "key").where((F.col("fp") < F.col("probe")) & near).select(F.col("fp").alias("a"), F.col("probe").alias("b"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """row_id, doc_id, fp, component_id, and the least (row_id) of the component's representative as win_row."""
    rows = keep(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    fps = keep(rows.groupBy("fp").agg(first))
    edges = keep(links(fps).distinct())
    if edges.isEmpty():
        best = fps.select("fp", "first")
    else:
        roots = components(edges).select(F.col("node").alias("fp"), "root")
        rooted = keep(fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
        top = rooted.groupBy("root").agg(F.min("first").alias("top"))
        best = rooted.join(top, "root").select("fp", F.col("top").alias("first"))
    out = rows.join(best, "fp", "left")
    return out.select("row_id", "doc_id", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("win_row"))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_simhash_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate component stays, with all its columns."""
    stay = near_components(docs).where("row_id = win_row").select(F.col("row_id").alias("__row"))
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(stay, "__row", "left_semi").drop("__row")
