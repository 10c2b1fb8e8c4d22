"""Toxicity by a counterfactual-regularised sparse logistic model.

A text is the set of its lower-cased words (runs of letters) and their first
``PREFIXES`` letters, hashed to 2^``HASH_BITS`` places.  Training texts that mention a group get a twin in which
each identity term is swapped for another of its list; the loss adds
``PENALTY`` times the squared change of score between the two, so a mention as
such carries no weight.  Weights are learnt by FTRL-proximal steps whose L1 part
leaves words without evidence at exactly 0: long clean texts gather no noise.

The fit reads a bounded sample: of each class the ``PER_CLASS`` labelled rows
first in hash order of the id, never rows whose crc32(doc_id) mod 4 is 2.  A row
weighs its class's labels / sampled labels, scaled to a mean of 1, so the base rate
and the threshold mean the same whether or not a class reaches ``PER_CLASS``.  The
fit runs in one task over at most 2 x ``PER_CLASS`` texts; the nonzero weights (at most
2^``HASH_BITS``) go to the scoring tasks.  Every text is scored whole.

Edge cases: null and empty texts score the base rate; labels that are null are not
used, a doc_id labelled twice takes its highest label; without any usable label
every score is 0; null doc_ids and rows repeated whole are ordinary rows; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import doc_crc_mod, table

HASH_BITS = 20
PER_CLASS = 8000
PREFIXES = (4, 5, 6)
EPOCHS = 10
RATE, L1, L2 = 2.0, 4.0, 0.1
PENALTY = 4.0
THRESHOLD = 0.3
FOLDS, TEST_FOLD = 4, 2

# Identity terms, each list a dimension along which a mention is swapped.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "bisexual"),
    ("lesbian", "heterosexual"),
    ("transgender", "cisgender"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAP = {t: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS for i, t in enumerate(terms)}
LETTERS = re.compile(r"[^\W\d_]+")
MASK = (1 << HASH_BITS) - 1


def text_words(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def places(words: set[str]) -> set[int]:
    """Hashed places of the words and of the starts of the longer ones."""
    found = set(words)
    for n in PREFIXES:
        found |= {"^" + w[:n] for w in words if len(w) > n}
    return {crc32(w.encode("utf-8", "replace")) & MASK for w in found}


def hashed(words: set[str]) -> np.ndarray:
    return np.array(sorted(places(words)), np.int32)


def twin(words: set[str]) -> set[str] | None:
    """The words with identity terms swapped; None if there are none."""
    named = words & SWAP.keys()
    return (words - named) | {SWAP[w] for w in named} if named else None


class Ftrl:
    """FTRL-proximal logistic regression over sets of hashed words, with an unpenalised base weight."""

    def __init__(self):
        size = MASK + 2
        self.z, self.n, self.w = np.zeros(size), np.zeros(size), np.zeros(size)

    def score(self, ids: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.w[ids].sum() + self.w[-1], -35, 35)))

    def step(self, ids: np.ndarray, gradient: float) -> None:
        for at, l1 in ((ids, L1), (np.array([MASK + 1]), 0.0)):
            new = self.n[at] + gradient * gradient
            sigma = (np.sqrt(new) - np.sqrt(self.n[at])) / RATE
            self.z[at] += gradient - sigma * self.w[at]
            self.n[at] = new
            z = self.z[at]
            self.w[at] = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(new)) / RATE + L2))

    def learn(self, ids: np.ndarray, other: np.ndarray | None, label: int, weight: float = 1.0) -> None:
        p = self.score(ids)
        gradient = weight * (p - label)
        if other is not None:  # d/ds of PENALTY * (p - p')^2, on the words in which the twins differ
            q = self.score(other)
            gap = 2 * weight * PENALTY * (p - q)
            self.step(np.setdiff1d(other, ids), -gap * q * (1 - q))
            self.step(np.setdiff1d(ids, other), gap * p * (1 - p))
        self.step(ids, gradient)


def class_weights(labels: dict[int, int]) -> dict[int, float]:
    """Weight of a sampled row of each class, from the classes' label counts: labels / sampled, scaled to a mean of 1 over the sample."""
    sampled = {c: min(n, PER_CLASS) for c, n in labels.items()}
    scale = sum(sampled.values()) / max(1, sum(labels.values()))
    return {c: n / sampled[c] * scale for c, n in labels.items()}


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """tie, toxic, row_weight, ids, other (int32 bytes) of at most ``PER_CLASS`` labelled documents of each class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (doc_crc_mod("doc_id", FOLDS) != TEST_FOLD))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    row_weights = class_weights({r["__toxic"]: r["count"] for r in known.where("__toxic IN (0, 1)").groupBy("__toxic").count().collect()})
    first = lambda c: known.where(F.col("__toxic") == c).orderBy(F.xxhash64("__id", F.lit(5)), "__id").limit(PER_CLASS)
    pick = lambda c: first(c).withColumn("__weight", F.lit(row_weights.get(c, 1.0)))
    sample = F.broadcast(pick(1).unionByName(pick(0)))  # 2 x PER_CLASS rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).join(sample, "__id")

    def run(batches):
        for b in batches:
            words = [text_words(t) for t in b.column(3).to_pylist()]
            twins = [twin(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([hashed(w).tobytes() for w in words], pa.binary()),
                 pa.array([hashed(w).tobytes() if w is not None else None for w in twins], pa.binary())],
                ["tie", "toxic", "row_weight", "ids", "other"],
            )

    return rows.select(F.xxhash64("__id", F.lit(6)), "__toxic", "__weight", "__text").mapInArrow(run, "tie long, toxic int, row_weight double, ids binary, other binary")


def fit(sample: DataFrame) -> dict[int, float] | None:
    """Nonzero weights by hashed word, the base weight at -1; None without labels."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("tie", "ids", "toxic", "other", "row_weight"))), key=lambda r: r[:3])
        rows = [(np.frombuffer(i, np.int32), None if o is None else np.frombuffer(o, np.int32), y, w) for _, i, y, o, w in rows]
        model = Ftrl()
        for _ in range(EPOCHS):
            for ids, other, label, weight in rows:
                model.learn(ids, other, label, weight)
        at = np.append(np.flatnonzero(model.w[:-1]), MASK + 1)
        return pa.table({"id": pa.array(np.where(at > MASK, -1, at), pa.int64()), "weight": pa.array(model.w[at])})

    one = sample.withColumn("one", F.lit(1)).groupBy("one")
    return {r["id"]: r["weight"] for r in one.applyInArrow(run, "id long, weight double").collect()} or None


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row_id, held_out, score, predicted of every document."""
    weights = fit(training_sample(docs, labels))

    def run(batches):
        ids = (weights or {}).keys() - {-1}
        for b in batches:
            out = []
            for text in b.column(3).to_pylist():
                hit = places(text_words(text)) & ids if weights else ()
                s = sum(weights[i] for i in sorted(hit)) + weights[-1] if weights else -np.inf
                out.append(1 / (1 + np.exp(-np.clip(s, -35, 35))) if weights else 0.0)
            score = np.array(out, float)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["row_id", "doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), (doc_crc_mod("doc_id", FOLDS) == TEST_FOLD).alias("held_out"), "text")
    return rows.mapInArrow(run, "row_id long, doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def stage_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go, the others stay with all their columns."""
    clean = scored(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(F.col("row_id").alias("__row"))
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(clean, "__row", "left_semi").drop("__row")
