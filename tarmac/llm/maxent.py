"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(member | class, context) * P(word | member).
The class factor is a softmax over ``CLASSES`` classes whose scores sum weight
rows looked up by hash: a bias, the words 1 to 4 back (skip features) and the pairs
(1, 2) and (1, 3) back.  The end of a text and the ``SINGLES`` most frequent words
are classes of their own; the others are clusters of words with like neighbours,
where rarer words go by the hash of their last letters.  The member factor is a
softmax inside the class over its ``MEMBERS`` - 1 most frequent words and one member
for all others, from the class's own bias and hashed rows of the words 1 and 2 back;
both factors learn in the same steps.  A word among "all others" has its share of
their training words, less the share u kept for unknown words (words seen once /
all training words there).

Four passes, each over all rows.  *Counts*: every training word, pre-aggregated in
the tasks; N, V, the word list and u come from them.  *Neighbours*: sums of
neighbour counts by context symbol, from which the classes are clustered.
*Training*: each task makes AdaGrad steps on minibatches from the common start;
tasks' weights are averaged by their tokens in a tree of fan-in ``FAN_IN``.
*Scoring*: every text, in sparse numpy batches; words outside the list are joined
with their counts by word and summed by document.

The sizes follow the training tokens N (``sizes``): context words up to 96 N^(1/4),
weight rows and word list 4 and 16 times as many, so what the model gathers grows
with the corpus while a task can hold it (N = 10^13: 131,072 context words, 100 MB
of class weights).

Edge cases: a null text is empty and is scored as its end; without training texts
every word is unknown; null doc_ids and rows repeated whole are ordinary rows (a
null id counts as empty text for the fold); an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import doc_crc_mod, keep, table, text_bytes, words

FOLDS, HELD_OUT = 10, 0
CLASSES = 48
MEMBERS = 48
SINGLES = 15
TAILS = 1024
NEIGHBOURS = 200
BATCH = 8192
RATE = 0.1
FAN_IN = 64
TASK_TOKENS = 1 << 22
BLOCK_ROWS = 1024
FLUSH_WORDS = 1 << 17
HOT_HITS = 32
BACK = 4
OPEN = SINGLES + 1


def tail_of(word: bytes) -> int:
    """Bucket of a word by its last three bytes."""
    return crc32(word[-3:]) % TAILS


def sizes(tokens: int) -> tuple[int, int, int]:
    """Context words, weight rows of a factor and listed words for so many training tokens."""
    context = 256
    while 2 * context <= 96 * tokens ** 0.25:
        context *= 2
    return context, 4 * context, 16 * context


class Layout:
    """How the model is cut: ``ids`` word -> number (0 is the end), the symbol a number has in contexts, and by symbol its class
    and its member there (0: among all others).  ``head`` holds the listed words by falling count, ``counts`` their counts after
    that of the end."""

    def __init__(self, tokens: int, head: list[bytes], counts: list[int]):
        self.context, self.rows, _ = sizes(tokens)
        self.head, self.counts = head, np.array(counts, np.int64)
        self.ids = {w: i + 1 for i, w in enumerate(head)}
        tails = np.array([tail_of(w) for w in head], np.int64).reshape(-1)
        n = np.arange(1, len(head) + 1)
        self.symbols = self.context + TAILS
        self.symbol = np.append(0, np.where(n < self.context, n, self.context + tails)).astype(np.int32)
        self.symbol_class = np.zeros(self.symbols, np.int16)
        self.symbol_member = np.zeros(self.symbols, np.int16)

    def classify(self, signature: np.ndarray, weight: np.ndarray) -> None:
        """Classes and members from the symbols' neighbour counts and training counts, and the start of both factors."""
        free = np.r_[OPEN:self.symbols]
        self.symbol_class[1:OPEN] = np.arange(1, OPEN)
        self.symbol_class[free] = OPEN + cluster(signature[free], weight[free], CLASSES - OPEN)
        listed = min(self.context, len(self.head) + 1)
        share = np.zeros((CLASSES, MEMBERS))
        for c in range(OPEN, CLASSES):
            own = np.flatnonzero(self.symbol_class[:listed] == c)[: MEMBERS - 1]  # numbers go by falling count
            self.symbol_member[own] = np.arange(1, len(own) + 1)
            share[c, 1:len(own) + 1] = self.counts[own] + 0.5
        total = np.bincount(self.symbol_class, weights=weight, minlength=CLASSES)
        self.class_bias = np.log((total + 1) / (total + 1).sum()).astype(np.float32)
        inside = np.bincount(self.symbol_class, weights=weight * (self.symbol_member > 0), minlength=CLASSES)
        self.others = np.rint(total - inside)  # training words of a class that are no members
        share[:, 0] = self.others + 0.5
        with np.errstate(divide="ignore"):
            start = np.log(share / share.sum(axis=1, keepdims=True))
        self.member_bias = np.maximum(start, -1e4).astype(np.float32)  # -1e4: no such member


def cluster(signature: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k-means on the square roots of neighbour shares, from the heaviest rows as centres."""
    x = np.sqrt(signature / np.maximum(signature.sum(axis=1, keepdims=True), 1))
    centres = x[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(12):
        near = np.argmax(x @ centres.T - 0.5 * (centres ** 2).sum(axis=1), axis=1)
        for j in range(len(centres)):
            mine = near == j
            if mine.any():
                centres[j] = np.average(x[mine], axis=0, weights=weight[mine] + 1e-9)
    return near


class Parsed:
    """The tokens of some texts, each ending with its end: text, word number (-1: not listed), class, member, and the weight rows
    of both factors; ``odd`` holds the unlisted words."""

    def __init__(self, texts: list[bytes], layout: Layout, rows: bool = True):
        numbers, lengths, odd = [], [], []
        get = layout.ids.get
        for t in texts:
            w = words(t)
            at = [get(x, -1) for x in w]
            if -1 in at:
                odd += [x for x, i in zip(w, at) if i < 0]
            numbers += at
            numbers.append(0)
            lengths.append(len(w) + 1)
        self.number, lengths, self.odd = np.array(numbers, np.int32), np.array(lengths, np.int64), odd
        self.doc = np.repeat(np.arange(len(texts)), lengths)
        self.symbol = layout.symbol[self.number]
        self.symbol[self.number < 0] = [layout.context + tail_of(w) for w in odd]
        self.position = np.arange(len(self.number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if rows:
            self.classes, self.members = layout.symbol_class[self.symbol], layout.symbol_member[self.symbol]
            back = [self.back(k, layout.symbols) for k in range(1, BACK + 1)]
            pairs = [back[0] * 1048583 + back[1], back[0] * 1048583 + back[2]]
            self.rows = np.stack([hashed(v, k, layout.rows) for k, v in enumerate([*back, *pairs])], axis=1)
            own = self.classes.astype(np.int64)
            inner = [hashed(v * CLASSES + own, 16 + k, layout.rows - CLASSES) + CLASSES for k, v in enumerate(back[:2])]
            self.inner = np.stack([own.astype(self.rows.dtype), *(x.astype(self.rows.dtype) for x in inner)], axis=1)

    def back(self, k: int, start: int) -> np.ndarray:
        """Symbol ``k`` tokens back in the same text, or ``start``."""
        s = np.full(len(self.symbol), start, np.int64)
        s[k:] = np.where(self.position[k:] >= k, self.symbol[:-k], start)
        return s


def hashed(value: np.ndarray, k: int, n: int) -> np.ndarray:
    """Row of each value of feature ``k`` among ``n``."""
    return ((((value + 1) * 2654435761 + (k + 1) * 40503 * 65537) >> 13) % n).astype(np.uint16 if n < 1 << 16 else np.uint32)


def row_sums(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows``, and for each the sum of the lines of ``g`` that hit it.

    Rows go by falling hits: those above ``HOT_HITS`` are summed one by one, of the
    others the first hits of all are added at once, then the second ones, and so on.
    """
    flat = rows.ravel(order="F")
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    order %= len(g)
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    hits = np.diff(np.append(first, len(flat)))
    by_hits = np.argsort(-hits, kind="stable")
    first, hits = first[by_hits], hits[by_hits]
    sums = np.zeros((len(first), g.shape[1]), np.float32)
    hot = int((hits > HOT_HITS).sum())
    for i in range(hot):
        sums[i] = g[order[first[i]:first[i] + hits[i]]].sum(axis=0)
    for j in range(min(HOT_HITS, int(hits[0]))):
        upto = int(np.searchsorted(-hits, -j))  # rows of more than j hits
        sums[hot:upto] += g.take(order[first[hot:upto] + j], axis=0)
    return flat[first], sums


class Factor:
    """A softmax whose scores are sums of hashed weight rows, trained by AdaGrad."""

    def __init__(self, rows: int, width: int):
        self.weights, self.square = np.zeros((rows, width), np.float32), np.full((rows, width), 1e-2, np.float32)

    def step(self, target: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> None:
        g = np.exp(scores(self.weights, bias, rows))
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(g)), target] -= 1
        g *= np.float32(1 / np.sqrt(len(g)))
        at, sums = row_sums(rows, g)
        square = self.square.take(at, axis=0)
        square += sums * sums
        self.square[at] = square
        self.weights[at] -= RATE * sums / np.sqrt(square)


def scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unnormalised log scores, a row a token, greatest 0; ``bias`` is one row for all or one a token."""
    s = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        s += weights.take(rows[:, k], axis=0)
    s += bias
    s -= s.max(axis=1, keepdims=True)
    return s


def log_probability(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each token's target."""
    s = scores(weights, bias, rows)
    return s[np.arange(len(s)), target] - np.log(np.exp(s).sum(axis=1))


def choice(layout: Layout, weights: np.ndarray, inner: np.ndarray, bias: np.ndarray, p: Parsed) -> np.ndarray:
    """Natural log of P(class | context) * P(member | class, context) of each token."""
    out = np.zeros(len(p.number))
    for i in range(0, len(out), BATCH):
        to = slice(i, i + BATCH)
        out[to] = log_probability(weights, bias, p.rows[to], p.classes[to])
        at = i + np.flatnonzero(p.classes[to] >= OPEN)
        if len(at):
            out[at] += log_probability(inner, layout.member_bias[p.classes[at]], p.inner[at], p.members[at])
    return out


class Trainer:
    """AdaGrad on both factors, minibatch by minibatch."""

    def __init__(self, layout: Layout):
        self.layout, self.tokens = layout, 0
        self.outer, self.inner = Factor(layout.rows, CLASSES), Factor(layout.rows, MEMBERS)

    def learn(self, texts: list[bytes]) -> None:
        p = Parsed(texts, self.layout)
        self.tokens += len(p.number)
        for i in range(0, len(p.number), BATCH):
            to = slice(i, i + BATCH)
            self.outer.step(p.classes[to], p.rows[to], self.layout.class_bias)
            at = i + np.flatnonzero(p.classes[to] >= OPEN)
            if len(at):
                self.inner.step(p.members[at], p.inner[at], self.layout.member_bias[p.classes[at]])

    def parts(self):
        """(kind, values) of what the task adds to the common model; weights times its tokens."""
        n = np.float32(self.tokens)
        return [("weights", self.outer.weights * n), ("inner", self.inner.weights * n)]


class Neighbours:
    """Sums by symbol: its tokens (last column) and how often each of the most frequent words is within two places of it."""

    def __init__(self, layout: Layout):
        self.layout, self.tokens = layout, 0
        self.sums = np.zeros((layout.symbols, NEIGHBOURS + 1))

    def learn(self, texts: list[bytes]) -> None:
        p = Parsed(texts, self.layout, rows=False)
        self.tokens += len(p.number)
        n, flat = self.layout.symbols, self.sums.reshape(-1)
        self.sums[:, NEIGHBOURS] += np.bincount(p.symbol, minlength=n)
        for gap in (1, 2):
            b = p.back(gap, n)
            for x, y in ((p.symbol, b), (b, p.symbol)):
                near = (b < n) & (y < NEIGHBOURS)
                at, times = np.unique(x[near].astype(np.int64) * (NEIGHBOURS + 1) + y[near], return_counts=True)
                flat[at] += times

    def parts(self):
        return [("sums", self.sums)]


PART = "kind string, block int, node int, tokens double, data binary"
PART_NAMES = [c.split()[0] for c in PART.split(", ")]
PART_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.binary())


def part_type(kind: str) -> str:
    """Neighbour sums are whole numbers beyond what single precision holds."""
    return "<f8" if kind == "sums" else "<f4"


def learners(docs: DataFrame, tokens: int) -> DataFrame:
    """``docs`` in one task for every ``TASK_TOKENS`` training tokens, at least one a core, and never more than there were: each
    stores a whole model, so their number must not follow the files."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS)))


def gather(docs: DataFrame, learner, shared) -> tuple[dict, float]:
    """What ``learner`` (Trainer or Neighbours) learns from all rows of ``docs`` (text): its parts summed over tasks block by
    block in a tree, and the tokens."""

    def run(batches):
        one = learner(shared.value)
        for b in batches:
            texts = text_bytes(b.column(0))
            for i in range(0, len(texts), 200):
                one.learn(texts[i:i + 200])
        if one.tokens:
            node = TaskContext.get().partitionId()
            for kind, values in one.parts():
                blocks = [values[i:i + BLOCK_ROWS].astype(part_type(kind)).tobytes() for i in range(0, len(values), BLOCK_ROWS)]
                rows = [(kind, i, node, float(one.tokens), v) for i, v in enumerate(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), PART_TYPES)], PART_NAMES)

    def add(t: pa.Table) -> pa.Table:
        kind = t["kind"][0].as_py()
        values = 0
        for b in t["data"].to_pylist():
            values = values + np.frombuffer(b, part_type(kind)).astype(float)
        one = [[kind], [t["block"][0].as_py()], [t["node"][0].as_py()], [sum(t["tokens"].to_pylist())], [values.astype(part_type(kind)).tobytes()]]
        return pa.table([pa.array(c, f) for c, f in zip(one, PART_TYPES)], names=PART_NAMES)

    parts = keep(docs.mapInArrow(run, PART))
    last = parts.agg(F.max("node")).first()[0]
    while last:
        up = parts.withColumn("node", F.floor(F.col("node") / F.lit(FAN_IN)).cast("int"))
        parts, last = keep(up.groupBy("kind", "block", "node").applyInArrow(add, PART)), last // FAN_IN
    found, tokens = {}, 0.0
    for r in parts.orderBy("kind", "block").collect():  # one row a block: bounded by the model's size
        found.setdefault(r["kind"], []).append(np.frombuffer(r["data"], part_type(r["kind"])))
        tokens = r["tokens"]
    return {k: np.concatenate(v) for k, v in found.items()}, tokens


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: exact counts over all rows of ``docs`` (text); the empty word stands for the ends."""

    def batch(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts = Counter()
        for b in batches:
            for t in text_bytes(b.column(0)):
                counts.update(words(t))
                counts[b""] += 1
                if len(counts) > FLUSH_WORDS:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    return keep(docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))


def terms(docs: DataFrame, model) -> DataFrame:
    """word, row_id, class, and for sums of a document n_tokens, n_known, base and score: one row for each unlisted word, and one
    for each document (class -1, a word that no text has) with the sums of all else.  An unlisted word's share is left out."""

    def run(batches):
        layout, weights, inner, bias, unknown = model.value
        log_c = np.log10(np.maximum(layout.counts, 1))
        own = np.where(layout.symbol_member[layout.symbol] > 0, 0.0, log_c - np.log10(np.maximum(layout.others, 1))[layout.symbol_class[layout.symbol]] + np.log10(1 - unknown))
        own[:OPEN] = 0.0
        base = np.log10(layout.counts + 0.1)
        for b in batches:
            texts, ids = text_bytes(b.column(1)), b.column(0).to_numpy()
            for i in range(0, len(texts), 200):
                yield scored(texts[i:i + 200], ids[i:i + 200], layout, weights, inner, bias, own, base)

    def scored(texts, ids, layout, weights, inner, bias, own, base):
        p, n = Parsed(texts, layout), len(texts)
        local = choice(layout, weights, inner, bias, p) / np.log(10)
        listed = p.number >= 0
        known = listed & (layout.counts[p.number] > 0)
        local += np.where(listed, own[p.number], 0.0)
        total = lambda v: np.bincount(p.doc, weights=v, minlength=n)
        tail = np.flatnonzero(~listed)
        word = [*(b"\xff" + int(r).to_bytes(8, "little") for r in ids), *p.odd]
        blank = lambda v, f: pa.concat_arrays([pa.array(v, f), pa.nulls(len(tail), f)])
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.binary()), pa.array(np.concatenate([ids, ids[p.doc[tail]]])),
             pa.array(np.concatenate([np.full(n, -1, np.int32), p.classes[tail].astype(np.int32)])),
             blank(np.bincount(p.doc, minlength=n), pa.int64()), blank(total(known).astype(np.int64), pa.int64()),
             blank(total(np.where(listed, base[p.number], 0.0)), pa.float64()), blank(total(local), pa.float64())],
            ["word", "row_id", "class", "n_tokens", "n_known", "base", "score"],
        )

    return docs.mapInArrow(run, "word binary, row_id long, class int, n_tokens long, n_known long, base double, score double")


def make_layout(training: DataFrame, counts: DataFrame) -> tuple[Layout, int, int, float]:
    """The layout, N, V and u, from all training texts and their word counts."""
    spark = training.sparkSession
    ends = F.col("word") == F.lit(b"")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if((F.col("c") == 1) & ~ends).alias("once"), F.sum(F.when(ends, F.col("c"))).alias("ends")).first()
    n = total["n"] or 0
    head = counts.where(~ends).orderBy(F.desc("c"), "word").limit(sizes(n)[2]).collect()  # bounded by the model's size
    layout = Layout(n, [bytes(r["word"]) for r in head], [total["ends"] or 0, *(r["c"] for r in head)])
    found, _ = gather(learners(training, n), Neighbours, spark.sparkContext.broadcast(layout))
    sums = found.get("sums", np.zeros(layout.symbols * (NEIGHBOURS + 1))).reshape(layout.symbols, NEIGHBOURS + 1)
    layout.classify(sums[:, :NEIGHBOURS], sums[:, NEIGHBOURS])
    single = (layout.counts == 1) & ((layout.symbol_member[layout.symbol] > 0) | (np.arange(len(layout.counts)) < OPEN))
    once = total["once"] - int(single[1:].sum())
    return layout, n, total["v"], min(0.5, (once + 0.5) / (layout.others[OPEN:].sum() + 1))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"),
        (doc_crc_mod(id_col, FOLDS) != HELD_OUT).alias("train"), F.col(text_col).alias("text"),
    )
    training = rows.where("train").select("text")
    counts = word_counts(training)
    layout, n, distinct, unknown = make_layout(training, counts)
    fit, tokens = gather(learners(training, n), Trainer, spark.sparkContext.broadcast(layout))
    average = lambda k, width: (fit.get(k, np.zeros(layout.rows * width, np.float32)) / np.float32(tokens or 1)).reshape(-1, width)
    model = spark.sparkContext.broadcast((layout, average("weights", CLASSES), average("inner", MEMBERS), layout.class_bias, unknown))

    # an unlisted word: its share among its class's others, or u
    share = F.array(*[F.lit(float(np.log10(1 - unknown) - np.log10(max(x, 1)))) for x in layout.others])
    odd, c = F.col("class") >= 0, F.col("c")
    part = terms(rows.select("row_id", "text"), model).join(counts, "word", "left").select(
        "row_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.when(odd, c.isNotNull().cast("long")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(odd, F.log10(F.coalesce(c, F.lit(0)) + 0.1)).otherwise(F.col("base")).alias("base"),
        F.when(odd & c.isNull(), F.lit(float(np.log10(unknown)))).when(odd, F.log10(c) + F.element_at(share, F.col("class") + 1)).otherwise(F.col("score")).alias("score"),
    )
    done = part.groupBy("row_id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    floor = F.lit(float(np.log10(n + 0.1 * (distinct + 1))))
    done = done.select("row_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score")
    return rows.select("row_id", "doc_id", (~F.col("train")).alias("held_out")).join(done, "row_id")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return lm_scores(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
