"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns give their spans always.  The field then reads the tokens near
digits and at-signs (nothing else can be part of a span): every run of at most
``MAX_TOKENS`` tokens that could be an email, ip, card or phone is a candidate
segment with features of the span as a whole - group lengths, separators, check
digit, number of digits, the characters beside it, the word before it.  Dynamic
programming over segments chooses boundaries and kinds jointly; a chosen segment
is added if its marginal probability is at least ``CONFIDENCE`` and it overlaps no
base span.

The field is trained by likelihood (AdaGrad) in one task on at most ``PER_KIND``
token islands with a base span of each kind and ``PLAIN`` with none, first in hash order of the id, of texts whose base spans are the
labels, and on rewritten copies of them: phones without plus or country code,
cards and addresses with other separators, spelt-out at-signs, and the same with
broken check digits or numbers as counterexamples.

Edge cases: a null or empty text has no spans; null doc_ids and rows repeated
whole are ordinary rows; an empty table gives an empty result; other columns are
not looked at.  Every pattern takes time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
PER_KIND, PLAIN, PER_ROW = 120, 320, 3
EPOCHS = 6
RATE, L2 = 0.3, 1e-4
CONFIDENCE = 0.9
SPACE = 1 << 14

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
NUMERIC = re.compile(r"[0-9 ().+/\[\]-]+")
ADDRESS = re.compile(r"[A-Za-z0-9._%+@\[\]() -]+")
SPELT = re.compile(r"@|[\[(]at[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Matches of local part, @ and domain; each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(DIGIT.findall(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def islands(text: str):
    """Lists of (start, end) of the tokens near anchors; anchors closer than two reaches share one."""
    reach, groups = 96, []
    for m in ANCHOR.finditer(text):
        if groups and m.start() - groups[-1][1] <= 2 * reach:
            groups[-1][1] = m.end()
        else:
            groups.append([m.start(), m.end()])
    for a, b in groups:
        a, b = max(0, a - reach), min(len(text), b + reach)
        yield [m.span() for m in TOKEN.finditer(text, a, b)]


def features(text: str, a: int, b: int, kind: int, before: str) -> list[int]:
    """Hashed features of the span text[a:b] as a whole."""
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    seps = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", s))))
    side = lambda c: "0" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c
    left, right = side(text[a - 1]) if a else "^", side(text[b]) if b < len(text) else "$"
    fs = ["bias", "seps" + seps, "n%d" % min(20, len(digits)), "left" + left, "right" + right, "before" + before, "head" + side(s[0]) + side(s[-1])]
    if kind == 0:
        parts = re.split(r"@|[\[(]at[\])]", s)
        host = parts[-1].strip()
        fs += ["ats%d" % min(3, len(parts) - 1), "dots%d" % min(3, host.count(".") + host.count("dot")), "last%d" % min(6, len(re.split(r"[^A-Za-z]+", host)[-1])), "blank%d" % (" " in parts[0].strip())]
    elif kind == 1:
        fs += ["groups%d" % min(6, len(groups)), "byte%d" % all(int(g) < 256 for g in groups if len(g) < 10), "long%d" % min(9, max(map(len, groups)))]
    elif kind == 2:
        fs += ["luhn%d%d" % (luhn(digits), 13 <= len(digits) <= 19), "even%d" % (len(set(map(len, groups))) <= 2)]
    else:
        fs += ["shape" + "-".join(str(len(g)) for g in groups[:6]), "plus%d" % s.startswith("+"), "paren%d" % ("(" in s and ")" in s)]
    return [crc32(f"{kind}|{f}".encode("utf-8", "replace")) % SPACE for f in fs]


def candidates(text: str, tokens: list[tuple[int, int]]):
    """(first token, last token + 1, kind, features) of every segment that could be an entity."""
    out, before = [], ""
    for i, (a, e) in enumerate(tokens):
        first = text[a]
        if first.isspace():
            continue
        if not (first.isalnum() or first in "+(["):
            before = first
            continue
        numeric = mail = True
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            t = text[tokens[j][0]:tokens[j][1]]
            numeric = numeric and NUMERIC.fullmatch(t) is not None
            mail = mail and ADDRESS.fullmatch(t) is not None
            if not (numeric or mail):
                break
            b = tokens[j][1]
            s = text[a:b]
            if numeric and t.isdigit() and 7 <= len(DIGIT.findall(s)) <= 19:
                for kind in (1, 2, 3):
                    out.append((i, j + 1, kind, features(text, a, b, kind, before)))
            elif numeric and t.isdigit() and 4 <= len(DIGIT.findall(s)) and s.count(".") >= 3:
                out.append((i, j + 1, 1, features(text, a, b, 1, before)))
            if mail and t.isalpha() and SPELT.search(s):
                out.append((i, j + 1, 0, features(text, a, b, 0, before)))
        if first.isalpha():
            before = text[a:e].lower()[:12]
    return out


def marginals(n: int, segments, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each segment under the field, and the log partition sum; tokens outside score 0."""
    by_end, by_start = {}, {}
    for k, (i, j, *_) in enumerate(segments):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    ahead, back = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, n + 1):
        ahead[t] = np.logaddexp.reduce([ahead[t - 1], *(ahead[segments[k][0]] + scores[k] for k in by_end.get(t, ()))])
    for t in range(n - 1, -1, -1):
        back[t] = np.logaddexp.reduce([back[t + 1], *(back[segments[k][1]] + scores[k] for k in by_start.get(t, ()))])
    p = np.array([np.exp(ahead[i] + s + back[j] - ahead[n]) for (i, j, *_), s in zip(segments, scores)])
    return p, float(ahead[n])


def best_segments(n: int, segments, scores: np.ndarray) -> list[int]:
    """The segments of the best segmentation (dynamic programming over token positions)."""
    by_end, best, came = {}, [0.0] * (n + 1), [-1] * (n + 1)
    for k, (_, j, *_) in enumerate(segments):
        by_end.setdefault(j, []).append(k)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for k in by_end.get(t, ()):
            s = best[segments[k][0]] + scores[k]
            if s > best[t]:
                best[t], came[t] = s, k
    out, t = [], n
    while t > 0:
        if came[t] < 0:
            t -= 1
        else:
            out.append(came[t])
            t = segments[came[t]][0]
    return out[::-1]


def rewritten(text: str, kind: int, a: int, b: int):
    """(text, span or None): the text with its entity written otherwise, still an entity or broken."""
    s, out = text[a:b], []
    if kind == 0:
        user, host = s.split("@", 1)
        out = [(f"{user} [at] {host}", True), (f"{user}(at){host}", True), (f"{user}@{host.split('.')[0]}", False)]
    elif kind == 1:
        out = [(s.replace(".", "[.]"), True), (s.replace(".", " . "), False), (s.split(".", 1)[0] + "." + "9" + s.split(".", 1)[1], int("9" + s.split(".")[1]) < 256), (s.rsplit(".", 1)[0], False)]
    elif kind == 2:
        digits = re.sub(r"[^0-9]", "", s)
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        out = [(".".join(fours), True), ("/".join(fours), True), (wrong, False), (wrong[:8] + " " + wrong[8:], False)]
    else:
        bare = s[1:]
        local = bare.split(" ", 1)[-1]
        out = [(bare, True), (local, True), (local.replace(" ", ""), True), (re.sub(r"[ -]+", ".", bare), True), (bare[:6], False), (re.sub(r"[^0-9]", "", bare), False)]
    for new, good in out:
        yield text[:a] + new + text[b:], (kind, a, a + len(new)) if good else None


def train_field(rows: list[str]) -> np.ndarray:
    """Weights of the hashed features by conditional likelihood over island texts."""
    examples = []
    for text in rows:
        spans = base_spans(text)
        cases = [(text, spans)]
        if len(spans) == 1:
            cases += [(t, [*base_spans(t), *([s] if s else [])]) for t, s in rewritten(text, *spans[0])]
        for t, gold in cases:
            tokens = [m.span() for m in TOKEN.finditer(t)]
            segments = candidates(t, tokens)
            wanted = {(k, a, b) for k, a, b in gold}
            is_gold = np.array([(kind, tokens[i][0], tokens[j - 1][1]) in wanted for i, j, kind, _ in segments], float)
            if segments:
                examples.append((len(tokens), segments, is_gold))
    w, square = np.zeros(SPACE), np.full(SPACE, 1e-2)
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for x in rng.permutation(len(examples)):
            n, segments, gold = examples[x]
            scores = np.array([w[f].sum() for *_, f in segments])
            gap = marginals(n, segments, scores)[0] - gold
            g = np.zeros(SPACE)
            for d, (*_, f) in zip(gap, segments):
                if abs(d) > 1e-4:
                    np.add.at(g, f, d)
            at = np.flatnonzero(g)
            step = g[at] + L2 * w[at]
            square[at] += step * step
            w[at] -= RATE * step / np.sqrt(square[at])
    return w


def added_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray) -> list[tuple[int, int, int]]:
    """Segments that the field adds to the base spans."""
    out, taken = [], sorted((a, b) for _, a, b in base)
    for tokens in islands(text):
        segments = candidates(text, tokens)
        if not segments:
            continue
        scores = np.array([w[f].sum() for *_, f in segments])
        chosen = best_segments(len(tokens), segments, scores)
        if not chosen:
            continue
        p = marginals(len(tokens), segments, scores)[0]
        for k in chosen:
            i, j, kind, _ = segments[k]
            a, b = tokens[i][0], tokens[j - 1][1]
            at = np.searchsorted([x for x, _ in taken], b) if taken else 0
            if p[k] >= CONFIDENCE and not any(x < b and a < y for x, y in taken[max(0, at - 4):at]):
                out.append((kind, a, b))
    return out


def training_islands(docs: DataFrame) -> DataFrame:
    """tie, island (text): in hash order the first ``PER_KIND`` islands that hold a base span of each kind and the first
    ``PLAIN`` that hold none, at most ``PER_ROW`` of each from one row, so that a rare kind is learnt however common
    numbers are."""

    def run(batches):
        for b in batches:
            out = []
            for tie, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_kind = {}
                for n, tokens in enumerate(islands(text or "")):
                    if tokens and tokens[-1][1] - tokens[0][0] < 600:
                        island = text[tokens[0][0]:tokens[-1][1]]
                        for kind in {k for k, *_ in base_spans(island)} or {len(KINDS)}:
                            by_kind.setdefault(kind, []).append((crc32(f"{tie}:{n}".encode()), island, kind))
                for found in by_kind.values():
                    out += nsmallest(PER_ROW, found)
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))], ["tie", "island", "kind"])

    found = docs.select(F.xxhash64("doc_id", F.lit(23)), "text").mapInArrow(run, "tie long, island string, kind long")
    most = F.when(F.col("kind") < len(KINDS), F.lit(PER_KIND)).otherwise(F.lit(PLAIN))
    # first within a slice of the hashes, then within the kind: a task sees a bounded number of rows from every other
    for group in (["kind", F.pmod("tie", F.lit(64))], ["kind"]):
        found = found.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy("tie", "island"))).where(
            (F.col("__n") <= max(PER_KIND, PLAIN)) & (F.col("__n") <= most)).drop("__n")
    return found.select("tie", "island").distinct()


def fit(docs: DataFrame) -> np.ndarray:
    """The field's weights, trained in one task from the bounded sample."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["tie"].to_pylist(), t["island"].to_pylist()))
        w = train_field([r for _, r in rows])
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary())})

    got = training_islands(docs).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "weights binary").collect()
    return np.frombuffer(got[0]["weights"]) if got else np.zeros(SPACE)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added of every row."""
    w = fit(docs)
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text) if ANCHOR.search(text) else []
                more = added_spans(text, base, w) if ANCHOR.search(text) else []
                rows.append((*(sum(k == n for k, *_ in base) for n in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more]), len(more)))
            columns = zip(*rows) if rows else [[]] * 7
            types = (*(pa.int64(),) * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *counts, "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_added long")


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    return find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
