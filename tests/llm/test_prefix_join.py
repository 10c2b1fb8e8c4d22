"""Grouped prefix join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarmac.llm import prefix_join as J
from tarmac.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, percent=90):
    """(doc_id, n, component) by all pairs and a union-find."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and percent * max(len(a), len(b)) <= 100 * min(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def run(spark, path):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.op13_ngram_jaccard_join(spark, path).collect())


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


def made(rng, families, copies, edits, length=(12, 160)):
    """Families of near copies: every copy changes some words of a base text, so pairs lie on both sides of the threshold."""
    out = []
    for f in range(families):
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[], [f"x{rng.randrange(9)}"], [w[at], "and"]])
            out.append((len(out), " ".join(w)))
    return out


def test_families_on_both_sides_of_the_threshold(spark, write_docs, monkeypatch):
    monkeypatch.setattr(J, "GROWTH", 2)
    rng = random.Random(0)
    rows = made(rng, 30, 12, 4, (60, 300))
    got = run(spark, write_docs([(i, t, "a") for i, t in rows]))
    want = brute(rows)
    assert got == want and 30 < len({c for _, _, c in want}) < len(rows) - 50


def test_one_large_family_and_a_frequent_passage(spark, write_docs):
    rng = random.Random(1)
    rows = made(rng, 1, 1, 0, (120, 120))
    base = rows[0][1].split()
    for i in range(1, 160):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(1, 4)):
            w[at] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"line{i}" for i in range(30))
    rows += [(1000 + i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60)))) for i in range(80)]
    assert run(spark, write_docs([(i, t, "a") for i, t in rows])) == brute(rows)


def test_edges(spark, write_docs, edge_rows):
    rows = edge_rows + [(20, "one two three", "a"), (21, "ONE two  three", "b"), (22, "a a a a a a", "a"), (23, "a a a", "a")]
    assert run(spark, write_docs(rows)) == brute([(i, t) for i, t, _ in rows])
    assert run(spark, write_docs([])) == Counter() and run(spark, write_docs([(1, "", "a"), (1, None, "a")])) == Counter({(1, 0, 1): 2})


def test_exactly_at_the_threshold(spark, write_docs):
    rows = []
    for n in (9, 10, 19, 20, 38):  # sets of n and n + k shingles with n common ones
        w = [f"t{n}_{i}" for i in range(n + 2)]
        rows += [(10 * len(rows) + k, " ".join(w + [f"s{n}_{i}" for i in range(k)])) for k in (0, 1, 2, 3, 4, 5)]
    assert run(spark, write_docs([(i, t, "a") for i, t in rows])) == brute(rows)


def test_fixture_documents(spark):
    path = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{path}/documents.parquet").to_pydict()
    rows = list(zip(docs["doc_id"], docs["text"]))
    want = brute(rows)
    assert run(spark, path) == want and len({c for _, _, c in want}) < len(rows)


def test_prefix_length_and_order_keep_every_pair(spark):
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        assert J.prefix_length(n) == n - int(np.ceil(0.9 * n - 1e-9)) + 1
    for _ in range(200):  # any order: a pair that reaches 90 shares a prefix shingle
        a = rng.choice(300, rng.integers(5, 120), replace=False)
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.choice(300, 3)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 90 * (len(a) + len(b) - inter):
            order = rng.permutation(300)
            head = lambda s: set(sorted(s, key=lambda x: order[x])[: J.prefix_length(len(s))])
            assert head(a) & head(b)


def test_hashes_follow_words(monkeypatch):
    texts = ["a b c d", None, "", " \t\n\x0b\x0c\r ", "A b  C\nd", "ab c d", "a bc d", "b a c d", "Ä ä é", "ä ä é", "x", "x y", "y x", "a b c a b c a b", "\x1fa b\x1c c d"]
    rng = random.Random(5)
    texts += [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    for chunk in (1 << 18, 7):
        monkeypatch.setattr(J, "CHUNK_BYTES", chunk)
        for column in (pa.array(texts), pa.array(["pad", *texts])[1:], pa.array(texts, pa.large_string())):
            got = [set(h.tolist()) for h in J.shingle_sets(column)]
            want = [shingles(t) for t in texts]
            assert [len(h) for h in got] == list(map(len, want))
            name = {}
            for h, text in zip(J.all_shingles(column), texts):  # one hash for one shingle, in order
                w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
                s = [tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
                assert len(h) == len(s) and all(name.setdefault(x, y) == y for x, y in zip(s, h.tolist()))
            assert len(set(name.values())) == len(name)
