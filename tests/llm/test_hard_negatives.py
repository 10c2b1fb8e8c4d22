"""Hard negatives against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarmac.llm import hard_negatives as H
from tarmac.llm.common import prepare
from tarmac.llm.topk import SCALE


def brute(rows):
    """The contract by plain loops over all pairs, in Python integers."""
    v = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(SCALE * float(np.float32(c)))) for c in x]))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for n, (a, label, x) in enumerate(v):
        if a % 50:
            continue
        s = sorted((-clip(sum(p * q for p, q in zip(x, w))), i, m, lab) for m, (i, lab, w) in enumerate(v) if m != n)
        for ps, p, _, _ in [r for r in s if r[3] == label][:5]:
            window = [(q, -ns) for ns, q, _, lab in s if lab != label and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out += [(a, p, k + 1, q, -ps, ns) for k, (q, ns) in enumerate(window)]
    return sorted(out)


def run(spark, path, rows):
    ids, x, labels = zip(*rows) if rows else ((), (), ())
    n = len(ids)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(x, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32()),
                             "row_id": ["r"] * n, "windows": ["w"] * n, "cell": ["c"] * n, "rank": ["k"] * n}), f"{path}/embeddings.parquet")
    return sorted(tuple(r) for r in H.op11_hard_negatives(spark, str(path)).collect())


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


def made(rng, n, dims=24, labels=10, pull=1.0):
    centre = rng.normal(size=(labels, dims)) * pull
    return [(i, (centre[i % labels] + rng.normal(size=dims)).round(2).tolist(), i % labels) for i in range(n)]


def test_small_cells_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "CELL_VALUES", 24 * 256)
    monkeypatch.setattr(H, "CELL_ANCHORS", 3)
    rows = made(np.random.default_rng(0), 900)
    want = brute(rows)
    assert run(spark, tmp_path, rows) == want and len(want) > 100


def test_hot_label_repeats_ties_and_bad_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, x, 3 if i % 3 else label) for i, x, label in made(rng, 400)]
    rows += [(1000 + k, rows[50][1], 3) for k in range(8)] + [(2000 + k, rows[51][1], 4) for k in range(8)]  # ties
    rows += [(50, rows[50][1], 3), (50, rows[60][1], 3), (61, rows[61][1], 5), (61, rows[61][1], 5)]  # repeated ids
    rows += [(None, rows[0][1], 1), (3001, None, 1), (3002, rows[1][1], None), (3003, [None] * 24, 2), (3004, [float("nan")] * 24, 2), (3005, [float("inf")] * 24, 2)]
    rows += [(3050, [], 3), (3100, [0.0] * 24, 2), (3150, rows[2][1][:5], 6), (3200, [1.0], 77)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_huge_values_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * (1e9 if i % 5 else 1e12)).tolist(), i % 4) for i in range(160)]
    assert run(spark, tmp_path, rows) == brute(rows)
    assert run(spark, tmp_path, []) == [] and run(spark, tmp_path, [(0, [1.0], 1)]) == []


def test_threshold_stops_early_and_is_strict():
    rng = np.random.default_rng(3)
    c = rng.integers(-20, 20, (4000, 8))
    c[7] = 400  # far above the rest
    order, values = H.sorted_lists(c)
    calls = []

    def done(scores, rows, threshold):
        calls.append(threshold)
        unseen = np.setdiff1d(np.arange(len(c)), rows)
        assert (c[unseen] @ anchor <= threshold).all()
        return threshold < H.kth(scores, 1, -np.inf)

    anchor = np.array([3, -1, 2, 5, 0, 1, 4, 2])
    rows, scores = H.threshold_search(anchor.astype(float), c.astype(float), order, values, done)
    assert rows[np.argmax(scores)] == np.argmax(c @ anchor) and len(rows) < len(c) / 2 and calls == sorted(calls, reverse=True)
    tied = np.ones((500, 4))
    order, values = H.sorted_lists(tied.astype(int))
    rows, _ = H.threshold_search(np.ones(4), tied, order, values, lambda s, r, t: t < H.kth(s, 3, -np.inf))
    assert len(rows) == 500  # equal scores must all be seen: ids decide
