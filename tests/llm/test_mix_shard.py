"""Mixing and sharding: invariants on edge rows and on the given tables."""

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tarmac.llm import mixing as M
from tarmac.llm import sharding as H
from tarmac.llm.common import prepare, table

SF = "/root/testdata/sf0.01"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def check_mix(docs, out):
    """docs: (doc_id, text, source); out: rows of op3."""
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    want = targets(dict(sizes))
    by_target = defaultdict(float)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, size(t)) for i, t, _ in docs)
    expected = defaultdict(list)
    for s in sizes:
        expected[(sizes[s], round(want[s], 6))].append(s)
    assert set(by_target) == set(expected)
    largest = max((size(t) for _, t, _ in docs), default=0)
    for key, taken in by_target.items():
        assert abs(taken - len(expected[key]) * key[1]) <= largest * len(expected[key])


def test_mix_given_tables(spark):
    prepare(spark)
    docs = [(r[0], r[1], r[2]) for r in table(spark, SF, "documents").select("doc_id", "text", "source").collect()]
    first = [r.asDict() for r in M.op3_pivotal_mixing(spark, SF).collect()]
    check_mix(docs, first)
    again = {r["doc_id"]: r["taken"] for r in M.op3_pivotal_mixing(spark, SF).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in first}


def test_mix_edges(spark, write_docs, edge_rows):
    prepare(spark)
    check_mix(edge_rows, [r.asDict() for r in M.op3_pivotal_mixing(spark, write_docs(edge_rows)).collect()])


def test_residuals_climb_the_tree(spark, write_docs, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(M, "NODE_ROWS", 4)
    monkeypatch.setattr(M, "FAN_IN", 3)
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    check_mix(rows, [r.asDict() for r in M.op3_pivotal_mixing(spark, write_docs(rows)).collect()])


def test_repeated_ids_are_dealt_over_nodes(spark, write_docs, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(M, "NODE_ROWS", 40)
    largest, rounds = [], M._round_nodes
    monkeypatch.setattr(M, "_round_nodes", lambda rows, level: largest.append(rows.groupBy("rank", "node").count().agg({"count": "max"}).first()[0]) or rounds(rows, level))
    # sources hot (5), s0 (2), s1 (1): hot's target is capped, so s0 and s1 hold the fractions
    rows = [*((None, "w x " * (1 + i % 5), "s0") for i in range(400)), *((7, "w " * (1 + i % 3), "s1") for i in range(400)),
            *((7, None, "s1") for _ in range(200)), *((100 + i, "w", "hot") for i in range(50))]
    out = [r.asDict() for r in M.op3_pivotal_mixing(spark, write_docs(rows)).collect()]
    check_mix(rows, out)
    assert largest[0] <= 90
    mixed = M.mix(table(spark, write_docs(rows), "documents").selectExpr("monotonically_increasing_id() AS row_id", "doc_id", "source", "size(split(coalesce(text, ''), 'w')) - 1L AS size"))
    copies = Counter(r["copies"] for r in mixed.where("size = 0").collect())
    assert len(copies) == 2


def test_pivot_keeps_the_mass_and_the_expectations():
    size, p = np.array([3.0, 5.0, 2.0, 7.0, 1.0, 4.0]), np.array([0.2, 0.7, 0.5, 0.35, 0.9, 0.6])
    total, runs = np.zeros(6), 4000
    for k in range(runs):
        out, left = M.pivot(p, size, np.random.default_rng(k))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-9
        assert sum(0 < x < 1 for x in out) <= 1 and (left < 0 or 0 < out[left] < 1)
        total += out
    assert np.abs(total / runs - p).max() < 0.03


def test_mix_stage_repeats_rows(spark, write_docs, edge_rows):
    prepare(spark)
    docs = table(spark, write_docs(edge_rows), "documents")
    out = M.stage_mixing(spark, docs, "")
    assert out.columns == docs.columns
    taken = sum(len((r["text"] or "").encode().split()) for r in out.collect())
    total = sum(len((t or "").encode().split()) for _, t, _ in edge_rows)
    assert abs(taken - 1.5 * total) <= 30000


@pytest.mark.parametrize("op", [M.op3_pivotal_mixing, H.op10_vector_sharding])
def test_empty(spark, write_docs, op):
    prepare(spark)
    assert op(spark, write_docs([])).count() == 0


def check_shards(docs, out):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < 40 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even(spark):
    prepare(spark)
    docs = [(r[0], r[1]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    out = H.op10_vector_sharding(spark, SF).collect()
    check_shards(docs, out)
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 40
    assert len(load) == 40 and max(load.values()) < 1.06 * mean and min(load.values()) > 0.94 * mean


def test_shards_edges(spark, write_docs, edge_rows):
    prepare(spark)
    check_shards([(i, t) for i, t, _ in edge_rows], H.op10_vector_sharding(spark, write_docs(edge_rows)).collect())


def test_hot_group_and_nodes_are_split(spark, write_docs, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(H, "NODE_ITEMS", 50)
    monkeypatch.setattr(H, "FAN_IN", 4)
    monkeypatch.setattr(H, "SLOT_ROWS", 5)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i} " * (i % 11), "a") for i in range(1500)]
    out = H.op10_vector_sharding(spark, write_docs(rows)).collect()
    check_shards([(i, t) for i, t, _ in rows], out)
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 40
    assert max(load.values()) < 1.1 * mean and min(load.values()) > 0.9 * mean
    assert len({r["shard"] for r in out if r["size"] == 24}) == 40
