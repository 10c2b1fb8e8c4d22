"""Exact dedup and SimHash components against brute force, with edge rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tarmac.llm import exact_dedup as E
from tarmac.llm import simhash as S
from tarmac.llm.common import prepare, table

SF = "/root/testdata/sf0.01"


def lower(t):
    return (t or "").encode().lower()


def test_bucket_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    for m in (1, 2, 3, 17, 256, 300):
        h = rng.integers(-2**63, 2**63 - 1, (2, m), dtype=np.int64)
        pilots, slots = E.build_bucket(h[0], h[1])
        assert sorted(slots.tolist()) == list(range(m))
        sub = np.mod(h[0], len(pilots))
        assert (E._slot_hash(h[1], pilots[sub].astype(np.int64)) % m == slots).all()


def test_exact_dedup_edges(spark, write_docs, edge_rows):
    prepare(spark)
    out = [r.asDict() for r in E.op2_exact_dedup(spark, write_docs(edge_rows)).collect()]
    groups = defaultdict(list)
    for i, t, _ in edge_rows:
        groups[hashlib.sha256(lower(t)).hexdigest()].append(i)
    assert len(out) == len(edge_rows)
    seen = defaultdict(list)
    for r in out:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        seen[r["text_sha256"]].append(r)
    for rows in seen.values():
        stay = [r for r in rows if r["kept"]]
        assert len(stay) == 1 and stay[0]["doc_id"] == stay[0]["keep_id"]


def test_nonmembers_of_an_earlier_history_group_on_their_own(spark, write_docs):
    prepare(spark)
    old = table(spark, write_docs([(1, "known", "a"), (2, "also known", "a")]), "documents").select("doc_id", "text")
    history = E.history_of(E.digests(old)).checkpoint()
    new = spark.createDataFrame([(10, "KNOWN"), (11, "fresh"), (12, "Fresh"), (13, "alone")], "doc_id long, text string")
    got = {r["doc_id"]: (r["member"], r["keep_id"], r["kept"]) for r in E.exact_dedup(new, history).collect()}
    assert got == {10: (True, 1, False), 11: (False, 12, False), 12: (False, 12, True), 13: (False, 13, True)}


@pytest.mark.parametrize("op", [E.op2_exact_dedup, S.op6_simhash_near_dedup])
def test_empty(spark, write_docs, op):
    prepare(spark)
    assert op(spark, write_docs([])).count() == 0


def brute_fingerprint(t):
    w = lower(t).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """Expected (fingerprint, component) by pairwise comparison."""
    fps = [f for _, f in rows]
    u = sorted(set(fps))
    root = {f: f for f in u}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i is None, i or 0, f"{f:016x}", least.get(find(f))) for i, f in rows), key=repr)


def test_simhash_edges(spark, write_docs, edge_rows):
    prepare(spark)
    got = S.op6_simhash_near_dedup(spark, write_docs(edge_rows)).collect()
    assert sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in got), key=repr) == brute_components([(i, brute_fingerprint(t)) for i, t, _ in edge_rows])


def test_golay_codes():
    leader, more = S.error_table()
    x = np.arange(1 << 23)[:: 4099]
    index, others = S.decode(x)
    assert ((others >= 0).sum(axis=1) == np.where(np.bitwise_count(leader[S.syndrome(x)]) == 3, 5, 0)).all()
    rng = np.random.default_rng(1)
    y = x ^ (1 << rng.integers(0, 23, len(x)))
    near = np.column_stack(S.decode(y)[0:1] + (S.decode(y)[1],))
    assert (near == index[:, None]).any(axis=1).all()  # one bit off: the stored key is among the probe's


def test_links_find_every_pair_within_three_bits(spark):
    prepare(spark)
    rng = np.random.default_rng(2)
    base = rng.integers(-2**63, 2**63 - 1, 60, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base:
        for k in range(1, 6):
            f = np.uint64(b.view(np.uint64) if hasattr(b, "view") else b)
            for bit in rng.choice(64, k, replace=False):
                f ^= np.uint64(1) << np.uint64(bit)
            fps.add(int(np.array([f]).view(np.int64)[0]))
    fps = sorted(fps)
    got = {(r["a"], r["b"]) for r in S.links(spark.createDataFrame([(f,) for f in fps], "fp long")).distinct().collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_stages_keep_one_of_each_group_with_all_columns(spark, write_docs, edge_rows):
    prepare(spark)
    docs = table(spark, write_docs(edge_rows), "documents")
    for stage in (E.stage_exact_dedup, S.stage_simhash_near_dedup):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert len({lower(r["text"]) for r in rows}) == len(rows)
    assert len(E.stage_exact_dedup(spark, docs, "").collect()) == len({lower(t) for _, t, _ in edge_rows})
