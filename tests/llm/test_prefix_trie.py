"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest

from tarmac.llm import prefix_trie as T
from tarmac.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """The contract by a dictionary from turn sequences to members."""
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            number = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            conv[c].append((turn is not None, turn or 0, role, number, text))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in conv.items()}
    made = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
        ends[made[c]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items())


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string")
    got = T.conversation_trie(df).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SEGMENT_TURNS", 2), ("SUPER", 2), ("TASK_ROWS", 5), ("CHUNK_IDS", 2)):
        monkeypatch.setattr(T, name, value)


def made(rng, convs, longest, words):
    out = []
    for c in range(convs):
        for turn in range(rng.randint(1, longest)):
            out.append((c, turn, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, words)))))
    return out


def test_shared_prefixes_over_many_small_tiles(spark, small):
    prepare(spark)
    rng = random.Random(0)
    rows = made(rng, 70, 9, 1) + [(100, t, "user", "a") for t in range(40)] + [(121, t, "user", "a") for t in range(23)]  # long ones
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_copies_and_turnless(spark, small):
    prepare(spark)
    rows = [(c, t, "user", f"same {t}") for c in range(200, 240) for t in range(3)]  # copies
    rows += [(None, 0, "user", "x"), (1, None, None, None), (1, None, "user", ""), (1, 0, "user", " \t"), (1, 0, "user", " \t"), (2, 5, "ÄÖ", "é  ü x"), (2, 5, "ÄÖ", "other")]
    rows += [(c, 0, "user", "only") for c in range(3001, 3019)]  # no conversation 3000, and some lose their only turn
    rows += [(-5, 0, "user", "minus"), (-5, 1, "user", "five")]
    want = brute(rows)
    assert run(spark, rows) == want and any(w[1] == 0 and w[-1] != hashlib.sha256(b"").hexdigest() for w in want)
    assert run(spark, []) == []


def test_default_sizes(spark):
    prepare(spark)
    rng = random.Random(1)
    rows = made(rng, 120, 6, 2) + [(400, t, "user", str(t % 3)) for t in range(300)] + [(401, t, "user", str(t % 3)) for t in range(150)]
    assert run(spark, rows) == brute(rows)


def test_radix_tree_layouts_and_path_compression():
    rng = random.Random(2)
    root, keys = T.Node(b""), set()
    for n in range(300):  # every first byte: the root grows to 256 children
        keys.add(bytes([n % 256]) + rng.randbytes(15))
    keys |= {bytes(16) + rng.randbytes(16) for _ in range(30)} | {bytes(16)}
    for row, key in enumerate(sorted(keys)):
        T.insert(root, key, row)
    assert root.layout() == 256
    grown = T.Node(b"")
    seen = []
    for b in range(60):
        grown.put((b * 37) % 256, T.Node(bytes([(b * 37) % 256])))
        seen.append(grown.layout())
        assert all(grown.child((x * 37) % 256).path == bytes([(x * 37) % 256]) for x in range(b + 1)) and grown.child((b * 37 + 37) % 256) is None
    assert sorted(set(seen)) == [4, 16, 48, 256]
    values = {key: [1, row] for row, key in enumerate(sorted(keys))}
    got = sorted((turns, total[0], total[1]) for turns, _, total in T.tile_nodes(sorted(keys), [values[k] for k in sorted(keys)]))
    want = defaultdict(list)
    for key, (_, row) in values.items():
        for d in range(16, len(key) + 1, 16):
            want[key[:d]].append(row)
    assert got == sorted((len(p) // 16, len(m), min(m)) for p, m in want.items())
    assert T.shared(b"abc", b"abd") == 2 and T.shared(b"", b"a") == 0 and T.shared(b"ab", b"abc") == 2 and T.shared(b"\x80a", b"\x00a") == 0
