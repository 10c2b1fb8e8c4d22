"""Top-k search, packing and chat formatting against brute force and exact round trips."""

import hashlib
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarmac.llm import chat as C
from tarmac.llm import packing as P
from tarmac.llm import topk as T
from tarmac.llm.common import prepare, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def integer_rows(rows):
    return [(i, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]


def brute_top(rows):
    v = integer_rows(rows)
    out = []
    for n, (q, x) in enumerate(v):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, w)), i) for m, (i, w) in enumerate(v) if m != n)[:5]
            out += [(q, k + 1, i, -score) for k, (score, i) in enumerate(s)]
    return sorted(out)


def write_vectors(path, rows):
    ids, x = zip(*rows) if rows else ((), ())
    n = len(ids)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(x, pa.list_(pa.float32())), "label": pa.array([0] * n, pa.int32()), "score": ["s"] * n, "rank": ["r"] * n}), f"{path}/embeddings.parquet")
    return str(path)


def test_top_k_edges(spark, tmp_path):
    prepare(spark)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=64).round(2).tolist()) for i in range(130)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (0, rows[0][1]), (7, rows[50][1]), (7, rows[100][1]), (100, rows[9][1]), (250, None), (300, [None] * 64), (301, [float("nan")] * 64), (350, [float("inf")] * 64), (None, rows[1][1]), (400, rows[2][1][:10]), (401, []), (500, [0.0] * 64)]
    got = sorted(tuple(r) for r in T.op9_exact_top_k(spark, write_vectors(tmp_path, rows)).collect())
    assert got == brute_top(rows)


def test_top_k_many_cells_and_huge_values(spark, tmp_path, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(T, "CELL_CANDIDATES", 40)
    monkeypatch.setattr(T, "CELL_QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=24) * (1e5 if i % 7 == 0 else 1)).tolist()) for i in range(300)]
    assert sorted(tuple(r) for r in T.op9_exact_top_k(spark, write_vectors(tmp_path, rows)).collect()) == brute_top(rows)


def test_pruning_drops_only_losers():
    rng = np.random.default_rng(2)
    c = rng.integers(-90, 90, (3000, 64))
    c[:, 16:] //= 8  # mass in the first block, so bounds bite
    ids = np.arange(3000)
    want = {q: sorted((-int(c[q] @ c[i]), int(i)) for i in ids if i != q)[:5] for q in range(20)}
    none = np.full(20, -np.inf)
    for floors in (none, np.array([-want[q][-1][0] for q in range(20)], float)):  # a floor met exactly keeps all five
        got = list(T.cell_top(ids[:20], c[:20], floors, ids, ids, c))
        assert all([(i, x) for a, i, _, x in got if a == q] == [(i, -x) for x, i in want[q]] for q in range(20))


def test_floor_rises_with_lower_bounds():
    assert T.raised(-np.inf, np.arange(9.0), 5) == 4 and T.raised(7.0, np.arange(9.0), 5) == 7 and T.raised(-np.inf, np.arange(3.0), 5) == -np.inf


def test_top_k_empty(spark, tmp_path):
    prepare(spark)
    assert T.op9_exact_top_k(spark, write_vectors(tmp_path, [])).count() == 0
    assert T.op9_exact_top_k(spark, write_vectors(tmp_path, [(0, [1.0])])).count() == 0


def check_pack(rows, out, tokenizer):
    docs = defaultdict(list)
    for i, t in rows:
        docs[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    place, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        place[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["length"], r["ids_crc32"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    for i, copies in docs.items():
        for ids in copies:
            pieces = sorted(place[(i, len(ids))])
            assert sum(n for _, n, _ in pieces) == len(ids) * sum(len(c) == len(ids) for c in copies)
            assert all(any(crc32(np.array(c[s:s + n], "<u4").tobytes()) == x for c in copies if len(c) == len(ids)) for s, n, x in pieces)
    assert set(place) == {(i, len(c)) for i, copies in docs.items() for c in copies}


def test_pack_given_tables(spark, tokenizer):
    prepare(spark)
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    check_pack(rows, P.op7_curve_packing(spark, SF).collect(), tokenizer)


def test_pack_edges(spark, write_docs, edge_rows, tokenizer):
    prepare(spark)
    check_pack([(i, t) for i, t, _ in edge_rows], P.op7_curve_packing(spark, write_docs(edge_rows)).collect(), tokenizer)
    assert P.op7_curve_packing(spark, write_docs([])).count() == 0


def test_pack_many_ranges(spark, monkeypatch, tokenizer):
    prepare(spark)
    monkeypatch.setattr(P, "RANGE_BYTES", 1 << 16)
    out = P.pack(table(spark, SF, "documents"))
    rows = out.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) > 10
    check_pack([tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()], rows, tokenizer)


def test_ids_are_the_tokenizers(tokenizer):
    encode = P.encoder(public_tokenizers.path(P.VOCABULARY))
    points = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1{c}\n {c}{c}" for c in points] + ["", " ", "a  b", "<|endoftext|>", "it's \t\r\n x", "x" * 5000]
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encode(t) == e.ids


def test_hilbert_neighbours_touch():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        key = P.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_copies_lie_together_and_spread_over_ranges():
    v = np.array([P.vector(b"the same text")] * 1000)
    key = P.curve_key(v, np.zeros(P.DIMS), np.ones(P.DIMS), np.random.default_rng(0).integers(-2**62, 2**62, 1000))
    assert len(set((key >> P.TIE_BITS).tolist())) == 1 and len(set(key.tolist())) > 990


def brute_chat(rows):
    turns = defaultdict(list)
    for c, n, role, text in [*rows, (-1, 0, "user", C.PROBE), (-1, 1, "assistant", C.PROBE)]:
        turns[c].append((n is not None, n or 0, role or "", text or ""))
    out = {}
    for c, ts in turns.items():
        ts.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in ts)
        loss = "".join(t for *_, r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def write_chat(path, rows):
    c = list(zip(*rows)) if rows else [[]] * 4
    pq.write_table(pa.table({"conv_id": pa.array(c[0], pa.int64()), "turn": pa.array(c[1], pa.int64()), "role": pa.array(c[2], pa.string()), "text": pa.array(c[3], pa.string()), "piece": ["p"] * len(rows), "end": ["e"] * len(rows)}), f"{path}/conversations.parquet")
    return str(path)


TRICKY = ["</s>", "\\</s>", "<\\/s>", "[INST][/INST]", "\\\\", "a\\", "<", "</", "[/", "\\n$1", "[INST", "é\U0001f600</s>x", "", None, "line\nline", "x" * 50000]


def test_chat_edges(spark, tmp_path):
    prepare(spark)
    rows = [(k % 3, n, ("user", "assistant", "system", None, "[INST]odd</s>")[n % 5], t) for k in range(6) for n, t in enumerate(TRICKY)]
    rows += [(7, 0, "user", "only a user"), (8, None, "assistant", "no turn"), (8, 1, "assistant", "turn"), (None, 0, "assistant", "no conversation"), (9, 0, "assistant", "twice"), (9, 0, "assistant", "twice")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.op5_chat_formatting(spark, write_chat(tmp_path, rows)).collect()}
    assert got == brute_chat(rows)


def test_chat_examples_hold_context_and_one_target(spark, tmp_path):
    prepare(spark)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (1, 4, "user", "left over")]
    made = sorted((r["example"], r["text"], r["loss_start"], r["loss_len"]) for r in C.examples(table(spark, write_chat(tmp_path, rows), "conversations")).collect())
    one = "[INST]user[/INST]hi</s>[INST]assistant[/INST]a<\\/s></s>"
    two = one + "[INST]user[/INST]more</s>[INST]assistant[/INST]b</s>"
    assert [m[1] for m in made] == [one, two, two + "[INST]user[/INST]left over</s>"]
    assert [t[s:s + n] for _, t, s, n in made] == ["a<\\/s>", "b", ""]


def test_chat_empty(spark, tmp_path):
    prepare(spark)
    got = C.op5_chat_formatting(spark, write_chat(tmp_path, [])).collect()
    assert [r["conv_id"] for r in got] == [-1]
