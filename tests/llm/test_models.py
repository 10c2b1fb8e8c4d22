"""Language model, toxicity and personal data: exact parts by brute force, models by held-out rows."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tarmac.llm import maxent as L
from tarmac.llm import pii as Q
from tarmac.llm import toxicity as X
from tarmac.llm.common import prepare, table

SF = "/root/testdata/sf0.01"


def check_base(rows, out):
    """Base scores and counts of op1 for rows (doc_id, text)."""
    train = lambda i: crc32(("" if i is None else str(i)).encode()) % 10 != 0
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if train(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        s = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want[(i, not train(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, float(f"{s:.8g}"))] += 1
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], float(f"{r['base_score']:.8g}")) for r in out)


def test_lm_given_tables(spark):
    prepare(spark)
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    out = L.op1_lm_scoring(spark, SF).collect()
    check_base(rows, out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.9
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_lm_edges(spark, write_docs, edge_rows):
    prepare(spark)
    out = L.op1_lm_scoring(spark, write_docs(edge_rows)).collect()
    check_base([(i, t) for i, t, _ in edge_rows], out)
    assert all(math.isfinite(r["score"]) for r in out)
    assert L.op1_lm_scoring(spark, write_docs([])).count() == 0


def test_lm_stores_a_model_a_core_and_not_a_file(spark, monkeypatch):
    """Many small partitions: the parts that tasks store do not grow with them, and the sums stay whole."""
    prepare(spark)
    kept, keep = [], L.keep
    docs = keep(table(spark, SF, "documents").limit(300).repartition(40))
    monkeypatch.setattr(L, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a task a file
    try:
        check_base(rows, L.lm_scores(docs).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = [df for df in kept if "node" in df.columns]
    assert len(parts) >= 2 and all(df.select("node").distinct().count() <= spark.sparkContext.defaultParallelism for df in parts)


def test_lm_without_training_rows(spark, write_docs):
    prepare(spark)
    held = next(i for i in range(1000) if crc32(str(i).encode()) % 10 == 0)
    out = L.op1_lm_scoring(spark, write_docs([(held, "nothing to learn from", "a")])).collect()
    check_base([(held, "nothing to learn from")], out)
    assert math.isfinite(out[0]["score"])


def local_layout(texts, tokens=None):
    """Layout of all texts, counted here."""
    counts = Counter(w for t in texts for w in t.lower().split())
    n = sum(counts.values()) + len(texts)
    head = sorted(counts, key=lambda w: (-counts[w], w))
    layout = L.Layout(tokens or n, head, [len(texts), *(counts[w] for w in head)])
    near = L.Neighbours(layout)
    near.learn(texts)
    layout.classify(near.sums[:, :L.NEIGHBOURS], near.sums[:, L.NEIGHBOURS])
    return layout


def test_both_factors_learn_context_and_sum_to_one():
    """After "red" comes one of 30 words, after "blue" one of 30 others; all 60 have the same words on both sides."""
    rng = np.random.default_rng(0)
    names = [[b"%s%d" % (k, i) for i in range(30)] for k in (b"ra", b"bo")]
    often = [b"w%d" % i for i in range(L.SINGLES - 2)]
    texts = []
    for _ in range(400):
        colour = rng.integers(2, size=20)
        texts.append(b" ".join(x for c in colour for x in (rng.choice(often), (b"red", b"blue")[c], names[c][rng.integers(30)])))
    trainer = L.Trainer(local_layout(texts))
    layout, p = trainer.layout, L.Parsed(texts[300:], trainer.layout)

    def now():
        return L.choice(layout, trainer.outer.weights, trainer.inner.weights, layout.class_bias, p)

    at = np.flatnonzero((p.classes >= L.OPEN) & (p.members > 0))
    assert len(at) > 500
    before = now().sum()
    for i in range(0, 300, 10):
        trainer.learn(texts[i:i + 10])
    each = [np.exp(L.log_probability(trainer.outer.weights, layout.class_bias, p.rows, np.full(len(p.rows), c))) for c in range(L.CLASSES)]
    assert np.allclose(sum(each), 1, atol=1e-4)
    each = [np.exp(L.log_probability(trainer.inner.weights, layout.member_bias[p.classes[at]], p.inner[at], np.full(len(at), m))) for m in range(L.MEMBERS)]
    assert np.allclose(sum(each), 1, atol=1e-4)
    assert now().sum() > 0.9 * before


def test_members_of_one_class_are_told_apart_by_context():
    rng = np.random.default_rng(1)
    often = [b"w%d" % i for i in range(L.SINGLES)]
    texts = [b" ".join(x for _ in range(30) for x in ((often[0], b"ra") if rng.random() < 0.5 else (often[1], b"bo"))) + b" " + b" ".join(often * 5) for _ in range(300)]
    layout = local_layout(texts)
    two = [layout.ids[b"ra"], layout.ids[b"bo"]]
    layout.symbol_class[two], layout.symbol_member[two] = L.OPEN, [1, 2]  # one class, whatever the clustering said
    layout.member_bias[L.OPEN, :3] = np.log([0.02, 0.49, 0.49])
    trainer = L.Trainer(layout)
    for i in range(0, 300, 2):  # a step each
        trainer.learn(texts[i:i + 2])
    p = L.Parsed(texts[:20], layout)
    at = np.flatnonzero(np.isin(p.number, two))
    got = L.log_probability(trainer.inner.weights, layout.member_bias[p.classes[at]], p.inner[at], p.members[at])
    assert np.exp(got).mean() > 0.9


def test_row_sums_add_every_hit():
    rng = np.random.default_rng(2)
    for n, k, spread in ((1, 6, 5), (300, 6, 3), (300, 3, 4000), (2000, 2, 40)):
        rows, g = rng.integers(spread, size=(n, k)).astype(np.uint16), rng.standard_normal((n, 7)).astype(np.float32)
        want = np.zeros((spread, 7))
        for j in range(k):
            np.add.at(want, rows[:, j], g)
        at, sums = L.row_sums(rows, g)
        got = np.zeros((spread, 7))
        got[at] = sums
        assert len(set(at)) == len(at) == len(np.unique(rows)) and np.allclose(got, want, atol=1e-3)


def test_model_sizes_follow_the_corpus():
    assert L.sizes(0)[0] == 256 < L.sizes(4_000_000)[0] < L.sizes(10 ** 9)[0] < L.sizes(10 ** 13)[0] == 131072
    assert all(L.sizes(n)[1] == 4 * L.sizes(n)[0] for n in (0, 10 ** 6, 10 ** 12))


def test_lm_hot_and_rare_words(spark, write_docs, monkeypatch):
    """A word outside a short word list is a third of all tokens; counts stay exact and one row a document comes back."""
    prepare(spark)
    monkeypatch.setattr(L, "sizes", lambda n: (256, 1024, 4))
    monkeypatch.setattr(L, "FLUSH_WORDS", 50)
    rows = [(i, " ".join(["a b c d e hot"] * 40 + [f"rare{i}", f"pair{i // 2}"]), "s") for i in range(60)]
    out = L.op1_lm_scoring(spark, write_docs(rows)).collect()
    check_base([(i, t) for i, t, _ in rows], out)
    assert len(out) == 60 and all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_toxicity_on_held_out_rows(spark):
    prepare(spark)
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    out = X.op8_toxicity(spark, SF).collect()
    assert len(out) == table(spark, SF, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    clean = [p for p, y in held if y == 0]
    toxic = [p for p, y in held if y == 1]
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.5 * len(toxic)


def test_toxicity_edges(spark, write_docs, edge_rows):
    prepare(spark)
    rows = [*edge_rows, *((100 + i, "you awful pest" if i % 2 else "a calm sentence here", "a") for i in range(80))]
    labels = [(100 + i, i % 2) for i in range(80)] + [(None, 1), (3, None), (101, 0), (9999, 1)]
    folder = write_docs(rows, labels)
    out = X.op8_toxicity(spark, folder).collect()
    assert len(out) == len(rows)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out if r["doc_id"] is not None and r["doc_id"] >= 100)
    docs = table(spark, folder, "documents")
    stay = X.stage_toxicity(spark, docs, folder)
    assert stay.columns == docs.columns and not [r for r in stay.collect() if "pest" in (r["text"] or "")]


def test_toxicity_without_labels_or_documents(spark, write_docs):
    prepare(spark)
    assert [r["score"] for r in X.op8_toxicity(spark, write_docs([(1, "text", "a")])).collect()] == [0.0]
    assert X.op8_toxicity(spark, write_docs([])).count() == 0


def test_toxicity_base_rate_stays_when_classes_are_capped(spark, write_docs, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(3)
    toxic = [int(k % 9 == 0) for k in range(2700)]
    rows = [(k, " ".join([*("w%s" % "abcdefghij"[j] for j in rng.integers(0, 10, 6)), "vile" if rng.random() < (0.5 if y else 0.05) else "plain"]), "a") for k, y in enumerate(toxic)]
    folder = write_docs(rows, list(enumerate(toxic)))
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")

    def held_out():
        out = [r for r in X.scored(docs, labels).collect() if r["held_out"]]
        return np.mean([r["score"] for r in out]), np.mean([r["predicted"] for r in out if not toxic[r["doc_id"]]])

    whole, rejected = held_out()
    monkeypatch.setattr(X, "PER_CLASS", 200)
    capped, rejected_capped = held_out()
    assert abs(whole - 1 / 9) < 0.04 and abs(capped - whole) < 0.04
    assert abs(rejected_capped - rejected) < 0.05


def test_class_weights_keep_the_class_ratio(monkeypatch):
    assert X.class_weights({0: 3531, 1: 449}) == {0: 1.0, 1: 1.0} and X.class_weights({}) == {}
    monkeypatch.setattr(X, "PER_CLASS", 100)
    w = X.class_weights({0: 900, 1: 100})
    assert w[0] / w[1] == pytest.approx(9) and 100 * w[0] + 100 * w[1] == pytest.approx(200)


def test_counterfactual_penalty_frees_group_mentions():
    def gap(penalty, monkeypatch_value):
        X.PENALTY = monkeypatch_value
        model, rng = X.Ftrl(), np.random.default_rng(0)
        rows = []
        for k in range(600):
            toxic = k % 2
            words = {"w%d" % rng.integers(50), "vile" if k % 4 == 1 else "plain", "muslims" if toxic else "people"}
            rows.append((X.hashed(words), None if X.twin(words) is None or not penalty else X.hashed(X.twin(words)), toxic))
        for _ in range(5):
            for r in rows:
                model.learn(*r)
        base = {"w1", "plain"}
        return abs(model.score(X.hashed(base | {"muslims"})) - model.score(X.hashed(base | {"christians"})))

    kept = X.PENALTY
    try:
        assert gap(True, kept) < 0.5 * gap(False, kept)
    finally:
        X.PENALTY = kept


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return out


def check_spans(rows, out):
    want = Counter()
    for i, t in rows:
        b = brute_spans(t or "")
        n = Counter(k for k, *_ in b)
        want[(i, *(n[k] for k in Q.KINDS), hashlib.sha256(",".join("%s:%d:%d" % s for s in b).encode()).hexdigest())] += 1
    assert want == Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out)


def test_base_patterns_match_the_contract():
    rng = np.random.default_rng(0)
    chars = list("abZ019.@+-() %_\n٣é") + ["192.168.0.1", "4111 1111 1111 1111", "+49 (30) 123-4567", "a@b.co"]
    for _ in range(4000):
        t = "".join(rng.choice(chars, rng.integers(0, 30)))
        assert sorted((Q.KINDS.index(k), a, b) for k, a, b in brute_spans(t)) == sorted(Q.base_spans(t)), t
    for t in ("1" * 200000, "a" * 200000 + "@", "+1" * 50000, "1." * 50000, "@" * 100000):  # linear time
        Q.base_spans(t)


def test_personal_data(spark, write_docs, edge_rows):
    prepare(spark)
    given = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    out = Q.op4_personal_data(spark, SF).collect()
    check_spans(given, out)
    rows = [*((i, t) for i, t, _ in edge_rows), (50, "é mail x.y@mail.example.org!"), (51, "+1 (825) 555-0563"), (52, "1.2.3.4.5.6.7.8 256.1.1.1")]
    check_spans(rows, Q.op4_personal_data(spark, write_docs([(i, t, None) for i, t in rows])).collect())
    assert Q.op4_personal_data(spark, write_docs([])).count() == 0


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(5)
    words = "and the in of is it that was".split()
    rows = []
    for k in range(300):
        d = "".join(map(str, rng.integers(0, 10, 16)))
        card = next(c for c in (d[:15] + str(x) for x in range(10)) if Q.luhn(c))
        entity = [f"+1 ({d[:3]}) 555-{d[3:7]}", card, ".".join(str(x) for x in rng.integers(1, 255, 4)), f"{rng.choice(words)}.{d[:2]}@mail{d[3]}.example.com", d[:4], f"token={d[:9]}ab{d[9:]}"][k % 6]
        rows.append(f"{' '.join(rng.choice(words, 4))} {entity} {' '.join(rng.choice(words, 4))}")
    return Q.train_field(rows)


def test_field_adds_spans_that_the_patterns_miss(field):
    found = lambda t: [(Q.KINDS[k], t[a:b]) for k, a, b in Q.added_spans(t, Q.base_spans(t), field)]
    assert found("that was (825) 555-0563 in the") == [("phone", "(825) 555-0563")]
    assert found("it is 86[.]204[.]171[.]17 of the") == [("ip", "86[.]204[.]171[.]17")]
    assert found("in the bik.12 [at] mail8.example.com is") == [("email", "bik.12 [at] mail8.example.com")]


def test_field_leaves_clean_text_alone(field):
    for t in ("in 1999 and 2004 the", "it was 17 of 25", "page 12-14 of 300", "the year 2020, 31.12.2020 is", "4920383034567390 in the", "no digits here at all"):
        assert not Q.added_spans(t, Q.base_spans(t), field), t


def test_rare_kinds_are_sampled(spark, write_docs):
    prepare(spark)
    rows = [(i, f"build {i} of {i * 7} in row {i % 13} " * 3, "log") for i in range(1500)] + [(2000 + i, f"mail a{i}@example.org now", "web") for i in range(6)]
    rows.append((3000, " ".join(f"{i} " + "word " * 60 for i in range(400)), "log"))
    got = Q.training_islands(table(spark, write_docs(rows), "documents").select("doc_id", "text")).collect()
    spans = [Q.base_spans(r["island"]) for r in got]
    assert sum(any(k == 0 for k, *_ in s) for s in spans) == 6
    assert sum(not s for s in spans) == Q.PLAIN and len(got) == Q.PLAIN + 6


def test_best_segments_agree_with_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 6
        segments = [(i, j, 0, []) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        scores = rng.normal(size=len(segments))
        best, z = 0.0, 0.0
        for mask in range(1 << min(len(segments), 12)):
            pick = [k for k in range(min(len(segments), 12)) if mask >> k & 1]
            spans = sorted(segments[k][:2] for k in pick)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                best, z = max(best, scores[pick].sum()), z + math.exp(scores[pick].sum())
        few = segments[:12]
        assert abs(scores[Q.best_segments(n, few, scores)].sum() - best) < 1e-9
        assert abs(Q.marginals(n, few, scores[:12])[1] - math.log(z)) < 1e-9
