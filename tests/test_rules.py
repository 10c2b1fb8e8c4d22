"""Components, quantiles, question rules and the anomaly sample: the cases that caps and switches used to hide."""

import numpy as np
from pyspark.sql import functions as F

from paths import SF
from tarmac.operators import ml as M
from tarmac.operators import nlq as N
from tarmac.operators import windows as W
from tarmac.operators.components import components
from tarmac.operators.quantiles import exact_quantile
from tarmac.sources.fixtures import flights


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(499)], "a string, b string")
    got = components(edges).collect()
    assert len(got) == 500 and len({r.root for r in got}) == 1


def test_exact_quantiles_by_brackets(spark, monkeypatch):
    from tarmac.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 50)
    rng = np.random.default_rng(0)
    for v in (rng.exponential(30, 4000), np.repeat([1.0, 2.0, 7.0], 700), rng.integers(0, 20, 3000).astype(float), np.array([5.0])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
        for q in (0.0, 0.25, 0.5, 0.8, 0.95, 1.0):
            assert abs(exact_quantile(df, "v", q) - np.quantile(v, q)) < 1e-9
    assert exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_rolling_delay_has_one_formula_for_every_size(spark):
    f = flights(spark, SF).orderBy("Scheduled_Time", "Flight_ID").limit(8)
    got = W.rolling_delay(f).toPandas().set_index("Flight_ID")
    p = f.toPandas().sort_values(["Scheduled_Time", "Flight_ID"]).set_index("Flight_ID").Delay_Minutes
    assert np.allclose(got.loc[p.index].Rolling_Delay_Mean, p.rolling(5, min_periods=1).mean())


def test_forest_scores_do_not_depend_on_lost_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"P{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(np.vstack([rng.normal(size=(600, 2)), rng.uniform(8, 12, (6, 2))]))]
    s = M.isolation_forest(spark.createDataFrame(rows, "Flight_ID string, x double, y double"), ["x", "y"], n_trees=30, contamination=0.01)
    low = {r.Flight_ID for r in s.orderBy("anomaly_score").limit(6).collect()}
    assert len(low & {f"P{i:04d}" for i in range(600, 606)}) >= 5
    mean = s.agg(F.avg("anomaly_score")).first()[0]
    assert -0.6 < mean < -0.35  # full samples: the average path is near c(256)


def test_question_tags_of_literal_questions(spark):
    qs = ["Show delays over 99999999999 minutes", "flights at 7 am", "flights at 7:30", "show delayed flights over 30 minutes from BOM in the morning", ""]
    t = N.tag_questions(spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "id int, text string")).orderBy("id").collect()
    assert t[0].filters.delay_threshold is None
    assert t[1].filters.time == "specific_time_('7', 'am')"
    assert t[3].filters.delay_threshold == 30 and t[3].filters.airports == ["BOM"] and t[3].filters.time == "morning"
    assert t[4].entity == "flights"


def test_intent_metrics_by_brute_force(spark):
    import datetime as dt

    f = flights(spark, SF)
    qs = [f"flights {when} delayed more than {n} minutes" for when in ("", "in the morning", "in the evening") for n in (5, 30, 30, 61, 100000)] + ["show delays", "flights in the morning"]
    tagged = N.tag_questions(spark.createDataFrame([(q,) for q in qs], "text string"))
    got = {(r.time, r.delay_gt, r.entity): (r.flight_count, r.avg_delay) for r in N.intent_metrics(f, tagged, dt.date(2024, 1, 15)).collect()}
    p = f.select("Hour", "Delay_Minutes").toPandas()
    hours = {None: range(24), "morning": range(6, 12), "evening": range(18, 24)}
    assert len(got) >= 10
    for (time, gt, entity), (n, mean) in got.items():
        x = p[p.Hour.isin(hours[time])].Delay_Minutes
        x = x[x > gt] if gt is not None else x
        x = x[x > 0] if entity == "delays" else x
        assert n == len(x), (time, gt, entity)
        assert (mean is None) == (len(x) == 0) and (mean is None or abs(mean - x.mean()) < 1e-6)


def test_suggestions_of_equal_rows_stay_apart(spark):
    rows = [(1, "delay"), (1, "delay"), (2, None), (3, "zzqx"), (4, ""), (5, "Show RUNWAY zzqx")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted((r.id, r.rank, r.template_id) for r in N.suggest(df, k=3).collect())
    want = []
    for i, text in rows:
        if text is not None:
            hits = [j for j, s in enumerate(N.TEMPLATES) if text.lower() in s.lower() or any(w in s.lower() for w in text.lower().split())]
            want += [(i, at + 1, j) for at, j in enumerate(hits[:3])]
    assert got == sorted(want)
    assert "Exchange" not in N.suggest(df)._jdf.queryExecution().executedPlan().toString()


def test_tags_by_a_plain_loop_and_one_search_a_word(spark):
    """Every word is searched for by one expression over a list, however many rules read it (n01 had about 900 searches)."""
    rng = np.random.default_rng(3)
    words = sorted({w for lists in (N.INTENT_PATTERNS, N.ENTITY_PATTERNS) for pats in lists.values() for w in pats} | {"how to", "who", "zzz", "busy", "?", "TODAY"})
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 6, 200)] + [None, "", "how to x", "zzz"]
    t = N.tag_questions(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    for r in t.collect():
        q = (r.text or "").lower()
        intents = [i for i, pats in N.INTENT_PATTERNS.items() if any(p in q for p in pats)]
        shown = "show" if any(w in q for w in ("what", "which", "who", "where", "when")) or not any(w in q for w in ("how to", "can you", "should i")) else "optimize"
        scores = {e: sum(p in q for p in pats) for e, pats in N.ENTITY_PATTERNS.items()}
        best = max(scores.values())
        assert r.action == (intents[0] if intents else shown), r.text
        assert r.entity == (next(e for e, s in scores.items() if s == best) if best else "flights"), r.text
        assert abs(r.confidence - min(1.0, 0.5 + 0.2 * bool(intents) + 0.2 * (best > 0) + 0.1 * ("?" in q))) < 1e-9
        assert r.filters.time == next((c for p, c in N.TIME_PATTERNS.items() if p in q), None)
    assert t.select("action", "entity", "confidence")._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") <= 20


def test_suggestions_split_a_text_once(spark):
    plan = N.suggest(spark.createDataFrame([(1, "delay")], "id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(split(" in plan and plan.count("split(") == 1 and "lower(lambda" not in plan
