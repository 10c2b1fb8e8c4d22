import numpy as np
from pyspark.sql import functions as F

from tarmac.operators import ml as M


def test_isolation_forest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, (145, 2))
    b = rng.normal(6, 1, (145, 2))
    o = rng.uniform(15, 25, (10, 2))
    x = np.vstack([a, b, o])
    rows = [(f"P{i:03d}", float(p[0]), float(p[1])) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "Flight_ID string, x double, y double")
    s = M.isolation_forest(df, ["x", "y"], n_trees=50, contamination=0.05).toPandas().sort_values("anomaly_score")
    top = set(s.head(10).Flight_ID)
    assert len(top & {f"P{i:03d}" for i in range(290, 300)}) >= 8


def test_standard_scale_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    z = [r.v_z for r in M.standard_scale(df, ["v"]).collect()]
    assert abs(z[0] + 1.224744871391589) < 1e-12


def test_dbscan_noise_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 0.3, (140, 2))
    b = rng.normal(3, 0.3, (140, 2))
    o = rng.uniform(-6, 9, (20, 2))
    x = np.vstack([a, b, o])
    flag = (np.arange(len(x)) % 7 == 0).astype(int)
    flag[-1] = 1 - flag[-1]
    rows = [(f"P{i:03d}", float(p[0]), float(p[1]), int(f)) for i, (p, f) in enumerate(zip(x, flag))]
    df = spark.createDataFrame(rows, "Flight_ID string, x double, y double, f int")
    got = M.dbscan(df, ["x", "y", "f"], ["f"], eps=0.5, min_samples=5).toPandas().set_index("Flight_ID")
    # brute force on the same standardisation (ddof 0)
    m = np.column_stack([x, flag]).astype(float)
    z = (m - m.mean(0)) / m.std(0)
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(-1))
    nb = d <= 0.5
    core = nb.sum(1) >= 5
    noise = ~core & ~(nb & core[None, :]).any(1)
    ids = [f"P{i:03d}" for i in range(len(x))]
    assert (got.loc[ids, "DBSCAN_Anomaly"].to_numpy() == noise).all()
    # two points share a cluster iff connected through core points: check core pairs within eps agree
    lab = got.loc[ids, "DBSCAN_Cluster"].to_numpy()
    ci = np.where(core)[0]
    for i in ci:
        for j in ci:
            if nb[i, j]:
                assert lab[i] == lab[j]


def plain_type(r, busy, large):
    if not r["Combined_Anomaly"]:
        return "Normal"
    if r["Delay_Minutes"] > 60:
        return "Severe Delay"
    if r["High_Congestion"] == 1:
        return "Congestion Anomaly"
    if r["Is_Peak_Hour_I"] == 1 and r["Delay_Minutes"] > 30:
        return "Peak Hour Disruption"
    if r["Runway_Utilization"] > busy:
        return "Runway Overutilization"
    return "Large Aircraft Anomaly" if r["Capacity"] > large else "General Anomaly"


def test_detector_queries_flag_planted_flights_that_are_on_time(spark, monkeypatch):
    from pyspark.sql import functions as F

    from paths import SF
    from tarmac.plans import queries_ml as Q
    from tarmac.plans.catalog import REGISTRY

    given = Q.flights(spark, SF)
    first = given.orderBy("Flight_ID").limit(1)
    odd = first.withColumns({"Flight_ID": F.lit("ODD"), "Runway": F.lit("ZZ/99"), "Airline": F.lit("Nobody Air"), "Aircraft_Type": F.lit("A380"),
                             "Capacity": F.lit(5000).cast(given.schema["Capacity"].dataType), "Congestion_Factor": F.lit(9.0).cast(given.schema["Congestion_Factor"].dataType),
                             "Delay_Minutes": F.lit(0).cast(given.schema["Delay_Minutes"].dataType)})
    rows = given.unionByName(odd).localCheckpoint()
    monkeypatch.setattr(Q, "flights", lambda spark, sf: rows)
    d, cols = Q._detected(spark, SF)
    monkeypatch.setattr(Q, "_detected", lambda spark, sf: (d, cols))
    run = lambda name: REGISTRY[name].build(spark, SF).collect()
    full = {r["Flight_ID"]: r for r in d.collect()}
    assert len(full) == rows.count() and full["ODD"]["Combined_Anomaly"]
    assert all(r["Combined_Anomaly"] == (r["is_anomaly"] or r["DBSCAN_Anomaly"]) for r in full.values())
    busy, large = (np.quantile([r[c] for r in full.values()], 0.95) for c in ("Runway_Utilization", "Capacity"))
    types = {r["Flight_ID"]: r["Anomaly_Type"] for r in run("m21d_detected_anomaly_type")}
    assert types == {i: plain_type(r, busy, large) for i, r in full.items()} and types["ODD"] == "Congestion Anomaly"
    limit = np.quantile([r["Anomaly_Confidence"] for r in full.values()], 0.8)
    assert {r["Flight_ID"] for r in run("m22d_detected_alerts")} == {i for i, r in full.items() if r["Combined_Anomaly"] and r["Anomaly_Confidence"] > limit}
    a = run("m23d_detected_accuracy")[0]
    late = lambda r: r["Delay_Minutes"] > 60
    assert (a["tp"], a["fp"], a["fn"], a["tn"]) == tuple(sum((late(r), r["Combined_Anomaly"]) == k for r in full.values()) for k in ((True, True), (False, True), (True, False), (False, False)))
    patterns = {(r["dimension"], r["key"]): r["value"] for r in run("a49d_detected_patterns")}
    flagged = [i for i, r in full.items() if r["Combined_Anomaly"]]
    assert all(patterns["Anomaly_Type", t] == sum(types[i] == t for i in flagged) for t in {types[i] for i in flagged})
    importance = {r["feature"]: r["importance"] for r in run("a52d_detected_feature_importance")}
    assert set(importance) == set(cols) and len(cols) > len(M.ANOMALY_NUMERIC)
    x, y = (np.array([float(r[c] or 0) for r in full.values()]) for c in ("Capacity_Utilization", "Anomaly_Confidence"))
    assert abs(importance["Capacity_Utilization"] - abs(np.corrcoef(x, y)[0, 1])) < 1e-9


def test_exact_silhouette_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 2)) + np.repeat([[0, 0], [3, 0], [0, 4]], 200, 0)
    own = np.repeat([0, 1, 2], 200)
    x, own = np.vstack([x, [[9, 9]]]), np.append(own, 3)  # a cluster of one
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, own)], "x double, y double, c int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    means = np.stack([d[:, own == c].sum(1) / (own == c).sum() for c in range(4)], 1)
    a = np.array([d[i, own == own[i]].sum() / max(1, (own == own[i]).sum() - 1) for i in range(len(x))])
    means[np.arange(len(x)), own] = np.inf
    b = means.min(1)
    want = np.where(own == 3, 0.0, (b - a) / np.maximum(a, b)).mean()
    assert abs(M.exact_silhouette(df, ["x", "y"], "c").first()[0] - want) < 1e-9
    assert M.exact_silhouette(df.where("c = 0"), ["x", "y"], "c").first()[0] is None


def test_neighbours_are_exact_for_every_grid(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 3))
    pts = spark.createDataFrame([(f"P{i}", "k" if i % 5 else "l", [float(v) for v in p], 1) for i, p in enumerate(x)],
                                "pid string, key string, v array<double>, w int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    group = np.arange(300) % 5 == 0
    want = {(f"P{i}", f"P{j}") for i, j in np.argwhere((d <= 0.5) & (group[:, None] == group[None]))}
    for grid in ((), (2,), (0, 2), M.spread_grid(pts, 0.5, 3)):
        assert {(r.pid, r.qid) for r in M.eps_neighbours(pts, 0.5, grid).collect()} == want


def test_grouped_quantiles(spark, monkeypatch):
    import pandas as pd

    from tarmac.operators import quantiles as Q

    rng = np.random.default_rng(2)
    t = pd.concat([pd.DataFrame({"g": "big", "v": rng.integers(0, 3000, 60_000) / 7.0}), pd.DataFrame({"g": "tied", "v": np.repeat([1.0, 5.0], [9000, 3000])}),
                   pd.DataFrame({"g": "few", "v": [3.0, 1.0, 2.0]}), pd.DataFrame({"g": [None] * 4, "v": [4.0, 8.0, 1.0, np.nan]})])
    df = spark.createDataFrame([(g, None if v != v else float(v)) for g, v in t.itertuples(index=False)], "g string, v double")
    got = {(r.g, r.q): r.value for r in Q.grouped_quantiles(df, ["g"], "v", [0.33, 0.66, 0.8, 0.85]).collect()}
    want = {(None if g != g or g is None else g, q): x.quantile(q) for g, x in t.groupby("g", dropna=False)["v"] for q in (0.33, 0.66, 0.8, 0.85)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert Q.grouped_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_performance_recommendations_by_mean_delay(spark):
    import datetime as dt

    from tarmac.operators import kpi

    def rules(delay):
        rows = [(f"F{i}", f"A{i % 2}", f"R{i % 2}", 8 if i else 9, float(delay + i), dt.date(2024, 1, 1)) for i in range(8)]
        f = spark.createDataFrame(rows, "Flight_ID string, Airline string, Runway string, Hour int, Delay_Minutes double, Date date")
        return [r.rule for r in kpi.performance_recommendations(f).orderBy("priority").collect()], kpi.performance_recommendations(f.limit(0)).count()

    for delay, level in ((30, "high"), (10, "medium"), (0, "maintenance")):
        got, empty = rules(delay)
        assert empty == 0 and [x.split(":")[0] for x in got[:3]] == [level] * 3 and "move flights out of the peak hour" in got


def test_dbscan_over_blocks_hands_on_no_pairs(spark, monkeypatch):
    """Keys cut into many blocks give the clusters of brute force; what is handed on grows with points, not pairs."""
    from collections import deque

    rng = np.random.default_rng(11)
    x = np.vstack([rng.uniform(0, 40, (500, 2)) * [1, 0.02], rng.normal([20, 9], 0.05, (300, 2)), rng.uniform(0, 40, (60, 2))])
    flag = np.arange(len(x)) % 2
    df = spark.createDataFrame([(f"P{i:03d}", float(a), float(b), 5.0, int(f)) for i, ((a, b), f) in enumerate(zip(x, flag))],
                               "Flight_ID string, x double, y double, c double, f int")
    eps = 0.12
    z = (x - x.mean(0)) / x.std(0)
    near = (((z[:, None] - z[None]) ** 2).sum(-1) <= eps * eps) & (flag[:, None] == flag[None])
    core, label = near.sum(1) >= 4, {}
    for s in np.where(core)[0]:
        todo = deque([s] if s not in label else [])
        while todo:
            i = todo.popleft()
            if label.setdefault(i, s) == s:
                todo.extend(j for j in np.where(near[i] & core)[0] if j not in label and not label.update({j: s}))
    want = [label.get(i, min((label[j] for j in np.where(near[i] & core)[0]), default=-1)) for i in range(len(x))]
    dense = {s: k for k, s in enumerate(sorted(set(want) - {-1}))} | {-1: -1}
    import tarmac.session as session

    written, cut = [], session.cut_lineage

    def counted(frame, *replaces):
        out = cut(frame, *replaces)
        written.append(out.count())
        return out

    monkeypatch.setattr(session, "cut_lineage", counted)
    monkeypatch.setattr(M, "DBSCAN_BLOCK", 16)
    monkeypatch.setattr(M, "DBSCAN_HELD", 300)
    got = {r.Flight_ID: r.DBSCAN_Cluster for r in M.dbscan(df, ["x", "y", "c", "f"], ["f"], eps=eps, min_samples=4).collect()}
    assert [got[f"P{i:03d}"] for i in range(len(x))] == [dense[s] for s in want]
    assert len(dense) > 5 and max(written) < 6 * len(x) < near.sum()


def test_exact_quantile_computes_its_frame_once(spark):
    from tarmac.operators.quantiles import exact_quantile

    made = spark.sparkContext.accumulator(0)

    def rows(it):
        made.add(1)
        yield from it

    v = np.random.default_rng(1).permutation(120_000) / 7.0
    df = spark.range(120_000, numPartitions=2).mapInPandas(rows, "id long").selectExpr("(id * 7919 % 120000) / 7.0D AS v")
    assert abs(exact_quantile(df, "v", 0.8) - np.quantile(v, 0.8)) < 1e-9 and made.value == 2
    assert exact_quantile(df.limit(0), "v", 0.8) is None


def test_models_train_and_predict_on_every_core(spark, monkeypatch):
    """One file is one task of a scan: training rows of a large table and all rows to predict are dealt; none is lost."""
    n = 25_000
    f = spark.range(n, numPartitions=1).select(F.concat(F.lit("FL"), "id").alias("Flight_ID"), F.timestamp_seconds("id").alias("Scheduled_Time"),
                                               (F.col("id") % 50).cast("double").alias("Delay_Minutes"),
                                               *[(F.col("id") % 7).cast("double").alias(c) for c in M.NUMERIC_FEATURES],
                                               *[(F.col("id") % 3).cast("string").alias(c) for c in M.CATEGORICAL])
    seen = []
    monkeypatch.setattr(M, "_fit_delay", lambda df, kind, label: seen.append((df.rdd.getNumPartitions(), df.select("Flight_ID").distinct().count())))
    M.train_delay(f)
    M.train_delay(f.limit(9_000))
    assert seen == [(3, n), (1, 9_000)]
    assert [M.train_tasks(x) for x in (0, 10_000, 10_001, 80_000, 3_200_000, 4_800_000)] == [1, 1, 2, 8, 32, 48]

    class Model:
        def transform(self, df):
            return df.withColumn("prediction", F.col("Delay_Minutes") - 1)

    p = M.predict_delay(Model(), f)
    assert p.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert p.agg(F.count(F.lit(1)), F.min("Predicted_Delay")).first()[:] == (n, 0.0)


def test_risk_table_predicts_once(spark):
    pred = spark.range(2_000).select(F.to_date(F.lit("2024-01-01")).alias("Date"), (F.col("id") % 24).alias("Hour"), (F.col("id") % 31).cast("double").alias("Delay_Minutes"),
                                     (F.col("id") % 29).cast("double").alias("Predicted_Delay"))
    risk = M.ml_risk(pred)
    assert "Range" not in risk._jdf.queryExecution().optimizedPlan().toString()
    assert risk.agg(F.sum("Flight_Count")).first()[0] == 2_000


def test_block_search_joins_what_chains_join_and_compares_few(spark, monkeypatch):
    """Cores and clusters of one dense block are those of brute force, with few of its distances taken."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, eps = 3_000, 0.5
    x = np.vstack([rng.normal(0, 0.05, (1_500, 4)), rng.normal(0.9, 0.3, (1_400, 4)), rng.uniform(-3, 3, (100, 4))])
    x[:, 3] = np.round(x[:, 3], 1)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= 5
    names = np.array([f"P{i:04d}" for i in rng.permutation(n)])
    t = pa.table({"pid": names, "w": np.ones(n, dtype=np.int64), "own": np.arange(n) % 10 > 0, "core": core, "v": [list(map(float, r)) for r in x]})
    taken, close = [], M._close
    monkeypatch.setattr(M, "_close", lambda a, b, eps: taken.append(len(a) * len(b)) or close(a, b, eps))
    own = t.column("own").to_numpy()
    got = M._count_near(eps, 5)(t)
    assert (np.minimum(got.column("n").to_numpy(), 5) == np.minimum(near.sum(1), 5)[own]).all() and got.column("pid").to_pylist() == list(names[own])
    links = [tuple(r.values()) for r in M._link_near(eps)(t).to_pylist()]
    assert sum(taken) < n * n / 4

    label, order = {}, [i for i in np.argsort(names) if core[i]]
    for s in order:
        todo = [] if s in label else [s]
        while todo:
            i = todo.pop()
            if label.setdefault(i, s) == s:
                todo += [j for j in np.where(near[i] & core)[0] if j not in label and not label.update({j: s})]
    want = {(names[i], names[label[i]], True) for i in order}
    want |= {(names[i], names[label[j]], False) for i in np.where(~core & own)[0] for j in np.where(near[i] & core)[0]}
    assert len(links) == len(want) and set(links) == want and len(set(label.values())) > 1
    empty = t.slice(0, 0)
    assert M._count_near(eps, 5)(empty).num_rows == 0 and M._link_near(eps)(empty).num_rows == 0


def test_forest_lookups_follow_the_trees():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5))
    x[:, 3:] = x[:, 3:] > 0
    trees = [M._build_tree(x[rng.integers(0, 400, 64)], np.random.default_rng(i), 6) for i in range(5)]

    def walk(t, row):
        node, depth = 0, 0
        while t["feat"][node] >= 0:
            node, depth = t["left" if row[t["feat"][node]] < t["thr"][node] else "right"][node], depth + 1
        return depth + M._c_norm(t["size"][node])

    assert np.allclose(M._path_sums([M._paths(t) for t in trees], x), [sum(walk(t, row) for t in trees) for row in x], rtol=0, atol=1e-12)
    single = M._paths(M._build_tree(x[:1], rng, 6))
    assert (M._path_sums([single], x) == 0).all()


def test_detectors_share_one_stored_set_of_features(spark, monkeypatch):
    from paths import SF
    from tarmac.plans import queries_ml as Q

    made, features = [], M.anomaly_features
    monkeypatch.setattr(M, "anomaly_features", lambda df: made.append(1) or features(df))
    d, cols = Q._detected(spark, SF)
    assert len(made) == 1 and {*Q.REPORTED, *cols, "decision", "is_anomaly", "DBSCAN_Anomaly", "Combined_Anomaly", "Anomaly_Confidence"} <= set(d.columns)
    assert d.count() == Q.flights(spark, SF).count()
