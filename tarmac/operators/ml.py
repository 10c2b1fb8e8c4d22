"""Delay models, clustering and anomaly detection on Spark ML.

Feature engineering is DataFrame columns; models are ``pyspark.ml``
estimators.  The isolation forest is built Spark-side: trees are grown in
``applyInPandas`` per tree id from its own sample (min(256, n) rows a tree,
drawn by hash) and every row is scored by ``mapInPandas`` with
the small forest shipped to the tasks.
"""

from __future__ import annotations

import json
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import dims
from tarmac.functions import columns as C
from tarmac.operators import joins as J
from tarmac.operators.components import components
from tarmac.operators.quantiles import exact_quantile
from tarmac.operators.windows import rolling_delay
from tarmac.session import cut_lineage, wide_rows

NUMERIC_FEATURES = [
    "Hour", "Day_of_Week", "Month", "Is_Weekend", "Is_Morning_Peak", "Is_Evening_Peak", "Is_Night",
    "Congestion_Factor", "Peak_Category_Numeric", "Runway_Efficiency", "Runway_Capacity", "Is_Congested_Airport",
    "Runway_Utilization", "Is_High_Impact_Int", "Is_Large_Aircraft", "Capacity",
    "Dest_BOM", "Dest_DEL", "Dest_BLR", "Dest_MAA", "Dest_CCU", "Dest_HYD",
]
CATEGORICAL = ["Airline", "Aircraft_Type", "Runway", "Capacity_Category"]


# M01
def delay_features(df: DataFrame, default_origin: str = "BOM") -> DataFrame:
    f = df.withColumn("Origin", F.coalesce(F.col("Origin"), F.lit(default_origin)))  # Q8 fixed
    cal = C.calendar_parts("Scheduled_Time")
    f = f.withColumn("Month", cal["Month"]).withColumn("Is_Weekend", C.is_weekend("Day_of_Week"))
    f = (f.withColumn("Is_Morning_Peak", C.in_hours("Hour", C.MORNING_PEAK))
         .withColumn("Is_Evening_Peak", C.in_hours("Hour", C.EVENING_PEAK))
         .withColumn("Is_Night", C.in_hours("Hour", C.NIGHT_HOURS))
         .withColumn("Peak_Category_Numeric", C.peak_numeric("Peak_Category"))
         .withColumn("Is_Congested_Airport", C.congested_origin("Origin")))
    f = J.with_group_counts(f, ["Origin", "Hour"], "Hourly_Flights", "Runway_Capacity", "Runway_Utilization")
    f = f.withColumn("Runway_Utilization", F.coalesce("Runway_Utilization", F.lit(0.5)))
    for k, v in C.destination_onehots("Destination").items():
        f = f.withColumn(k, v)
    return (f.withColumn("Is_High_Impact_Int", F.coalesce(F.col("Is_High_Impact"), F.lit(False)).cast("int"))
            .withColumn("Is_Large_Aircraft", C.is_large_aircraft("Capacity"))
            .withColumn("Capacity_Category", C.capacity_bucket("Capacity")))


# M02 / M11
def feature_pipeline(numeric=NUMERIC_FEATURES, categorical=CATEGORICAL) -> list:
    """Indexers (alphabetical, like LabelEncoder) + one-hot + assembler (only encoded vectors, Q7 fixed)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_vec" for c in categorical], handleInvalid="keep")
    asm = VectorAssembler(inputCols=list(numeric) + [f"{c}_vec" for c in categorical], outputCol="features", handleInvalid="keep")
    return [*idx, ohe, asm]


def standard_scale(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std (ddof 0, as the reference's scaler); constant columns -> 0."""
    st = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(st))
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))), F.lit(0.0)))
    return out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


# M03
def split(df: DataFrame, frac: float = 0.8, key: str = "Flight_ID", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by hash bucket; buckets are uniform within every stratum, so
    the delayed/on-time mix is kept (stratified in expectation, no sort, no shuffle)."""
    b = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000))
    return df.where(b < int(frac * 1000)), df.where(b >= int(frac * 1000))


ROWS_A_TASK = 10_000
SPREAD_ROWS = 20_000  # fewer are predicted where they lie
MANY_ROWS_A_TASK = 100_000
DEAL_KEYS = ["Flight_ID", "Scheduled_Time"]


def train_tasks(rows: int) -> int:
    """Tasks that train on so many rows: 1 for each 10,000 up to 32, then 32 until each has 100,000."""
    return max(min(-(-rows // ROWS_A_TASK), 32), -(-rows // MANY_ROWS_A_TASK), 1)


def spread(df: DataFrame) -> DataFrame:
    """The same rows, many of them dealt over all cores: a scan of one file is one task, and a row's way through 100 trees is long."""
    if df.count() <= SPREAD_ROWS:
        return df
    keys = [k for k in DEAL_KEYS if k in df.columns]
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# M04 / M05 / M08 / M10
def train_delay(df: DataFrame, kind: str = "rf", label: str = "Delay_Minutes") -> PipelineModel:
    """Fit on every row.  Large tables are dealt by key into tasks by their number of rows and kept while the fit reads them:
    without that it would run in as many tasks as the scan and compute the features anew for every indexer."""
    keys = [k for k in DEAL_KEYS if k in df.columns]
    narrow = df.select(*dict.fromkeys([*keys, *NUMERIC_FEATURES, *CATEGORICAL, label]))
    tasks = train_tasks(df.count())
    if tasks > 1:
        narrow = narrow.repartition(tasks, *keys).sortWithinPartitions(*keys).persist()
    try:
        return _fit_delay(narrow, kind, label)
    finally:
        if tasks > 1:
            narrow.unpersist()


def _fit_delay(df: DataFrame, kind: str, label: str) -> PipelineModel:
    if kind == "rf":
        est = RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=100, maxDepth=10, seed=42)
    else:
        est = GBTRegressor(labelCol=label, featuresCol="features", maxIter=100, maxDepth=6, stepSize=0.1, seed=42)
    return Pipeline(stages=[*feature_pipeline(), est]).fit(df)


def predict_delay(model: PipelineModel, df: DataFrame, late: float = 15.0) -> DataFrame:
    p = model.transform(spread(df)).withColumn("Predicted_Delay", F.greatest(F.col("prediction"), F.lit(0.0)))
    return p.withColumn("Predicted_Late", F.col("Predicted_Delay") > late)


# M06
def regression_metrics(pred: DataFrame, label: str = "Delay_Minutes", p: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(p)
    return pred.agg(
        F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
        (1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop(label))).alias("R2"))


# M09
def importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    fitted = model.stages[-1]
    attrs = model.transform(df.limit(1)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    imp = fitted.featureImportances.toArray().tolist()
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


# M12
def risk_heatmap(pred: DataFrame) -> DataFrame:
    # the heat map uses the raw model output (not clipped at 0) and its > 15 min flag
    g = pred.groupBy("Date", "Hour").agg(
        F.avg((F.col("prediction") > 15).cast("double")).alias("Delay_Risk"), F.avg("prediction").alias("Predicted_Delay"),
        F.count(F.lit(1)).alias("Flight_Count"))
    return g.withColumn("Risk_Level", C.risk_level_fixed("Delay_Risk"))


# M13
def ml_risk(pred: DataFrame) -> DataFrame:
    """ML risk table per (Date, Hour) from per-flight predictions.

    Delay_Risk = .4 mean prediction + .2 prediction std + .3 mean risk score
    + 10 * count / max count; levels by the 33/66/85 % quantiles of Delay_Risk
    with right-closed bins starting at 0 (<= 0 or a one-flight slot's null std
    give a null level, Q2); confidence = clip(100 - error / max(pred, 1) * 100).
    """
    err = F.abs(F.col("Delay_Minutes") - F.col("Predicted_Delay"))
    p = pred.withColumn("__err", err).withColumn("__score", F.col("Predicted_Delay") * 0.7 + err * 0.3)
    g = p.groupBy("Date", "Hour").agg(
        F.avg("Predicted_Delay").alias("Predicted_Avg_Delay"), F.stddev_samp("Predicted_Delay").alias("Predicted_Delay_Std"),
        F.max("Predicted_Delay").alias("Max_Predicted_Delay"), F.avg("Delay_Minutes").alias("Actual_Avg_Delay"),
        F.count(F.lit(1)).alias("Flight_Count"), F.avg("__score").alias("Avg_Risk_Score"), F.avg("__err").alias("Avg_Prediction_Error"))
    g = cut_lineage(g)  # read three times below: the predictions behind it are not to be made again
    mx = g.agg(F.max("Flight_Count").alias("__mx"))
    g = g.crossJoin(F.broadcast(mx)).withColumn(
        "Delay_Risk", F.col("Predicted_Avg_Delay") * 0.4 + F.col("Predicted_Delay_Std") * 0.2 + F.col("Avg_Risk_Score") * 0.3
        + F.col("Flight_Count") / F.col("__mx") * 10).drop("__mx")
    # (Date, Hour) rows: bounded by the time span; quantiles from one aggregate
    q = g.agg(F.percentile("Delay_Risk", 0.33).alias("q1"), F.percentile("Delay_Risk", 0.66).alias("q2"), F.percentile("Delay_Risk", 0.85).alias("q3"))
    g = g.crossJoin(F.broadcast(q))
    r = F.col("Delay_Risk")
    lvl = (F.when((r > 0) & (r <= F.col("q1")), "Low").when((r > F.col("q1")) & (r <= F.col("q2")), "Medium")
           .when((r > F.col("q2")) & (r <= F.col("q3")), "High").when(r > F.col("q3"), "Critical"))
    conf = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - F.col("Avg_Prediction_Error") / F.greatest(F.col("Predicted_Avg_Delay"), F.lit(1.0)) * 100))
    return g.withColumn("Risk_Level", lvl).withColumn("Model_Confidence", conf).drop("q1", "q2", "q3")


# M14 / M15 / M16
def peak_clusters(stats: DataFrame, cols=("Flight_Count", "Avg_Delay", "Congestion_Score"), k: int = 4) -> DataFrame:
    z = standard_scale(stats, list(cols))
    v = VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="features").transform(z)
    m = KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster").fit(v)
    out = m.transform(v)
    rank = out.groupBy("cluster").agg(F.avg(cols[-1]).alias("__m"))
    # k rows: bounded window
    rank = rank.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("__m"), "cluster")))
    names = F.element_at(F.array(*[F.lit(x) for x in ["Super Peak", "Peak", "Moderate", "Low Traffic"]]), F.least(F.col("__r"), F.lit(4)).cast("int"))
    return out.join(rank.select("cluster", names.alias("Peak_Tier")), "cluster").drop("features")


def silhouette(df: DataFrame, features: str = "features", pred: str = "cluster") -> float:
    return ClusteringEvaluator(featuresCol=features, predictionCol=pred, distanceMeasure="squaredEuclidean").evaluate(df)


SILHOUETTE_BLOCK = 256


def exact_silhouette(df: DataFrame, features: list[str], pred: str) -> DataFrame:
    """Mean Euclidean silhouette as one row; a point alone in its cluster counts 0, one cluster alone gives null.

    All pair distances are needed, so points are dealt into blocks of at most
    ``SILHOUETTE_BLOCK`` by their number; every point meets every block as one
    array and sends on one sum and count per cluster, never a pair.
    """
    from tarmac.sources.ingest import dense_index

    points = dense_index(df.select(F.col(pred).alias("own"), F.array(*[F.col(c).cast("double") for c in features]).alias("v")), None, "pid")
    points = points.withColumn("block", F.floor(F.col("pid") / F.lit(SILHOUETTE_BLOCK)))
    per = points.groupBy("block", F.col("own").alias("other")).agg(F.collect_list("v").alias("vs"))
    last = points.agg(F.max("block").alias("last"))  # one row
    asked = points.drop("block").crossJoin(F.broadcast(last)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))

    def total(v, vs):
        gap = lambda x: F.sqrt(F.aggregate(F.zip_with(v, x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d))
        return F.aggregate(vs, F.lit(0.0), lambda t, x: t + gap(x))

    sums = asked.join(per, "block").select("pid", "own", "other", total(F.col("v"), F.col("vs")).alias("s"), F.size("vs").alias("n"))
    means = sums.groupBy("pid", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    same = F.col("own").eqNullSafe(F.col("other"))
    per_point = means.groupBy("pid").agg(F.max(F.when(same, F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"),
                                         F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    score = F.when(F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per_point.agg(F.avg(score).alias("silhouette"))


def flight_clusters(df: DataFrame, k: int = 3) -> DataFrame:
    """K-means on standardised delay, hour and seats; a cluster's label by its mean delay."""
    names = ["Delay_Minutes", "Hour", "Capacity"]
    z = standard_scale(df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}), names)
    v = VectorAssembler(inputCols=[f"{c}_z" for c in names], outputCol="features").transform(z)
    out = KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster").fit(v).transform(v)
    prof = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("Delay_Minutes").alias("avg_delay"), F.avg("Hour").alias("avg_hour"))
    return prof.withColumn("label", F.when(F.col("avg_delay") < 10, "High Performance").when(F.col("avg_delay") < 20, "Moderate Performance")
                           .otherwise("Needs Optimization"))


# M18
ANOMALY_NUMERIC = ["Hour", "Day_of_Week", "Month", "Day_of_Year", "Delay_Minutes", "Is_Delayed", "Capacity_Utilization", "Is_Peak_Hour_I",
                   "Is_Weekend", "Congestion_Factor", "High_Congestion", "Rolling_Delay_Mean", "Rolling_Delay_Std",
                   "Hourly_Traffic_Density", "Runway_Utilization"]
TOP_AIRLINES = 10


def anomaly_features(df: DataFrame) -> DataFrame:
    """Calendar, delay, capacity, family, airline and runway flags, rolling delay, traffic per hour of day and per runway and hour.

    Traffic counts come from one aggregate of (runway, hour); it has as many rows
    as runways times 24.
    """
    f = df.withColumn("Delay_Minutes", F.coalesce(F.col("Delay_Minutes").cast("double"), F.lit(0.0)))
    f = f.withColumn("Capacity", F.coalesce(F.col("Capacity").cast("double"), F.lit(150.0)))
    f = f.withColumn("Congestion_Factor", F.coalesce(F.col("Congestion_Factor").cast("double"), F.lit(1.0)))
    per = f.groupBy("Runway", "Hour").agg(F.count(F.lit(1)).alias("Runway_Utilization"))
    per = per.withColumn("Hourly_Traffic_Density", F.sum("Runway_Utilization").over(Window.partitionBy("Hour")))
    most = f.agg(F.max("Capacity")).first()[0]
    f = rolling_delay(f).join(per, ["Runway", "Hour"], "left")
    f = f.withColumns({"Month": F.month("Scheduled_Time"), "Day_of_Year": F.dayofyear("Scheduled_Time"),
                       "Capacity_Utilization": F.col("Capacity") / F.lit(most), "Is_Delayed": (F.col("Delay_Minutes") > 0).cast("int"),
                       "Delay_Category": C.delay_category("Delay_Minutes"), "Is_Peak_Hour_I": C.in_hours("Hour", C.ANOMALY_PEAK_HOURS),
                       "Is_Weekend": C.is_weekend("Day_of_Week"), "High_Congestion": C.high_congestion("Congestion_Factor"),
                       "Aircraft_Family": C.aircraft_family("Aircraft_Type")})
    return f.withColumns(C.family_flags("Aircraft_Family"))


def name_flags(df: DataFrame) -> dict[str, Column]:
    """Flags of the ten airlines with the most flights and of every runway (both short lists of names)."""
    clean = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\W+", "_")
    airlines = df.groupBy(clean("Airline").alias("a")).count().orderBy(F.desc("count"), "a").limit(TOP_AIRLINES)
    runways = df.select(clean("Runway").alias("r")).distinct().orderBy("r")
    out = {f"Airline_{r['a'][:10]}": (clean("Airline") == r["a"]).cast("int") for r in airlines.collect() if r["a"] is not None}
    for r in runways.toLocalIterator():
        if r["r"] is not None:
            out[f"Runway_ID_{r['r'][:5]}"] = (clean("Runway") == r["r"]).cast("int")
    return out


def anomaly_columns(feat: DataFrame) -> list[str]:
    """The numeric columns that the detectors read."""
    return ANOMALY_NUMERIC + [c for c in feat.columns if c.startswith(("Airline_", "Runway_ID_")) or c == "Is_Wide_Body" or (c.startswith("Is_") and c.endswith("_Family"))]


# M19 ---------------------------------------------------------------------------
def _c_norm(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _build_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def grow(idx, depth):
        node = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return node
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return node
        j = int(rng.choice(cand))
        t = float(rng.uniform(lo[j], hi[j]))
        feat[node], thr[node] = j, t
        lmask = sub[:, j] < t
        left[node] = grow(idx[lmask], depth + 1)
        right[node] = grow(idx[~lmask], depth + 1)
        return node

    grow(np.arange(len(x)), 0)
    return {"feat": feat, "thr": thr, "left": left, "right": right, "size": size}


def _paths(tree: dict) -> dict:
    """A tree for lookups: leaves lead to themselves, ``path`` is a node's depth plus the average path of the unbuilt subtree below."""
    feat, left, right = (np.asarray(tree[k], dtype=np.int64) for k in ("feat", "left", "right"))
    leaf, depth = feat < 0, np.zeros(len(feat))
    for node in np.where(~leaf)[0]:  # a node comes before its children
        depth[[left[node], right[node]]] = depth[node] + 1
    own = np.arange(len(feat))
    after = np.column_stack([np.where(leaf, own, right), np.where(leaf, own, left)]).ravel()
    return {"feat": np.where(leaf, 0, feat), "thr": np.where(leaf, -np.inf, np.asarray(tree["thr"], dtype=float)), "after": after,
            "path": depth + np.array([_c_norm(int(n)) for n in tree["size"]]), "deep": int(depth.max())}


def _path_sums(forest: list[dict], x: np.ndarray) -> np.ndarray:
    """The path length of every row of ``x``, summed over the trees."""
    n = len(x)
    at, flat, total = np.arange(n), np.ascontiguousarray(x.T).ravel(), np.zeros(n)
    for t in forest:
        node, column = np.zeros(n, dtype=np.int64), t["feat"] * n
        for _ in range(t["deep"]):
            less = flat.take(column.take(node) + at) < t["thr"].take(node)
            node *= 2
            node += less
            node = t["after"].take(node)
        total += t["path"].take(node)
    return total


def isolation_forest(df: DataFrame, features: list[str], key: str = "Flight_ID", n_trees: int = 100, max_samples: int = 256,
                     contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Isolation forest: returns key, anomaly_score (higher = more normal, like score_samples),
    decision (score - offset) and is_anomaly (decision < 0, offset = contamination quantile)."""
    from tarmac.session import cut_lineage

    # the feature rows are read three times (count, tree samples, scoring): materialise them once
    stored = getattr(df, "_cut_path", None) is not None
    df = df.select(key, *[F.col(c).cast("double").alias(c) for c in features])
    df = df if stored else cut_lineage(df)
    n = df.count()
    psi = int(min(max_samples, n))
    # each tree draws its own rows: over-drawn by hash of (row, tree), then the first psi in hash order
    chance = min(1.0, (psi + 8 * psi ** 0.5 + 16) / max(n, 1))
    draw = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("__u", draw(F.col("tree"))).where(F.col("__u") < F.lit(chance))
    sample = sample.withColumn("__n", F.row_number().over(Window.partitionBy("tree").orderBy("__u", key))).where(F.col("__n") <= psi).drop("__n")
    max_depth = int(np.ceil(np.log2(max(psi, 2))))
    cols = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["__u", key])
        x = pdf[cols].to_numpy(dtype=float)
        x = np.nan_to_num(x)
        tree = _build_tree(x, np.random.default_rng(seed + tid), max_depth)
        return pd.DataFrame({"tree": [tid], "model": [json.dumps(tree)]})

    forest_df = sample.groupBy("tree").applyInPandas(grow, "tree int, model string")
    # the forest is n_trees x (<= 2 * psi) nodes: bounded by the parameters, not by the data
    forest = [json.loads(r["model"]) for r in forest_df.orderBy("tree").collect()]
    forest = [_paths(t) for t in forest]
    cn = _c_norm(psi)

    def score(it):
        for pdf in it:
            x = np.nan_to_num(pdf[cols].to_numpy(dtype=float))
            depth_sum = _path_sums(forest, x)
            s = 2.0 ** (-(depth_sum / len(forest)) / cn) if cn > 0 else np.full(len(x), 0.5)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "anomaly_score": -s})

    scored = df.select(key, *[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(
        score, T.StructType([T.StructField(key, T.StringType()), T.StructField("anomaly_score", T.DoubleType())]))
    scored = cut_lineage(scored)  # read twice: for the offset and as the result
    off = scored.agg(F.percentile_approx("anomaly_score", contamination, 100000).alias("__off"))
    out = scored.crossJoin(F.broadcast(off)).withColumn("decision", F.col("anomaly_score") - F.col("__off")).drop("__off")
    return out.withColumn("is_anomaly", F.col("decision") < 0)


# M21 / M22 / M23 / A49 / A52 -- ``flag`` names the boolean of the combined detectors
ACTIONS = {  # FIXED VALUES (must equal the reference's texts)
    "Severe Delay": "Immediate intervention required - Consider flight rebooking or gate reassignment",
    "Congestion Anomaly": "Activate congestion management protocols",
    "Peak Hour Disruption": "Deploy additional ground crew and expedite turnaround",
    "Runway Overutilization": "Consider runway redistribution or delay non-critical flights",
    "Large Aircraft Anomaly": "Ensure adequate ground support and runway capacity",
    "General Anomaly": "Monitor closely and investigate root cause",
}


def anomaly_type(df: DataFrame, flag: str = "Combined_Anomaly", limits: tuple[float, float] | None = None) -> DataFrame:
    """Type of every flight; the 95 % limits of runway use and seats are over all flights, unless they are given."""
    busy, large = map(F.lit, limits or [exact_quantile(df, c, 0.95) for c in ("Runway_Utilization", "Capacity")])
    t = (F.when(~F.col(flag), "Normal")
         .when(F.col("Delay_Minutes") > 60, "Severe Delay")
         .when(F.col("High_Congestion") == 1, "Congestion Anomaly")
         .when((F.col("Is_Peak_Hour_I") == 1) & (F.col("Delay_Minutes") > 30), "Peak Hour Disruption")
         .when(F.col("Runway_Utilization") > busy, "Runway Overutilization")
         .when(F.col("Capacity") > large, "Large Aircraft Anomaly")
         .otherwise("General Anomaly"))
    return df.withColumn("Anomaly_Type", t)


def alerts(typed: DataFrame, q: float = 0.8, flag: str = "Combined_Anomaly", limit: float | None = None) -> DataFrame:
    """Flagged flights whose confidence exceeds ``limit`` (the q-quantile of all flights, unless it is given), with severity
    and action, best first."""
    c, d = F.col("Anomaly_Confidence"), F.col("Delay_Minutes")
    a = typed.where(F.col(flag) & (c > F.lit(exact_quantile(typed, "Anomaly_Confidence", q) if limit is None else limit)))
    severity = (F.when((c > 1.5) | (d > 60) | (F.col("Anomaly_Type") == "Severe Delay"), "Critical")
                .when((c > 1.0) | (d > 30), "High").when((c > 0.5) | (d > 15), "Medium").otherwise("Low"))
    action = dims.lookup(F.col("Anomaly_Type"), ACTIONS, "Monitor and investigate")
    return a.select("Flight_ID", "Airline", "Scheduled_Time", "Runway", "Anomaly_Type", c.alias("confidence"), "Delay_Minutes",
                    severity.alias("Severity"), action.alias("Recommended_Action")).orderBy(F.desc("confidence"), "Flight_ID")


def detection_accuracy(df: DataFrame, truth_delay: float = 60.0, flag: str = "Combined_Anomaly") -> DataFrame:
    t = F.col("Delay_Minutes") > truth_delay
    p = F.col(flag)
    c = df.agg(F.count(F.lit(1)).alias("total_predictions"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
               F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    acc = (F.col("tp") + F.col("tn")) / F.col("total_predictions")
    return c.select("*", acc.alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                    F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"), (acc * 100).alias("accuracy_percentage"))


def anomaly_patterns(typed: DataFrame, flag: str = "Combined_Anomaly") -> DataFrame:
    """(dimension, key, value): counts of flagged flights by hour, day, month, runway, airline, aircraft and type, delay
    statistics, and the shares in peak hours and under high congestion."""
    a = typed.where(F.col(flag))
    names = ["Hour", "Day_of_Week", "Month", "Runway", "Airline", "Aircraft_Type", "Anomaly_Type"]
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).cast("string").alias("key")) for n in names])
    counts = a.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).cast("double").alias("value"))
    d, n = F.col("Delay_Minutes"), F.count(F.lit(1))
    median = F.lit(exact_quantile(a, "Delay_Minutes", 0.5))
    cell = lambda dim, key, v: F.struct(F.lit(dim).alias("dimension"), F.lit(key).alias("key"), v.cast("double").alias("value"))
    stats = a.agg(F.array(
        cell("delay", "mean", F.avg(d)), cell("delay", "median", F.max(median)), cell("delay", "max", F.max(d)), cell("delay", "std", F.stddev_samp(d)),
        cell("rate", "peak_hour", F.try_divide(F.count_if(F.col("Is_Peak_Hour_I") == 1) * 100.0, n)),
        cell("rate", "congestion", F.try_divide(F.count_if(F.col("High_Congestion") == 1) * 100.0, n))).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return counts.unionByName(stats)


def feature_importance_corr(df: DataFrame, features: list[str]) -> DataFrame:
    """|correlation| of each feature with |decision|, highest first."""
    s = F.abs(F.col("decision"))

    def corr(x):
        return F.try_divide(F.covar_pop(x, s), F.stddev_pop(x) * F.stddev_pop(s))

    row = df.agg(*[F.coalesce(F.abs(corr(F.col(c).cast("double"))), F.lit(0.0)).alias(c) for c in features])
    stack = ", ".join(f"'{c}', `{c}`" for c in features)
    return row.selectExpr(f"stack({len(features)}, {stack}) as (feature, importance)").orderBy(F.desc("importance"), "feature")


# J09 / M17 ----------------------------------------------------------------------
def spread_grid(points: DataFrame, eps: float, dims: int, most: int = 4) -> tuple[int, ...]:
    """Positions of the continuous columns to block on: the columns with the most cells of width eps come first, and as many
    of them as make copies to neighbouring cells plus candidate pairs least (figures of one aggregate a choice)."""
    if not dims:
        return ()
    cell = lambda i: F.floor(F.col("v")[i] / eps)
    spread = points.agg(*[F.approx_count_distinct(cell(i)) for i in range(dims)]).first()
    order = sorted(range(dims), key=lambda i: (-spread[i], i))
    best, cost = (), None
    for k in range(1, min(dims, most) + 1):
        per = points.groupBy("key", *[cell(i).alias(f"__{i}") for i in order[:k]]).agg(F.count(F.lit(1)).cast("double").alias("n"))
        n, pairs = per.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()
        c = 3**k * n + 3 * pairs
        if cost is None or c < cost:
            best, cost = tuple(order[:k]), c
    return best


def eps_neighbours(points: DataFrame, eps: float, grid: tuple[int, ...] = (0, 1)) -> DataFrame:
    """All (a, b) pairs (a != b allowed equal-position duplicates collapsed upstream) with ||v_a - v_b|| <= eps.

    ``points``: (pid, key, v array<double>, w).  Exact blocking: rows with a
    different ``key`` (the tuple of binary features) are > eps apart; inside a
    key, candidates come from the neighbouring grid cells of width eps
    on the continuous dimensions of ``grid``, then the full distance is checked.
    """
    cells = F.array(*[F.floor(F.col("v")[i] / eps).cast("long") for i in grid]) if grid else F.array().cast("array<bigint>")
    p = points.withColumn("cell", cells)
    steps = [F.array(*[F.lit(x).cast("long") for x in o]) if o else F.array().cast("array<bigint>") for o in product((-1, 0, 1), repeat=len(grid))]
    q = p.select(F.col("pid").alias("qid"), "key", F.col("v").alias("qv"), F.col("w").alias("qw"), "cell", F.explode(F.array(*steps)).alias("o"))
    q = q.select("qid", "key", "qv", "qw", F.zip_with("cell", "o", lambda a, b: a + b).alias("cell"))
    cand = p.join(q, ["key", "cell"])
    d2 = F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return cand.where(d2 <= eps * eps).select("pid", "qid", "qw")


#: Points of one key that are compared in one block; a larger key is cut by its most spread columns.
DBSCAN_BLOCK = 4096
#: Width of a block in eps: a point is copied to the next block if it lies within eps of it.
DBSCAN_WIDE = 4
#: Distances held at once by a task.
DBSCAN_HELD = 2_000_000
#: Points of a leaf of a block's tree: leaves wholly beyond or wholly within eps of each other are settled by their boxes.
DBSCAN_LEAF = 64


def spread_order(points: DataFrame, eps: float, dims: int, most: int = 4) -> list[int]:
    """The ``most`` continuous columns with the most cells of width eps."""
    if not dims:
        return []
    spread = points.agg(*[F.approx_count_distinct(F.floor(F.col("v")[i] / eps)) for i in range(dims)]).first()
    return sorted(range(dims), key=lambda i: (-spread[i], i))[:most]


def eps_blocks(points: DataFrame, eps: float, order: list[int]) -> DataFrame:
    """``points`` (key, v, ...) with ``block`` and ``own``: a point once in its own block and once in every block within eps.

    Small keys are one block.  Larger keys are cut along the columns of
    ``order``, one more for every fourfold size, so that all points within eps
    of a block's own points are in the block.
    """
    sizes = points.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    deep = F.least(F.lit(len(order)), F.greatest(F.lit(0), F.ceil(F.log(4.0, F.col("__n") / float(DBSCAN_BLOCK))).cast("int")))
    p = points.join(sizes.select("key", deep.alias("__deep")), "key").withColumns({"block": F.array().cast("array<bigint>"), "own": F.lit(True)})
    wide, near = DBSCAN_WIDE * eps, eps * (1 + 1e-9)
    for j, i in enumerate(order):
        x = F.col("v")[i]
        c = F.floor(x / wide)
        cells = F.array(c, F.when(x - c * wide <= near, c - 1), F.when((c + 1) * wide - x <= near, c + 1))
        cells = F.when(F.col("__deep") > j, F.filter(cells, lambda y: y.isNotNull())).otherwise(F.array(F.lit(0).cast("long")))
        p = p.withColumn("__c", F.explode(cells))
        p = p.withColumns({"block": F.concat("block", F.array("__c")), "own": F.col("own") & ((F.col("__deep") <= j) | (F.col("__c") == c))})
    return p.drop("__c", "__deep")


class _Leaves:
    """Rows of ``x`` dealt into leaves of at most ``DBSCAN_LEAF`` with the box of each: halves along the widest column, cut at a gap.

    ``order`` lists the rows leaf by leaf, leaf i is ``order[start[i]:stop[i]]``.
    """

    def __init__(self, x: np.ndarray):
        order, stops, todo = np.arange(len(x)), [], [(0, len(x))] if len(x) else []
        while todo:
            lo, hi = todo.pop()
            n = hi - lo
            if n > DBSCAN_LEAF and x.shape[1]:
                rows = order[lo:hi]
                y = x[rows]
                line = y[:, int(np.argmax(y.max(axis=0) - y.min(axis=0)))]
                by = np.argsort(line, kind="stable")
                line = line[by]
                near = slice(n // 4, n - n // 4)
                cut = n // 4 + int(np.argmax(line[near] - line[near.start - 1:near.stop - 1]))
                order[lo:hi] = rows[by]
                todo += [(lo + cut, hi), (lo, lo + cut)]
            else:
                stops.append(hi)
        self.order, self.x, self.stop = order, x[order], np.array(stops, dtype=int)
        self.start = np.append(0, self.stop[:-1]).astype(int) if stops else self.stop
        self.low, self.high = (f.reduceat(self.x, self.start, axis=0) if stops else self.x for f in (np.minimum, np.maximum))

    def around(self, low: np.ndarray, high: np.ndarray, eps: float, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Leaves from ``least`` on: those whose every point lies within eps of every point of the box, and the others within eps
        of it, the nearest first."""
        a, b = self.low[least:], self.high[least:]
        gap = (np.maximum(np.maximum(a - high, low - b), 0.0) ** 2).sum(axis=1)
        far = (np.maximum(high - a, b - low) ** 2).sum(axis=1)
        whole = far <= eps * eps * (1 - 1e-9)
        some = np.where(~whole & (gap <= eps * eps * (1 + 1e-9)))[0]
        return np.where(whole)[0] + least, some[np.argsort(gap[some], kind="stable")] + least

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        """Places in ``order`` of the points of the leaves."""
        n = self.stop[leaves] - self.start[leaves]
        return np.arange(n.sum()) + np.repeat(self.start[leaves] - np.cumsum(n) + n, n)

    def pieces(self, leaves: np.ndarray, against: int):
        """The points of the leaves in pieces that grow, as far as ``DBSCAN_HELD`` distances to ``against`` points allow."""
        at, take = 0, 8
        most = max(1, DBSCAN_HELD // (max(1, against) * DBSCAN_LEAF))
        while at < len(leaves):
            yield self.rows(leaves[at:at + min(take, most)])
            at, take = at + min(take, most), take * 2

    def reached(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, eps: float) -> np.ndarray:
        """Which of the points lie within eps of the box."""
        y = self.x[rows]
        return (np.maximum(np.maximum(y - high, low - y), 0.0) ** 2).sum(axis=1) <= eps * eps * (1 + 1e-9)


def _close(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    d2 = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d2 += (a[:, k, None] - b[None, :, k]) ** 2
    return d2 <= eps * eps


def _varied(x: np.ndarray) -> np.ndarray:
    """The columns that tell points apart; a constant one adds nothing to a distance."""
    return x[:, (x != x[:1]).any(axis=0)]


def _vectors(t) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def _count_near(eps: float, enough: int):
    """The neighbours of a block's own points, counted until there are enough."""
    def run(t):
        import pyarrow as pa

        x, w, own = _vectors(t), t.column("w").to_numpy(), t.column("own").to_numpy()
        real = np.where(~np.isnan(x).any(axis=1))[0]  # a point without a place is near none
        tree = _Leaves(_varied(x[real]))
        w, asks, n = w[real][tree.order], own[real][tree.order], np.zeros(len(real), dtype=np.int64)
        for i in range(len(tree.start)):
            todo = np.arange(tree.start[i], tree.stop[i])
            todo = todo[asks[todo]]
            if not len(todo):
                continue
            low, high = tree.x[todo].min(axis=0), tree.x[todo].max(axis=0)
            whole, some = tree.around(low, high, eps)
            n[todo] = w[tree.rows(whole)].sum()
            for at in tree.pieces(some, len(todo)):
                todo = todo[n[todo] < enough]
                if not len(todo):
                    break
                at = at[tree.reached(at, low, high, eps)]
                n[todo] += np.where(_close(tree.x[todo], tree.x[at], eps), w[at], 0).sum(axis=1)
        out = np.zeros(len(x), dtype=np.int64)
        out[real[tree.order]] = n
        return pa.table({"pid": t.column("pid").filter(pa.array(own)), "n": out[own]})

    return run


def _joined(tree: _Leaves, name: np.ndarray, eps: float) -> np.ndarray:
    """The cluster of every point of a tree: the least of the numbers ``name`` of the points that chains of steps within eps reach.

    Leaves whose points are all within eps of each other join without a
    distance; points that are in one cluster already are not compared.
    """
    parent = np.arange(len(name))

    def roots(i):
        r = parent[i]
        while True:
            up = parent[r]
            if (up == r).all():
                parent[i] = r
                return r
            r = up

    def join(some):
        some = np.unique(roots(some))
        parent[some] = some[0]

    for i in range(len(tree.start)):
        own, low, high = np.arange(tree.start[i], tree.stop[i]), tree.low[i], tree.high[i]
        whole, some = tree.around(low, high, eps, i)
        if len(whole):
            join(np.append(name[own], name[tree.rows(whole)]))
        for at in tree.pieces(some, len(own)):
            mine, theirs = roots(name[own]), roots(name[at])
            if (mine == mine[0]).all():
                at, theirs = at[theirs != mine[0]], theirs[theirs != mine[0]]
            keep = tree.reached(at, low, high, eps)
            at, theirs = at[keep], theirs[keep]
            if not len(at):
                continue
            mask = _close(tree.x[own], tree.x[at], eps)
            for r in np.unique(mine):
                met = theirs[mask[mine == r].any(axis=0)]
                if len(met):
                    join(np.append(met, r))
    return roots(np.arange(len(name)))


def _link_near(eps: float):
    """The clusters inside a block: (pid, root) for its core points, and for its own other points every root within eps."""
    def run(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        x, own, core, pid = _vectors(t), t.column("own").to_numpy(), t.column("core").to_numpy(), t.column("pid").combine_chunks()
        real = ~np.isnan(x).any(axis=1)
        x = _varied(x) if real.all() else x
        at = np.where(core & real)[0]
        at = at[pc.sort_indices(pid.take(pa.array(at))).to_numpy()]  # core points in the order of their ids: a root is the least
        tree = _Leaves(x[at])
        root, border = _joined(tree, tree.order, eps), [np.zeros((0, 2), dtype=int)]
        rest = np.where(~core & own & real)[0]
        asks = _Leaves(x[rest])
        for i in range(len(asks.start)):
            ask, low, high = np.arange(asks.start[i], asks.stop[i]), asks.low[i], asks.high[i]
            whole, some = tree.around(low, high, eps)
            for there in tree.pieces(np.append(whole, some), len(ask)):
                there = there[tree.reached(there, low, high, eps)]
                j, k = np.nonzero(_close(asks.x[ask], tree.x[there], eps))
                border.append(np.unique(np.column_stack([rest[asks.order[ask[j]]], root[tree.order[there[k]]]]), axis=0))
        found = np.unique(np.concatenate(border), axis=0)
        named = lambda rows: pid.take(pa.array(rows.astype(np.int64)))
        return pa.table({"pid": pa.concat_arrays([named(at), named(found[:, 0])]), "root": pa.concat_arrays([named(at[root]), named(at[found[:, 1]])]),
                         "core": pa.array(np.arange(len(at) + len(found)) < len(at))})

    return run


def dbscan(df: DataFrame, features: list[str], binary: list[str], key: str = "Flight_ID", eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """DBSCAN on population-standardised features: (key, DBSCAN_Cluster, DBSCAN_Anomaly).

    Identical vectors are collapsed with a multiplicity first; core points have
    >= min_samples neighbours (self included).  Points are compared block by
    block (``eps_blocks``) and a block hands on counts, then the root of every
    core point's cluster inside the block and the roots next to its border
    points, never a pair; clusters of blocks that share a core point are joined
    by contraction until no edge is left; a border point takes the smallest
    adjacent cluster label; the rest is noise (-1).
    """
    from tarmac.session import cut_lineage
    from tarmac.sources.ingest import dense_index

    cont = [c for c in features if c not in binary]
    z = standard_scale(df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]), cont)
    # the binary columns are equal inside a key, so distances are over the continuous ones
    z = z.select(F.col(key).cast("string").alias("id"), F.col(key), F.array(*[F.col(f"{c}_z") for c in cont]).cast("array<double>").alias("v"),
                 F.concat_ws("|", *[F.col(c).cast("long").cast("string") for c in binary]).alias("key"))
    with wide_rows(df.sparkSession):
        z = cut_lineage(z)
    pts = cut_lineage(z.groupBy("v", "key").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("pid")))
    order = spread_order(pts, eps, len(cont))
    n = eps_blocks(pts, eps, order).select("key", "block", "pid", "w", "own", "v").groupBy("key", "block").applyInArrow(
        _count_near(eps, min_samples), "pid string, n long")
    core = cut_lineage(n.groupBy("pid").agg(F.sum("n").alias("n")).where((F.col("n") >= min_samples) & F.col("pid").isNotNull()).select("pid"))
    known = pts.join(core.withColumn("core", F.lit(True)), "pid", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    links = eps_blocks(known, eps, order).select("key", "block", "pid", "own", "core", "v").groupBy("key", "block").applyInArrow(
        _link_near(eps), "pid string, root string, core boolean")
    links = cut_lineage(links.where(F.col("pid").isNotNull()))
    several = links.where("core").groupBy("pid").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.collect_set("root").alias("roots")).where("a < z")
    joined = cut_lineage(several.select("a", F.explode("roots").alias("b")).where("a < b").distinct())
    roots = components(joined)
    least = roots.groupBy("root").agg(F.min("node").alias("label"))
    named = roots.join(least, "root").select(F.col("node").alias("root"), "label")
    lab = links.join(named, "root", "left").groupBy("pid").agg(F.min(F.coalesce("label", "root")).alias("lbl"))
    labels = cut_lineage(pts.select("pid", "v", "key").join(lab, "pid").select("v", "key", "lbl"))
    # dense cluster ids in label order, by range partitions and the counts before them
    ids = dense_index(labels.select("lbl").distinct(), ["lbl"], "DBSCAN_Cluster")
    ids = ids.select("lbl", F.col("DBSCAN_Cluster").cast("int").alias("DBSCAN_Cluster"))
    out = z.join(labels.join(ids, "lbl").select("v", "key", "DBSCAN_Cluster"), ["v", "key"], "left")
    return out.select(key, F.coalesce("DBSCAN_Cluster", F.lit(-1)).alias("DBSCAN_Cluster"),
                      F.col("DBSCAN_Cluster").isNull().alias("DBSCAN_Anomaly"))


# M20
def ensemble(iforest: DataFrame, db: DataFrame, key: str = "Flight_ID") -> DataFrame:
    x = iforest.join(db, key)
    return x.withColumn("Combined_Anomaly", F.col("is_anomaly") | F.col("DBSCAN_Anomaly")).withColumn("Anomaly_Confidence", F.abs("decision"))


def ensemble_summary(x: DataFrame) -> DataFrame:
    return x.agg(F.count(F.lit(1)).alias("total_samples"), F.count_if("is_anomaly").alias("isolation_anomalies"),
                 F.count_if("DBSCAN_Anomaly").alias("dbscan_anomalies"), F.count_if("Combined_Anomaly").alias("combined_anomalies"),
                 (F.avg(F.col("Combined_Anomaly").cast("double")) * 100).alias("anomaly_rate"),
                 F.countDistinct(F.when(F.col("DBSCAN_Cluster") >= 0, F.col("DBSCAN_Cluster"))).alias("unique_clusters"))


# M07 / M10
def best_model_predictions(df: DataFrame, kinds=("rf", "gbt")) -> DataFrame:
    """Fit each model on the 70/30 split, keep the lowest test MAE, predict all flights (clipped at 0),
    error and risk score = .7 * prediction + .3 * error."""
    tr, te = split(df, 0.7)
    best = None
    for kind in kinds:
        m = train_delay(tr, kind)
        mae = regression_metrics(m.transform(spread(te))).first()["MAE"]  # one scalar per model
        if best is None or mae < best[0]:
            best = (mae, kind, m)
    p = predict_delay(best[2], df)
    err = F.abs(F.col("Delay_Minutes") - F.col("Predicted_Delay"))
    return p.withColumn("Model", F.lit(best[1])).withColumn("Prediction_Error", err).withColumn(
        "Risk_Score", F.col("Predicted_Delay") * 0.7 + err * 0.3)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# A50 (peak rules) / A51 / A54 -- over the clustered hour x weekday table (M14)
def peak_recommendations(clustered: DataFrame) -> DataFrame:
    """Per hour: super-peak hours with mean count > 25 -> redistribute 20 %; mean delay > 15 -> capacity;
    low-traffic hours with mean count < 10 -> utilisation.  Sorted by priority, hour."""
    by_hour = clustered.groupBy("Hour").agg(F.avg("Flight_Count").alias("f"), F.avg("Avg_Delay").alias("d"),
                                            F.bool_or(F.col("Peak_Tier") == "Super Peak").alias("super"), F.bool_or(F.col("Peak_Tier") == "Low Traffic").alias("low"))
    sp = by_hour.where("super")
    r1 = sp.where(F.col("f") > 25).select("Hour", F.lit("redistribution").alias("type"), F.lit("high").alias("severity"), F.lit(1).alias("priority"),
                                          F.floor(F.col("f") * 0.2).alias("flights_to_move"), (F.col("d") * 0.15).alias("expected_reduction"))
    r2 = sp.where(F.col("d") > 15).select("Hour", F.lit("capacity").alias("type"), F.lit("medium").alias("severity"), F.lit(2).alias("priority"),
                                          F.lit(None).cast("long").alias("flights_to_move"), (F.col("d") * 0.25).alias("expected_reduction"))
    lt = by_hour.where(F.col("low") & (F.col("f") < 10))
    r3 = lt.select("Hour", F.lit("utilization").alias("type"), F.lit("low").alias("severity"), F.lit(3).alias("priority"),
                   F.round(20 - F.col("f")).cast("long").alias("flights_to_move"), F.lit(None).cast("double").alias("expected_reduction"))
    return r1.unionByName(r2).unionByName(r3).orderBy("priority", "Hour")


def recommendation_counts(recommendations: DataFrame) -> DataFrame:
    return recommendations.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def optimisation_opportunities(clustered: DataFrame) -> DataFrame:
    sp = F.col("Peak_Tier") == "Super Peak"
    lt = F.col("Peak_Tier") == "Low Traffic"
    o = clustered.agg(
        (F.sum(F.when(sp, F.col("Flight_Count"))) * 0.2).alias("excess"),
        F.sum(F.when(lt, 20 - F.col("Flight_Count"))).alias("available"),
        F.avg("Avg_Delay").alias("current_avg_delay"),
        (F.avg(F.when(sp, F.col("Avg_Delay"))) * 0.25).alias("potential_delay_reduction"),
        F.sum("Flight_Count").alias("throughput"),
        F.countDistinct(F.when(sp, F.col("Hour"))).alias("peak_hours_count"))
    o = o.withColumn("redistribution_feasible", F.least(F.coalesce("excess", F.lit(0.0)), F.coalesce("available", F.lit(0.0))))
    o = o.withColumn("delay_improvement_pct", F.col("potential_delay_reduction") / F.col("current_avg_delay") * 100)
    o = o.withColumn("throughput_improvement_pct", F.col("redistribution_feasible") / F.col("throughput") * 100)
    return o.withColumn("optimization_score", F.least(F.lit(95.0), (F.col("potential_delay_reduction") / F.col("current_avg_delay")
                                                                     + F.col("throughput_improvement_pct") / 100) * 50)).drop("excess", "available")


def hourly_rollup(clustered: DataFrame) -> DataFrame:
    from tarmac.operators.windows import modal_value

    h = clustered.groupBy("Hour").agg(F.avg("Flight_Count").alias("Flight_Count"), F.avg("Avg_Delay").alias("Avg_Delay"))
    return h.join(modal_value(clustered, ["Hour"], "Peak_Tier", "Peak_Tier"), "Hour")
