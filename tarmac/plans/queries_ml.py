"""Registered queries for the ML operators (M*, A49, A52, A53)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import kpi
from tarmac.operators import ml as M
from tarmac.plans.catalog import register
from tarmac.plans.sql_views import with_views
from tarmac.session import cut_lineage
from tarmac.sources.fixtures import flights


@register("m01_delay_features", sql=with_views("""SELECT Flight_ID, month(Scheduled_Time) AS Month, CAST(Day_of_Week IN (5,6) AS BIGINT) AS Is_Weekend,
  CAST(Hour IN (6,7,8,9) AS BIGINT) AS Is_Morning_Peak, CAST(Hour IN (18,19,20,21) AS BIGINT) AS Is_Evening_Peak,
  CAST(Hour IN (22,23,0,1,2,3,4,5) AS BIGINT) AS Is_Night,
  CASE Peak_Category WHEN 'super_peak' THEN 4 WHEN 'peak' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 2 END AS Peak_Category_Numeric,
  CAST(Origin IN ('BOM','DEL') AS BIGINT) AS Is_Congested_Airport,
  count(*) OVER (PARTITION BY Origin, Hour) / Runway_Capacity AS Runway_Utilization,
  CAST(Is_High_Impact AS BIGINT) AS Is_High_Impact_Int, CAST(Capacity > 250 AS BIGINT) AS Is_Large_Aircraft,
  CASE WHEN Capacity > 0 AND Capacity <= 150 THEN 'Small' WHEN Capacity > 150 AND Capacity <= 200 THEN 'Medium'
       WHEN Capacity > 200 AND Capacity <= 250 THEN 'Large' WHEN Capacity > 250 AND Capacity <= 350 THEN 'XLarge' END AS Capacity_Category
FROM flights"""), floats=("Runway_Utilization",),
          ints=("Month", "Is_Weekend", "Is_Morning_Peak", "Is_Evening_Peak", "Is_Night", "Peak_Category_Numeric", "Is_Congested_Airport",
                "Is_High_Impact_Int", "Is_Large_Aircraft"))
def m01(spark, sf):
    return M.delay_features(flights(spark, sf)).select(
        "Flight_ID", "Month", "Is_Weekend", "Is_Morning_Peak", "Is_Evening_Peak", "Is_Night", "Peak_Category_Numeric",
        "Is_Congested_Airport", "Runway_Utilization", "Is_High_Impact_Int", "Is_Large_Aircraft", "Capacity_Category")


@register("m03_split")
def m03(spark, sf):
    """Hash split: per (part, delayed) stratum row counts."""
    f = flights(spark, sf)
    tr, te = M.split(f)
    s = tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))
    return s.groupBy("part", (F.col("Delay_Minutes") > 0).alias("delayed")).agg(F.count(F.lit(1)).alias("n"))


def _rf_predictions(spark, sf, kind="rf"):
    f = M.delay_features(flights(spark, sf))
    tr, _ = M.split(f)
    model = M.train_delay(tr, kind)
    return model, f, M.predict_delay(model, f)


@register("m04_random_forest")
def m04(spark, sf):
    """Random forest (100 trees, depth 10) trained on the 80 % split, predictions for all flights."""
    return _rf_predictions(spark, sf)[2].select("Flight_ID", "Delay_Minutes", "Predicted_Delay", "Predicted_Late")


@register("m05_gbt")
def m05(spark, sf):
    """Gradient-boosted trees (100 iterations, depth 6, step .1)."""
    return _rf_predictions(spark, sf, "gbt")[2].select("Flight_ID", "Delay_Minutes", "Predicted_Delay", "Predicted_Late")


@register("m06_regression_metrics")
def m06(spark, sf):
    f = M.delay_features(flights(spark, sf))
    tr, te = M.split(f)
    model = M.train_delay(tr, "rf")
    return M.regression_metrics(model.transform(M.spread(te)))


@register("m09_importance")
def m09(spark, sf):
    model, f, _ = _rf_predictions(spark, sf)
    return M.importance(model, f)


@register("m11_standard_scale", sql=with_views("""SELECT Flight_ID,
  coalesce((Delay_Minutes - avg(Delay_Minutes) OVER ()) / nullif(stddev_pop(Delay_Minutes) OVER (), 0), 0.0) AS Delay_Minutes_z,
  coalesce((Capacity - avg(Capacity) OVER ()) / nullif(stddev_pop(Capacity) OVER (), 0), 0.0) AS Capacity_z FROM flights"""),
          floats=("Delay_Minutes_z", "Capacity_z"))
def m11(spark, sf):
    return M.standard_scale(flights(spark, sf), ["Delay_Minutes", "Capacity"]).select("Flight_ID", "Delay_Minutes_z", "Capacity_z")


@register("m12_risk_heatmap")
def m12(spark, sf):
    return M.risk_heatmap(_rf_predictions(spark, sf)[2])


@register("m13_ml_risk")
def m13(spark, sf):
    return M.ml_risk(_rf_predictions(spark, sf)[2])


@register("a53_risk_distribution")
def a53(spark, sf):
    return M.ml_risk(_rf_predictions(spark, sf)[2]).groupBy("Risk_Level").agg(F.count(F.lit(1)).alias("count"))


@register("m14_peak_clusters")
def m14(spark, sf):
    """K-means (k=4) on the hour x weekday congestion table; tiers by mean congestion."""
    return M.peak_clusters(kpi.hour_dow_stats(flights(spark, sf)))


@register("m16_flight_clusters")
def m16(spark, sf):
    return M.flight_clusters(flights(spark, sf))


def _features(spark, sf):
    f = flights(spark, sf)
    return M.anomaly_features(f).withColumns(M.name_flags(f))


FEATURES_SQL = """ft AS (SELECT *, month(Scheduled_Time) AS Month, dayofyear(Scheduled_Time) AS Day_of_Year, CAST(Delay_Minutes > 0 AS BIGINT) AS Is_Delayed,
  Capacity / max(Capacity) OVER () AS Capacity_Utilization, CAST(Hour IN (7,8,9,18,19,20) AS BIGINT) AS Is_Peak_Hour_I,
  CAST(Day_of_Week IN (5,6) AS BIGINT) AS Is_Weekend, CAST(Congestion_Factor > 1.5 AS BIGINT) AS High_Congestion,
  avg(Delay_Minutes) OVER w AS Rolling_Delay_Mean, coalesce(stddev_samp(Delay_Minutes) OVER w, 0.0) AS Rolling_Delay_Std,
  count(*) OVER (PARTITION BY Hour) AS Hourly_Traffic_Density, count(*) OVER (PARTITION BY Runway, Hour) AS Runway_Utilization,
  CAST(left(Aircraft_Type, 4) IN ('A330','A350','A380','B747','B767','B777','B787') AS BIGINT) AS Is_Wide_Body
FROM flights WINDOW w AS (ORDER BY Scheduled_Time, Flight_ID ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
#: A score that SQL can express stands in for the detectors: the z-score of the delay, flagged above 1.
SCORED_SQL = [FEATURES_SQL, """sc AS (SELECT *, decision > 1 AS Combined_Anomaly, abs(decision) AS Anomaly_Confidence
FROM (SELECT *, (Delay_Minutes - avg(Delay_Minutes) OVER ()) / stddev_pop(Delay_Minutes) OVER () AS decision FROM ft) z)""",
              """ty AS (SELECT *, CASE WHEN NOT Combined_Anomaly THEN 'Normal' WHEN Delay_Minutes > 60 THEN 'Severe Delay'
  WHEN High_Congestion = 1 THEN 'Congestion Anomaly' WHEN Is_Peak_Hour_I = 1 AND Delay_Minutes > 30 THEN 'Peak Hour Disruption'
  WHEN Runway_Utilization > (SELECT quantile_cont(Runway_Utilization, 0.95) FROM sc) THEN 'Runway Overutilization'
  WHEN Capacity > (SELECT quantile_cont(Capacity, 0.95) FROM sc) THEN 'Large Aircraft Anomaly' ELSE 'General Anomaly' END AS Anomaly_Type FROM sc)"""]


def _scored(spark, sf):
    f = M.anomaly_features(flights(spark, sf))
    m = f.agg(F.avg("Delay_Minutes").alias("__m"), F.stddev_pop("Delay_Minutes").alias("__s"))
    f = f.crossJoin(F.broadcast(m)).withColumn("decision", (F.col("Delay_Minutes") - F.col("__m")) / F.col("__s")).drop("__m", "__s")
    return f.withColumn("Combined_Anomaly", F.col("decision") > 1).withColumn("Anomaly_Confidence", F.abs("decision"))


@register("m18_anomaly_features", sql=with_views(f"SELECT Flight_ID, {', '.join(M.ANOMALY_NUMERIC)}, Is_Wide_Body FROM ft", FEATURES_SQL),
          floats=("Delay_Minutes", "Capacity_Utilization", "Congestion_Factor", "Rolling_Delay_Mean", "Rolling_Delay_Std"),
          ints=("Hour", "Day_of_Week", "Month", "Day_of_Year", "Is_Delayed", "Is_Peak_Hour_I", "Is_Weekend", "High_Congestion",
                "Hourly_Traffic_Density", "Runway_Utilization", "Is_Wide_Body"))
def m18(spark, sf):
    return M.anomaly_features(flights(spark, sf)).select("Flight_ID", *M.ANOMALY_NUMERIC, "Is_Wide_Body")


@register("m19_isolation_forest", bench=True)
def m19(spark, sf):
    """Isolation forest (100 trees x 256 samples, contamination .1): train + score every flight."""
    feat = _features(spark, sf)
    return M.isolation_forest(feat, M.anomaly_columns(feat), contamination=0.1)


@register("m21_anomaly_type", sql=with_views("SELECT Flight_ID, Combined_Anomaly, Anomaly_Type FROM ty", *SCORED_SQL))
def m21(spark, sf):
    return M.anomaly_type(_scored(spark, sf)).select("Flight_ID", "Combined_Anomaly", "Anomaly_Type")


ACTION_SQL = "CASE Anomaly_Type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.ACTIONS.items()) + " ELSE 'Monitor and investigate' END"


@register("m22_alerts", sql=with_views(f"""SELECT Flight_ID, Airline, Scheduled_Time, Runway, Anomaly_Type, Anomaly_Confidence AS confidence, Delay_Minutes,
  CASE WHEN Anomaly_Confidence > 1.5 OR Delay_Minutes > 60 OR Anomaly_Type = 'Severe Delay' THEN 'Critical'
       WHEN Anomaly_Confidence > 1.0 OR Delay_Minutes > 30 THEN 'High' WHEN Anomaly_Confidence > 0.5 OR Delay_Minutes > 15 THEN 'Medium' ELSE 'Low' END AS Severity,
  {ACTION_SQL} AS Recommended_Action
FROM ty WHERE Combined_Anomaly AND Anomaly_Confidence > (SELECT quantile_cont(Anomaly_Confidence, 0.8) FROM ty)""", *SCORED_SQL), floats=("confidence", "Delay_Minutes"))
def m22(spark, sf):
    return M.alerts(M.anomaly_type(_scored(spark, sf)))


@register("m23_detection_accuracy", sql=with_views("""SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1, (tp + tn) / total_predictions AS accuracy,
  (tp + tn) / total_predictions * 100 AS accuracy_percentage FROM (SELECT count(*) AS total_predictions,
  count_if(Delay_Minutes > 60 AND Combined_Anomaly) AS tp, count_if(Delay_Minutes <= 60 AND Combined_Anomaly) AS fp,
  count_if(Delay_Minutes > 60 AND NOT Combined_Anomaly) AS fn, count_if(Delay_Minutes <= 60 AND NOT Combined_Anomaly) AS tn FROM sc) c""", *SCORED_SQL[:2]),
          floats=("precision", "recall", "f1", "accuracy", "accuracy_percentage"), ints=("total_predictions", "tp", "fp", "fn", "tn"))
def m23(spark, sf):
    return M.detection_accuracy(_scored(spark, sf))


@register("a49_anomaly_patterns", sql=with_views("""SELECT dimension, key, CAST(count(*) AS DOUBLE) AS value FROM (
""" + " UNION ALL ".join(f"SELECT '{n}' AS dimension, CAST({n} AS VARCHAR) AS key FROM ty WHERE Combined_Anomaly"
                         for n in ("Hour", "Day_of_Week", "Month", "Runway", "Airline", "Aircraft_Type", "Anomaly_Type")) + """) d GROUP BY 1, 2
UNION ALL SELECT 'delay', 'mean', avg(Delay_Minutes) FROM ty WHERE Combined_Anomaly
UNION ALL SELECT 'delay', 'median', quantile_cont(Delay_Minutes, 0.5) FROM ty WHERE Combined_Anomaly
UNION ALL SELECT 'delay', 'max', max(Delay_Minutes) FROM ty WHERE Combined_Anomaly
UNION ALL SELECT 'delay', 'std', stddev_samp(Delay_Minutes) FROM ty WHERE Combined_Anomaly
UNION ALL SELECT 'rate', 'peak_hour', count_if(Is_Peak_Hour_I = 1) / count(*) * 100 FROM ty WHERE Combined_Anomaly
UNION ALL SELECT 'rate', 'congestion', count_if(High_Congestion = 1) / count(*) * 100 FROM ty WHERE Combined_Anomaly""", *SCORED_SQL), floats=("value",))
def a49(spark, sf):
    return M.anomaly_patterns(M.anomaly_type(_scored(spark, sf)))


@register("a52_anomaly_feature_importance", sql=with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(abs(covar_pop({c}, abs(decision)) / nullif(stddev_pop({c}) * stddev_pop(abs(decision)), 0)), 0.0) AS importance FROM sc"
    for c in M.ANOMALY_NUMERIC), *SCORED_SQL[:2]), floats=("importance",))
def a52(spark, sf):
    return M.feature_importance_corr(_scored(spark, sf), M.ANOMALY_NUMERIC)


BINARY = ["Is_Delayed", "Is_Peak_Hour_I", "Is_Weekend", "High_Congestion"]


def _db(feat, cols):
    return M.dbscan(feat, cols, BINARY + [c for c in cols if c not in M.ANOMALY_NUMERIC])


#: What the rules after the detectors read besides the detectors' own columns.
REPORTED = ["Flight_ID", "Airline", "Scheduled_Time", "Runway", "Aircraft_Type", "Capacity"]


def _stored_features(spark, sf):
    """The features, stored once for both detectors, and the columns that they read."""
    feat = _features(spark, sf)
    cols = M.anomaly_columns(feat)
    return cut_lineage(feat.select(*REPORTED, *cols)), cols


@register("m17_dbscan")
def m17(spark, sf):
    """DBSCAN (eps .5, min 5) on standardised anomaly features; exact grid-blocked neighbour join."""
    feat = _features(spark, sf)
    return _db(feat, M.anomaly_columns(feat))


@register("m20_ensemble")
def m20(spark, sf):
    """Isolation forest OR DBSCAN noise, with the summary counts."""
    feat, cols = _stored_features(spark, sf)
    d = feat.select("Flight_ID").join(M.isolation_forest(feat, cols, contamination=0.1), "Flight_ID")
    return M.ensemble_summary(M.ensemble(d, _db(feat, cols)))


def _detected(spark, sf):
    """Every flight with the combined flag of both detectors, stored once, and the columns that they read."""
    feat, cols = _stored_features(spark, sf)
    d = feat.join(M.isolation_forest(feat, cols, contamination=0.1), "Flight_ID")
    return cut_lineage(M.ensemble(d, _db(feat, cols)), feat), cols


@register("m21d_detected_anomaly_type")
def m21d(spark, sf):
    """Type of every flight by the isolation forest OR DBSCAN noise."""
    return M.anomaly_type(_detected(spark, sf)[0]).select("Flight_ID", "is_anomaly", "DBSCAN_Anomaly", "Combined_Anomaly", "Anomaly_Type")


@register("m22d_detected_alerts")
def m22d(spark, sf):
    """Alerts on the flights that the detectors flag."""
    return M.alerts(M.anomaly_type(_detected(spark, sf)[0]))


@register("m23d_detected_accuracy")
def m23d(spark, sf):
    """Accuracy of the detectors against delays above 60 minutes."""
    return M.detection_accuracy(_detected(spark, sf)[0])


@register("a49d_detected_patterns")
def a49d(spark, sf):
    """Patterns of the flights that the detectors flag."""
    return M.anomaly_patterns(M.anomaly_type(_detected(spark, sf)[0]))


@register("a52d_detected_feature_importance")
def a52d(spark, sf):
    """Correlation of every column that the detectors read with the forest's |decision|."""
    d, cols = _detected(spark, sf)
    return M.feature_importance_corr(d, cols)


@register("m07_best_model")
def m07(spark, sf):
    """Random forest vs boosted trees on a 70/30 split; lowest MAE predicts every flight."""
    return M.best_model_predictions(M.delay_features(flights(spark, sf))).select(
        "Flight_ID", "Model", "Predicted_Delay", "Prediction_Error", "Risk_Score")


@register("m10_save_load_model")
def m10(spark, sf):
    """Train, save to the shared checkpoint folder, load back and predict."""
    import uuid

    from tarmac.session import ensure_checkpoint_dir

    model, f, _ = _rf_predictions(spark, sf)
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/models/delay-rf-{uuid.uuid4().hex}"
    M.save_model(model, path)
    return M.predict_delay(M.load_model(path), f).select("Flight_ID", "Predicted_Delay")


@register("m15_silhouette")
def m15(spark, sf):
    """Silhouette (squared Euclidean, Spark's scalable form) of the hourly k-means tiers."""
    from pyspark.ml.feature import VectorAssembler

    c = M.peak_clusters(kpi.hour_dow_stats(flights(spark, sf)))
    v = VectorAssembler(inputCols=["Flight_Count_z", "Avg_Delay_z", "Congestion_Score_z"], outputCol="features").transform(c)
    return spark.createDataFrame([(float(M.silhouette(v)),)], "silhouette double")


def _clustered(spark, sf):
    return M.peak_clusters(kpi.hour_dow_stats(flights(spark, sf)))


@register("a50b_peak_recommendations")
def a50b(spark, sf):
    """Redistribution / capacity / utilisation recommendations from the k-means peak tiers."""
    return M.peak_recommendations(_clustered(spark, sf))


@register("a54b_recommendation_counts")
def a54b(spark, sf):
    """Recommendations per type."""
    return M.recommendation_counts(M.peak_recommendations(_clustered(spark, sf)))


@register("a51_optimisation_opportunities")
def a51(spark, sf):
    return M.optimisation_opportunities(_clustered(spark, sf))


@register("a54_hourly_rollup")
def a54(spark, sf):
    """Hour roll-up of the clustered hour x weekday table: mean count, mean delay, modal tier."""
    return M.hourly_rollup(_clustered(spark, sf))


@register("f05_filter_risk")
def f05(spark, sf):
    """Risk filter on the ML risk table with the reference's defaults: all levels, confidence >= 70."""
    from tarmac.operators.filters import filter_risk

    return filter_risk(M.ml_risk(_rf_predictions(spark, sf)[2]), None, 70.0, conf_col="Model_Confidence")


@register("a53b_confidence_by_hour")
def a53b(spark, sf):
    """Mean model confidence by hour of the ML risk table."""
    return M.ml_risk(_rf_predictions(spark, sf)[2]).groupBy("Hour").agg(F.avg("Model_Confidence").alias("Model_Confidence"))


# The rules after a model, over predictions and tiers that SQL can express -------------------------------------------
#: Mean delay of the flight's hour and runway stands in for the model's prediction.
RISK_SQL = ["pr AS (SELECT *, avg(Delay_Minutes) OVER (PARTITION BY Hour, Runway) AS prediction FROM flights)", """g AS (SELECT Date, Hour,
  avg(greatest(prediction, 0)) AS Predicted_Avg_Delay, stddev_samp(greatest(prediction, 0)) AS Predicted_Delay_Std,
  max(greatest(prediction, 0)) AS Max_Predicted_Delay, avg(Delay_Minutes) AS Actual_Avg_Delay, count(*) AS Flight_Count,
  avg(greatest(prediction, 0) * 0.7 + abs(Delay_Minutes - greatest(prediction, 0)) * 0.3) AS Avg_Risk_Score,
  avg(abs(Delay_Minutes - greatest(prediction, 0))) AS Avg_Prediction_Error FROM pr GROUP BY Date, Hour)""",
            """k AS (SELECT *, Predicted_Avg_Delay * 0.4 + Predicted_Delay_Std * 0.2 + Avg_Risk_Score * 0.3
  + Flight_Count / max(Flight_Count) OVER () * 10 AS Delay_Risk FROM g)""",
            "qs AS (SELECT quantile_cont(Delay_Risk, [0.33, 0.66, 0.85]) AS q FROM k)",
            """mr AS (SELECT k.*, CASE WHEN Delay_Risk <= 0 THEN NULL WHEN Delay_Risk <= q[1] THEN 'Low' WHEN Delay_Risk <= q[2] THEN 'Medium'
  WHEN Delay_Risk <= q[3] THEN 'High' WHEN Delay_Risk > q[3] THEN 'Critical' END AS Risk_Level,
  least(100.0, greatest(0.0, 100 - Avg_Prediction_Error / greatest(Predicted_Avg_Delay, 1.0) * 100)) AS Model_Confidence FROM k, qs)"""]
RISK_FLOATS = ("Predicted_Avg_Delay", "Predicted_Delay_Std", "Max_Predicted_Delay", "Actual_Avg_Delay", "Avg_Risk_Score", "Avg_Prediction_Error",
               "Delay_Risk", "Model_Confidence")


def _hour_means(spark, sf):
    """Flights with the mean delay of their hour and runway as prediction; the small table of means is joined back."""
    f = flights(spark, sf)
    means = f.groupBy(F.col("Hour").alias("__h"), F.col("Runway").alias("__r")).agg(F.avg("Delay_Minutes").alias("prediction"))
    f = f.join(means, F.col("Hour").eqNullSafe(F.col("__h")) & F.col("Runway").eqNullSafe(F.col("__r"))).drop("__h", "__r")
    return f.withColumn("Predicted_Delay", F.greatest(F.col("prediction"), F.lit(0.0)))


@register("m12b_risk_heatmap_of_means", sql=with_views("""SELECT *, CASE WHEN Delay_Risk > 0 AND Delay_Risk <= 0.2 THEN 'Low'
  WHEN Delay_Risk > 0.2 AND Delay_Risk <= 0.4 THEN 'Medium' WHEN Delay_Risk > 0.4 AND Delay_Risk <= 0.6 THEN 'High'
  WHEN Delay_Risk > 0.6 AND Delay_Risk <= 1 THEN 'Critical' END AS Risk_Level FROM (SELECT Date, Hour,
  avg(CAST(prediction > 15 AS INT)) AS Delay_Risk, avg(prediction) AS Predicted_Delay, count(*) AS Flight_Count FROM pr GROUP BY Date, Hour) x""", RISK_SQL[0]),
          floats=("Delay_Risk", "Predicted_Delay"), ints=("Hour", "Flight_Count"))
def m12b(spark, sf):
    """Risk heat map over the mean delay of hour and runway as prediction."""
    return M.risk_heatmap(_hour_means(spark, sf))


@register("m13b_risk_table_of_means", sql=with_views("SELECT * FROM mr", *RISK_SQL), floats=RISK_FLOATS, ints=("Hour", "Flight_Count"))
def m13b(spark, sf):
    """Risk table over the mean delay of hour and runway as prediction."""
    return M.ml_risk(_hour_means(spark, sf))


@register("a53c_risk_distribution_of_means", sql=with_views("SELECT Risk_Level, count(*) AS count FROM mr GROUP BY Risk_Level", *RISK_SQL), ints=("count",))
def a53c(spark, sf):
    """Risk levels counted over the mean delay of hour and runway as prediction."""
    return M.ml_risk(_hour_means(spark, sf)).groupBy("Risk_Level").agg(F.count(F.lit(1)).alias("count"))


@register("f05b_high_risk_slots", sql=with_views("SELECT * FROM mr WHERE Risk_Level IN ('High', 'Critical') AND Model_Confidence >= 20", *RISK_SQL),
          floats=RISK_FLOATS, ints=("Hour", "Flight_Count"))
def f05b(spark, sf):
    """Risk filter: high and critical slots of confidence 20 or more, over the mean delay of hour and runway as prediction."""
    from tarmac.operators.filters import filter_risk

    return filter_risk(M.ml_risk(_hour_means(spark, sf)), ["High", "Critical"], 20.0, conf_col="Model_Confidence")


#: Quartiles of the congestion score stand in for the k-means tiers.
TIER_SQL = ["""hd AS (SELECT Hour, Day_of_Week, count(*) AS Flight_Count, avg(Delay_Minutes) AS Avg_Delay,
  count(*) * 0.4 + avg(Delay_Minutes) * 0.3 + count(*) / count(DISTINCT Runway) * 0.3 AS Congestion_Score FROM flights GROUP BY Hour, Day_of_Week)""",
            "tq AS (SELECT quantile_cont(Congestion_Score, [0.25, 0.5, 0.75]) AS q FROM hd)",
            """ti AS (SELECT hd.*, CASE WHEN Congestion_Score > q[3] THEN 'Super Peak' WHEN Congestion_Score > q[2] THEN 'Peak'
  WHEN Congestion_Score > q[1] THEN 'Moderate' ELSE 'Low Traffic' END AS Peak_Tier FROM hd, tq)"""]
RECS_SQL = ["bh AS (SELECT Hour, avg(Flight_Count) AS f, avg(Avg_Delay) AS d, bool_or(Peak_Tier = 'Super Peak') AS s, bool_or(Peak_Tier = 'Low Traffic') AS l FROM ti GROUP BY Hour)",
            """rc AS (SELECT Hour, 'redistribution' AS type, 'high' AS severity, 1 AS priority, CAST(floor(f * 0.2) AS BIGINT) AS flights_to_move,
  d * 0.15 AS expected_reduction FROM bh WHERE s AND f > 25
  UNION ALL SELECT Hour, 'capacity', 'medium', 2, NULL, d * 0.25 FROM bh WHERE s AND d > 15
  UNION ALL SELECT Hour, 'utilization', 'low', 3, CAST(round(20 - f) AS BIGINT), NULL FROM bh WHERE l AND f < 10)"""]


def _tiers(spark, sf):
    """The hour x weekday table (at most 168 rows) with quartile tiers of the congestion score."""
    h = kpi.hour_dow_stats(flights(spark, sf))
    cut = h.agg(*[F.percentile("Congestion_Score", x).alias(n) for n, x in (("__a", 0.25), ("__b", 0.5), ("__c", 0.75))])
    s = F.col("Congestion_Score")
    tier = F.when(s > F.col("__c"), "Super Peak").when(s > F.col("__b"), "Peak").when(s > F.col("__a"), "Moderate").otherwise("Low Traffic")
    return h.crossJoin(F.broadcast(cut)).withColumn("Peak_Tier", tier).drop("__a", "__b", "__c")


@register("a50d_tier_recommendations", sql=with_views("SELECT * FROM rc", *TIER_SQL, *RECS_SQL), floats=("expected_reduction",),
          ints=("Hour", "priority", "flights_to_move"))
def a50d(spark, sf):
    """Redistribution, capacity and utilisation recommendations from quartile tiers."""
    return M.peak_recommendations(_tiers(spark, sf))


@register("a54d_tier_recommendation_counts", sql=with_views("SELECT type, count(*) AS count FROM rc GROUP BY type", *TIER_SQL, *RECS_SQL), ints=("count",))
def a54d(spark, sf):
    """Recommendations per type, from quartile tiers."""
    return M.recommendation_counts(M.peak_recommendations(_tiers(spark, sf)))


@register("a51b_tier_opportunities", sql=with_views("""SELECT * EXCLUDE (excess, available), least(95.0, (potential_delay_reduction / current_avg_delay
  + throughput_improvement_pct / 100) * 50) AS optimization_score FROM (SELECT *, potential_delay_reduction / current_avg_delay * 100 AS delay_improvement_pct,
  redistribution_feasible / throughput * 100 AS throughput_improvement_pct FROM (SELECT *, least(coalesce(excess, 0), coalesce(available, 0)) AS redistribution_feasible
  FROM (SELECT sum(Flight_Count) FILTER (Peak_Tier = 'Super Peak') * 0.2 AS excess, sum(20 - Flight_Count) FILTER (Peak_Tier = 'Low Traffic') AS available,
  avg(Avg_Delay) AS current_avg_delay, avg(Avg_Delay) FILTER (Peak_Tier = 'Super Peak') * 0.25 AS potential_delay_reduction, sum(Flight_Count) AS throughput,
  count(DISTINCT Hour) FILTER (Peak_Tier = 'Super Peak') AS peak_hours_count FROM ti) a) b) c""", *TIER_SQL),
          floats=("current_avg_delay", "potential_delay_reduction", "redistribution_feasible", "delay_improvement_pct", "throughput_improvement_pct", "optimization_score"),
          ints=("throughput", "peak_hours_count"))
def a51b(spark, sf):
    """Optimisation opportunities from quartile tiers."""
    return M.optimisation_opportunities(_tiers(spark, sf))


@register("a54c_tier_rollup", sql=with_views("""SELECT Hour, avg(Flight_Count) AS Flight_Count, avg(Avg_Delay) AS Avg_Delay,
  (SELECT Peak_Tier FROM ti t WHERE t.Hour = ti.Hour GROUP BY Peak_Tier ORDER BY count(*) DESC, Peak_Tier LIMIT 1) AS Peak_Tier FROM ti GROUP BY Hour""", *TIER_SQL),
          floats=("Flight_Count", "Avg_Delay"), ints=("Hour",))
def a54c(spark, sf):
    """Hour roll-up with the modal quartile tier."""
    return M.hourly_rollup(_tiers(spark, sf))


@register("m15b_exact_silhouette", sql=with_views("""SELECT avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM (
  SELECT i, any_value(n) AS n, max(m) FILTER (own) AS a, min(m) FILTER (NOT own) AS b FROM (
    SELECT x.Hour * 10 + x.Day_of_Week AS i, x.Peak_Tier = y.Peak_Tier AS own, any_value(x.n) AS n,
      sum(sqrt((x.f - y.f) ** 2 + (x.d - y.d) ** 2 + (x.c - y.c) ** 2)) / (count(*) - CAST(x.Peak_Tier = y.Peak_Tier AS INT)) AS m
    FROM sp x, sp y GROUP BY x.Hour, x.Day_of_Week, x.Peak_Tier, y.Peak_Tier) g GROUP BY i) s""", *TIER_SQL,
    """sp AS (SELECT Hour, Day_of_Week, Peak_Tier, count(*) OVER (PARTITION BY Peak_Tier) AS n,
  (Flight_Count - avg(Flight_Count) OVER ()) / stddev_pop(Flight_Count) OVER () AS f, (Avg_Delay - avg(Avg_Delay) OVER ()) / stddev_pop(Avg_Delay) OVER () AS d,
  (Congestion_Score - avg(Congestion_Score) OVER ()) / stddev_pop(Congestion_Score) OVER () AS c FROM ti)"""), floats=("silhouette",))
def m15b(spark, sf):
    """Exact Euclidean silhouette of the hour x weekday table under quartile tiers."""
    cols = ["Flight_Count", "Avg_Delay", "Congestion_Score"]
    z = M.standard_scale(_tiers(spark, sf), cols)
    return M.exact_silhouette(z, [f"{c}_z" for c in cols], "Peak_Tier")
