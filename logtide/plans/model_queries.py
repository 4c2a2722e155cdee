"""Queries over features and the model: rolling counts, labels, scaling, forest, evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from logtide.functions import alerting as A
from logtide.operators import alerts as alerting
from logtide.operators import dedup, evaluate, features, iforest, scaler, stats, validate
from logtide.operators.quantiles import percentiles
from logtide.plans import inputs
from logtide.plans.registry import query
from logtide.plans.sqltext import ALERTS, KEYED, LABELLED, PROC, SCORED, flagged
from logtide.schemas import FEATURE_COLUMNS
from logtide.session import materialise, scratch_path
from logtide.sources import tables

# ---------------------------------------------------------------- features


def rolling_sql(seconds: int, select: str = "log_id, ", what: str = "count(*)") -> str:
    return f"""SELECT {select}{what} OVER (PARTITION BY service ORDER BY epoch_us(event_time)
    RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS request_count_last_60s FROM proc"""


@query("rolling_request_count", f"WITH {PROC} {rolling_sql(60)}")
def rolling_request_count(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir).select("log_id", "service", "event_time")
    return features.rolling_count(rows).select("log_id", "request_count_last_60s")


@query("rolling_request_count_6h", f"WITH {PROC} {rolling_sql(21_600)}")
def rolling_request_count_6h(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir).select("log_id", "service", "event_time")
    return features.rolling_count(rows, 21_600).select("log_id", "request_count_last_60s")


@query(
    "rolling_request_count_distinct",
    f"""WITH {PROC}, coarse AS (SELECT log_id, service, date_trunc('hour', event_time) AS t FROM proc),
  d AS (SELECT DISTINCT service, t FROM coarse),
  w AS (SELECT service, t, count(*) OVER (PARTITION BY service ORDER BY epoch_us(t)
    RANGE BETWEEN {21_600_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM d)
  SELECT log_id, n FROM coarse JOIN w USING (service, t)""",
)
def rolling_request_count_distinct(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir).select(
        "log_id", "service", F.date_trunc("hour", "event_time").alias("event_time")
    )
    return features.rolling_count(rows, 21_600, out="n", distinct_micros=True).select("log_id", "n")


LABEL_SQL = """labels AS (SELECT service, CAST(row_number() OVER (ORDER BY min(event_time), service) AS INTEGER)
  AS service_id FROM proc GROUP BY service)"""


@query("encode_services", f"WITH {PROC}, {LABEL_SQL} SELECT service, service_id FROM labels")
def encode_services(spark, sf_dir):
    return features.service_labels(inputs.processed(spark, sf_dir))


@query(
    "encode_new_services",
    f"""WITH {PROC}, known AS (SELECT DISTINCT service, CAST(split_part(service, '-', 2) AS INTEGER) + 5 AS service_id
    FROM proc WHERE user_id % 10 < 4),
  fresh AS (SELECT service, min(event_time) AS f FROM proc WHERE service NOT IN (SELECT service FROM known) GROUP BY 1)
  SELECT service, service_id FROM known UNION ALL
  SELECT service, CAST(row_number() OVER (ORDER BY f, service) + (SELECT max(service_id) FROM known) AS INTEGER)
  FROM fresh""",
)
def encode_new_services(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir)
    known = rows.filter("user_id % 10 < 4").select(
        "service", (F.element_at(F.split("service", "-"), 2).cast("int") + 5).alias("service_id")
    )
    return features.service_labels(rows, known.distinct())


BUCKET = """CASE WHEN error_code IS NULL THEN 0 WHEN error_code < 300 THEN 1 WHEN error_code < 400 THEN 2
  WHEN error_code < 500 THEN 3 ELSE 4 END"""
LEVEL = "CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 ELSE 4 END"
FEATURES = f"""{PROC}, {LABEL_SQL}, counted AS ({rolling_sql(60, "*, ")}),
  feats AS (SELECT log_id, event_id, event_type, level, service, CAST(hour(event_time) AS INTEGER) AS hour_of_day,
    response_time_ms, {BUCKET} AS error_code, {LEVEL} AS log_level_encoded, request_count_last_60s,
    service_id AS service_id_encoded FROM counted JOIN labels USING (service))"""


def _features(spark, sf_dir):
    return features.extract_features(inputs.processed(spark, sf_dir))


@query("extract_features", f"WITH {FEATURES} SELECT log_id, {', '.join(FEATURE_COLUMNS)} FROM feats")
def extract_features(spark, sf_dir):
    return _features(spark, sf_dir).select("log_id", "features.*")


@query(
    "validate_features",
    f"""WITH {FEATURES} SELECT log_id, CASE WHEN log_level_encoded = 2 THEN 'features'
  WHEN event_id % 2 = 0 AND error_code = 4 THEN 'error_code'
  WHEN event_id % 2 = 0 THEN NULL WHEN hour_of_day > 20 THEN 'hour_of_day' END AS reason FROM feats""",
)
def validate_features(spark, sf_dir):
    f = F.col("features")
    bent = F.when(f["log_level_encoded"] != 2, f.withField("error_code", F.when(
        (F.col("event_id") % 2 == 0) & (f["error_code"] == 4), 9).otherwise(f["error_code"])
    ).withField("hour_of_day", F.when(
        (F.col("event_id") % 2 == 1) & (f["hour_of_day"] > 20), 30).otherwise(f["hour_of_day"])))
    rows = _features(spark, sf_dir).withColumn("features", bent)
    return validate.validate_features(rows).select("log_id", "reason")


@query(
    "score_inputs",
    f"""WITH {FEATURES} SELECT log_id, hour_of_day, least(response_time_ms * 1000, 300000.0) AS response_time_ms,
  error_code, CASE WHEN error_code = 1 THEN 1 ELSE log_level_encoded END AS log_level_encoded, request_count_last_60s,
  service_id_encoded FROM feats WHERE log_level_encoded <> 4""",
)
def score_inputs(spark, sf_dir):
    f = F.col("features")
    holes = F.when(f["log_level_encoded"] != 4, f.withField("response_time_ms", f["response_time_ms"] * 1000)
                   .withField("log_level_encoded", F.when(f["error_code"] != 1, f["log_level_encoded"])))
    rows = _features(spark, sf_dir).withColumn("features", holes)
    return validate.score_inputs(rows).select("log_id", "features.*")


@query(
    "impute_for_scoring",
    f"""WITH {PROC}, holes AS (SELECT *, CASE WHEN k % 3 <> 0 THEN response_time_ms END AS r,
    CASE WHEN k % 5 <> 0 THEN error_code END AS c FROM proc),
  full_rows AS (SELECT *, coalesce(r, CASE WHEN level = 'ERROR' THEN 4500.0 ELSE 120.0 END) AS rr,
    coalesce(c, CASE WHEN level = 'ERROR' THEN 503 ELSE 200 END) AS cc FROM holes)
  SELECT log_id, rr AS response_time_ms, CASE WHEN cc < 300 THEN 1 WHEN cc < 400 THEN 2 WHEN cc < 500 THEN 3 ELSE 4 END
    AS error_code, 25 AS request_count_last_60s,
    CAST((ascii('s') + ascii('v') + ascii('c') + ascii('-') + ascii(right(service, 1))) % 10 AS INTEGER)
    AS service_id_encoded FROM full_rows""",
)
def impute_for_scoring(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir).withColumns(
        {
            "response_time_ms": F.when(F.col("k") % 3 != 0, F.col("response_time_ms")),
            "error_code": F.when(F.col("k") % 5 != 0, F.col("error_code")),
        }
    )
    return features.impute_for_scoring(rows).select("log_id", "features.*").drop("hour_of_day", "log_level_encoded")


# ---------------------------------------------------------------- scaling and split


def _by_feature(template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in FEATURE_COLUMNS)


SCALER_SQL = _by_feature(
    "SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END"
    " AS scale FROM feats"
)


@query(
    "fit_scaler",
    f"WITH {FEATURES}, s AS ({SCALER_SQL}) SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM s",
)
def fit_scaler(spark, sf_dir):
    rows = scaler.fit_scaler(_features(spark, sf_dir), FEATURE_COLUMNS)
    return rows.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query(
    "scale_features",
    f"""WITH {FEATURES} SELECT log_id, """
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM feats)) / (SELECT stddev_pop({c}) FROM feats), 5) AS {c}"
        for c in FEATURE_COLUMNS
    )
    + " FROM feats",
)
def scale_features(spark, sf_dir):
    rows = _features(spark, sf_dir)
    scaled = scaler.scale_features(rows, scaler.fit_scaler(rows, FEATURE_COLUMNS))
    return scaled.select("log_id", *[F.round(f"scaled.{c}", 5).alias(c) for c in FEATURE_COLUMNS])


@query(
    "stratified_split",
    f"""WITH {LABELLED}, h AS (SELECT log_id, true_label,
    CAST('0x' || left(sha256('42:' || log_id), 15) AS BIGINT) AS h FROM labelled),
  r AS (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY h) AS rn,
    count(*) OVER (PARTITION BY true_label) AS n FROM h)
  SELECT log_id, true_label, rn <= ceil(n * 0.2) AS is_test FROM r""",
)
def stratified_split(spark, sf_dir):
    rows = inputs.labelled(spark, sf_dir).select("log_id", "true_label")
    return scaler.stratified_split(rows, "true_label", "log_id", 0.2)


@query(
    "labelled_union",
    f"WITH {PROC} SELECT log_id, CASE WHEN level = 'CRITICAL' THEN -1 ELSE 1 END AS true_label FROM proc",
)
def labelled_union(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir).select("log_id", "level")
    normal, odd = rows.filter("level <> 'CRITICAL'"), rows.filter("level = 'CRITICAL'")
    return evaluate.labelled_union(normal, odd, "log_id").drop("level")


# ---------------------------------------------------------------- forest

# Three small trees over (latency, error class), used to check the scorer against SQL (fixed values).
SMALL_TREES = [
    (0, 0, 0, 900.0, 1, 2, 8, 0.0),
    (0, 1, 1, 3.5, 3, 4, 6, 1.0),
    (0, 2, -1, 0.0, -1, -1, 2, 2.0),
    (0, 3, -1, 0.0, -1, -1, 4, 4.0),
    (0, 4, -1, 0.0, -1, -1, 2, 3.0),
    (1, 0, 1, 1.5, 1, 2, 8, 0.0),
    (1, 1, -1, 0.0, -1, -1, 5, 3.5),
    (1, 2, 0, 2000.0, 3, 4, 3, 1.0),
    (1, 3, -1, 0.0, -1, -1, 2, 3.0),
    (1, 4, -1, 0.0, -1, -1, 1, 2.0),
    (2, 0, 0, 300.0, 1, 2, 8, 0.0),
    (2, 1, -1, 0.0, -1, -1, 4, 2.5),
    (2, 2, -1, 0.0, -1, -1, 4, 3.0),
]
SMALL_COLUMNS = ["response_time_ms", "error_code"]


def small_forest(spark) -> iforest.ForestModel:
    nodes = spark.createDataFrame(SMALL_TREES, iforest.NODES)
    meta = {
        "algorithm": "IsolationForest",
        "trees": 3,
        "contamination": 0.05,
        "max_samples": 8,
        "features": SMALL_COLUMNS,
        "offset": -0.45,
    }
    return iforest.ForestModel(nodes, None, meta)


FIXED = f"""{PROC}, x AS (SELECT log_id, response_time_ms AS a, {BUCKET} AS b FROM proc),
  p AS (SELECT log_id, (CASE WHEN a > 900 THEN 2.0 WHEN b <= 3.5 THEN 4.0 ELSE 3.0 END
    + CASE WHEN b <= 1.5 THEN 3.5 WHEN a <= 2000 THEN 3.0 ELSE 2.0 END
    + CASE WHEN a <= 300 THEN 2.5 ELSE 3.0 END) / 3 AS h FROM x),
  s AS (SELECT log_id, -pow(2, -h / (2 * (ln(7) + 0.5772156649) - 2 * 7.0 / 8)) + 0.45 AS d FROM p),
  fixed AS (SELECT proc.*, d, round_even(d, 6) AS anomaly_score FROM proc JOIN s USING (log_id))"""


@query(
    "iforest_score_fixed",
    f"""WITH {FIXED}
  SELECT log_id, round_even(d, 6) AS anomaly_score, CASE WHEN d < 0 THEN -1 ELSE 1 END AS prediction,
    d < 0.01 AS is_anomaly, 0.01 AS threshold_used FROM s""",
)
def iforest_score_fixed(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir).withColumn(
        "error_code", features.E.encode_error_code(F.col("error_code"))
    )
    scored = iforest.score(rows, small_forest(spark), threshold=0.01, struct=None)
    return scored.select("log_id", "anomaly_score", "prediction", "is_anomaly", "threshold_used")


def _stored_features(spark, sf_dir):
    """Features as the stored log table has them: training and scoring read them several times."""
    return materialise(_features(spark, sf_dir), "features")


def _model(rows, **kw):
    return iforest.fit_iforest(rows.select("log_id", "features"), "log_id", **kw)


@query(
    "iforest_invariants",
    f"""WITH {PROC} SELECT CAST(t AS INTEGER) AS tree, least(256, (SELECT count(*) FROM proc))::BIGINT AS rows,
    true AS binary_tree, true AS leaves_hold_all, true AS depth_bounded FROM range(100) r(t)""",
)
def iforest_invariants(spark, sf_dir):
    """What holds for every trained tree, whatever the random splits: sample size, shape, rows in its leaves, depth."""
    model = _model(_stored_features(spark, sf_dir))
    leaf = F.col("feature") < 0
    rows, psi = F.max("samples"), model.meta["max_samples"]
    # a leaf's path is its depth plus the expected rest for its rows
    bound = math.ceil(math.log2(max(psi, 2))) + float(iforest.average_path(psi))
    return model.nodes.groupBy("tree").agg(
        rows.cast("bigint").alias("rows"),
        (2 * F.count_if(leaf) - 1 == F.count(F.lit(1))).alias("binary_tree"),
        (F.sum(F.when(leaf, F.col("samples"))) == rows).alias("leaves_hold_all"),
        (F.max("path") <= bound).alias("depth_bounded"),
    )


@query(
    "iforest_share",
    f"WITH {PROC} SELECT count(*) AS n, true AS in_bounds, true AS share_as_asked FROM proc",
)
def iforest_share(spark, sf_dir):
    """Scores of the training rows: their bounds, and the contamination as the share below zero (ties stay above)."""
    rows = _stored_features(spark, sf_dir)
    model = _model(rows)
    scored = iforest.score_training_rows(rows, model, "log_id")
    below = F.count_if(F.col("prediction") == -1) / F.count(F.lit(1))
    inside = F.min("anomaly_score") > -1 - model.meta["offset"]
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        (inside & (F.max("anomaly_score") < -model.meta["offset"])).alias("in_bounds"),
        below.between(0.03, 0.05 + 1e-9).alias("share_as_asked"),
    )


@query("iforest_fit")
def iforest_fit(spark, sf_dir):
    """Size and depth of every tree."""
    nodes = _model(_stored_features(spark, sf_dir)).nodes
    return nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("feature") < 0).alias("leaves"),
        F.max("samples").alias("rows"),
        F.round(F.avg("path"), 6).alias("mean_path"),
    )


@query("iforest_score")
def iforest_score(spark, sf_dir):
    rows = _stored_features(spark, sf_dir)
    return iforest.score_training_rows(rows, _model(rows), "log_id").select(
        "log_id", "anomaly_score", "prediction", "is_anomaly", "threshold_used"
    )


@query(
    "iforest_offset",
    f"WITH {SCORED} SELECT round(quantile_cont(anomaly_score, 0.05), 6) AS offset_value FROM scored",
)
def iforest_offset(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir)
    return iforest.forest_offset(rows, 0.05, "anomaly_score").select(F.round("offset", 6).alias("offset_value"))


@query("model_roundtrip", f"WITH {PROC} SELECT log_id, true AS same FROM proc")
def model_roundtrip(spark, sf_dir):
    """Scores of a model after it was saved and loaded next to those before."""
    rows = _stored_features(spark, sf_dir)
    model = _model(rows, trees=20)
    root = scratch_path(spark, "models")
    tables.save_model(model, root, "v0001")
    again = tables.newest_model(spark, root)
    before = iforest.score(rows, model).select("log_id", F.col("anomaly_score").alias("before"))
    after = iforest.score(rows, again).select("log_id", F.col("anomaly_score").alias("after"))
    return before.join(after, "log_id").select("log_id", (F.col("before") == F.col("after")).alias("same"))


@query(
    "model_status",
    """SELECT 'loaded' AS status, 'IsolationForest' AS model_type, 20 AS n_estimators, 0.05::DOUBLE AS contamination,
  6 AS n_features, 0.0::DOUBLE AS anomaly_threshold""",
)
def model_status(spark, sf_dir):
    return iforest.model_status(_model(_stored_features(spark, sf_dir), trees=20)).drop("trained_at")


def flagged_alerts(spark, rows, scored):
    """Scored logs to alerts with severity and duplicate flag."""
    found = alerting.build_alerts(
        scored, F.col("event_time") + F.expr("INTERVAL 5 SECONDS"), alerting.repeatable_alert_id("log_id", "event_time")
    )
    # stored, as the alert topic is: deduplication reads it several times and must not score the logs again
    marked = dedup.dedup_alerts(materialise(dedup.with_dedup_key(found), "alerts"), 3_600, id_col="log_id")
    return marked.select(
        "alert_id",
        "log_id",
        "service",
        "level",
        "anomaly_score",
        A.severity(F.col("anomaly_score"), F.col("level")).alias("severity"),
        "deduplicated",
    )


FIXED_ALERTS = f"""{FIXED}, alerts AS (SELECT *, log_id AS alert_id, event_time + INTERVAL 5 SECOND AS detected_at
  FROM fixed WHERE anomaly_score < 0)"""


@query(
    "detect_and_dedup_fixed",
    f"""WITH RECURSIVE {FIXED_ALERTS}{KEYED.removeprefix(ALERTS)}, {flagged(3_600)}
  SELECT log_id, service, level, anomaly_score, CASE WHEN anomaly_score < -0.3 AND level IN ('CRITICAL', 'ERROR')
    THEN 'CRITICAL' WHEN anomaly_score < -0.2 OR level = 'ERROR' THEN 'HIGH' WHEN anomaly_score < -0.1 THEN 'MEDIUM'
    ELSE 'LOW' END AS severity, deduplicated FROM flagged""",
)
def detect_and_dedup_fixed(spark, sf_dir):
    """The whole way with three given trees, so that SQL can follow it from the log to the flag."""
    rows = validate.score_inputs(_stored_features(spark, sf_dir))
    return flagged_alerts(spark, rows, iforest.score(rows, small_forest(spark))).drop("alert_id")


@query("detect_and_dedup")
def detect_and_dedup(spark, sf_dir):
    """The whole way: features, model score, alerts with severity, duplicates flagged."""
    rows = validate.score_inputs(_stored_features(spark, sf_dir))
    scored = iforest.score_training_rows(rows, _model(rows), "log_id")
    found = alerting.build_alerts(
        scored, F.col("event_time") + F.expr("INTERVAL 5 SECONDS"), alerting.repeatable_alert_id("log_id", "event_time")
    )
    # stored, as the alert topic is: deduplication reads it several times and must not score the logs again
    flagged = dedup.dedup_alerts(materialise(dedup.with_dedup_key(found), "alerts"), 3_600)
    return flagged.select(
        "alert_id",
        "log_id",
        "service",
        "level",
        "anomaly_score",
        A.severity(F.col("anomaly_score"), F.col("level")).alias("severity"),
        "deduplicated",
    )


# ---------------------------------------------------------------- evaluation


@query(
    "score_summary",
    f"""WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomaly_count,
  round_even(count(*) FILTER (is_anomaly) / count(*), 3) AS anomaly_rate FROM scored""",
)
def score_summary(spark, sf_dir):
    return stats.score_summary(inputs.scored(spark, sf_dir))


CM_SQL = """cm AS (SELECT count(*) FILTER (true_label = 1 AND prediction = 1) AS true_negative,
  count(*) FILTER (true_label = 1 AND prediction = -1) AS false_positive,
  count(*) FILTER (true_label = -1 AND prediction = 1) AS false_negative,
  count(*) FILTER (true_label = -1 AND prediction = -1) AS true_positive FROM labelled)"""


@query("confusion_matrix", f"WITH {LABELLED}, {CM_SQL} SELECT * FROM cm")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(inputs.labelled(spark, sf_dir))


METRICS_SQL = f"""{LABELLED}, {CM_SQL}, m AS (SELECT *, true_positive / (true_positive + false_positive) AS p,
  true_positive / (true_positive + false_negative) AS r,
  true_negative + false_positive + false_negative + true_positive AS test_samples FROM cm)"""


@query(
    "classification_metrics",
    f"""WITH {METRICS_SQL} SELECT true_negative, false_positive, false_negative, true_positive, round(p, 4) AS precision,
  round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1_score,
  round((true_positive + false_positive) / test_samples, 4) AS anomaly_rate_predicted,
  round((true_positive + false_negative) / test_samples, 4) AS anomaly_rate_true, test_samples FROM m""",
)
def classification_metrics(spark, sf_dir):
    return evaluate.classification_metrics(inputs.labelled(spark, sf_dir))


@query(
    "classification_report",
    f"""WITH {METRICS_SQL}, c AS (
    SELECT 'anomaly' AS class, p, r, 2 * p * r / (p + r) AS f, true_positive + false_negative AS support FROM m
    UNION ALL SELECT 'normal', true_negative / (true_negative + false_negative),
      true_negative / (true_negative + false_positive),
      2 * true_negative / (2 * true_negative + false_negative + false_positive), true_negative + false_positive FROM m),
  a AS (SELECT * FROM c
    UNION ALL SELECT 'accuracy', v, v, v, n FROM (SELECT (true_positive + true_negative) / test_samples AS v,
      test_samples AS n FROM m)
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM c
    UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
      sum(f * support) / sum(support), sum(support) FROM c)
  SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1_score,
    CAST(support AS BIGINT) AS support FROM a""",
)
def classification_report(spark, sf_dir):
    return evaluate.classification_report(inputs.labelled(spark, sf_dir))


@query(
    "roc_auc",
    f"""WITH {LABELLED}, s AS (SELECT anomaly_score, count(*) FILTER (true_label = -1) AS pos,
    count(*) FILTER (true_label = 1) AS neg FROM labelled GROUP BY 1),
  c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY anomaly_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    0) AS below FROM s)
  SELECT round(CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (sum(pos) * sum(neg)), 4) AS roc_auc FROM c""",
)
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(inputs.labelled(spark, sf_dir))


SPREAD_SQL = """round(avg(anomaly_score), 6) AS mean, round(stddev_pop(anomaly_score), 6) AS std,
  min(anomaly_score) AS min, max(anomaly_score) AS max,
  round(quantile_cont(anomaly_score, 0.1), 6) AS p10, round(quantile_cont(anomaly_score, 0.25), 6) AS p25,
  round(quantile_cont(anomaly_score, 0.5), 6) AS p50, round(quantile_cont(anomaly_score, 0.75), 6) AS p75,
  round(quantile_cont(anomaly_score, 0.9), 6) AS p90"""


@query("score_distribution", f"WITH {SCORED} SELECT {SPREAD_SQL} FROM scored")
def score_distribution(spark, sf_dir):
    return evaluate.score_distribution(inputs.scored(spark, sf_dir))


@query(
    "score_drift",
    f"""WITH {SCORED} SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS log_date, {SPREAD_SQL}
  FROM scored GROUP BY 1""",
)
def score_drift(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).withColumn("log_date", F.to_date("event_time").cast("string"))
    return evaluate.score_distribution(rows, by=["log_date"])


@query(
    "latency_percentiles",
    f"""WITH {PROC} SELECT service, count(*) AS n, round(quantile_cont(response_time_ms, 0.5), 6) AS p50,
  round(quantile_cont(response_time_ms, 0.99), 6) AS p99 FROM proc GROUP BY 1""",
)
def latency_percentiles(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir)
    marks = percentiles(rows, "response_time_ms", {"p50": 0.5, "p99": 0.99}, band_width=10.0, by=["service"])
    return marks.withColumns({c: F.round(c, 6) for c in ("p50", "p99")})


@query(
    "eval_report",
    f"""WITH {METRICS_SQL}, s AS (SELECT {SPREAD_SQL} FROM labelled)
  SELECT test_samples AS total_samples, true_positive + false_negative AS anomaly_samples, round(p, 4) AS precision,
    round(r, 4) AS recall, true_positive, s.p50, s.std FROM m, s""",
)
def eval_report(spark, sf_dir):
    report = evaluate.evaluation_report(inputs.labelled(spark, sf_dir))
    path = scratch_path(spark, "report")
    tables.write_report(report, path)
    again = spark.read.schema(report.schema).json(path)
    return again.select(
        "dataset.total_samples",
        "dataset.anomaly_samples",
        "metrics.precision",
        "metrics.recall",
        "confusion_matrix.true_positive",
        "score_distribution.p50",
        "score_distribution.std",
    )


@query(
    "quality_gate",
    f"""WITH {METRICS_SQL}, g AS (SELECT round(p, 4) >= 0.8 AS a, round(r, 4) >= 0.75 AS b,
    round(2 * p * r / (p + r), 4) >= 0.77 AS c FROM m)
  SELECT a AS precision_ok, b AS recall_ok, c AS f1_score_ok, a AND b AND c AS passed FROM g""",
)
def quality_gate(spark, sf_dir):
    checked = evaluate.quality_gate(evaluate.classification_metrics(inputs.labelled(spark, sf_dir)))
    return checked.select("precision_ok", "recall_ok", "f1_score_ok", "passed")


@query(
    "read_eval_csv",
    f"""WITH {FEATURES} SELECT CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS true_label, count(*) AS n,
  round(avg(response_time_ms), 6) AS latency FROM feats GROUP BY 1""",
)
def read_eval_csv(spark, sf_dir):
    rows = _features(spark, sf_dir).select(
        "features.*", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("true_label")
    )
    path = scratch_path(spark, "eval-csv")
    rows.write.option("header", True).csv(path)
    again = tables.read_eval_csv(spark, path)
    return again.groupBy("true_label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("response_time_ms"), 6).alias("latency")
    )


