"""Quality of a detector on labelled rows: -1 is an anomaly, 1 is normal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.operators.quantiles import percentiles, value_ranks
from logtide.session import materialise

# Least acceptable quality (fixed values).
QUALITY_GATE = {"precision": 0.80, "recall": 0.75, "f1_score": 0.77}

SCORE_POINTS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def _share(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "true_label", pred: str = "prediction") -> DataFrame:
    bad, said = F.col(label) == -1, F.col(pred) == -1
    return df.agg(
        F.count_if(~bad & ~said).alias("true_negative"),
        F.count_if(~bad & said).alias("false_positive"),
        F.count_if(bad & ~said).alias("false_negative"),
        F.count_if(bad & said).alias("true_positive"),
    )


def _quality(hit: Column, predicted: Column, actual: Column, digits: int = 4) -> dict[str, Column]:
    precision, recall = _share(hit, predicted), _share(hit, actual)
    f1 = _share(2 * hit, predicted + actual)
    return {
        "precision": F.round(precision, digits),
        "recall": F.round(recall, digits),
        "f1_score": F.round(f1, digits),
    }


def classification_metrics(df: DataFrame, label: str = "true_label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 of the anomaly class and predicted and true anomaly rates; 0 when undefined."""
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive")
    )
    total = tn + fp + fn + tp
    return confusion_matrix(df, label, pred).withColumns(
        {
            **_quality(tp, tp + fp, tp + fn),
            "anomaly_rate_predicted": F.round(_share(tp + fp, total), 4),
            "anomaly_rate_true": F.round(_share(tp + fn, total), 4),
            "test_samples": total,
        }
    )


def classification_report(df: DataFrame, label: str = "true_label", pred: str = "prediction") -> DataFrame:
    """Per class and averaged precision, recall, F1 and support. Everything after the counts is one row."""
    m = confusion_matrix(df, label, pred)
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive")
    )

    def row(name: str, hit: Column, predicted: Column, actual: Column) -> Column:
        q = _quality(hit, predicted, actual, digits=15)
        return F.struct(
            F.lit(name).alias("class"), *[c.alias(k) for k, c in q.items()], actual.alias("support")
        )

    total = tn + fp + fn + tp
    both = m.select(
        row("normal", tn, tn + fn, tn + fp).alias("a"),
        row("anomaly", tp, tp + fp, tp + fn).alias("b"),
        _share(tn + tp, total).alias("acc"),
        total.alias("total"),
    )

    def average(name: str, weight_a: Column, weight_b: Column) -> Column:
        parts = [
            (F.col("a")[k] * weight_a + F.col("b")[k] * weight_b).alias(k) for k in QUALITY_GATE
        ]
        return F.struct(F.lit(name).alias("class"), *parts, F.col("total").alias("support"))

    accuracy = F.struct(
        F.lit("accuracy").alias("class"), *[F.col("acc").alias(k) for k in QUALITY_GATE], F.col("total").alias("support")
    )
    half = F.lit(0.5)
    rows = F.array(
        F.col("a"),
        F.col("b"),
        accuracy,
        average("macro avg", half, half),
        average(
            "weighted avg", _share(F.col("a.support"), F.col("total")), _share(F.col("b.support"), F.col("total"))
        ),
    )
    flat = both.select(F.explode(rows).alias("r")).select("r.*")
    return flat.withColumns({k: F.round(k, 4) for k in QUALITY_GATE})


def roc_auc(df: DataFrame, label: str = "true_label", score: str = "anomaly_score") -> DataFrame:
    """Area under the ROC curve, a lower score meaning more anomalous; null with one class."""
    bad = F.col(label) == -1
    ranked = value_ranks(
        df.withColumn("_risk", -F.col(score)), "_risk", {"pos": F.count_if(bad), "neg": F.count_if(~bad)}
    )
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.max(F.col("pos_all").cast("double") * F.col("neg_all"))
    return ranked.agg(F.round(F.try_divide(won, pairs), 4).alias("roc_auc"))


def score_distribution(
    df: DataFrame, score: str = "anomaly_score", by: list[str] | None = None, approx: bool = False
) -> DataFrame:
    """Mean, population deviation, extremes and percentiles of the scores."""
    by = by or []
    basic = [
        F.round(F.avg(score), 6).alias("mean"),
        F.round(F.stddev_pop(score), 6).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    ]
    if approx:
        marks = F.percentile_approx(score, list(SCORE_POINTS.values()), 10_000)
        rows = df.groupBy(*by).agg(*basic, marks.alias("_marks"))
        return rows.select(
            *by, "mean", "std", "min", "max", *[F.col("_marks")[i].alias(n) for i, n in enumerate(SCORE_POINTS)]
        )
    marks = percentiles(df, score, SCORE_POINTS, by=by).drop("n")
    marks = marks.withColumns({n: F.round(n, 6) for n in SCORE_POINTS})
    stats = df.groupBy(*by).agg(*basic)
    if by:
        return stats.join(marks, by)
    return stats.withColumn("_m", marks.select(F.struct(*SCORE_POINTS)).scalar()).select("*", "_m.*").drop("_m")


def evaluation_report(
    df: DataFrame, label: str = "true_label", pred: str = "prediction", score: str = "anomaly_score"
) -> DataFrame:
    """One row: sample counts, metrics, confusion matrix, report and score distribution.

    The three columns are stored once; matrix, curve and percentiles read them from there and not from the input again.
    """
    df = materialise(df.select(label, pred, score), "evaluated")
    one = classification_metrics(df, label, pred)
    matrix = ["true_negative", "false_positive", "false_negative", "true_positive"]
    report = classification_report(df, label, pred)
    report = report.agg(F.array_sort(F.collect_list(F.struct("class", *QUALITY_GATE, "support"))))
    spread = score_distribution(df, score)
    return one.select(
        F.struct(
            F.col("test_samples").alias("total_samples"),
            (F.col("true_negative") + F.col("false_positive")).alias("normal_samples"),
            (F.col("true_positive") + F.col("false_negative")).alias("anomaly_samples"),
        ).alias("dataset"),
        F.struct(*QUALITY_GATE, roc_auc(df, label, score).scalar().alias("roc_auc")).alias("metrics"),
        F.struct(*matrix).alias("confusion_matrix"),
        report.scalar().alias("classification_report"),
        spread.select(F.struct(*spread.columns)).scalar().alias("score_distribution"),
    )


def quality_gate(metrics: DataFrame, gate: dict[str, float] = QUALITY_GATE) -> DataFrame:
    """Add ``<metric>_ok`` for each gated metric and ``passed``."""
    checks = {f"{name}_ok": F.col(name) >= least for name, least in gate.items()}
    done = metrics.withColumns(checks)
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return done.withColumn("passed", passed)


def labelled_union(normal: DataFrame, anomalous: DataFrame, order_by: str, seed: int = 42) -> DataFrame:
    """Both sets with their label, mixed in an order that only depends on the seed."""
    rows = normal.withColumn("true_label", F.lit(1)).unionByName(anomalous.withColumn("true_label", F.lit(-1)))
    return rows.withColumn("_mix", F.xxhash64(F.lit(seed), F.col(order_by))).orderBy("_mix", order_by).drop("_mix")
