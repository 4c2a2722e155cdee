"""Stored tables: the daily log table, the alert change log, reports, exports and model versions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators.iforest import NODES, ForestModel
from logtide.schemas import FEATURE_COLUMNS


def index_name(time: Column, prefix: str = "logs") -> Column:
    """Name of the daily index a record belongs to."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(time, "yyyy.MM.dd"))


def index_logs_daily(logs: DataFrame, today: Column | None = None) -> DataFrame:
    """Rows of the daily table: one per (log_date, log_id), the one processed last.

    The aggregation combines copies of a row before the shuffle, so many copies of one id cost no more than one.
    """
    day = F.to_date("event_time") if today is None else F.coalesce(F.to_date("event_time"), today)
    dated = logs.withColumn("log_date", day)
    rest = [c for c in dated.columns if c not in ("log_date", "log_id")]
    last = F.max_by(F.struct(*rest), F.struct("processed_at", F.xxhash64(*_hashable(dated, rest))))
    return dated.groupBy("log_date", "log_id").agg(last.alias("r")).select("log_date", "log_id", "r.*")


def _hashable(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if not isinstance(df.schema[n].dataType, (T.MapType, T.VariantType))]


def write_daily(logs: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Write rows into their day. Days in the batch are rewritten together with the rows they already hold.

    With ``existing`` (the table as read) a second run of the same batch leaves the same table. Rows are dealt out by
    day and balanced: small days share a task, and a day with a third of the rows is split over many.
    """
    rows = logs if "log_date" in logs.columns else logs.withColumn("log_date", F.to_date("event_time"))
    if existing is not None:
        days = rows.select("log_date").distinct()
        rows = rows.unionByName(existing.join(days, "log_date", "left_semi"), allowMissingColumns=True)
    (
        index_logs_daily(rows)
        .hint("rebalance", "log_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date")
        .parquet(path)
    )


def append_daily(logs: DataFrame, path: str) -> None:
    """Append a batch to the daily table; the reader keeps the last row of each id with ``index_logs_daily``."""
    logs.withColumn("log_date", F.to_date("event_time")).write.mode("append").partitionBy("log_date").parquet(path)


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows from CSV. Fails when the label or a feature column is missing."""
    header = spark.read.option("header", True).csv(path)
    if "true_label" not in header.columns:
        raise ValueError("the file needs a true_label column (-1 anomaly, 1 normal)")
    missing = [c for c in FEATURE_COLUMNS if c not in header.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return header.select(
        *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS], F.col("true_label").cast("int").alias("true_label")
    )


def export_ndjson(logs: DataFrame, path: str) -> None:
    """One JSON object per line, compressed by the codec of the session."""
    logs.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.write.mode("overwrite").json(path)


def write_changes(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


def save_model(model: ForestModel, root: str, version: str) -> str:
    """Write a model version: nodes and scaler tables, then the metadata that makes the version visible."""
    spark = model.nodes.sparkSession
    path = f"{root.rstrip('/')}/{version}"
    model.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    if model.scaler is not None:
        model.scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    meta = {**model.meta, "version": version, "has_scaler": model.scaler is not None}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta"
    )
    return path


def load_model(spark: SparkSession, path: str) -> ForestModel:
    """Read a model version. The scaler is optional; anything that is no forest is refused."""
    text = spark.read.text(f"{path}/meta").first()
    meta = json.loads(text["value"]) if text else {}
    if meta.get("algorithm") != "IsolationForest":
        raise TypeError(f"{path} does not hold an isolation forest")
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
    scaler = spark.read.parquet(f"{path}/scaler") if meta.get("has_scaler") else None
    return ForestModel(nodes, scaler, meta)


def newest_version(spark: SparkSession, root: str) -> str:
    """The version with the highest number in its name among those whose metadata is complete; names break ties."""
    metas = spark.read.text(f"{root.rstrip('/')}/*/meta")
    versions = metas.select(F.get_json_object("value", "$.version").alias("v"))
    number = F.regexp_extract("v", r"(\d+)(?!.*\d)", 1).try_cast("decimal(38,0)")
    top = versions.where("v IS NOT NULL").agg(F.max(F.struct(F.coalesce(number, F.lit(-1)).alias("n"), "v"))).first()[0]
    if top is None:
        raise FileNotFoundError(f"no model below {root}")
    return top["v"]


def newest_model(spark: SparkSession, root: str) -> ForestModel:
    return load_model(spark, f"{root.rstrip('/')}/{newest_version(spark, root)}")

