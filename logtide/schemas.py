"""Record shapes shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order in which the model reads the features (fixed values).
FEATURE_COLUMNS = [
    "hour_of_day",
    "response_time_ms",
    "error_code",
    "log_level_encoded",
    "request_count_last_60s",
    "service_id_encoded",
]

FEATURES = T.StructType(
    [
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("log_level_encoded", T.IntegerType()),
        T.StructField("request_count_last_60s", T.LongType()),
        T.StructField("service_id_encoded", T.IntegerType()),
    ]
)

# A raw record keeps every scalar as text: what the client sent may not parse.
RAW_LOG = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("response_time_ms", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("epoch_seconds", T.DoubleType()),
        T.StructField("ingested_at", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)

PROCESSED_LOG = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("features", FEATURES),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("log_id", T.StringType()),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("features", FEATURES),
    ]
)

ALERT_HISTORY = T.StructType(
    [
        T.StructField("alert_id", T.StringType(), False),
        T.StructField("log_id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("host", T.StringType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("slack_sent", T.BooleanType()),
        T.StructField("email_sent", T.BooleanType()),
        T.StructField("deduplicated", T.BooleanType()),
        T.StructField("notification_channels", T.ArrayType(T.StringType())),
        T.StructField("features", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

METRIC_SAMPLE = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("value", T.DoubleType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType, text_key_limit: int | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what can be cast, null what cannot, drop the rest.

    With ``text_key_limit`` a ``message_keyword`` column holds the message when it is short enough to
    be a lookup key and null otherwise.
    """

    def cast(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        have = df.schema[field.name].dataType
        col = F.col(field.name)
        if have == field.dataType:
            return col
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return col.cast(field.dataType).alias(field.name)
        return col.try_cast(field.dataType).alias(field.name)

    cols = [cast(f) for f in schema.fields]
    if text_key_limit is not None:
        short = F.when(F.char_length("message") <= text_key_limit, F.col("message").cast("string"))
        cols.append(short.alias("message_keyword"))
    return df.select(*cols)
