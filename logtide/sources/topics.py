"""Topic records: JSON bytes in, JSON bytes out. The parse step is the same for Kafka, files and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.text import iso_text
from logtide.schemas import RAW_LOG

RAW_TOPIC = "raw-logs"
PROCESSED_TOPIC = "processed-logs"
ALERT_TOPIC = "anomaly-alerts"
POLL_SIZE = 500


def source_options(servers: str, topic: str, earliest: bool = True, per_trigger: int | None = None) -> dict[str, str]:
    """Options of a topic source: one topic, aborted transactions not read, at most ``per_trigger`` records a batch."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest" if earliest else "latest",
        "kafka.isolation.level": "read_committed",
    }
    return options | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def read_topic(
    spark: SparkSession, servers: str, topic: str, earliest: bool = True, per_trigger: int | None = None
) -> DataFrame:
    """Streaming rows of a Kafka topic. Needs the Kafka connector."""
    return spark.readStream.format("kafka").options(**source_options(servers, topic, earliest, per_trigger)).load()


def topic_options(servers: str, topic: str) -> dict[str, str]:
    """Options of a topic sink: every copy acknowledges, and a retried send is not written twice."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
    }


def write_topic(records: DataFrame, servers: str, topic: str, checkpoint: str):
    writer = records.writeStream.format("kafka").options(**topic_options(servers, topic))
    return writer.option("checkpointLocation", checkpoint).start()


def topic_publisher(servers: str, topic: str, key: str = "service", headers: dict[str, str] | None = None):
    """A ``publish`` step for the streaming jobs: the rows of a micro-batch as topic records. Needs the Kafka connector."""

    def publish(rows: DataFrame, batch_id: int) -> None:
        records = to_topic_records(rows, key=key, headers=headers)
        records.write.format("kafka").options(**topic_options(servers, topic)).save()

    return publish


def read_json_lines(spark: SparkSession, path: str, per_trigger: int | None = None, stream: bool = True) -> DataFrame:
    """Landed JSON lines, one record per line, in the column a topic would have."""
    if not stream:
        return spark.read.text(path)
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def parse_raw_logs(records: DataFrame, value: str = "value") -> DataFrame:
    """Add the raw record fields and ``decodable``, parsing each value once.

    A number in ``timestamp`` is an epoch in seconds; a text there is left as text. ``metadata`` is kept if it is
    an object. Undecodable values and values that are no object keep null fields.
    """
    v = F.try_parse_json(F.col(value).cast("string"))
    rows = records.withColumn("_v", v).withColumn("_is_object", F.schema_of_variant("_v").startswith("OBJECT"))
    rows = rows.withColumn("_v", F.when(F.col("_is_object"), F.col("_v")))

    def member(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("_v", f"$.{name}", kind)

    time_kind = F.schema_of_variant(member("timestamp", "variant"))
    is_number = time_kind.isin("BIGINT", "DOUBLE") | time_kind.startswith("DECIMAL")
    cols = []
    for f in RAW_LOG.fields:
        if f.name == "timestamp":
            col = F.when(~F.coalesce(is_number, F.lit(False)), member("timestamp"))
        elif f.name == "epoch_seconds":
            col = F.when(is_number, member("timestamp", "double"))
        elif f.name == "metadata":
            is_map = F.schema_of_variant(member("metadata", "variant")).startswith("OBJECT")
            col = F.when(is_map, member("metadata"))
        else:
            col = member(f.name)
        cols.append(col.alias(f.name))
    keep = [c for c in records.columns if c not in RAW_LOG.fieldNames()]
    return rows.select(*keep, F.coalesce("_is_object", F.lit(False)).alias("decodable"), *cols)


def quarantine_undecodable(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with fields, undecodable values)."""
    return parsed.filter("decodable").drop("decodable"), parsed.filter(~F.col("decodable")).drop(
        "decodable", *RAW_LOG.fieldNames()
    )


def json_value(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Row as JSON text; times as ISO text with offset."""
    names = columns or df.columns
    kinds = dict(df.dtypes)
    cols = [iso_text(F.col(c)).alias(c) if kinds[c] == "timestamp" else F.col(c) for c in names]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def to_topic_records(
    df: DataFrame, topic: str | None = None, key: str = "service", headers: dict[str, str] | None = None
) -> DataFrame:
    """(key, value[, topic][, headers]): the key keeps records of a service in order."""
    cols = [F.col(key).cast("string").alias("key"), json_value(df).alias("value")]
    if topic:
        cols.append(F.lit(topic).alias("topic"))
    if headers:
        pairs = [
            F.struct(F.lit(k).alias("key"), F.encode(F.lit(v), "UTF-8").alias("value")) for k, v in headers.items()
        ]
        cols.append(F.array(*pairs).alias("headers"))
    return df.select(*cols)
