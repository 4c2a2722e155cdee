"""Collector inputs: container log lines, syslog lines and pushed JSON, as one stream of log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.sources.tail import tail_files

# Severity names by their syslog number (fixed values).
SYSLOG_SEVERITY = ["emerg", "alert", "crit", "err", "warn", "notice", "info", "debug"]

MEMBERS = "map<string,string>"
# Members of a nested record that have a column of their own (fixed values); all others stay in ``members``.
NESTED_COLUMNS = ("level", "service", "response_time_ms", "error_code")
SYSLOG_LINE = r"^<(\d{1,3})>([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"


def read_container_logs(spark: SparkSession, path: str, stream: bool = True, rotated: str | None = None) -> DataFrame:
    """Lines of container log files with the container name from the file name.

    The stream follows growing files (``sources.tail``): the checkpoint of the query keeps the positions, files are read from
    their start, and files renamed to a name that ``rotated`` finds are read to their end.
    """
    if stream:
        lines = tail_files(spark, path, rotated)
        file = F.col("file")
    else:
        lines, file = spark.read.text(path), F.input_file_name()
    name = F.element_at(F.split(file, "/"), -1)
    return lines.select("value", F.regexp_replace(name, r"\.log(\..*)?$", "").alias("container_name"))


def service_from_container(name: Column) -> Column:
    """First two dash-separated parts of a container name."""
    return F.substring_index(name, "-", 2)


def json_members(text: Column) -> Column:
    """All members of a JSON object as text by name; null if the text is no object."""
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return F.when(is_object, F.from_json(text, MEMBERS))


def split_container_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines that hold a JSON object, the others with the reason)."""
    readable = json_members(F.col("value")).isNotNull()
    return lines.filter(readable), lines.filter(~readable | F.col("value").isNull()).withColumn("reason", F.lit("no JSON object"))


def collect_container_logs(lines: DataFrame, collected_at: Column, hostname: str | None = None) -> DataFrame:
    """Container lines (value, container_name) to records; every line that is a JSON object is one.

    ``members`` holds all members of the line and of the record nested in its ``log``, which wins. Lines that are no
    object come out of ``split_container_lines``.
    """
    parsed = split_container_lines(lines)[0].withColumn("members", json_members(F.col("value")))
    member = lambda name: F.try_element_at("members", F.lit(name))
    rows = parsed.select(
        F.lit("docker").alias("source"),
        "container_name",
        member("log").alias("log"),
        member("message").alias("message"),
        member("time").alias("timestamp"),
        F.coalesce(member("level"), member("severity"), F.lit("INFO")).alias("level"),
        *[member(c).alias(c) for c in NESTED_COLUMNS if c not in ("level", "service")],
        F.coalesce(F.lit(hostname).cast("string"), member("host")).alias("host"),
        "members",
        collected_at.alias("collected_at"),
    )
    return parse_nested_json(rows).withColumn("service", service_from_container(F.col("container_name")))


def parse_nested_json(rows: DataFrame, field: str = "log") -> DataFrame:
    """Merge all members of a JSON text field into the row; the field stays, other texts are left as they are.

    ``message``, level, service, latency and error code go to their columns; every member goes to the map ``members``.
    """
    merged = rows.withColumn("_n", json_members(F.col(field)))
    have = set(rows.columns)
    nested = lambda name: F.try_element_at("_n", F.lit(name))
    own = lambda name: [F.col(name)] if name in have else []
    none = F.create_map().cast(MEMBERS)
    before = F.coalesce("members", none) if "members" in have else none
    inner = F.coalesce("_n", none)
    cols = {name: F.coalesce(nested(name), *own(name)) for name in NESTED_COLUMNS}
    cols["message"] = F.coalesce(nested("message"), *own("message"), field)
    cols["members"] = F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(inner, k)), inner)
    return merged.withColumns(cols).drop("_n")


def split_syslog_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of the syslog form, the others with the reason)."""
    readable = F.coalesce(F.col("value").rlike(SYSLOG_LINE), F.lit(False))
    return lines.filter(readable), lines.filter(~readable).withColumn("reason", F.lit("no syslog line"))


def collect_syslog(lines: DataFrame, year: Column, collected_at: Column) -> DataFrame:
    """Syslog lines (value) to records; the line carries no year.

    Lines of another form come out of ``split_syslog_lines``.
    """
    part = [F.regexp_extract("value", SYSLOG_LINE, i) for i in range(7)]
    pri = part[1].try_cast("int")
    severity = F.get(F.array(*[F.lit(s) for s in SYSLOG_SEVERITY]), pri.bitwiseAND(F.lit(7)))
    stamp = F.concat_ws(" ", year.cast("string"), F.regexp_replace(part[2], " +", " "))
    return split_syslog_lines(lines)[0].select(
        F.lit("syslog").alias("source"),
        F.shiftright(pri, 3).alias("facility"),
        severity.alias("severity"),
        severity.alias("level"),
        F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss")).alias("event_time"),
        part[3].alias("host"),
        part[4].alias("service"),
        F.nullif(part[5], F.lit("")).try_cast("int").alias("pid"),
        part[6].alias("message"),
        collected_at.alias("collected_at"),
    )


def collect_pushed(records: DataFrame) -> DataFrame:
    """Pushed JSON records (already read) with their source tag."""
    return records.withColumn("source", F.lit("http"))


def collect_all(*inputs: DataFrame) -> DataFrame:
    """All inputs as one set of records; fields an input lacks are null."""
    merged = inputs[0]
    for df in inputs[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged


VALUES = "map<string,variant>"


def json_values(text: Column) -> Column:
    """All members of a JSON object with their types, by name; null if the text is no object."""
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return F.when(is_object, F.from_json(text, VALUES))


def value_of(values: str, name: str, kind: str, path: str = "$") -> Column:
    """A member, or a place within it, as a type; null if it is missing or of another kind."""
    return F.try_variant_get(F.try_element_at(values, F.lit(name)), path, kind)


def collect_typed_logs(lines: DataFrame, collected_at: Column) -> DataFrame:
    """Container lines (value, container_name) to records whose members keep their types.

    ``values`` holds all members of the line and of the record nested in its ``log``, which wins: numbers, nested objects
    and arrays as they were sent. Texts are as in ``collect_container_logs``, numbers come as numbers.
    """
    outer = split_container_lines(lines)[0].withColumn("_outer", json_values(F.col("value")))
    log = value_of("_outer", "log", "string")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    both = outer.withColumn("_inner", F.coalesce(json_values(log), none))
    left = F.map_filter("_outer", lambda k, v: ~F.map_contains_key("_inner", k))
    rows = both.withColumn("values", F.map_concat(left, "_inner"))
    return rows.select(
        F.lit("docker").alias("source"),
        "container_name",
        service_from_container(F.col("container_name")).alias("service"),
        F.coalesce(value_of("values", "level", "string"), value_of("values", "severity", "string"), F.lit("INFO")).alias("level"),
        F.coalesce(value_of("values", "message", "string"), log).alias("message"),
        value_of("values", "response_time_ms", "double").alias("response_time_ms"),
        value_of("values", "error_code", "int").alias("error_code"),
        "values",
        collected_at.alias("collected_at"),
    )
