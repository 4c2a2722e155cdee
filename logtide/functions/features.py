"""Encodings of log fields as model inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.functions.text import strip

# Level codes; a level outside the list counts as INFO (fixed values).
LEVEL_CODES = {"DEBUG": 0, "INFO": 1, "WARN": 2, "WARNING": 2, "ERROR": 3, "CRITICAL": 4, "FATAL": 4}

# Service codes of the evaluation set; other services are 5 (fixed values).
EVAL_SERVICE_CODES = {
    "auth-service": 0,
    "payment-service": 1,
    "user-service": 2,
    "order-service": 3,
    "api-gateway": 4,
}

LATENCY_CAP_MS = 300_000.0


def encode_level(col: Column) -> Column:
    name = F.upper(strip(col))
    result = F.when(F.lit(False), 0)
    for code in sorted(set(LEVEL_CODES.values())):
        result = result.when(name.isin([k for k, v in LEVEL_CODES.items() if v == code]), code)
    return result.otherwise(1)


def encode_error_code(col: Column, keep_buckets: bool = False) -> Column:
    """Status code class 0..5. With ``keep_buckets`` values 1..5 are taken as already encoded."""
    hundreds = F.floor(col / 100).cast("int")
    result = F.when(col.isNull() | (col == 0), 0).when(hundreds.between(2, 5), hundreds - 1)
    if keep_buckets:
        result = result.when(col.between(1, 5), col.cast("int"))
    return result.otherwise(5)


def encode_eval_service(col: Column) -> Column:
    result = F.when(F.lit(False), 0)
    for name, code in EVAL_SERVICE_CODES.items():
        result = result.when(col == name, code)
    return result.otherwise(5)


def hash_service(col: Column, size: int = 10_000) -> Column:
    """Stable id of a service that has no label yet."""
    digest = F.left(F.sha2(col.cast("string"), 256), F.lit(8))
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(size)).cast("int")


def charsum_service(col: Column, size: int = 10) -> Column:
    """Sum of character codes modulo ``size``."""
    codes = F.transform(F.split(F.coalesce(col, F.lit("gateway")), ""), F.ascii)
    return F.pmod(F.aggregate(codes, F.lit(0), lambda acc, code: acc + code), F.lit(size))


def cap_latency(col: Column) -> Column:
    return F.least(col, F.lit(LATENCY_CAP_MS))


def zero_features(schema) -> Column:
    """Feature vector used when extraction is not possible: all zero, level INFO."""
    fields = [
        F.lit(1 if f.name == "log_level_encoded" else 0).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return F.struct(*fields)
