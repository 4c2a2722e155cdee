"""Level, timestamp and number clean-up as Column expressions. Dirty input never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.functions.text import strip

# Accepted spellings of each canonical level (fixed values).
LEVEL_SPELLINGS = {
    "DEBUG": ["DEBUG", "TRACE"],
    "INFO": ["INFO", "INFORMATION"],
    "WARN": ["WARN", "WARNING"],
    "ERROR": ["ERROR", "ERR"],
    "CRITICAL": ["CRITICAL", "CRIT", "FATAL", "EMERGENCY", "ALERT"],
}

ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([ T]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
# Further ISO 8601 forms: basic and week dates, basic times, any sign between date and time.
ISO_DATES = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?"
ISO_CLOCKS = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{2}(?:\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
ISO_ZONE = r"Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?"
ANY_ISO = rf"^({ISO_DATES})(?:.({ISO_CLOCKS})({ISO_ZONE})?)?$"
ACCESS_LOG_TIME = r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"


def canonical_level(name: Column) -> Column:
    """One of DEBUG, INFO, WARN, ERROR, CRITICAL; unknown and null become INFO."""
    pairs = [F.lit(x) for level, names in LEVEL_SPELLINGS.items() for name in names for x in (name, level)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit("INFO"))


def normalise_level(col: Column) -> Column:
    """``canonical_level`` of a level as the source wrote it."""
    return canonical_level(F.upper(strip(col)))


def iso_date(text: Column) -> Column:
    """A date as YYYY-MM-DD from its extended, basic or week form; null if there is no such day."""
    plain = F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    part = lambda i: F.nullif(F.regexp_extract(text, r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", i), F.lit("")).try_cast("int")
    year, week, day = part(1), part(2), F.coalesce(part(3), F.lit(1))
    # the week with January 4th is the first one
    first = F.trunc(F.make_date(F.when(year > 0, year), F.lit(1), F.lit(4)), "week")
    found = F.date_add(first, (week - 1) * 7 + day - 1)
    valid = (week >= 1) & day.between(1, 7) & (F.weekofyear(found) == week)
    by_week = F.when(valid, F.date_format(found, "yyyy-MM-dd"))
    return F.when(text.contains("W"), by_week).otherwise(F.coalesce(plain, text))


def parse_any_iso(col: Column) -> Column:
    """The forms of ``ANY_ISO``, brought to the one that a cast reads."""
    clock = F.regexp_replace(F.regexp_extract(col, ANY_ISO, 2), ":", "")
    hour, minute, second = (F.substring(clock, i, 2) for i in (1, 3, 5))
    two = lambda c: F.when(c != "", c).otherwise("00")
    fraction = F.left(F.regexp_extract(clock, r"[.,](\d+)$", 1), F.lit(6))
    zone = F.regexp_replace(F.regexp_extract(col, ANY_ISO, 3), r"^([+-]\d{2}):?(\d{2}):?", "$1:$2:")
    zone = F.regexp_replace(zone, ":$", "")
    date = iso_date(F.regexp_extract(col, ANY_ISO, 1))
    text = F.concat(date, F.lit("T"), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), fraction, zone)
    return F.when(col.rlike(ANY_ISO), F.regexp_replace(text, r"\.($|Z|[+-])", "$1").try_cast("timestamp"))


def parse_iso(col: Column) -> Column:
    """ISO 8601 text to timestamp; no zone means UTC (the session zone); null when it is not ISO."""
    common = F.replace(col, F.lit(","), F.lit(".")).try_cast("timestamp")
    return F.when(col.rlike(ISO_TIME), common).otherwise(parse_any_iso(col))


def parse_access_log(col: Column) -> Column:
    """Time as web server access logs write it. The pattern check keeps other texts off the slow parser."""
    parsed = F.try_to_timestamp(col, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.when(col.rlike(ACCESS_LOG_TIME), parsed)


def normalise_timestamp(text: Column, epoch_seconds: Column | None, default: Column) -> Column:
    """Event time from stripped ISO text, access-log text or a numeric epoch, else ``default``."""
    parsed = [parse_iso(text), parse_access_log(text)]
    if epoch_seconds is not None:
        # 0001-01-01 .. 9999-12-31, the range a calendar date can take
        in_range = epoch_seconds.between(-62135596800.0, 253402300799.0)
        micros = F.when(in_range, F.round(epoch_seconds * 1000000).cast("bigint"))
        parsed.insert(0, F.timestamp_micros(micros))
    return F.coalesce(*parsed, default)


def source_hour(text: Column, utc_time: Column) -> Column:
    """Hour as written by the source, before any shift to UTC; the UTC hour when it is not readable."""
    written = F.regexp_extract(strip(text), rf"^(?:{ISO_DATES}).(\d{{2}})", 1)
    return F.coalesce(F.nullif(written, F.lit("")).try_cast("int"), F.hour(utc_time))


def safe_double(col: Column, default: float | None = None) -> Column:
    """Number from text, else ``default``; blanks around it are ignored, a type suffix as in ``1.5d`` is not."""
    text = col.cast("string")
    number = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def safe_int(col: Column) -> Column:
    """Integer from text, blanks around it ignored; a text with a fraction is not an integer."""
    return col.cast("string").try_cast("int")


def clean_latency(col: Column) -> Column:
    """Latency in ms: unreadable or negative becomes 0."""
    return F.greatest(F.lit(0.0), safe_double(col, 0.0))


def clean_error_code(col: Column) -> Column:
    """Error code, null when unreadable or negative."""
    code = safe_int(col)
    return F.when(code >= 0, code)


def clean_service(col: Column) -> Column:
    return F.lower(strip(col))
