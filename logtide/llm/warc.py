"""Resolution of not-modified revisit records against earlier captures.

A revisit says that a page had not changed and carries no body. It is joined to the latest response of the same canonical
URL that was captured before it; if the validators agree, its record becomes that response with the headers that a
not-modified answer may update.

The as-of join is split by time: captures of a URL are cut into slices, the last response of each slice is carried to the
slices behind it by a short window over slices, and a window inside each slice finds the rest. A URL or host with a third
of all captures is spread over its slices. Records are stored once under a row number; only numbers, ids and times go through
the windows, and headers are joined to the result by row number, so records that share an id are resolved each.

Rules. Equal times are not earlier; of responses at one time the one with the largest id counts (a null id last), of those
with one id the one with the largest row hash. A validator is compared
if both sides have it: the entity tag without its weak mark, the time of last modification, the payload digest. All that
are compared must agree. A revisit without URL or time has no earlier response. Header names are lower-cased, of names
that differ only in case the last entry counts, null headers are empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import row_hash
from logtide.session import materialise

# The fields that a 304 answer updates in a stored response (RFC 9110, 15.4.5).
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid)(=.*)?$"
SLICE_SECONDS = 7 * 86_400


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without a closing slash, sorted parameters without tracking ones."""
    url = F.trim(url)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    given = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def clean_headers(headers: Column) -> Column:
    """Header names in lower case; of equal names the last entry counts."""
    entries = F.transform(
        F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    last = F.filter(
        entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])
    )
    return F.map_from_entries(last)


def latest_earlier(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(row, base) of each revisit with key and time in rows (row, id, turn, key, at in microseconds, response).

    ``base`` is the row number of the last response before it, or null; ``turn`` breaks ties of responses.
    """
    cut = records.where(F.col("key").isNotNull() & F.col("at").isNotNull())
    cut = cut.withColumn("slice", F.floor(F.col("at") / (slice_seconds * 1_000_000)))
    place = F.struct("at", "id", "turn", "row")
    capture = F.when(F.col("response"), place)
    last = cut.where("response").groupBy("key", "slice").agg(F.max(place).alias("last"))
    # every slice that has a row gets the last response of the slices before it
    used = cut.where(~F.col("response")).select("key", "slice").distinct()
    steps = last.unionByName(used.withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    steps = steps.groupBy("key", "slice").agg(F.max("last").alias("last"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("key", "slice", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = cut.withColumn("near", F.max(capture).over(inside)).where(~F.col("response"))
    found = found.join(carried.where("carried IS NOT NULL"), ["key", "slice"], "left")
    return found.select("row", F.coalesce("near.row", "carried.row").alias("base"))


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per revisit: record_id, url (canonical), status, base_id, headers, digest.

    ``records`` has record_id, kind (``response`` or ``revisit``), url, at (timestamp), headers (map), digest. ``status``
    is ``resolved``, ``validator_mismatch``, ``no_validator`` or ``no_earlier_response``; only a resolved record takes the
    headers and the digest of its base.
    """
    known = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("bigint").alias("id"),
        canonical_url(F.col("url")).alias("key"),
        F.unix_micros("at").alias("at"),
        (F.col("kind") == "response").alias("response"),
        clean_headers(F.col("headers")).alias("headers"),
        "digest",
    )
    known = known.withColumns({"turn": row_hash(known), "row": F.monotonically_increasing_id()})
    known = materialise(known, "captures")  # row numbers must not change between the reads below
    pairs = latest_earlier(known.select("row", "id", "turn", "key", "at", "response"), slice_seconds)
    revisits = known.where(~F.col("response")).drop("response", "at").join(pairs, "row", "left")
    bases = known.where(F.col("response"))
    bases = bases.select(
        F.col("row").alias("stored_row"), F.col("id").alias("base_id"), F.col("headers").alias("stored"), F.col("digest").alias("payload")
    )
    # rows without a base match nothing; a number of their own keeps them from meeting in one task
    near = revisits.withColumn("near", F.coalesce("base", -1 - F.col("row")))
    both = near.join(bases, F.col("near") == F.col("stored_row"), "left")
    bare = lambda tag: F.regexp_replace(tag, r"^W/", "")
    equal = [
        bare(F.col("headers")["etag"]) == bare(F.col("stored")["etag"]),
        F.col("headers")["last-modified"] == F.col("stored")["last-modified"],
        F.col("digest") == F.col("payload"),
    ]
    agree = F.coalesce(*[F.when(~e, False) for e in equal], *[F.when(e, True) for e in equal])
    status = (
        F.when(F.col("base").isNull(), "no_earlier_response")
        .when(agree.isNull(), "no_validator")
        .when(agree, "resolved")
        .otherwise("validator_mismatch")
    )
    fresh = F.map_filter("headers", lambda k, v: k.isin(*UPDATED))
    kept = F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    done = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        F.col("id").alias("record_id"),
        F.col("key").alias("url"),
        "status",
        "base_id",
        F.when(done, F.map_concat(kept, fresh)).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("payload")).otherwise(F.col("digest")).alias("digest"),
    )


def header_text(headers: Column) -> Column:
    """Headers as sorted lines ``name: value``."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log made of the pages: each page as a response, later revisits of some, and revisits before others.

    Revisits come under another spelling of the URL; some have another entity tag, some no validator at all.
    """
    page = F.col("page_id").cast("bigint")
    seconds = F.lit(1_700_000_000) + page * 420
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    text = lambda c: c.cast("string")
    base = pages.select(page.alias("page"), "url", seconds.alias("seconds"), digest.alias("digest"), tag.alias("tag"))
    page, seconds = F.col("page"), F.col("seconds")
    first = base.select(
        (page * 4).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        F.timestamp_seconds(seconds).alias("at"),
        F.create_map(
            F.lit("Date"), text(seconds), F.lit("ETag"), F.col("tag"), F.lit("Content-Type"), F.lit("text/html"),
            F.lit("Last-Modified"), text(seconds - 1000),
        ).alias("headers"),
        "digest",
    )

    def revisit(rows: DataFrame, step: int, later: Column, tag: Column) -> DataFrame:
        at = seconds + later
        return rows.select(
            (page * 4 + step).alias("record_id"),
            F.lit("revisit").alias("kind"),
            F.concat("url", F.lit("#again")).alias("url"),
            F.timestamp_seconds(at).alias("at"),
            F.map_filter(
                F.create_map(
                    F.lit("date"), text(at), F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=60"),
                    F.lit("content-type"), F.lit("text/plain"),
                ),
                lambda k, v: v.isNotNull(),
            ).alias("headers"),
            F.lit(None).cast("string").alias("digest"),
        )

    weak = F.when(page % 10 == 4, F.lit('"changed"')).when(page % 10 == 6, F.lit(None)).otherwise(
        F.concat(F.lit("W/"), F.col("tag"))
    )
    late = revisit(base.where(page % 2 == 0), 1, (page % 40 + 1) * 86_400, weak)
    early = revisit(base.where(page % 7 == 0), 2, F.lit(-3600), F.col("tag"))
    return first.unionByName(late).unionByName(early)
