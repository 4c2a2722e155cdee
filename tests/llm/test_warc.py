import datetime as dt
import random

from logtide.llm import warc

SCHEMA = "record_id bigint, kind string, url string, at timestamp, headers map<string,string>, digest string, base bigint, id int"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def log(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)


def resolved(spark, rows, **kw):
    return {r["record_id"]: r for r in warc.resolve_revisits(log(spark, rows), **kw).collect()}


def test_canonical_urls(spark):
    same = [
        "http://www.Example.com:80/a/b/?utm_source=x&b=2&a=1#top",
        "https://user@example.com/a/b?a=1&b=2&ref=q",
        " HTTPS://example.com:443/a/b//?b=2&a=1",
    ]
    other = ["http://example.com/A/b?a=1&b=2", "http://example.com/a/b?a=1", "ftp://m.example.com/", "no url", "", None]
    docs = spark.createDataFrame([(u,) for u in same + other], "url string")
    got = [r[0] for r in docs.select(warc.canonical_url(docs["url"])).collect()]
    assert set(got[:3]) == {"example.com/a/b?a=1&b=2"}
    assert got[3:] == ["example.com/A/b?a=1&b=2", "example.com/a/b?a=1", "m.example.com", None, None, None]


def test_rules(spark):
    u = "http://e.com/x"
    rows = [
        (1, "response", u, at(1), {"ETag": '"a"', "Date": "1", "Server": "s"}, "d1"),
        (2, "response", u, at(5), {"ETag": '"b"', "Last-Modified": "m"}, "d2"),
        (3, "response", u, at(5), {"ETag": '"c"', "etag": '"d"'}, None),
        (10, "revisit", u + "#y", at(1), {}, None),
        (11, "revisit", u, at(4), {"etag": 'W/"a"', "date": "2", "server": "t", "Vary": "v"}, None),
        (12, "revisit", u, at(6), {"etag": '"d"'}, None),
        (13, "revisit", u, at(6), {"etag": '"c"'}, None),
        (14, "revisit", u, at(4), None, None),
        (15, "revisit", u, at(4), None, "d1"),
        (16, "revisit", u, at(4), {"etag": '"a"'}, "other"),
        (17, "revisit", None, at(4), {"etag": '"a"'}, None),
        (18, "revisit", u, None, {"etag": '"a"'}, None),
        (19, "request", u, at(4), {}, None),
        (20, None, u, at(4), {}, None),
    ]
    got = resolved(spark, rows)
    assert set(got) == set(range(10, 19))
    assert {i: (r["status"], r["base_id"]) for i, r in got.items()} == {
        10: ("no_earlier_response", None),
        11: ("resolved", 1),
        12: ("resolved", 3),
        13: ("validator_mismatch", 3),
        14: ("no_validator", 1),
        15: ("resolved", 1),
        16: ("validator_mismatch", 1),
        17: ("no_earlier_response", None),
        18: ("no_earlier_response", None),
    }
    assert got[11]["headers"] == {"etag": 'W/"a"', "date": "2", "server": "s", "vary": "v"} and got[11]["digest"] == "d1"
    assert got[16]["digest"] == "other" and got[14]["headers"] == {}


def test_hot_url_over_many_slices(spark):
    rng = random.Random(4)
    rows = [
        (i, rng.choice(["response", "revisit"]), rng.choice(["http://hot.com/", "http://hot.com/", f"http://e.com/{i % 5}"]), at(rng.randrange(0, 3000)), {}, "d")
        for i in range(1500)
    ]
    got = resolved(spark, rows, slice_seconds=3600 * 24)
    for i, kind, url, when, _, _ in rows:
        if kind == "revisit":
            before = [(w, k) for k, kk, u, w, _, _ in rows if kk == "response" and u == url and w < when]
            assert got[i]["base_id"] == (max(before)[1] if before else None)


def test_repeated_rows(spark):
    u = "http://e.com/x"
    rows = [(1, "response", u, at(1), {"etag": "a"}, None)] * 2 + [(2, "revisit", u, at(2), {"etag": "a"}, None)] * 2
    found = warc.resolve_revisits(log(spark, rows)).collect()
    assert [(r["record_id"], r["status"]) for r in found] == [(2, "resolved")] * 2


def test_records_that_share_an_id_are_resolved_each(spark):
    """Equal and null ids under different URLs, of revisits and of responses."""
    x, y, z = "http://a.com/x", "http://b.com/y", "http://c.com/z"
    rows = [
        (1, "response", x, at(1), {"etag": "a"}, "dx"),
        (2, "response", y, at(1), {"etag": "b"}, "dy"),
        (2, "response", z, at(1), {"etag": "c"}, "dz"),
        (None, "response", "http://d.com/", at(1), {"etag": "d"}, "dd"),
        (9, "revisit", x, at(2), {"etag": "a"}, None),
        (9, "revisit", y, at(2), {"etag": "b"}, None),
        (None, "revisit", z, at(2), {"etag": "c"}, None),
        (None, "revisit", "http://d.com/", at(2), {"etag": "d"}, None),
        (None, "revisit", "http://e.com/", at(2), {"etag": "d"}, None),
    ]
    found = sorted((r["url"], r["status"], r["base_id"], r["digest"]) for r in warc.resolve_revisits(log(spark, rows)).collect())
    assert found == [
        ("a.com/x", "resolved", 1, "dx"),
        ("b.com/y", "resolved", 2, "dy"),
        ("c.com/z", "resolved", 2, "dz"),
        ("d.com", "resolved", None, "dd"),
        ("e.com", "no_earlier_response", None, None),
    ]


def test_ties_of_one_id_do_not_depend_on_order(spark):
    u = "http://e.com/x"
    twins = [(1, "response", u, at(1), {"etag": t}, t) for t in "abcdef"] + [(None, "response", u, at(1), {"etag": "n"}, "n")]
    chosen = set()
    for some in (twins, twins[::-1]):
        rows = some + [(ord(t), "revisit", u, at(2), {"etag": t}, None) for t in "abcdefn"]
        got = resolved(spark, rows)
        assert {r["base_id"] for r in got.values()} == {1}
        chosen.add(tuple(i for i, r in sorted(got.items()) if r["status"] == "resolved"))
    assert len(chosen) == 1 and len(min(chosen)) == 1


def test_empty(spark):
    assert resolved(spark, []) == {}
