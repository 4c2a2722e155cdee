"""The registered queries of the corpus operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtide.llm import audit, codes, decontam, exact, jaccard, lm, mixing, quality, secrets, substring, suffix, toxicity, warc
from logtide.llm.common import table
from logtide.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op10_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)""",
)
def exact_dedup(spark, sf_dir):
    index = exact.DigestIndex(spark, scratch_path(spark, "digest-index"))
    return exact.report_copies(table(spark, sf_dir, "documents"), index)


def _secret_sql() -> str:
    """Positions from the lengths of the matches and of the text between them."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(rf"""
          SELECT doc_id, {i} AS kind_no, '{r.kind}' AS kind,
                 list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x)))
                 + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda x: length(x))), 0) AS s,
                 length(hits[i]) AS n
          FROM (SELECT doc_id, hits, tested, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits,
                   regexp_extract_all(text, '{pattern}', {r.group}) AS tested,
                   string_split_regex(text, '{pattern}') AS gaps FROM t))
          WHERE length(tested[i]) >= {r.least}""")
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    f AS ({" UNION ALL ".join(parts)}),
    j AS (
      SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
             count(*) FILTER (kind_no = 2) AS n_hex,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, kind_no)
               FILTER (kind_no < 3) AS base,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, kind_no) AS spans
      FROM f GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN j USING (doc_id)"""


@query("op5_secrets", _secret_sql())
def find_secrets(spark, sf_dir):
    found = secrets.scan_over_time(table(spark, sf_dir, "documents"), scratch_path(spark, "blob-ledger"))
    return secrets.digest_columns(found)


@query(
    "op3_decontamination",
    rf"""
    WITH d AS (
      SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
    i AS (
      SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
    x AS (SELECT doc_id, len(w) AS m, unnest(w) AS token, unnest(range(len(w))) AS p FROM d),
    y AS (
      SELECT item_id, len(w) AS n, least({decontam.STRETCH}, len(w)) AS need, unnest(w) AS token, unnest(range(len(w))) AS q FROM i),
    g AS (
      SELECT doc_id, m, item_id, n, need, p - q AS shift, list(q) AS same FROM x JOIN y USING (token)
      GROUP BY ALL HAVING count(*) >= ceil(need * {decontam.SHARE}::DECIMAL(3, 2))),
    s AS (
      SELECT *, unnest(range(greatest(-shift, 0), least(n - need, m - shift - need) + 1)) AS s FROM g),
    e AS (
      SELECT doc_id, item_id, need, shift + s AS place, len(list_filter(same, lambda q: q >= s AND q < s + need)) AS equal FROM s),
    b AS (
      SELECT doc_id, item_id, max(equal::DOUBLE / need) AS similarity, arg_max(place, (equal::DOUBLE / need, -place)) AS place
      FROM e WHERE equal >= ceil(need * {decontam.SHARE}::DECIMAL(3, 2)) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, round(similarity, 6) AS similarity, place AS at FROM b""",
)
def decontamination(spark, sf_dir):
    found = decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key").withColumn("similarity", F.round("similarity", 6))


@query(
    "op2_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5('mix' || coalesce(':' || doc_id, '')) AS turn
      FROM documents),
    src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1 AS number FROM src),
    c AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + number % 3] AS weight, source_size * 2.0::DOUBLE AS cap FROM w),
    l AS (
      SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM c),
    f AS (SELECT arg_min(level, (cap / weight, number)) AS level FROM l WHERE level * weight <= cap),
    g AS (SELECT source, number, source_size, least(f.level * weight, cap) AS target FROM l, f),
    p AS (
      SELECT doc_id, d.source, size, source_size, target, round(target)::BIGINT AS goal,
             [-0.5::DOUBLE, 0.0, 0.5][1 + number % 3] AS tilt,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
    q AS (
      SELECT *, greatest(least(size, goal - start), 0) AS first_copy,
             greatest(least(size, goal - start - source_size), 0) AS second_copy,
             CASE WHEN target > 0 THEN least(start / target, 1.0) ELSE 0 END AS share
      FROM p)
    SELECT doc_id, size, source_size, target, (first_copy + second_copy)::BIGINT AS taken,
           ((first_copy > 0)::INT + (second_copy > 0)::INT)::BIGINT AS copies,
           CASE WHEN first_copy > 0 THEN round(CASE WHEN tilt = 0 THEN share ELSE
             2.0 * share / (1.0 - tilt + sqrt(greatest((1.0 - tilt) * (1.0 - tilt) + 4.0 * tilt * share, 0.0))) END, 9)
           END AS position
    FROM q""",
)
def mixing_query(spark, sf_dir):
    return mixing.report_mix(table(spark, sf_dir, "documents"))


@query(
    "op6_substring_dedup",
    rf"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS i FROM t WHERE len(w) >= {substring.WINDOW}),
    k AS (
      SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(list_slice(w, i, i + {substring.WINDOW - 1}), ' '))
        ORDER BY doc_id, i) AS turn FROM s),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS p FROM k WHERE turn > 1),
    x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
    c AS (
      SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (g.p IS NULL) AS kept
      FROM x LEFT JOIN g USING (doc_id, p) GROUP BY doc_id)
    SELECT t.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM t LEFT JOIN c USING (doc_id)""",
)
def substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring.drop_repeated_windows(docs, carry=["doc_id"])
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op9_suffix_dedup",
    f"""
    WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    q AS (
      SELECT doc_id, h, length(h) // 2 - {suffix.LENGTH - 1} AS n, unnest(range(0, length(h) // 2 - {suffix.LENGTH - 1}, 500)) AS base
      FROM t WHERE length(h) >= {2 * suffix.LENGTH}),
    s AS (
      SELECT doc_id, base, substring(h, 2 * base + 1, {2 * (suffix.LENGTH + 499)}) AS piece, unnest(range(0, least(500, n - base))) AS j
      FROM q),
    k AS (
      SELECT doc_id, base + j AS i, row_number() OVER (
        PARTITION BY md5_number(substring(piece, 2 * j + 1, {2 * suffix.LENGTH})) ORDER BY doc_id, base + j) AS turn
      FROM s),
    g AS (
      SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffix.LENGTH}, true)::INT AS new
      FROM k WHERE turn > 1),
    r AS (
      SELECT doc_id, min(i) AS begins, max(i) + {suffix.LENGTH} AS ends
      FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
    p AS (
      SELECT doc_id, begins, ends, coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY begins), 0) AS before FROM r),
    c AS (
      SELECT doc_id, sum(ends - begins)::BIGINT AS n_removed, count(*) AS n_spans, max(ends) AS last,
             string_agg(substring(h, 2 * before + 1, 2 * (begins - before)), '' ORDER BY begins) AS kept
      FROM p JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM t LEFT JOIN c USING (doc_id)""",
)
def suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix.drop_repeated_strings(docs, carry=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query(
    "op8_jaccard_join",
    r"""
    WITH RECURSIVE t AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN 'short ' || array_to_string(w, ' ')
        ELSE array_to_string(list_slice(w, i, i + 3), ' ') END AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (
      SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.size + y.size - shared)),
    r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
    SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, (SELECT min(reached) FROM r WHERE r.node = d.doc_id) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id)""",
)
def jaccard_join(spark, sf_dir):
    return jaccard.report_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_language_model")
def language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", lm.id_remainder(7) == 2)
    model = lm.fit(docs.where(~F.col("held_out")).select("text"), order=3)
    scored = lm.score(docs, model)
    train = F.lit(model.tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", train, "base_score", "score")


@query("op1_toxicity")
def toxicity_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lm.id_remainder(5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    network = toxicity.fit_on(docs, labels)
    scored = toxicity.score(docs.withColumn("held_out", held_out), network)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query(
    "op4_revisits",
    r"""
    WITH b AS (
      SELECT page_id AS page, url, 1700000000 + page_id * 420 AS seconds, sha256(coalesce(html, '')) AS digest,
             '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag
      FROM pages),
    r AS (
      SELECT page * 4 AS record_id, 'response' AS kind, url, seconds AS moment, tag, digest, seconds FROM b
      UNION ALL
      SELECT page * 4 + 1, 'revisit', url || '#again', seconds + (page % 40 + 1) * 86400,
             CASE WHEN page % 10 = 4 THEN '"changed"' WHEN page % 10 = 6 THEN NULL ELSE 'W/' || tag END, NULL, seconds
      FROM b WHERE page % 2 = 0
      UNION ALL
      SELECT page * 4 + 2, 'revisit', url || '#again', seconds - 3600, tag, NULL, seconds FROM b WHERE page % 7 = 0),
    u AS (
      SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url,
                '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
             regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> ''
                AND NOT regexp_matches(p, '^(utm_[a-z]*|ref|fbclid|gclid)(=.*)?$'))) AS params
      FROM r),
    k AS (
      SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(params) > 0
                THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
      FROM u),
    j AS (
      SELECT v.record_id, v.key, v.moment, v.tag, arg_max(s.record_id, (s.moment, s.record_id)) AS base_id
      FROM k v LEFT JOIN k s ON s.kind = 'response' AND s.key = v.key AND s.moment < v.moment
      WHERE v.kind = 'revisit' GROUP BY ALL),
    m AS (
      SELECT j.*, s.digest AS stored, s.seconds, s.tag AS stored_tag,
             CASE WHEN base_id IS NULL THEN 'no_earlier_response' WHEN j.tag IS NULL THEN 'no_validator'
               WHEN regexp_replace(j.tag, '^W/', '') = s.tag THEN 'resolved' ELSE 'validator_mismatch' END AS status
      FROM j LEFT JOIN k s ON s.record_id = j.base_id)
    SELECT record_id, key AS url, status, base_id, CASE WHEN status = 'resolved' THEN stored END AS digest,
           'cache-control: max-age=60' || chr(10) || 'content-type: '
             || CASE WHEN status = 'resolved' THEN 'text/html' ELSE 'text/plain' END
             || chr(10) || 'date: ' || moment || coalesce(chr(10) || 'etag: ' || tag, '')
             || CASE WHEN status = 'resolved' THEN chr(10) || 'last-modified: ' || (seconds - 1000) ELSE '' END AS headers
    FROM m""",
)
def revisits(spark, sf_dir):
    records = warc.records_of_pages(table(spark, sf_dir, "pages"))
    return warc.resolve_revisits(records).withColumn("headers", warc.header_text(F.col("headers")))


def _codes_sql() -> str:
    """Every round written out: parts with their nearest entry, then the floors of the means."""
    steps = []
    for i in range(codes.ROUNDS + 1):
        steps.append(f"""
          a{i} AS MATERIALIZED (
            SELECT vec_id, label, p, min(d) AS d, arg_min(e, (d, e)) AS e, any_value(x) AS x
            FROM (SELECT v.*, b.e, list_sum(list_transform(list_zip(v.x, b.y), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d
                  FROM v JOIN b{i} b USING (p)) GROUP BY vec_id, label, p)""")
        if i < codes.ROUNDS:
            steps.append(f"""
          m{i} AS (
            SELECT p, e, list(m ORDER BY i) AS y
            FROM (SELECT p, e, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS m
                  FROM (SELECT p, e, unnest(x)::HUGEINT AS c, unnest(range(len(x))) AS i FROM a{i}) GROUP BY p, e, i)
            GROUP BY p, e),
          b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y::BIGINT[], b.y) AS y FROM b{i} b LEFT JOIN m{i} m USING (p, e))""")
    return f"""
    WITH k AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {codes.SCALE})::BIGINT) AS w FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (
      SELECT vec_id, label, p, list_slice(w, p * len(w) // {codes.PARTS} + 1, (p + 1) * len(w) // {codes.PARTS}) AS x
      FROM k, range({codes.PARTS}) AS r(p)),
    b0 AS MATERIALIZED (
      SELECT p, e, x AS y FROM v JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {codes.ENTRIES}) USING (vec_id)),
    {",".join(steps)},
    c AS (
      SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
      FROM a{codes.ROUNDS} GROUP BY vec_id, label),
    h AS (
      SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{codes.ROUNDS})
    SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"""


@query("op12_vector_codes", _codes_sql())
def vector_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query(
    "op13_filter_audit",
    r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
    d AS (
      SELECT doc_id, part,
             [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
              100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
             coalesce((SELECT bool_or(quality = 1) FROM labels l WHERE l.doc_id = w.doc_id), false) AS good,
             coalesce((SELECT bool_or(toxic = 1) FROM labels l WHERE l.doc_id = w.doc_id), false) AS toxic
      FROM w),
    g AS (
      SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
    f AS (SELECT i, chr(64 + i::INT) AS name FROM range(1, 6) AS r(i)),
    o AS (
      SELECT [a.i, b.i, c.i, d.i, e.i] AS ids, a.name || b.name || c.name || d.name || e.name AS filter_order
      FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    s AS (SELECT *, unnest(range(1, 6)) AS step FROM o),
    x AS (
      SELECT part, filter_order, step, ids[step] AS filter, n, good, toxic,
             list_bool_or(list_transform(list_slice(ids, 1, step - 1), lambda j: fails[j])) AS gone, fails[ids[step]] AS failed,
             len(list_filter(fails, lambda b: b)) = 1 AS alone
      FROM g, s),
    c AS (
      SELECT part, filter_order, step, filter,
             coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND NOT failed), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND failed), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (failed AND alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (NOT coalesce(gone, false) AND failed), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (NOT coalesce(gone, false) AND failed), 0)::BIGINT AS toxic_lost
      FROM x GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
    FROM c""",
)
def filter_audit(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit.audit(docs, labels, F.col("lang"), audit.text_failures(), "E")


@query("op11_line_quality")
def line_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lm.id_remainder(3) == 1
    field = quality.fit_on(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs.withColumn("held_out", held_out), field)
    return scored.select("doc_id", "held_out", "score", "predicted")
