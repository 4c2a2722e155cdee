"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger remembers which rule versions have been
run on which blob; a scan runs only the missing pairs of blob and rule version, once per blob however many paths hold it,
and the findings are joined back to all paths. Everything is DataFrame work: matches come from ``regexp_extract_all``, the
text between them from ``split`` with the same pattern, and running lengths of both give positions in code points.

A null text is an empty blob. Rows that repeat a path and text share the findings. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import whole_text
from logtide.session import materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in their order.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    # a run below 24 characters is dropped whole, so only longer runs need to be matched
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost matches that do not overlap, as (start, kind, end); positions in code points, end exclusive."""
    between = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(
        F.slice(between, F.lit(1), F.size(matches)),
        F.zip_with(matches, checked, lambda m, c: F.struct(F.length(m).alias("n"), F.length(c).alias("c"))),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), m["n"].alias("n"), m["c"].alias("c")),
    )

    def put(acc: Column, step: Column) -> Column:
        start = acc["at"] + step["gap"]
        end = start + step["n"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        added = F.when(step["c"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), added.alias("spans"))

    none = F.array().cast(SPAN)
    first = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, first, put)["spans"]).otherwise(none)


class BlobLedger:
    """Stored tables below ``path``: ``scanned`` (blob, rule) and ``findings`` (blob, rule, spans)."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> None:
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _stored(self, name: str, schema: str) -> DataFrame:
        """What has been appended so far; a ledger that is new has no rows."""
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self._stored("scanned", "blob binary, rule string")

    def findings(self) -> DataFrame:
        """Spans per blob and rule version; a scan that was repeated after a loss is counted once."""
        return self._stored("findings", f"blob binary, rule string, spans {SPAN}").dropDuplicates(["blob", "rule"])

    def scan(self, versions: DataFrame, path_column: str = "doc_id") -> DataFrame:
        """Run what has not been run on the texts of ``versions``; returns (path, blob) of all rows.

        Findings are appended before the pairs are marked as scanned, so a job lost in between scans again and loses
        nothing.
        """
        named = versions.select(
            F.col(path_column).alias("path"), F.unhex(F.sha2(whole_text(), 256)).alias("blob"), whole_text().alias("text")
        )
        paths = materialise(named.select("path", "blob"), "blob-paths")
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        done = self.scanned().groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = (
            paths.groupBy("blob")
            .agg(F.min("path").alias("path"))
            .join(done, "blob", "left")
            .withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0)
            .select("blob", F.col("path").alias("first_path"), "todo")
        )
        todo = materialise(todo, "unseen-blobs")
        same = named["blob"] == todo["blob"]
        texts = named.join(todo, same & named["path"].eqNullSafe(todo["first_path"])).select(
            named["blob"], named["text"], "todo"
        )
        for_rules = F.array(
            *[
                F.struct(
                    F.lit(r.key).alias("rule"),
                    F.when(F.array_contains("todo", r.key), rule_spans(F.col("text"), r, i)).alias("spans"),
                )
                for i, r in enumerate(self.rules)
            ]
        )
        hits = F.filter(for_rules, lambda x: F.size(x["spans"]) > 0)
        found = texts.select("blob", hits.alias("hits")).where(F.size("hits") > 0)
        found.select("blob", F.inline("hits")).write.mode("append").parquet(f"{self.path}/findings")
        todo.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{self.path}/scanned")
        return paths

    def report(self, paths: DataFrame) -> DataFrame:
        """All paths with the spans found in their blob, sorted by start and kind."""
        current = [r.key for r in self.rules]
        spans = (
            self.findings()
            .where(F.col("rule").isin(current))
            .groupBy("blob")
            .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        )
        spans = materialise(spans, "blob-findings")
        return paths.join(spans, "blob", "left").select(
            "path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")
        )


def scan_over_time(versions: DataFrame, path: str, steps: int = 2, rules: tuple[Rule, ...] = RULES, before: int = len(BASE_RULES)) -> DataFrame:
    """The report on all versions, scanned as they would arrive: ``steps`` ranges of ``doc_id``, one after another.

    All ranges but the last are scanned with the first ``before`` rules. Then the other rules come in, and the ledger is
    shown every version again: of the blobs it knows only the new rules are run, of the others all.
    """
    early = BlobLedger(versions.sparkSession, path, rules[:before])
    cuts = versions.agg(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], 1000).alias("c")).first()["c"] or []
    for low, high in zip([None, *cuts], cuts, strict=False):
        part = versions.where(F.col("doc_id") <= high)
        early.scan(part if low is None else part.where(F.col("doc_id") > low))
    ledger = BlobLedger(versions.sparkSession, path, rules)
    return ledger.report(ledger.scan(versions))


def span_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(one, ",")


def digest_columns(report: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """The report as counts per base kind, a digest of the base spans and the text of all spans."""
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base_spans = F.filter("spans", lambda s: s["kind"] < base)
    return report.select(
        F.col("path").alias("doc_id"),
        *[of_kind(i).alias(f"n_{rules[i].kind}") for i in range(base)],
        F.sha2(span_text(base_spans, rules), 256).alias("base_sha256"),
        span_text(F.col("spans"), rules).alias("spans"),
    )
