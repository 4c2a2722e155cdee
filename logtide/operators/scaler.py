"""Standard scaling and train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.operators.quantiles import value_ranks

HASH_BITS = 60


def feature_values(df: DataFrame, columns: list[str], features: str = "features") -> DataFrame:
    """Feature struct members as double columns."""
    return df.select("*", *[F.col(f"{features}.{c}").cast("double").alias(f"f_{c}") for c in columns])


def fit_scaler(df: DataFrame, columns: list[str], struct: str | None = "features") -> DataFrame:
    """(feature, mean, scale, n), one row per feature, in one pass. A constant feature gets scale 1."""
    stats = []
    for c in columns:
        value = F.col(f"{struct}.{c}" if struct else c).cast("double")
        spread = F.stddev_pop(value)
        stats.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(value).alias("mean"),
                F.when(spread > 0, spread).otherwise(1.0).alias("scale"),
                F.count(F.lit(1)).alias("n"),
            )
        )
    return df.agg(F.explode(F.array(*stats)).alias("s")).select("s.*")


def scale_columns(scaler_rows, struct: str | None = "features") -> dict[str, Column]:
    """Scaled value of each feature as an expression, from the collected scaler table."""
    return {
        r["feature"]: (
            F.col(f"{struct}.{r['feature']}" if struct else r["feature"]).cast("double") - F.lit(r["mean"])
        )
        / F.lit(r["scale"])
        for r in scaler_rows
    }


def scale_features(df: DataFrame, scaler: DataFrame, struct: str | None = "features") -> DataFrame:
    """Add a ``scaled`` struct. The scaler has one row per feature; it comes in as a scalar subquery."""
    names = [r["feature"] for r in scaler.select("feature").collect()]
    params = scaler.agg(
        F.struct(
            *[F.max(F.when(F.col("feature") == n, F.col(k))).alias(f"{k}_{n}") for n in names for k in ("mean", "scale")]
        ).alias("p")
    )
    rows = df.withColumn("_p", params.scalar())
    cols = [
        (
            (F.col(f"{struct}.{n}" if struct else n).cast("double") - F.col("_p")[f"mean_{n}"])
            / F.col("_p")[f"scale_{n}"]
        ).alias(n)
        for n in names
    ]
    return rows.withColumn("scaled", F.struct(*cols)).drop("_p")


def seeded_hash(id_col: str, seed: int) -> Column:
    """60-bit number from seed and id, the same on every run and partitioning."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint")


MAX_LABELS = 1_000


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: exactly ceil(n * fraction) rows of each label, those with the smallest seeded hash.

    The cut per label comes from a banded rank, so a label with most of the rows is not ranked in one task.
    """
    rows = df.withColumn("_h", seeded_hash(id_col, seed))
    ranked = value_ranks(rows, "_h", band_width=2.0 ** (HASH_BITS - 12), by=[label])
    cut = ranked.filter(F.col("n_before") < F.ceil(F.col("n_all") * test_fraction))
    cuts = cut.groupBy(label).agg(F.max("_h").alias("_cut"))
    # one cut per label: a literal map instead of a shuffle of all rows by a column of few values
    found = cuts.limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    cut_of = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.lit(r["_cut"])) for r in found], F.lit(None))
    return rows.withColumn("is_test", F.col("_h") <= cut_of.cast("bigint")).drop("_h")
