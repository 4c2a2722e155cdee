"""Exact ranks and percentiles without sorting all rows in one task.

Equal values are counted first, then each value learns how many rows lie before it by a two-level running sum:
over value bands, and inside each band. No task sees more than one band or the list of bands; choose ``band_width`` so that the values
span some ten thousand bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.session import materialise


def numbered(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Rows numbered from 1 in order of columns that no two rows share, without sorting all in one task.

    The rows are dealt to partitions by ranges of the order and sorted there; a window over the partitions' sizes, one row
    for each, tells how many rows lie before a partition.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = materialise(placed, "numbered")  # places must not change between the two reads
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def value_ranks(
    df: DataFrame,
    value: str,
    counts: dict[str, Column] | None = None,
    band_width: float = 1 / 65536,
    by: list[str] | None = None,
) -> DataFrame:
    """Per distinct value: each count, the count before it (``<name>_before``) and over all (``<name>_all``)."""
    by = by or []
    counts = counts or {"n": F.count(F.lit(1))}
    band = F.floor(F.col(value) / band_width).alias("_band")
    per_value = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[c.alias(name) for name, c in counts.items()])
        .select("*", band)
    )
    in_order = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    all_bands = Window.partitionBy(*by)
    totals = per_value.groupBy(*by, "_band").agg(*[F.sum(n).alias(n) for n in counts])
    offsets = totals.select(
        *by,
        "_band",
        *[F.coalesce(F.sum(n).over(in_order), F.lit(0)).alias(f"_{n}_band") for n in counts],
        *[F.sum(n).over(all_bands).alias(f"{n}_all") for n in counts],
    )
    inside = Window.partitionBy(*by, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per_value.join(offsets, [*by, "_band"])
    for n in counts:
        before = F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_{n}_band")
        ranked = ranked.withColumn(f"{n}_before", before)
    return ranked.drop("_band", *[f"_{n}_band" for n in counts])


def percentiles(
    df: DataFrame,
    value: str,
    points: dict[str, float],
    band_width: float = 1 / 65536,
    by: list[str] | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles (0..1), one column per point and the row count ``n``."""
    by = by or []
    ranked = value_ranks(df, value, band_width=band_width, by=by)

    def at(index: Column) -> Column:
        here = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(here, F.col(value)))

    cols = []
    for name, p in points.items():
        pos = F.lit(float(p)) * (F.col("n_all") - 1)
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        part = F.max(pos - F.floor(pos))
        cols.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(F.max("n_all").alias("n"), *cols)
