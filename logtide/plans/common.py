"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.plans.inputs import AS_OF, END


def stamp(name: str, alias: str | None = None) -> Column:
    """A time column as text, so both engines give the same value."""
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(alias or name)


def stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: stamp(n) for n in names})


def at(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def the_end() -> Column:
    return at(END)
