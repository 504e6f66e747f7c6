"""Reading the catalogue tables of one data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as blanks around an id.
BLANKS = " \t\r\n\f\v "


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bare(col: Column | str) -> Column:
    """An id or name without surrounding blanks and case; blank counts as null."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(c != "", c)


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key by *order*; ties go to the greatest values.

    One hash aggregation with a partial step on the map side: no sort, and
    repeats of a row collapse before the shuffle.
    """
    picked = F.max(F.struct(*[F.col(c) for c in [*order, *[v for v in values if v not in order]]])).alias("_last")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])
