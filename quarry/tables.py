"""The tables of the project: names, schemas, loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that str.strip() removes in ASCII, and the no-break space.
BLANKS = " \t\n\r\x0b\x0c "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_type(c: Column | str) -> Column:
    """The spelling in which event types are compared: trimmed, lower case, '-' read as '_'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(F.btrim(c, F.lit(BLANKS))), "-", "_")


def records(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """One row per record: redelivered rows are equal in all columns, so equal rows under one key collapse.

    Rows whose key is null are no records and are left out. Hash aggregation on the
    key and the few columns given; keys are spread evenly, whatever the hot values are.
    """
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("__id"), *columns).distinct()
