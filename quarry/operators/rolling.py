"""Totals and averages over trailing periods, for every entity and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.tables import records


def rolling_totals(
    events: DataFrame,
    entity: str = "project_dir",
    at: str = "created_at",
    measures: Sequence[str] = ("bytes_avoided", "bytes_returned"),
    periods: Sequence[int] = (7, 30),
    key: str = "id",
) -> DataFrame:
    """One row per entity and day from the entity's first to its last day with records.

    Columns: entity, day DATE, n_records, then per measure m its total of the day (m) and
    per period p the total m_sum_p and the average m_avg_p of the p days ending on the day.
    Days without records count as 0, also those before the first; averages divide by p.

    Defined results: a redelivered record (same key, equal columns) counts once; null or empty
    entity, or null time: left out; null measure: 0; empty input: no rows; ties in time don't
    matter; other columns of events are never read, so their names can't clash. Totals are LONG.

    Plan: redeliveries collapse on the evenly spread key; partial sums reduce an entity's rows to
    one per day before they move, so a hot entity is as cheap as any other; the calendar is
    entity x day with bounds per entity (no product over all entities); the window holds one
    entity's days, bounded by the calendar and not by the number of records.
    """
    rows = records(
        events.where((F.col(entity) != "") & F.col(at).isNotNull()),
        key,
        F.col(entity).alias("__entity"),
        F.to_date(at).alias("__day"),
        *[F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(f"__m{i}") for i, m in enumerate(measures)],
    )
    daily = rows.groupBy("__entity", "__day").agg(
        F.count("*").alias("n_records"), *[F.sum(f"__m{i}").alias(f"__m{i}") for i in range(len(measures))]
    )
    span = daily.groupBy("__entity").agg(F.min("__day").alias("__a"), F.max("__day").alias("__b"))
    calendar = span.select("__entity", F.explode(F.sequence("__a", "__b")).alias("__day"))
    dense = calendar.join(daily, ["__entity", "__day"], "left")
    by = Window.partitionBy("__entity").orderBy("__day")
    filled = {f"__m{i}": F.coalesce(F.col(f"__m{i}"), F.lit(0)) for i in range(len(measures))}
    dense = dense.withColumns(filled | {"n_records": F.coalesce("n_records", F.lit(0))})
    out = [F.col("__entity").alias(entity), F.col("__day").alias("day"), F.col("n_records")]
    for i, m in enumerate(measures):
        out.append(F.col(f"__m{i}").alias(m))
        for p in periods:
            total = F.sum(f"__m{i}").over(by.rowsBetween(1 - p, 0))
            out += [total.alias(f"{m}_sum_{p}"), (total / F.lit(p)).alias(f"{m}_avg_{p}")]
    return dense.select(*out)


def quiet_days_above(panel: DataFrame, entity: str = "project_dir", measure: str = "bytes_avoided", short: int = 7, long: int = 30) -> DataFrame:
    """Days of a rolling_totals panel without records on which the short average exceeds the long one.

    Compared as whole numbers (long x sum_short > short x sum_long), so rounding can't decide.
    """
    above = F.col(f"{measure}_sum_{short}") * long > F.col(f"{measure}_sum_{long}") * short
    return panel.where((F.col("n_records") == 0) & above).select(entity, F.date_format("day", "yyyy-MM-dd").alias("day"))
