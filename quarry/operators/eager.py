"""Per-key results through a join, without a task per hot key: aggregate first, then join states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.tables import records


def eager_rollup(
    events: DataFrame,
    meta: DataFrame,
    keys: Sequence[str] = ("project_dir", "session_id"),
    on: str = "session_id",
    measures: Sequence[str] = ("bytes_avoided", "bytes_returned"),
    weights: Sequence[str] = ("event_count", "compact_count"),
    key: str = "id",
) -> DataFrame:
    """Per value of each key what `events LEFT JOIN meta USING (on) GROUP BY key` gives, never joining rows.

    Columns: field (the key's name), key_value, n_records, n_joined (rows of the join), then per
    measure its total over the records and per weight its total over the joined rows, n_total
    (all records, whatever their keys).

    Defined results: redelivered records count once; null key: no result row, but the record counts in
    n_total; the empty string is a value; null in `on`: the record joins nothing; repeated rows
    of meta multiply as in the join; null measure or weight: 0; empty input: no rows.

    Plan (eager aggregation): events shrink to one state per (keys, on) with map-side combining,
    meta to one state per `on`; the two compact tables are joined and combined algebraically
    (counts multiply, sums scale with the other side's count), then rolled up per key in one
    pass. A key holding a third of the rows never meets its rows in one task.
    """
    names = list(dict.fromkeys([*keys, on]))
    rows = records(
        events, key, *[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)],
        *[F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(f"__m{i}") for i, m in enumerate(measures)],
    )
    cols = [f"__k{i}" for i in range(len(names))]
    left = rows.groupBy(*cols).agg(F.count("*").alias("n"), *[F.sum(f"__m{i}").alias(f"__m{i}") for i in range(len(measures))])
    right = meta.where(F.col(on).isNotNull()).groupBy(F.col(on).alias("__on")).agg(
        F.count("*").alias("n_meta"), *[F.sum(F.coalesce(F.col(w).cast("long"), F.lit(0))).alias(f"__w{i}") for i, w in enumerate(weights)]
    )
    joined = left.join(right, left[f"__k{names.index(on)}"] == right["__on"], "left")
    state = joined.select(
        *[F.col(f"__k{names.index(k)}").alias(f"__v{i}") for i, k in enumerate(keys)],
        F.col("n"),
        (F.col("n") * F.coalesce("n_meta", F.lit(1))).alias("n_joined"),
        *[F.col(f"__m{i}") for i in range(len(measures))],
        *[(F.col("n") * F.coalesce(f"__w{i}", F.lit(0))).alias(f"__w{i}") for i in range(len(weights))],
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"__v{i}").cast("string").alias("key_value")) for i, k in enumerate(keys)])
    rolled = state.select("*", F.explode(pairs).alias("p")).where(F.col("p.key_value").isNotNull()).groupBy(
        F.col("p.field").alias("field"), F.col("p.key_value").alias("key_value")
    ).agg(
        F.sum("n").alias("n_records"),
        F.sum("n_joined").alias("n_joined"),
        *[F.sum(f"__m{i}").alias(m) for i, m in enumerate(measures)],
        *[F.sum(f"__w{i}").alias(w) for i, w in enumerate(weights)],
    )
    total = left.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
    return rolled.withColumn("n_total", total.scalar())


def heavy_keys(rolled: DataFrame, percent: int = 4) -> DataFrame:
    """Keys of an eager_rollup that hold at least `percent` % of all records.

    A left join keeps every record at least once, so a key whose joined rows are fewer than its records lost states and isn't reported.
    """
    held = (F.col("n_records") * 100 >= F.col("n_total") * percent) & (F.col("n_joined") >= F.col("n_records"))
    return rolled.where(held).select("field", "key_value")
