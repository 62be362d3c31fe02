"""Structured Streaming: event-time windows with watermarks, and the state machines of quarry.operators.state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.state import Step


def timed(stream: DataFrame, at: str = "created_at", late: str = "1 day") -> DataFrame:
    """The stream with an event time and a watermark; redelivered records (same id) within it are dropped."""
    rows = stream.where(F.col(at).isNotNull()).withColumn("event_time", F.col(at).cast("timestamp"))
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(stream: DataFrame, key: str = "project_dir", width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Per window and key: records and bytes. Windows are final once the watermark has passed them."""
    rows = timed(stream, late=late)
    return rows.groupBy(F.window("event_time", width, slide or width).alias("w"), F.coalesce(key, F.lit("")).alias(key)).agg(
        F.count("*").alias("events"), F.sum(F.coalesce("bytes_avoided", F.lit(0))).alias("avoided")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events", "avoided")


def session_bursts(stream: DataFrame, gap: str = "10 seconds", late: str = "1 day") -> DataFrame:
    """Runs of records of a session with gaps of at most `gap`: start, size; runs of one are left out."""
    rows = timed(stream.where("session_id is not null"), late=late)
    runs = rows.groupBy(F.session_window("event_time", gap).alias("w"), "session_id").agg(F.count("*").alias("size"))
    return runs.where("size >= 2").select("session_id", F.col("w.start").alias("start"), "size")


def stateful(stream: DataFrame, key: str, order: str, step: Step, schema: str, columns: list[str]) -> DataFrame:
    """A step function over a stream: rows of a micro-batch in order, state kept per key between batches (as JSON)."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(_: Any, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out: list[dict] = []
        for row in rows.to_dict("records"):
            state, more = step(state, row)
            out += more
        kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    wanted = list(dict.fromkeys([key, order, *columns]))
    return stream.where(F.col(key).isNotNull()).select(*wanted).groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
