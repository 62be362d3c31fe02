"""Order-dependent operators: pure step functions, one scan per key for batches; quarry.streaming runs the same steps.

A step takes (state, row) and gives (state, outputs). Rows come in the order of their id; the scan streams a key's rows and
holds only its state, so a hot key takes the time of its rows but no more memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import IDS, id_block, with_carried

Step = Callable[[Any, dict], tuple[Any, list[dict]]]


def scan(rows: DataFrame, key: str, order: str, step: Step, schema: str, columns: list[str]) -> DataFrame:
    """Runs step over each key's rows in order. Null keys are left out."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                if row[key] != current:
                    current, state = row[key], None
                state, more = step(state, row)
                out += more
            yield pd.DataFrame(out, columns=names)

    wanted = list(dict.fromkeys([key, order, *columns]))
    return rows.where(F.col(key).isNotNull()).select(*wanted).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def dedup_step(state: list | None, row: dict, window: int = 5) -> tuple[list, list[dict]]:
    """Drops a record whose (type, hash) is among the last `window` stored ones; dropped records take no place."""
    state = state or []
    mark = [row["type"], row["data_hash"]]
    if mark in state:
        return state, []
    return [*state, mark][-window:], [row]


def loop_step(state: list | None, row: dict, least: int = 3, most: int = 50) -> tuple[list, list[dict]]:
    """Finds `least` equal calls in a row; the run is forgotten when it is reported."""
    state = [*(state or []), [row["type"], row["data_hash"]]][-most:]
    run = 0
    for mark in reversed(state):
        if mark != state[-1]:
            break
        run += 1
    if run >= least:
        return state[:-run], [{"session_id": row["session_id"], "id": row["id"], "type": row["type"], "run": run}]
    return state, []


def resolution_step(state: dict | None, row: dict, within: int = 10) -> tuple[dict, list[dict]]:
    """After an error, the first success of the same tool (or a write after a failed read) among the next `within` records: the pair of ids.

    An error that names no tool is that of the last call before it.
    """
    state = state or {"last": "", "error": None}
    if row["category"] == "error" and row["type"] != "error_resolved":
        return state | {"error": [row["id"], row["tool"] or state["last"], within]}, []
    state = state | {"last": row["tool"]}
    if state["error"] is None:
        return state, []
    at, tool, left = state["error"]
    if row["tool"] == tool or tool == "read" and row["tool"] in ("edit", "write"):
        return state | {"error": None}, [{"session_id": row["session_id"], "error_id": at, "id": row["id"], "after": within - left + 1}]
    return state | {"error": [at, tool, left - 1] if left > 1 else None}, []


def flood_step(state: dict | None, row: dict, seconds: int = 60, soft: int = 3, hard: int = 8) -> tuple[dict, list[dict]]:
    """Counts records in a window anchored at its first: pass, slow above `soft`, block above `hard`; a later record opens the next window."""
    at = row["at"]
    if state is None or at - state["start"] > seconds * 1_000_000:
        state = {"start": at, "n": 0}
    state = {"start": state["start"], "n": state["n"] + 1}
    verdict = "block" if state["n"] > hard else "slow" if state["n"] > soft else "pass"
    return state, [{"session_id": row["session_id"], "id": row["id"], "n": state["n"], "verdict": verdict}]


def carry_step(state: list | None, row: dict, least: float = 0.55, sure: float = 0.9) -> tuple[list, list[dict]]:
    """The project of a record; without one, the last that a record named surely, else the last that one named with enough confidence."""
    state = state or [None, None]
    own, c = row["project_dir"] or None, row["attribution_confidence"]
    c = c if c is not None and c == c else 0
    if own:
        state = [own if c >= sure else state[0], own if c >= least else state[1]]
    project = own or state[0] or state[1]
    return state, [{"session_id": row["session_id"], "id": row["id"], "project": project, "carried": own is None and project is not None}]


def evict_step(state: list | None, row: dict, most: int = 1000) -> tuple[list, list[dict]]:
    """A bounded log: when it is full, the record of the lowest priority number and then the oldest leaves. Outputs what leaves."""
    heap = state or []
    out = []
    if len(heap) >= most:
        gone = heapq.heappop(heap)
        out.append({"session_id": row["session_id"], "id": gone[1], "priority": gone[0], "by": row["id"]})
    heapq.heappush(heap, [row["priority"], row["id"]])
    return heap, out


def stored_events(events: DataFrame, window: int = 5) -> DataFrame:
    return scan(events, "session_id", "id", lambda s, r: dedup_step(s, r, window), "session_id string, id long, type string, data_hash string", ["type", "data_hash"])


def retry_loops(events: DataFrame, least: int = 3) -> DataFrame:
    return scan(events, "session_id", "id", lambda s, r: loop_step(s, r, least), "session_id string, id long, type string, run long", ["type", "data_hash"])


def tool_of() -> Column:
    """The tool of a record: the one its data names, else that of its type."""
    named = F.lower(F.regexp_extract("data", r"(?i)(?:^|[\s,|;])tool:\s*([^\s,|;]+)", 1))
    by_type = F.coalesce(*[F.when(F.col("type") == t, n) for t, n in (("file_read", "read"), ("file_write", "write"), ("file_edit", "edit"), ("bash_outcome", "bash"), ("error_tool", ""))], F.col("type"))
    return F.when(named != "", named).otherwise(by_type)


def resolved_errors(events: DataFrame, within: int = 10) -> DataFrame:
    return scan(events.withColumn("tool", tool_of()), "session_id", "id", lambda s, r: resolution_step(s, r, within), "session_id string, error_id long, id long, after long", ["type", "category", "tool"])


def flood_verdicts(events: DataFrame, seconds: int = 60, soft: int = 3, hard: int = 8) -> DataFrame:
    timed = events.where("created_at is not null").withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("order", F.struct("at", "id"))
    timed = timed.withColumn("seq", F.concat(F.lpad(F.col("at").cast("string"), 20, "0"), F.lpad(F.col("id").cast("string"), 20, "0")))
    return scan(timed, "session_id", "seq", lambda s, r: flood_step(s, r, seconds, soft, hard), "session_id string, id long, n long, verdict string", ["id", "at"])


def carried_projects(events: DataFrame, least: float = 0.55, sure: float = 0.9, width: int = IDS) -> DataFrame:
    """carry_step for stored records, as windows over blocks of a session."""
    own, c = F.nullif(F.col("project_dir"), F.lit("")), F.col("attribution_confidence")
    rows = with_carried(events.select("session_id", "id", "project_dir", "attribution_confidence"), ["session_id"], ["id"], id_block(width), F.when(c >= sure, own), "__sure")
    rows = with_carried(rows, ["session_id"], ["id"], id_block(width), F.when(c >= least, own), "__likely")
    before = F.coalesce("__sure", "__likely")
    return rows.select("session_id", "id", F.coalesce(own, before).alias("project"), (own.isNull() & before.isNotNull()).alias("carried"))


def evicted_events(events: DataFrame, most: int = 1000) -> DataFrame:
    """What a bounded log would have dropped. Records with null priority count as 2."""
    return scan(events.withColumn("priority", F.coalesce("priority", F.lit(2))), "session_id", "id", lambda s, r: evict_step(s, r, most), "session_id string, id long, priority long, by long", ["priority"])
