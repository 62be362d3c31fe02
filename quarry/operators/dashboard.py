"""Aggregates over the activity log: rollups, ratios, bursts, scores. Every function takes and gives DataFrames.

`events` are records as `clean_events` gives them: one row per id, types in normal form. All aggregates combine on the map
side, so hot sessions and projects cost no more than others; the few windows are keyed by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import SECONDS, id_block, with_carried, with_previous
from quarry.tables import normal_type

UNKNOWN = "__unknown__"
# Types, categories and names of the log.
#: Types that are context, not tool use.
CONTEXT_TYPES = ("rule", "rule_content", "user_prompt", "intent", "data", "role", "cwd")
#: Categories and the types they count.
CATEGORY_TYPES = {
    "file": ("file_read", "file_write", "file_edit", "file_glob", "file_search"), "git": ("git",), "error": ("error_tool",), "subagent": ("subagent_launched", "subagent_completed"),
    "rejected-approach": ("rejected",), "latency": ("tool_latency",), "decision": ("decision", "decision_question"), "skill": ("skill",), "rule": ("rule", "rule_content"),
    "plan": ("plan_enter", "plan_exit", "plan_approved", "plan_rejected", "plan_file_write"), "intent": ("intent",), "blocked-on": ("blocker", "blocker_resolved"), "constraint": ("constraint_discovered",),
    "user-prompt": ("user_prompt",), "error-resolution": ("error_resolved",), "iteration-loop": ("retry_detected",), "env": ("env", "worktree"), "task": ("task_create", "task_update"), "mcp": ("mcp",),
    "agent-finding": ("agent_finding",), "external-ref": ("external_ref",), "role": ("role",), "cwd": ("cwd",), "data": ("data",),
}


def clean_events(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per record with `type` in normal form; rows delivered twice collapse.

    columns: what the query reads (id comes always); only these are read, compared and moved.
    """
    kept = [c for c in events.columns if columns is None or c == "id" or c in columns]
    rows = events.where("id is not null").select(*kept)
    return (rows.withColumn("type", normal_type("type")) if "type" in kept else rows).distinct()


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves up, as scripts round."""
    f = 10**digits
    return F.floor(x * f + 0.5) / F.lit(float(f)) if digits else F.floor(x + 0.5)


def ratio(a: Column, b: Column, scale: float = 100.0, digits: int = 1, otherwise: Column | float = 0.0) -> Column:
    return F.when(b > 0, half_up(a * F.lit(scale) / b, digits)).otherwise(otherwise)


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))


def is_type(*types: str) -> Column:
    return F.col("type").isin(*types)


# --- per session ----------------------------------------------------------------------------------------------------
def session_rollup(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Per session: calls, errors, distinct types and files, commit flag, whole minutes, references, KiB avoided, searches, most edits of a file, latest commit, compactions, edit-test cycles."""
    seconds = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    base = events.groupBy("session_id").agg(
        F.count("*").alias("tool_calls"),
        count_if(F.col("category") == "error").alias("errors"),
        F.count_distinct("type").alias("unique_tools"),
        F.count_distinct(F.when(F.col("category") == "file", F.col("data"))).alias("unique_files"),
        F.max(F.when(is_type("git_commit"), 1).otherwise(0)).alias("has_commit"),
        F.coalesce((F.floor((F.max(seconds) - F.min(seconds)) / 60)), F.lit(0)).alias("duration_min"),
        count_if(is_type("external_ref")).alias("sources_indexed"),
        F.floor(F.coalesce(F.sum("bytes_avoided"), F.lit(0)) / 1024).alias("kib_avoided"),
        count_if(is_type("file_search", "file_glob")).alias("search_queries"),
        F.max_by("data", F.when(is_type("git_commit"), F.col("id"))).alias("latest_commit"),
    )
    edits = max_file_edits(events)
    compacts = meta.select("session_id", "compact_count")
    return base.join(edits, "session_id", "left").join(compacts, "session_id", "left").select(
        *base.columns, F.coalesce("max_file_edits", F.lit(0)).alias("max_file_edits"), F.coalesce("compact_count", F.lit(0)).alias("compact_count"), F.least("unique_files", "errors").alias("edit_test_cycles")
    )


def max_file_edits(events: DataFrame) -> DataFrame:
    per_file = events.where((F.col("category") == "file") & is_type("file_edit", "file_write")).groupBy("session_id", "data").agg(F.count("*").alias("n"))
    return per_file.groupBy("session_id").agg(F.max("n").alias("max_file_edits"))


def latest_by_session(events: DataFrame) -> DataFrame:
    """Per session its number of records, latest attributed project and latest record."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("events"), F.max_by("project_dir", F.when(F.col("project_dir") != "", F.col("id"))).alias("latest_project"), F.max("id").alias("latest_id"), F.max_by("type", "id").alias("latest_type")
    )


def project_sessions(events: DataFrame) -> DataFrame:
    """Distinct (project, session) with separators and trailing slashes of the path made equal."""
    path = F.regexp_replace(F.regexp_replace("project_dir", r"\\", "/"), "/+$", "")
    return events.where("project_dir <> ''").select(path.alias("project"), "session_id").distinct()


def bytes_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(
        F.coalesce(F.sum("bytes_avoided"), F.lit(0)).alias("avoided"), F.coalesce(F.sum("bytes_returned"), F.lit(0)).alias("returned"), F.sum(F.length("data")).cast("long").alias("data_chars")
    )


def is_commit() -> Column:
    """A commit: a git record whose data is that operation or a command that does it; other git records don't count."""
    return (F.col("type") == "git") & F.rlike(F.lower("data"), F.lit(r"^\s*commit\s*$|\bgit\b[^|;&]*\bcommit\b"))


def time_to_commit(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Minutes from a session's start to its first commit."""
    first = events.where(is_commit()).groupBy("session_id").agg(F.min("created_at").alias("first"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return meta.join(first, "session_id").where("started_at is not null and first is not null").select("session_id", half_up((us("first") - us("started_at")) / 6e7, 1).alias("minutes"))


def session_durations(meta: DataFrame) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return meta.where("started_at is not null and last_event_at is not null").select("session_id", "event_count", "compact_count", half_up((us("last_event_at") - us("started_at")) / 6e7, 1).alias("duration_min"))


def edit_test_cycles(events: DataFrame, width: int | None = None) -> DataFrame:
    """Per session, how often a written file is directly followed by a tool's error: the record before, not a self join."""
    rows = with_previous(events.select("session_id", "id", "type"), ["session_id"], ["id"], id_block(*([width] if width else [])), F.col("type"), "before")
    return rows.where("before = 'file_write' and type = 'error_tool'").groupBy("session_id").agg(F.count("*").alias("cycles"))


def rework(events: DataFrame) -> DataFrame:
    return events.where(is_type("file_write", "file_read") & (F.col("data") != "")).groupBy("session_id", "data").agg(F.count("*").alias("edits")).where("edits > 1")


def commits_per_session(events: DataFrame, meta: DataFrame) -> DataFrame:
    git = events.where(is_type("git")).groupBy("session_id").agg(count_if(is_commit()).alias("commits"), F.max("project_dir").alias("git_project"))
    project = F.coalesce(F.nullif(F.col("git_project"), F.lit("")), F.nullif(F.col("project_dir"), F.lit("")), F.lit(UNKNOWN))
    return meta.join(git, "session_id", "left").select("session_id", project.alias("project"), F.coalesce("commits", F.lit(0)).alias("commits"))


def retry_storms(events: DataFrame, most: int = 3) -> DataFrame:
    return events.where("category = 'iteration-loop' or type = 'retry_detected'").groupBy("session_id").agg(F.count("*").alias("retries")).where(F.col("retries") > most)


def delegation_per_session(events: DataFrame) -> DataFrame:
    return events.where(is_type("subagent_launched")).groupBy("session_id").agg(F.count("*").alias("launched")).where("launched > 1")


def conversation_days(events: DataFrame) -> DataFrame:
    """Per session and UTC day: records, categories; null times left out."""
    return events.where("created_at is not null").groupBy("session_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("category").alias("categories"))


def span_seconds(events: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    return events.where("created_at is not null").groupBy("session_id").agg(((F.max(us) - F.min(us)) / 1e6).alias("seconds"), F.count("*").alias("events"))


# --- per value ------------------------------------------------------------------------------------------------------
TOOL_NAMES = {"file_read": "Read", "file_write": "Write", "file_edit": "Edit", "file_glob": "Glob", "file_search": "Grep", "git": "Git", "mcp": "Sandbox", "subagent": "Agent", "task": "Task", "error_tool": "Error"}


def tool_usage(events: DataFrame) -> DataFrame:
    tool = F.coalesce(*[F.when(is_type(t), n) for t, n in TOOL_NAMES.items()], F.col("type"))
    return events.where(~is_type(*CONTEXT_TYPES)).groupBy(tool.alias("tool")).agg(F.count("*").alias("calls"))


def by_prefix(events: DataFrame, types: tuple[str, ...], prefixes: tuple[str, ...], otherwise: int = 20) -> DataFrame:
    """Counts of records of the types by which prefix their data has, in the order given, else by their first characters."""
    name = F.coalesce(*[F.when(F.lower("data").startswith(p), p) for p in prefixes], F.substring("data", 1, otherwise))
    return events.where(is_type(*types)).groupBy(name.alias("tool")).agg(F.count("*").alias("calls"))


def error_tools(events: DataFrame, names: tuple[str, ...] = ("bash", "read", "edit", "write", "agent")) -> DataFrame:
    name = F.coalesce(*[F.when(F.lower("data").contains(n), n) for n in names], F.substring("data", 1, 30))
    return events.where("category = 'error'").groupBy(name.alias("tool")).agg(F.count("*").alias("errors"))


def file_activity(events: DataFrame, most: int = 20) -> DataFrame:
    """The most touched files; ties go by name, the operation shown is the least of those seen."""
    counts = events.where(is_type("file_read", "file_write", "file_edit") & (F.col("data") != "")).groupBy("data").agg(F.count("*").alias("touches"), F.min("type").alias("op"))
    return counts.orderBy(F.desc("touches"), "data").limit(most)


def hot_files(events: DataFrame, more_than: int = 3, most: int = 10) -> DataFrame:
    counts = events.where((F.col("category") == "file") & is_type("file_read", "file_edit", "file_write") & (F.col("data") != "")).groupBy("data").agg(F.count("*").alias("touches"))
    return counts.where(F.col("touches") > more_than).orderBy(F.desc("touches"), "data").limit(most)


def values_of(events: DataFrame, *types: str) -> DataFrame:
    """Values of the types with their count, share of all such records (one decimal) and last time."""
    counts = events.where(is_type(*types) & (F.col("data") != "")).groupBy("data").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))
    total = events.where(is_type(*types) & (F.col("data") != "")).agg(F.count("*").alias("n")).scalar()
    return counts.select("data", "n", half_up(F.col("n") * 100.0 / total, 1).alias("pct"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def category_counts(events: DataFrame) -> DataFrame:
    """Every category and declared type with its count, zero where there is none."""
    spark = events.sparkSession
    declared = spark.createDataFrame([(c, t) for c, ts in CATEGORY_TYPES.items() for t in ts], "category string, type string")
    seen = events.groupBy("category", "type").agg(F.count("*").alias("n"))
    return declared.join(seen, ["category", "type"], "left").select("category", "type", F.coalesce("n", F.lit(0)).alias("n"))


def category_previews(events: DataFrame, most: int = 5) -> DataFrame:
    """Per session and category: records, distinct values, and the first `most` distinct values (by first id), cut to 40 characters and joined."""
    firsts = events.where("data is not null and data <> ''").groupBy("session_id", "category", "data").agg(F.min("id").alias("first"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("session_id", "category").orderBy("first"))).where(F.col("rank") <= most)
    previews = ranked.groupBy("session_id", "category").agg(F.sort_array(F.collect_list(F.struct("rank", F.substring("data", 1, 40).alias("v")))).alias("p"))
    counts = events.groupBy("session_id", "category").agg(F.count("*").alias("events"))
    joined = counts.join(previews, ["session_id", "category"], "left")
    return joined.select("session_id", "category", "events", F.array_join(F.transform("p", lambda s: s["v"]), "; ").alias("previews"))


def rejections(events: DataFrame) -> DataFrame:
    tool = F.coalesce(F.nullif(F.trim(F.split_part("data", F.lit(":"), F.lit(1))), F.lit("")), F.lit("unknown"))
    return events.where("category = 'rejected-approach' and data is not null and data <> ''").groupBy(tool.alias("tool")).agg(F.count("*").alias("n"))


def latency_by_tool(events: DataFrame) -> DataFrame:
    """Calls, mean and greatest duration per tool of records that say `duration_ms:N` and `tool:NAME`."""
    rows = events.select(F.regexp_extract("data", r"(?:^|\s)tool:(\S+)", 1).alias("tool"), F.regexp_extract("data", r"(?:^|\s)duration_ms:(\d{1,15})(?:\s|$)", 1).alias("ms")).where("tool <> '' and ms <> ''")
    ms = F.col("ms").cast("long")
    return rows.groupBy("tool").agg(F.count("*").alias("calls"), half_up(F.avg(ms)).cast("long").alias("avg_ms"), F.max(ms).alias("max_ms"))


def latency_p95(events: DataFrame) -> DataFrame:
    """Mean and the value at index floor(0.95 n) of all durations. Values are counted; of each thousand of values only the total is ordered as a whole, then those of the thousand that holds the index."""
    rows = events.select(F.regexp_extract("data", r"(?:^|\s)duration_ms:(\d{1,15})(?:\s|$)", 1).alias("ms")).where("ms <> ''").select(F.col("ms").cast("long").alias("ms"))
    counts = rows.groupBy("ms").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.log2(F.col("ms") + 1) * 64))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    total = blocks.agg(F.sum("n").alias("n")).scalar()
    ahead = blocks.select("block", "n", F.sum("n").over(Window.orderBy("block")).alias("upto"))
    hit = ahead.where(F.col("upto") > F.floor(total * 0.95)).agg(F.min_by(F.struct("block", (F.col("upto") - F.col("n")).alias("before")), "block").alias("h"))
    inside = counts.join(F.broadcast(hit.select("h.block", "h.before")), "block").select("ms", (F.col("before") + F.sum("n").over(Window.orderBy("ms"))).alias("upto"))
    p95 = inside.where(F.col("upto") > F.floor(total * 0.95)).agg(F.min("ms").alias("ms")).scalar()
    return counts.agg(F.sum("n").alias("samples"), half_up(F.sum(F.col("ms") * F.col("n")) / F.sum("n")).cast("long").alias("avg_ms")).withColumn("p95_ms", p95)


def kv_median(events: DataFrame) -> DataFrame:
    """Per tool named in `tool:` its calls, median and greatest `lines:`; records without either are skipped."""
    rows = events.select(F.regexp_extract("data", r"(?:^|\s)tool:(\S+)", 1).alias("tool"), F.regexp_extract("data", r"(?:^|\s)lines:(\d{1,9})(?:\s|$)", 1).alias("v")).where("tool <> '' and v <> ''")
    v = F.col("v").cast("long")
    return rows.groupBy("tool").agg(F.count("*").alias("calls"), F.median(v).alias("median_lines"), F.max(v).alias("max_lines"))


def json_tool_usage(events: DataFrame) -> DataFrame:
    """Tools named in JSON data with calls, and median and greatest args.limit above 0; data that is no JSON is skipped."""
    j = F.try_parse_json("data")
    parsed = events.where(is_type("mcp_tool_call") & F.col("data").startswith("{")).select(F.try_variant_get(j, "$.tool", "string").alias("tool"), F.try_variant_get(j, "$.args.limit", "double").alias("v"))
    v = F.when(F.col("v") > 0, F.floor("v"))
    return parsed.where("tool is not null").groupBy("tool").agg(F.count("*").alias("calls"), F.median(v).alias("median_limit"), F.max(v).cast("double").alias("max_limit"))


# --- per project and time -------------------------------------------------------------------------------------------
def project_activity(events: DataFrame) -> DataFrame:
    confidence = F.coalesce("attribution_confidence", F.lit(0.0))
    return events.groupBy(F.coalesce(F.nullif(F.col("project_dir"), F.lit("")), F.lit(UNKNOWN)).alias("project")).agg(
        F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"), F.round(F.avg(confidence), 6).alias("avg_confidence"), count_if(confidence >= 0.8).alias("high_confidence")
    )


def attribution_summary(events: DataFrame) -> DataFrame:
    confidence = F.coalesce("attribution_confidence", F.lit(0.0))
    t = events.agg(F.count("*").alias("total"), count_if(F.coalesce("project_dir", F.lit("")) == "").alias("unknown"), F.sum(confidence).alias("c"), count_if(confidence >= 0.8).alias("high"))
    return t.select("total", "unknown", ratio(F.col("unknown"), F.col("total")).alias("unknown_pct"), ratio(F.round("c", 4), F.col("total")).alias("confidence_pct"), ratio(F.col("high"), F.col("total")).alias("high_pct"))


def carried_project(events: DataFrame, width: int | None = None) -> DataFrame:
    """Each record's project, or the last one named earlier in its session: per project the records it gets. Null sessions are left out."""
    own = F.nullif(F.col("project_dir"), F.lit(""))
    rows = with_carried(events.select("session_id", "id", "project_dir"), ["session_id"], ["id"], id_block(*([width] if width else [])), own, "last")
    return rows.groupBy(F.coalesce("last", F.lit(UNKNOWN)).alias("project")).agg(F.count("*").alias("events"))


def hourly(events: DataFrame) -> DataFrame:
    return events.where("created_at is not null").groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("events"))


def monday_week(c: str) -> Column:
    """Year and week counted from Mondays, week 00 before the first one."""
    day = F.to_date(c)
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")
    return F.format_string("%d-W%02d", F.year(day), week)


def weekly(meta: DataFrame) -> DataFrame:
    return meta.where("started_at is not null").groupBy(monday_week("started_at").alias("week")).agg(F.count("*").alias("sessions"), F.sum("event_count").alias("events"))


def weekly_errors(events: DataFrame) -> DataFrame:
    t = events.where("created_at is not null").groupBy(monday_week("created_at").alias("week")).agg(count_if(is_type("error_tool")).alias("errors"), F.count("*").alias("total"))
    return t.select("week", "errors", "total", ratio(F.col("errors"), F.col("total")).alias("error_rate"))


def sessions_by_date(meta: DataFrame) -> DataFrame:
    return meta.where("started_at is not null").groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("sessions"), F.sum("event_count").alias("events"), F.sum("compact_count").alias("compacts"))


def bursts(events: DataFrame, gap_s: int = 30, types: tuple[str, ...] = ("subagent_launched", "subagent_completed"), keys: tuple[str, ...] = ("session_id",), block_s: int = SECONDS) -> DataFrame:
    """Runs of records of a session (without keys: of all records) whose gaps are at most gap_s seconds: first_id, size, seconds; runs of one are kept."""
    rows = events.where(is_type(*types) & F.col("created_at").isNotNull()).select(*keys, "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    block = F.floor(F.col("at") / (block_s * 1_000_000))
    rows = with_previous(rows, keys, ["at", "id"], block, F.col("at"), "before")
    start = F.when(F.col("before").isNull() | (F.col("at") - F.col("before") > gap_s * 1_000_000), F.struct("at", "id"))
    runs = with_carried(rows, keys, ["at", "id"], block, start, "run")
    return runs.groupBy(*keys, "run").agg(F.min("id").alias("first_id"), F.count("*").alias("size"), ((F.max("at") - F.min("at")) / 1e6).alias("seconds")).drop("run")


def burst_summary(found: DataFrame) -> DataFrame:
    parallel = F.col("size") >= 2
    return found.agg(
        F.sum("size").alias("total"), count_if(parallel).alias("bursts"), F.max("size").alias("largest"), F.sum(F.when(parallel, F.col("size")).otherwise(0)).alias("parallel"),
        F.sum(F.when(~parallel, F.col("size")).otherwise(0)).alias("sequential"), F.sum(F.when(parallel, (F.col("size") - 1) * 2).otherwise(0)).alias("saved_min"),
    )


# --- totals ---------------------------------------------------------------------------------------------------------
def overview(events: DataFrame, meta: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    parts = [("events", events), ("sessions", meta), ("sources", sources), ("chunks", chunks.select("chunk_id").distinct())]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def ratios(events: DataFrame) -> DataFrame:
    t = events.agg(
        count_if(is_type("file_read")).alias("reads"), count_if(is_type("file_write")).alias("writes"), count_if(is_type("file_read", "file_glob", "file_search")).alias("explore"),
        count_if(is_type("mcp")).alias("sandbox"), count_if(~is_type(*CONTEXT_TYPES)).alias("calls"), count_if(is_type("error_tool")).alias("errors"),
    )
    c = F.col
    return t.select(
        "reads", "writes", "explore", "sandbox", "calls", "errors", ratio(c("reads"), c("writes"), 1.0, 1, c("reads").cast("double")).alias("read_write"), ratio(c("explore"), c("explore") + c("writes")).alias("explore_pct"),
        ratio(c("sandbox"), c("calls")).alias("sandbox_pct"), ratio(c("errors"), c("calls")).alias("error_pct"),
    )


def error_resolution(events: DataFrame) -> DataFrame:
    t = events.agg(count_if(F.col("category") == "error").alias("errors"), count_if(is_type("error_resolved")).alias("resolved"))
    return t.select("errors", "resolved", ratio(F.col("resolved"), F.col("errors")).alias("rate"))


def delegation(events: DataFrame) -> DataFrame:
    t = events.agg(count_if(is_type("subagent_launched")).alias("launched"), count_if(is_type("subagent_completed")).alias("done"))
    done = F.when(F.col("launched") > 0, F.least("done", "launched")).otherwise(F.col("done"))
    return t.select("launched", done.alias("completed"), ratio(done, F.col("launched")).alias("rate"), (done * 2).alias("saved_min"))


def governance(events: DataFrame) -> DataFrame:
    t = events.agg(count_if(is_type("rejected")).alias("rejections"), count_if(is_type("decision", "decision_question")).alias("decisions"), count_if(is_type("plan_approved")).alias("approved"), count_if(is_type("plan_rejected")).alias("plans_rejected"))
    return t.select("*", ratio(F.col("approved"), F.col("approved") + F.col("plans_rejected")).alias("approval_rate"))


def git_mix(events: DataFrame) -> DataFrame:
    """First word after `git` in the data of git records, with counts."""
    op = F.regexp_extract("data", r"(?:^|\s)git\s+([a-z-]+)", 1)
    return events.where("category = 'git'").select(op.alias("operation")).where("operation <> ''").groupBy("operation").agg(F.count("*").alias("n"))


def context_health(events: DataFrame, meta: DataFrame) -> DataFrame:
    t = events.agg(
        F.count_distinct(F.when(is_type("rule") & (F.col("data") != ""), F.col("data"))).alias("rule_files"), count_if(is_type("rule", "rule_content")).alias("rules"),
        F.count_distinct(F.when((F.col("category") == "skill") & (F.col("data") != ""), F.col("data"))).alias("skills"), count_if(is_type("blocker")).alias("blockers"), count_if(is_type("blocker_resolved")).alias("resolved"),
    )
    sessions = meta.agg(F.count("*").alias("n")).scalar()
    compacts = meta.agg(F.coalesce(F.sum("compact_count"), F.lit(0)).alias("n")).scalar()
    t = t.withColumns({"sessions": sessions, "compacts": compacts})
    c = F.col
    return t.select("rule_files", "skills", "blockers", "resolved", ratio(c("rules"), c("sessions"), 1.0, 2).alias("rules_per_session"), ratio(c("compacts"), c("sessions"), 100.0, 0).cast("long").alias("compact_rate"), ratio(c("resolved"), c("blockers")).alias("blocker_rate"))


def file_churn(events: DataFrame) -> DataFrame:
    own = events.where("category = 'file' and data <> ''")
    t = own.agg(F.count_distinct(F.when(is_type("file_write", "file_edit"), F.col("data"))).alias("edited"), F.count_distinct(F.when(is_type("file_read"), F.col("data"))).alias("read"))
    return t.select("edited", "read", ratio(F.col("edited"), F.col("read"), 1.0, 2).alias("churn"))


def scores(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Four composite scores from 0 to 100 and a flag for too little data."""
    c = F.col
    own = lambda *types: F.count_distinct(F.when((c("category") == "file") & is_type(*types) & (c("data") != ""), c("data")))
    t = events.agg(
        F.count("*").alias("events"), F.count_distinct(F.when(is_commit(), c("session_id"))).alias("commit_sessions"), count_if(is_type("subagent_launched")).alias("launched"), count_if(is_type("subagent_completed")).alias("done"),
        count_if(c("category") == "error").alias("errors"), count_if(is_type("error_resolved")).alias("resolved"), own("file_write", "file_edit").alias("edited"), own("file_read").alias("read"), count_if(c("category") == "agent-finding").alias("findings"),
        F.count_distinct(F.when(is_type("rule") & (c("data") != ""), c("data"))).alias("rules"), F.count_distinct(F.when((c("category") == "skill") & (c("data") != ""), c("data"))).alias("skills"),
        count_if(is_type("plan_approved")).alias("approved"), count_if(is_type("plan_rejected")).alias("rejected"), F.count_distinct(F.when(is_type("intent") & (c("data") != ""), c("data"))).alias("modes"),
    )
    found = bursts(events, 30, keys=())
    t = t.withColumns({"sessions": meta.agg(F.count("*").alias("n")).scalar(), "storms": retry_storms(events).agg(F.count("*").alias("n")).scalar(), "parallel": found.where("size >= 2").agg(F.count("*").alias("n")).scalar()})
    pct = lambda a, b: F.when(b > 0, a * 100.0 / b).otherwise(0.0)
    resolution = ratio(c("resolved"), c("errors"))
    capped = lambda x: F.least(F.lit(100), half_up(x)).cast("long")
    productivity = pct(c("commit_sessions"), c("sessions")) * 0.3 + F.least(F.lit(100.0), pct(c("launched"), c("sessions"))) * 0.2 + (100 - F.least(F.lit(100.0), pct(c("edited"), c("read")))) * 0.2 + resolution * 0.3
    quality = F.when(c("errors") == 0, 100.0).otherwise(resolution) * 0.4 + (100 - pct(c("storms"), c("sessions"))) * 0.3 + (100 - pct(c("errors"), c("events"))) * 0.3
    done = F.when(c("launched") > 0, F.least("done", "launched")).otherwise(c("done"))
    delegation = ratio(done, c("launched")) * 0.5 + F.when(c("parallel") > 0, 30.0).otherwise(0.0) + F.least(c("findings") / 5, F.lit(1.0)) * 20
    approval = F.when(c("approved") + c("rejected") > 0, ratio(c("approved"), c("approved") + c("rejected"))).otherwise(50.0)
    health = F.when(c("rules") > 0, 30.0).otherwise(0.0) + F.least(c("skills") * 20, F.lit(100)) * 0.2 + approval * 0.25 + F.when(c("modes") > 1, 25.0).otherwise(12.5)
    return t.select(capped(productivity).alias("productivity"), capped(quality).alias("quality"), capped(delegation).alias("delegation"), capped(health).alias("context_health"), ((c("events") < 50) | (c("sessions") < 3)).alias("insufficient"))


def savings(events: DataFrame) -> DataFrame:
    """Kept and returned bytes per type, KiB with one decimal, tokens (a quarter), percentage kept out."""
    t = events.groupBy("type").agg(F.count("*").alias("calls"), F.coalesce(F.sum("bytes_avoided"), F.lit(0)).alias("avoided"), F.coalesce(F.sum("bytes_returned"), F.lit(0)).alias("returned"))
    c = F.col
    return t.select("type", "calls", "avoided", "returned", half_up(c("avoided") / 1024, 1).alias("avoided_kib"), F.floor(c("avoided") / 4).alias("tokens"), ratio(c("avoided"), c("avoided") + c("returned")).alias("kept_pct"))


def capped_ledger(events: DataFrame, above: int = 32 * 1024, to: int = 2 * 1024) -> DataFrame:
    """Per session: calls, returned and counterfactual bytes (values above a bound count as a fixed amount), and their difference."""
    raw = F.coalesce(F.col("bytes_avoided"), F.lit(0)) + F.coalesce(F.col("bytes_returned"), F.lit(0))
    return events.groupBy("session_id").agg(F.count("*").alias("calls"), F.coalesce(F.sum("bytes_returned"), F.lit(0)).alias("returned"), F.sum(F.when(raw > above, to).otherwise(raw)).alias("counterfactual")).withColumn("saved", F.col("counterfactual") - F.col("returned"))


def real_usage(events: DataFrame, events_least: int = 100, projects_least: int = 5, chars_least: int = 50, days: int = 30) -> DataFrame:
    """Per source of records: records, projects, sessions, mean characters, and whether that is real use: enough of each, and some within `days` of the log's last record."""
    now = events.agg(F.max("created_at").alias("n")).scalar()
    t = events.groupBy(F.coalesce("source_hook", F.lit("")).alias("source")).agg(
        F.count("*").alias("events"), F.count_distinct(F.nullif(F.col("project_dir"), F.lit(""))).alias("projects"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg(F.length("data")), 4).alias("avg_chars"), F.max("created_at").alias("last")
    )
    recent = F.coalesce(F.col("last") >= now - F.make_dt_interval(F.lit(days)), F.lit(False))
    real = (F.col("events") >= events_least) & (F.col("projects") >= projects_least) & (F.col("avg_chars") >= chars_least) & recent
    return t.withColumn("real", real).drop("last")


def kept_out(events: DataFrame) -> DataFrame:
    """Per session what the whole pool kept out without its own returned bytes, never below 0, and the session's share of avoided bytes."""
    pool = events.agg((F.coalesce(F.sum("bytes_avoided"), F.lit(0)) + F.coalesce(F.sum("bytes_returned"), F.lit(0))).alias("n")).scalar()
    own = events.groupBy("session_id").agg(F.coalesce(F.sum("bytes_avoided"), F.lit(0)).alias("avoided"), F.coalesce(F.sum("bytes_returned"), F.lit(0)).alias("returned"))
    return own.withColumn("kept_out", F.greatest(F.lit(0), pool - F.col("returned")))
