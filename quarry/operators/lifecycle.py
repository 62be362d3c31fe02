"""Sessions and their stores over time: totals, legs, resumes, markers, budgets, shards, catalogs; data of reports and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.dashboard import CONTEXT_TYPES, UNKNOWN, bytes_summary, count_if, half_up, is_commit, is_type, ratio
from quarry.operators.ordered import id_block, with_carried

# Prefixes of the commands of the log's own tools, in the order they are looked for.
OWN_TOOLS = (("batch_execute", "batch_execute"), ("execute_file", "execute_file"), ("execute", "execute"), ("search", "search"), ("index", "index"), ("fetch", "fetch_and_index"), ("stats", "stats"), ("purge", "purge"))
UNSET = object()


# --- totals ---------------------------------------------------------------------------------------------------------
def tool_totals(events: DataFrame) -> DataFrame:
    """Per session and type that is tool use: calls and bytes."""
    size = F.coalesce(F.col("bytes_avoided"), F.lit(0)) + F.coalesce(F.col("bytes_returned"), F.lit(0))
    return events.where(~is_type(*CONTEXT_TYPES)).groupBy("session_id", "type").agg(F.count("*").alias("calls"), F.sum(size).alias("bytes"))


def own_tools(events: DataFrame) -> DataFrame:
    """Calls of the log's own tools by the prefix of their data, else by its first 20 characters."""
    name = F.coalesce(*[F.when(F.startswith(F.lower("data"), F.lit(p)), n) for p, n in OWN_TOOLS], F.substring("data", 1, 20))
    return events.where(is_type("mcp", "mcp_tool_call")).groupBy(name.alias("tool")).agg(F.count("*").alias("calls"))


def lifetime(events: DataFrame, meta: DataFrame) -> DataFrame:
    """One row over all time: records, sessions, named projects, first day, compactions, bytes kept out and returned."""
    t = events.agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.nullif(F.col("project_dir"), F.lit(""))).alias("projects"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first_day"),
        F.coalesce(F.sum("bytes_avoided"), F.lit(0)).alias("avoided"), F.coalesce(F.sum("bytes_returned"), F.lit(0)).alias("returned"),
    )
    return t.withColumn("compacts", meta.agg(F.coalesce(F.sum("compact_count"), F.lit(0)).alias("n")).scalar())


def source_bytes(events: DataFrame) -> DataFrame:
    """Per source of records the characters of data, bytes kept out and returned, and tokens (a quarter of characters and kept bytes)."""
    t = bytes_summary(events.withColumn("session_id", F.coalesce("source_hook", F.lit("")))).withColumnRenamed("session_id", "source")
    return t.withColumn("tokens", F.floor((F.coalesce("data_chars", F.lit(0)) + F.col("avoided")) / 4))


def totals(events: DataFrame, meta: DataFrame, cycles: DataFrame) -> DataFrame:
    """The totals of the whole log in one row. cycles: session_id, cycles."""
    c = F.col
    t = events.agg(
        F.count("*").alias("events"), count_if(is_type("error_tool")).alias("errors"), count_if(is_type("file_read")).alias("reads"), count_if(is_type("file_write")).alias("writes"), count_if(is_type("file_read", "file_write", "file", "file_glob", "file_search")).alias("file_ops"),
        count_if(is_type("subagent_launched", "subagent_completed")).alias("subagents"), count_if(c("category") == "task").alias("tasks"), count_if(is_type("user_prompt")).alias("prompts"), F.count_distinct(F.nullif(c("project_dir"), F.lit(""))).alias("projects"),
        count_if(is_commit()).alias("commits"), count_if(is_type("mcp")).alias("sandbox"), count_if(~is_type(*CONTEXT_TYPES)).alias("calls"), F.count_distinct(F.when(is_type("rule") & (c("data") != ""), c("data"))).alias("rules"),
    )
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    of_meta = {"sessions": F.count("*"), "compacts": F.coalesce(F.sum("compact_count"), F.lit(0)), "compacted": count_if(c("compact_count") > 0), "minutes": F.sum(half_up((us("last_event_at") - us("started_at")) / 6e7, 1))}
    t = t.withColumns({k: meta.agg(v.alias(k)).scalar() for k, v in of_meta.items()} | {"cycles": cycles.agg(F.coalesce(F.sum("cycles"), F.lit(0)).alias("n")).scalar()})
    per = lambda a, scale=1.0, digits=1: ratio(c(a), c("sessions"), scale, digits)
    return t.select(
        "sessions", "events", "errors", "compacts", "reads", "writes", "file_ops", "subagents", "tasks", "prompts", "projects", "commits", "rules", "cycles", F.coalesce(half_up(c("minutes") / c("sessions")), F.lit(0)).cast("long").alias("avg_session_min"), ratio(c("errors"), c("events")).alias("error_rate"),
        per("compacted", 100.0, 0).cast("long").alias("compact_rate"), ratio(c("reads"), c("writes"), 1.0, 1, c("reads").cast("double")).alias("read_write"), per("prompts").alias("prompts_per_session"), per("commits").alias("commits_per_session"), ratio(c("sandbox"), c("calls")).alias("sandbox_rate"),
    )


def commit_push(events: DataFrame) -> DataFrame:
    """Commits, pushes and their ratio (two decimals; without a push the commits)."""
    push = (F.col("type") == "git") & F.rlike(F.lower("data"), F.lit(r"^\s*push\s*$|\bgit\b[^|;&]*\bpush\b"))
    t = events.agg(count_if(is_commit()).alias("commits"), count_if(push).alias("pushes"))
    return t.select("commits", "pushes", ratio(F.col("commits"), F.col("pushes"), 1.0, 2, F.col("commits").cast("double")).alias("ratio"))


def statusline(events: DataFrame) -> DataFrame:
    """Per session: bytes kept out in it and over all, its share, and bytes a day of all."""
    own = events.groupBy("session_id").agg(F.coalesce(F.sum("bytes_avoided"), F.lit(0)).alias("own"), F.coalesce(F.sum("bytes_returned"), F.lit(0)).alias("returned"))
    whole = events.agg(F.coalesce(F.sum("bytes_avoided"), F.lit(0)).alias("n")).scalar()
    days = events.agg((F.datediff(F.max("created_at"), F.min("created_at")) + 1).alias("n")).scalar()
    return own.select("session_id", "own", ratio(F.col("own"), F.col("own") + F.col("returned")).alias("kept_pct"), whole.alias("lifetime"), F.floor(whole / days).alias("per_day"))


# --- sessions -------------------------------------------------------------------------------------------------------
def compactions(events: DataFrame) -> DataFrame:
    """Per session its compactions and the cursor of what was read: its last record."""
    return events.where("session_id is not null").groupBy("session_id").agg(count_if(F.startswith("type", F.lit("compact"))).alias("compactions"), F.max("id").alias("cursor"))


def resumes(events: DataFrame) -> DataFrame:
    """Per session its last resume record: last write wins; open until a later record of the session consumes it."""
    rows = events.where("session_id is not null").groupBy("session_id").agg(F.max(F.when(F.startswith("type", F.lit("resume")), F.col("id"))).alias("resume_id"), F.max("id").alias("last_id"))
    return rows.where("resume_id is not null").select("session_id", "resume_id", (F.col("last_id") > F.col("resume_id")).alias("consumed"))


def claims(resumed: DataFrame) -> DataFrame:
    """For each session, the latest resume that isn't its own: of all, only the two latest can be it."""
    two = resumed.select("session_id", "resume_id").orderBy(F.desc("resume_id")).limit(2).agg(F.sort_array(F.collect_list(F.struct("resume_id", F.col("session_id").alias("owner"))), asc=False).alias("t"))
    first, second = F.get(F.col("t"), F.lit(0)), F.get(F.col("t"), F.lit(1))
    claimed = resumed.select("session_id", two.scalar().alias("t"))
    return claimed.select("session_id", F.when(first["owner"] != F.col("session_id"), first["resume_id"]).otherwise(second["resume_id"]).alias("claimed"))


def clamped(c: Column) -> Column:
    """A whole number from 0 on: null, NaN and what isn't positive is 0."""
    return F.when(c.isNull() | F.isnan(c.cast("double")) | (c <= 0), F.lit(0)).otherwise(F.floor(c)).cast("long")


def latest_session(meta: DataFrame) -> DataFrame:
    """The session that started last."""
    return meta.agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_id"))


def latest_session_events(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Records of the session that started last among those with records, in order of time."""
    last = events.select("session_id").distinct().join(meta, "session_id").where("started_at is not null").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("s")).scalar()
    return events.where(F.col("session_id") == last).orderBy("created_at", "id")


def scoped(events: DataFrame, project: object = UNSET) -> DataFrame:
    """Records of a scope: no project given: those of named projects; None: all; a path: that project, separators and a last slash aside."""
    if project is None:
        return events
    path = F.regexp_replace(F.regexp_replace("project_dir", r"\\", "/"), "/+$", "")
    return events.where(F.coalesce("project_dir", F.lit("")) != "") if project is UNSET else events.where(path == str(project).replace("\\", "/").rstrip("/"))


def marker_bytes(events: DataFrame, consumer: str = "tool_latency", width: int = 1_000_000) -> DataFrame:
    """Bytes returned between two records of the consuming type in a session, summed once: session_id, after_id (null before the first), records, bytes."""
    rows = with_carried(events.select("session_id", "id", "type", "bytes_returned"), ["session_id"], ["id"], id_block(width), F.when(F.col("type") == consumer, F.col("id")), "after_id")
    return rows.where(F.col("type") != consumer).groupBy("session_id", "after_id").agg(F.count("*").alias("records"), F.sum(clamped(F.col("bytes_returned"))).alias("bytes"))


# --- shards, limits, catalogs ---------------------------------------------------------------------------------------
def top_per_shard(events: DataFrame, order: Column, shard: str = "project_dir", each: int = 10, whole: int = 30) -> DataFrame:
    """The best `each` records of every shard, and of these the best `whole`; ties by id. Limits of a shard are taken before the shuffle."""
    rows = events.withColumn("__shard", F.coalesce(F.nullif(F.col(shard), F.lit("")), F.lit(UNKNOWN))).withColumn("__order", order).where("__order is not null")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("__shard").orderBy(F.desc("__order"), "id"))).where(F.col("k") <= each)
    best = ranked.orderBy(F.desc("__order"), "id").limit(whole)
    return best.select(F.col("__shard").alias("shard"), "id", F.col("__order").alias("score"), F.col("k").cast("long").alias("k"))


def effective_limit(asked: Column, calls: Column, most: int = 2, soft: int = 3) -> Column:
    """At most `most` results, 1 once a caller is slowed."""
    return F.when(calls > soft, F.lit(1)).otherwise(F.least(asked, F.lit(most)))


def catalog_lookup(rows: DataFrame, key: str, catalog: DataFrame, name: str, value: str) -> DataFrame:
    """key, value: that of the key as it is, else trimmed in small letters, else without its first `part/`, else without last `-parts`, one by one."""
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    tries = own.select("key", F.posexplode(F.concat(F.array(F.col("key"), F.lower(F.trim("key"))), _shorter())).alias("place", "try"))
    known = catalog.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("try")).agg(F.max(value).alias("value"))
    best = tries.join(known, "try").groupBy("key").agg(F.min_by("value", "place").alias("value"), F.min("place").cast("long").alias("place"))
    return own.join(best, "key", "left")


def _shorter() -> Column:
    low = F.lower(F.trim("key"))
    bare = F.when(F.contains(low, F.lit("/")), F.expr("substring(lower(trim(key)), locate('/', lower(trim(key))) + 1)")).otherwise(low)
    parts = F.split(bare, "-")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "-"))


# --- data of snapshots and reports ----------------------------------------------------------------------------------
def file_operations(events: DataFrame) -> DataFrame:
    """Per session and file how often it was read, written, edited, and its last record."""
    return events.where(is_type("file_read", "file_write", "file_edit") & (F.col("data") != "")).groupBy("session_id", "data").agg(
        count_if(is_type("file_read")).alias("reads"), count_if(is_type("file_write")).alias("writes"), count_if(is_type("file_edit")).alias("edits"), F.max("id").alias("last_id")
    )


def task_states(events: DataFrame) -> DataFrame:
    """Per session: tasks created, updates, and tasks without an update; the n-th creation goes with the n-th least id that updates name."""
    named = F.regexp_extract("data", r"(?i)\"?(?:taskId|task_id|id)\"?\s*[:=]\s*\"?(\d{1,9})(?:\D|$)", 1)
    t = events.where(is_type("task_create", "task_update")).groupBy("session_id").agg(count_if(is_type("task_create")).alias("created"), count_if(is_type("task_update")).alias("updates"), F.count_distinct(F.when(is_type("task_update") & (named != ""), named.cast("long"))).alias("updated"))
    return t.select("session_id", "created", "updates", F.greatest(F.lit(0), F.col("created") - F.col("updated")).alias("pending"))


def snapshot_sections(events: DataFrame, most: int = 10) -> DataFrame:
    """Per session and category: records, distinct values, and the last `most` distinct values, latest first, cut to 80 characters."""
    last = events.where("data <> '' and session_id is not null and category is not null").groupBy("session_id", "category", "data").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    ranked = last.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "category").orderBy(F.desc("id"))))
    counts = last.groupBy("session_id", "category").agg(F.sum("n").alias("records"), F.count("*").alias("values"))
    values = ranked.where(F.col("k") <= most).groupBy("session_id", "category").agg(F.sort_array(F.collect_list(F.struct("k", F.substring("data", 1, 80).alias("v")))).alias("l"))
    return counts.join(values, ["session_id", "category"]).select("session_id", "category", "records", "values", F.array_join(F.transform("l", lambda s: s["v"]), "\n").alias("latest"))


def within_budget(events: DataFrame, tokens: int = 500) -> DataFrame:
    """Per session the records that fit a budget of tokens (a quarter of the characters, at least 1), by priority and then latest first.

    No more records than tokens can fit, so each session is cut to that many before sums run over it.
    """
    size = F.greatest(F.lit(1), F.ceil(F.length("data") / 4)).cast("long")
    w = Window.partitionBy("session_id").orderBy("priority", F.desc("id"))
    first = events.where("data <> '' and session_id is not null and priority is not null").select("session_id", "id", "priority", size.alias("tokens")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= tokens)
    return first.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= tokens).select("session_id", "id", "used")
