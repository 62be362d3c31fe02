"""Queries of lifecycle, totals, snapshot data and tool-call extraction, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dashboard as d
from quarry.operators import extract as x
from quarry.operators import lifecycle as l
from quarry.plans.dashboard import _COMMIT, E, _context, _pct, _sum, _up
from quarry.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, columns: str, make: Callable[..., DataFrame], sql: str | None, *more: str) -> None:
    QUERIES[name] = lambda spark, sf: make(d.clean_events(table(spark, sf, "session_events"), columns.split()), *[table(spark, sf, t) for t in more])
    if sql:
        ORACLE[name] = f"{E} {sql}" if not sql.startswith(",") else E + sql


_B = "CAST({} AS BIGINT)"
_SIZE = "coalesce(bytes_avoided, 0) + coalesce(bytes_returned, 0)"
_add("a04_tool_totals", "session_id type bytes_avoided bytes_returned", l.tool_totals, f"SELECT session_id, type, count(*) AS calls, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM e WHERE type NOT IN ({_context}) GROUP BY 1, 2")
_own = " ".join(f"WHEN starts_with(lower(data), '{p}') THEN '{n}'" for p, n in l.OWN_TOOLS)
_add("a20_own_tools", "type data", l.own_tools, f"SELECT CASE {_own} ELSE substr(data, 1, 20) END AS tool, count(*) AS calls FROM e WHERE type IN ('mcp', 'mcp_tool_call') GROUP BY 1")
_add(
    "a11_lifetime", "session_id project_dir created_at bytes_avoided bytes_returned", l.lifetime,
    "SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT nullif(project_dir, '')) AS projects, strftime(min(created_at), '%Y-%m-%d') AS first_day, CAST(coalesce(sum(bytes_avoided), 0) AS BIGINT) AS avoided, CAST(coalesce(sum(bytes_returned), 0) AS BIGINT) AS returned, (SELECT CAST(coalesce(sum(compact_count), 0) AS BIGINT) FROM session_meta) AS compacts FROM e",
    "session_meta",
)
_add(
    "a16_source_bytes", "session_id source_hook data bytes_avoided bytes_returned", l.source_bytes,
    ", t AS (SELECT coalesce(source_hook, '') AS source, CAST(coalesce(sum(bytes_avoided), 0) AS BIGINT) AS avoided, CAST(coalesce(sum(bytes_returned), 0) AS BIGINT) AS returned, CAST(sum(length(data)) AS BIGINT) AS data_chars FROM e GROUP BY 1) SELECT *, CAST(floor((coalesce(data_chars, 0) + avoided) / 4) AS BIGINT) AS tokens FROM t",
)
_add(
    "a32_totals", "session_id type category data project_dir", lambda e, m: l.totals(e, m, d.edit_test_cycles(e)),
    f""", t AS (SELECT count(*) AS events, {_sum("type = 'error_tool'")} AS errors, {_sum("type = 'file_read'")} AS reads, {_sum("type = 'file_write'")} AS writes, {_sum("type IN ('file_read', 'file_write', 'file', 'file_glob', 'file_search')")} AS file_ops, {_sum("type IN ('subagent_launched', 'subagent_completed')")} AS subagents,
      {_sum("category = 'task'")} AS tasks, {_sum("type = 'user_prompt'")} AS prompts, count(DISTINCT nullif(project_dir, '')) AS projects, {_sum(_COMMIT)} AS commits, {_sum("type = 'mcp'")} AS sandbox, {_sum(f"type NOT IN ({_context})")} AS calls, count(DISTINCT CASE WHEN type = 'rule' AND data <> '' THEN data END) AS rules FROM e),
    m AS (SELECT count(*) AS sessions, CAST(coalesce(sum(compact_count), 0) AS BIGINT) AS compacts, {_sum('compact_count > 0')} AS compacted, sum({_up('(epoch_us(last_event_at) - epoch_us(started_at)) / 6e7', 1)}) AS minutes FROM session_meta),
    n AS (SELECT type, lead(type) OVER (PARTITION BY session_id ORDER BY id) AS next FROM e WHERE session_id IS NOT NULL), k AS (SELECT count(*) AS cycles FROM n WHERE type = 'file_write' AND next = 'error_tool')
    SELECT sessions, events, errors, compacts, reads, writes, file_ops, subagents, tasks, prompts, projects, commits, rules, cycles, CAST(coalesce(floor(minutes / sessions + 0.5), 0) AS BIGINT) AS avg_session_min, {_pct('errors', 'events')} AS error_rate, CAST({_pct('compacted', 'sessions', '100.0', 0)} AS BIGINT) AS compact_rate,
      {_pct('reads', 'writes', '1.0', 1, 'reads')} AS read_write, {_pct('prompts', 'sessions', '1.0', 1)} AS prompts_per_session, {_pct('commits', 'sessions', '1.0', 1)} AS commits_per_session, {_pct('sandbox', 'calls')} AS sandbox_rate FROM t, m, k""",
    "session_meta",
)
_PUSH = _COMMIT.replace("commit", "push")
_add("a37_commit_push", "type data", l.commit_push, f", t AS (SELECT {_sum(_COMMIT)} AS commits, {_sum(_PUSH)} AS pushes FROM e) SELECT *, {_pct('commits', 'pushes', '1.0', 2, 'commits')} AS ratio FROM t")
_add(
    "a44_statusline", "session_id created_at bytes_avoided bytes_returned", l.statusline,
    f""", o AS (SELECT session_id, CAST(coalesce(sum(bytes_avoided), 0) AS BIGINT) AS own, CAST(coalesce(sum(bytes_returned), 0) AS BIGINT) AS ret FROM e GROUP BY 1), w AS (SELECT CAST(coalesce(sum(bytes_avoided), 0) AS BIGINT) AS n, date_diff('day', min(created_at)::DATE, max(created_at)::DATE) + 1 AS days FROM e)
    SELECT session_id, own, {_pct('own', 'own + ret')} AS kept_pct, n AS lifetime, CAST(floor(n / days) AS BIGINT) AS per_day FROM o, w""",
)
_add("l03_compactions", "session_id type", l.compactions, f"SELECT session_id, {_sum(chr(115) + 'tarts_with(type, ' + repr('compact') + ')')} AS compactions, max(id) AS cursor FROM e WHERE session_id IS NOT NULL GROUP BY 1")
_RES = ", r AS (SELECT session_id, max(CASE WHEN starts_with(type, 'resume') THEN id END) AS resume_id, max(id) AS last_id FROM e WHERE session_id IS NOT NULL GROUP BY 1) "
_add("l04_resumes", "session_id type", l.resumes, _RES + "SELECT session_id, resume_id, last_id > resume_id AS consumed FROM r WHERE resume_id IS NOT NULL")
_add("st8_claims", "session_id type", lambda e: l.claims(l.resumes(e)), _RES + ", t AS (SELECT session_id, resume_id FROM r WHERE resume_id IS NOT NULL) SELECT a.session_id, (SELECT max(b.resume_id) FROM t b WHERE b.session_id <> a.session_id) AS claimed FROM t a")
_CLAMP = "CASE WHEN {0} IS NULL OR {0} <= 0 THEN 0 ELSE {0} END"
_add("l06_clamped_bytes", "session_id bytes_returned", lambda e: e.groupBy("session_id").agg(F.sum(l.clamped(F.col("bytes_returned") - 500)).alias("bytes")), f"SELECT session_id, CAST(sum({_CLAMP.format('(bytes_returned - 500)')}) AS BIGINT) AS bytes FROM e GROUP BY 1")
_add("l11_latest_session", "session_id", lambda e, m: l.latest_session(m), "SELECT session_id FROM session_meta ORDER BY started_at DESC NULLS LAST, session_id DESC LIMIT 1", "session_meta")
_add(
    "l20_latest_events", "session_id created_at type", lambda e, m: l.latest_session_events(e, m).select("id", "session_id", "type"),
    "SELECT id, session_id, type FROM e WHERE session_id = (SELECT m.session_id FROM session_meta m WHERE started_at IS NOT NULL AND m.session_id IN (SELECT session_id FROM e) ORDER BY started_at DESC, m.session_id DESC LIMIT 1)", "session_meta",
)
_add("l21_scoped", "project_dir session_id", lambda e: l.scoped(e).groupBy("project_dir").agg(F.count("*").alias("n")), "SELECT project_dir, count(*) AS n FROM e WHERE project_dir <> '' GROUP BY 1")
_add(
    "l13_marker_bytes", "session_id type bytes_returned", l.marker_bytes,
    f""", k AS (SELECT session_id, type, bytes_returned, last_value(CASE WHEN type = 'tool_latency' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after_id FROM e WHERE session_id IS NOT NULL)
    SELECT session_id, after_id, count(*) AS records, CAST(sum({_CLAMP.format('bytes_returned')}) AS BIGINT) AS bytes FROM k WHERE type <> 'tool_latency' GROUP BY 1, 2""",
)
_SHARD = ", r AS (SELECT coalesce(nullif(project_dir, ''), '__unknown__') AS shard, id, bytes_avoided AS score, row_number() OVER (PARTITION BY coalesce(nullif(project_dir, ''), '__unknown__') ORDER BY bytes_avoided DESC, id) AS k FROM e WHERE bytes_avoided IS NOT NULL{}) SELECT shard, id, score, k FROM r WHERE k <= 10 ORDER BY score DESC, id LIMIT 30"
_add("f13_top_per_shard", "project_dir bytes_avoided", lambda e: l.top_per_shard(e, F.col("bytes_avoided")), _SHARD.format(""))
_add("k06_shard_search", "project_dir bytes_avoided data", lambda e: l.top_per_shard(e.where("lower(data) like '%token%'"), F.col("bytes_avoided")), _SHARD.format(" AND lower(data) LIKE '%token%'"))
_add(
    "k05_limits", "session_id", lambda e: e.groupBy("session_id").agg(F.count("*").alias("calls")).select("session_id", l.effective_limit(F.lit(5), F.col("calls")).cast("long").alias("limit")),
    "SELECT session_id, CAST(CASE WHEN count(*) > 3 THEN 1 ELSE 2 END AS BIGINT) AS \"limit\" FROM e GROUP BY 1",
)
_add(
    "j09_catalog", "type", lambda e, s: l.catalog_lookup(s.select(F.concat(F.lit(" Shelf/"), F.upper("label"), F.lit("-v2-x")).alias("k")), "k", s.select(F.lower("label").alias("n"), "id"), "n", "id").select("key", "value"),
    ", c AS (SELECT lower(label) AS n, max(id) AS v FROM sources WHERE label IS NOT NULL GROUP BY 1), o AS (SELECT DISTINCT concat(' Shelf/', upper(label), '-v2-x') AS key, lower(label) || '-v2-x' AS b FROM sources WHERE label IS NOT NULL), t AS (SELECT key, unnest(generate_series(1, len(string_split(b, '-')))) AS m, string_split(b, '-') AS p FROM o), h AS (SELECT key, m, c.v FROM t JOIN c ON array_to_string(p[1:m], '-') = c.n) SELECT o.key, (SELECT max_by(v, m) FROM h WHERE h.key = o.key) AS value FROM o",
    "sources",
)
_add("b1_file_operations", "session_id type data", l.file_operations, f"SELECT session_id, data, {_sum(chr(116) + 'ype = ' + repr('file_read'))} AS reads, {_sum(chr(116) + 'ype = ' + repr('file_write'))} AS writes, {_sum(chr(116) + 'ype = ' + repr('file_edit'))} AS edits, max(id) AS last_id FROM e WHERE type IN ('file_read', 'file_write', 'file_edit') AND data <> '' GROUP BY 1, 2")
_add(
    "b1_task_states", "session_id type data", l.task_states,
    f""", k AS (SELECT session_id, type, nullif(regexp_extract(data, '(?i)"?(?:taskId|task_id|id)"?\\s*[:=]\\s*"?(\\d{{1,9}})(?:\\D|$)', 1), '') AS n FROM e WHERE type IN ('task_create', 'task_update')), t AS (SELECT session_id, {_sum("type = 'task_create'")} AS created, {_sum("type = 'task_update'")} AS updates, count(DISTINCT CASE WHEN type = 'task_update' THEN n::BIGINT END) AS updated FROM k GROUP BY 1)
    SELECT session_id, created, updates, greatest(0, created - updated) AS pending FROM t""",
)
_add(
    "b1_sections", "session_id category data", l.snapshot_sections,
    """, v AS (SELECT session_id, category, data, max(id) AS id, count(*) AS n FROM e WHERE data <> '' AND session_id IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY id DESC) AS k FROM v)
    SELECT session_id, category, CAST(sum(n) AS BIGINT) AS records, count(*) AS "values", string_agg(substr(data, 1, 80), chr(10) ORDER BY k) FILTER (WHERE k <= 10) AS latest FROM r GROUP BY 1, 2""",
)
_add(
    "b3_budget", "session_id priority data", l.within_budget,
    """, r AS (SELECT session_id, id, CAST(sum(greatest(1, ceil(length(data) / 4))) OVER (PARTITION BY session_id ORDER BY priority, id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM e WHERE data <> '' AND session_id IS NOT NULL AND priority IS NOT NULL) SELECT * FROM r WHERE used <= 500""",
)

# --- extraction -----------------------------------------------------------------------------------------------------
_J = "CASE WHEN ltrim(data) LIKE '{%' AND json_valid(data) THEN data END"
_CALL = f", c AS (SELECT id, json_extract_string(j, '$.tool') AS tool, coalesce(json_extract_string(j, '$.input.file_path'), json_extract_string(j, '$.args.path'), json_extract_string(j, '$.input.path')) AS path FROM (SELECT id, {_J} AS j FROM e) WHERE j IS NOT NULL) "
_types = " ".join(f"WHEN lower(tool) = '{t}' THEN '{k}'" for t, k in x.TOOL_TYPES)
_rules = x.RULE_FILES.replace("'", "''")
_KIND = f"CASE WHEN lower(tool) = 'read' AND regexp_matches(path, '{_rules}') THEN 'rule' WHEN starts_with(lower(tool), 'mcp__') THEN 'mcp' {_types} END"


def _calls(e: DataFrame) -> DataFrame:
    tool, path, _ = x.call_of()
    return e.where("ltrim(data) like '{%'").select("id", tool.alias("tool"), path.alias("path")).where("tool is not null")


_add("e01_file_calls", "data", lambda e: _calls(e).select("id", x.tool_event(F.col("tool"), F.col("path")).alias("type"), "path").where("type is not null and path is not null"), _CALL + f", k AS (SELECT id, {_KIND} AS type, path FROM c) SELECT * FROM k WHERE type IS NOT NULL AND path IS NOT NULL")
_add("e06_call_types", "data", lambda e: _calls(e).groupBy(F.coalesce(x.tool_event(F.col("tool"), F.col("path")), F.lit("other")).alias("type")).agg(F.count("*").alias("n")), _CALL + f"SELECT coalesce({_KIND}, 'other') AS type, count(*) AS n FROM c WHERE tool IS NOT NULL GROUP BY 1")
_add("e03_tool_errors", "type data", lambda e: e.where("type in ('bash_outcome', 'error_tool')").where(x.is_tool_error("data")).select("id"), "SELECT id FROM e WHERE type IN ('bash_outcome', 'error_tool') AND NOT (starts_with(data, 'quarry:') OR regexp_matches(data, '^echo [\"'']quarry:')) AND regexp_matches(data, '(?i)exit code [1-9]|error:|fail')")
_add(
    "e07_servers", "data", lambda e: _calls(e).select(*[c.alias(n) for n, c in zip(("server", "tool"), x.server_and_tool(F.concat(F.lit("mcp__own__"), F.col("tool"))))]).groupBy("server", "tool").agg(F.count("*").alias("calls")),
    _CALL + ", t AS (SELECT 'mcp__own__' || tool AS n FROM c WHERE tool IS NOT NULL) SELECT regexp_extract(n, '^mcp__(.+?)__(.+)$', 1) AS server, regexp_extract(n, '^mcp__(.+?)__(.+)$', 2) AS tool, count(*) AS calls FROM t GROUP BY 1, 2",
)
_add("e08_named_sizes", "type data", lambda e: e.where("type = 'external_ref'").select("id", x.kib_named("data").alias("bytes")), "SELECT id, CAST(coalesce(floor(try_cast(nullif(regexp_extract(data, '\\((\\d{1,9}(?:\\.\\d{1,3})?) ?KB\\)', 1), '') AS DOUBLE) * 1024 + 0.5), 0) AS BIGINT) AS bytes FROM e WHERE type = 'external_ref'")
_add(
    "e14_slow_tools", "type data session_id", lambda e: e.select("id", "session_id", F.regexp_extract("data", r"(?:^|\s)duration_ms:(\d{1,15})(?:\s|$)", 1).alias("m")).where("m <> ''").select("id", "session_id", F.col("m").cast("long").alias("ms")).where("ms > 5000"),
    ", k AS (SELECT id, session_id, try_cast(nullif(regexp_extract(data, '(?:^|\\s)duration_ms:(\\d{1,15})(?:\\s|$)', 1), '') AS BIGINT) AS ms FROM e) SELECT * FROM k WHERE ms > 5000",
)
_add("e15_server_events", "type bytes_avoided session_id", lambda e: e.where("type in ('sandbox_execute', 'index_write', 'cache_hit')").groupBy("session_id", "type").agg(F.count("*").alias("n"), F.sum(F.coalesce("bytes_avoided", F.lit(0))).alias("avoided")), "SELECT session_id, type, count(*) AS n, CAST(sum(coalesce(bytes_avoided, 0)) AS BIGINT) AS avoided FROM e WHERE type IN ('sandbox_execute', 'index_write', 'cache_hit') GROUP BY 1, 2")
_add(
    "e18_second_buckets", "data", lambda e: e.select(F.regexp_extract("data", r"(?:^|\s)duration_ms:(\d{1,15})(?:\s|$)", 1).alias("m")).where("m <> ''").groupBy(x.second_duration_bucket(F.col("m").cast("long")).alias("bucket")).agg(F.count("*").alias("n")),
    ", k AS (SELECT try_cast(nullif(regexp_extract(data, '(?:^|\\s)duration_ms:(\\d{1,15})(?:\\s|$)', 1), '') AS BIGINT) AS ms FROM e) SELECT CASE WHEN ms < 1000 THEN 'fast' WHEN ms < 5000 THEN 'medium' WHEN ms < 30000 THEN 'slow' ELSE 'timeout' END AS bucket, count(*) AS n FROM k WHERE ms IS NOT NULL GROUP BY 1",
)
_like = r"^[/~.]?[\w./\\@+-]*[/\\][\w./\\@+-]+$"
_slash = "regexp_replace(replace({}, '\\', '/'), '(.)/+$', '\\1')"
_add(
    "e19_attribution", "session_id type data", lambda e, m: x.attribution(e, m.select("session_id", F.col("project_dir").alias("origin"))),
    f""", s AS (SELECT e.id, e.type, {_slash.format("coalesce(m.project_dir, '')")} AS o, CASE WHEN e.type IN ('cwd', 'file_read', 'file_write', 'file_edit', 'file_glob', 'rule') AND regexp_matches(e.data, '{_like}') THEN {_slash.format('e.data')} END AS g FROM e LEFT JOIN session_meta m USING (session_id)),
    a AS (SELECT id, type, o, CASE WHEN starts_with(g, '/') THEN g WHEN o <> '' THEN o || '/' || regexp_replace(g, '^\\./', '') END AS p FROM s), i AS (SELECT *, o <> '' AND (p = o OR starts_with(p, o || '/')) AS ins FROM a)
    SELECT id, CASE WHEN p IS NULL THEN o WHEN ins THEN o WHEN type = 'cwd' THEN p WHEN type IN ('file_read', 'file_write', 'file_edit', 'rule') THEN regexp_replace(p, '/[^/]*$', '') ELSE p END AS project,
      CASE WHEN p IS NULL THEN CASE WHEN o <> '' THEN 'session_origin' ELSE 'unknown' END WHEN ins THEN 'session_origin' WHEN type = 'cwd' THEN 'cwd_event' ELSE 'event_path' END AS source,
      CASE WHEN p IS NULL THEN CASE WHEN o <> '' THEN 0.35 ELSE 0.0 END WHEN ins THEN 0.82 WHEN type = 'cwd' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM i""",
    "session_meta",
)


def _pair(name: str, digits: str = r"(\d{1,9})"):  # noqa: ANN202
    return F.regexp_extract("data", rf"(?:^|\s){name}:{digits}(?:\s|$)", 1)


_add(
    "e20_hard_failures", "data", lambda e: e.select("id", _pair("exit_code").alias("c"), _pair("shell", r"(\S+)").alias("s"), _pair("lines").alias("n")).where("c <> ''").select("id", x.hard_failure(F.when(F.col("s") != "", "shell").otherwise("other"), F.col("c").cast("int"), F.when(F.col("n").try_cast("long") > 0, "x").otherwise("")).alias("failed")),
    ", k AS (SELECT id, regexp_extract(data, '(?:^|\\s)exit_code:(\\d{1,9})(?:\\s|$)', 1) AS c, regexp_extract(data, '(?:^|\\s)shell:(\\S+)(?:\\s|$)', 1) AS s, regexp_extract(data, '(?:^|\\s)lines:(\\d{1,9})(?:\\s|$)', 1) AS n FROM e) SELECT id, c::INT <> 0 AND NOT (s <> '' AND c::INT = 1 AND coalesce(try_cast(nullif(n, '') AS BIGINT), 0) > 0) AS failed FROM k WHERE c <> ''",
)
_add(
    "l15_exit_codes", "data", lambda e: e.groupBy(x.inferred_exit("data").alias("code")).agg(F.count("*").alias("n")),
    ", k AS (SELECT CASE WHEN regexp_matches(data, '(?i)\\bexit[ _]code[ :]+\\d{1,3}') THEN regexp_extract(data, '(?i)\\bexit[ _]code[ :]+(\\d{1,3})', 1)::INT WHEN regexp_matches(lower(data), 'command not found|: not found') THEN 127 WHEN regexp_matches(data, '(?im)^\\s*(?:error|fatal)\\b') THEN 1 ELSE 0 END AS code FROM e) SELECT code, count(*) AS n FROM k GROUP BY 1",
)
_keys = x.MASKED_KEYS
_add(
    "x18_masked_arguments", "type data", lambda e: e.where("type = 'mcp_tool_call' and data like '{%'").select("id", x.masked_arguments("data").alias("data")),
    f"""SELECT id, substr(regexp_replace(data, '(?i)(["''][^"'']*(?:{_keys})[^"'']*["'']\\s*:\\s*)(?:"(?:[^"\\\\]|\\\\.)*"|''(?:[^''\\\\]|\\\\.)*''|[^\\s,}}\\]]+)', '\\1"[REDACTED]"', 'g'), 1, 2048) AS data FROM e WHERE type = 'mcp_tool_call' AND data LIKE '{{%'""",
)
_counts = ", ".join(f"len(regexp_extract_all(text, '\\p{{{p}}}'))" for _, p in x.SCRIPTS)
_names = ", ".join(f"'{n}'" for n, _ in x.SCRIPTS)
QUERIES["x20_scripts"] = lambda spark, sf: table(spark, sf, "documents").where("text is not null").groupBy(x.dominant_script("text").alias("script")).agg(F.count("*").alias("n"))
ORACLE["x20_scripts"] = f"WITH k AS (SELECT [{_counts}] AS c FROM documents WHERE text IS NOT NULL) SELECT CASE WHEN list_max(c) > 0 THEN ([{_names}])[list_position(c, list_max(c))] ELSE 'none' END AS script, count(*) AS n FROM k GROUP BY 1"
QUERIES["x14_formats"] = lambda spark, sf: d.session_durations(table(spark, sf, "session_meta")).select("session_id", x.format_minutes(F.col("duration_min")).alias("duration"), x.format_count(F.col("event_count") * 97).alias("events"), x.format_bytes(F.col("event_count") * 1000).alias("size"))
ORACLE["x14_formats"] = f"""WITH t AS (SELECT session_id, CAST(floor({_up('(epoch_us(last_event_at) - epoch_us(started_at)) / 6e7', 1)}) AS BIGINT) AS m, event_count * 97 AS n, event_count * 1000 AS b FROM session_meta WHERE started_at IS NOT NULL AND last_event_at IS NOT NULL)
SELECT session_id, CASE WHEN m < 60 THEN m || 'm' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS duration, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN format('{{:.1f}}K', floor(n / 1000 * 10 + 0.5) / 10) ELSE format('{{:.1f}}M', floor(n / 1000000 * 10 + 0.5) / 10) END AS events,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{{:.1f}} KB', floor(b / 1024 * 10 + 0.5) / 10) ELSE format('{{:.1f}} MB', floor(b / 1048576 * 10 + 0.5) / 10) END AS size FROM t"""


def _re(p: str) -> str:
    return p.replace("'", "''")


QUERIES["e10_kinds"] = lambda spark, sf: table(spark, sf, "documents").where("text is not null").select(F.explode(x.message_kinds("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
ORACLE["e10_kinds"] = f"""WITH t AS (SELECT trim(text) AS t FROM documents WHERE text IS NOT NULL), k AS (SELECT t, regexp_matches(t, '{_re(x.SOLVED_MARKS).replace("(?i)", "").replace("works now|fixed", "(?i:works now|fixed").replace("resolved)", "resolved))")}') AS solved FROM t),
 u AS (SELECT unnest(list_filter([CASE WHEN regexp_matches(t, '^/plan\\b') THEN 'plan' END, CASE WHEN regexp_matches(t, '[,;，；、،]') AND regexp_matches(t, '\\p{{L}}') AND NOT regexp_matches(t, '[?？؟¿]') AND length(t) BETWEEN 15 AND 500 THEN 'decision' END,
   CASE WHEN regexp_matches(t, '{_re(x.ROLE_STARTS)}') AND length(t) BETWEEN 8 AND 120 THEN 'role' END, CASE WHEN regexp_matches(t, '[?？؟¿]') THEN 'investigate' WHEN length(t) > 0 AND length(t) < 60 AND regexp_matches(t, '\\p{{L}}') THEN 'implement' END,
   CASE WHEN regexp_matches(t, '(?i)^goal\\s*:') THEN 'goal' END, CASE WHEN solved THEN 'blocker_resolved' END, CASE WHEN NOT solved AND regexp_matches(t, '{_re(x.BLOCKER_MARKS)}') THEN 'blocker' END, CASE WHEN length(t) > 1024 THEN 'data' END], lambda v: v IS NOT NULL)) AS kind FROM k)
SELECT kind, count(*) AS n FROM u GROUP BY 1"""
QUERIES["x16_numbers"] = lambda spark, sf: x.numbered_references(table(spark, sf, "chunks").select("chunk_id", "content").distinct(), "chunk_id", "content")
ORACLE["x16_numbers"] = r"SELECT DISTINCT chunk_id AS key, unnest(regexp_extract_all(content, '(?:^|\W)#(\d{1,9})\b', 1)) AS ref FROM chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL"
