"""Queries of the activity log and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import dashboard as d
from quarry.plans.columns import READS
from quarry.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Records with one row per id and types in normal form.
E = "WITH e AS (SELECT DISTINCT * REPLACE (replace(lower(trim(type)), '-', '_') AS type) FROM session_events WHERE id IS NOT NULL)"
_COMMIT = "type = 'git' AND regexp_matches(lower(data), '^\\s*commit\\s*$|\\bgit\\b[^|;&]*\\bcommit\\b')"


def events_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The records with the columns that the query of this name reads."""
    return d.clean_events(table(spark, sf, "session_events"), READS[name].split())


def _add(name: str, make: Callable[..., DataFrame], sql: str, *more: str) -> None:
    """A query over records (and the other tables named)."""
    QUERIES[name] = lambda spark, sf: make(events_of(spark, sf, name), *[table(spark, sf, t) for t in more])
    ORACLE[name] = f"{E} {sql}" if not sql.startswith(",") else E + sql


def _meta(name: str, make: Callable[..., DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: make(table(spark, sf, "session_meta"))
    ORACLE[name] = sql


def _up(x: str, digits: int = 0) -> str:
    f = 10**digits
    return f"floor(({x}) * {f} + 0.5) / {f}.0::DOUBLE" if digits else f"floor(({x}) + 0.5)"


def _pct(a: str, b: str, scale: str = "100.0", digits: int = 1, other: str = "0.0") -> str:
    return f"CASE WHEN ({b}) > 0 THEN {_up(f'({a}) * {scale}::DOUBLE / ({b})', digits)} ELSE {other} END::DOUBLE"


_add(
    "a01_session_rollup", d.session_rollup,
    """, f AS (SELECT session_id, max(n) AS m FROM (SELECT session_id, data, count(*) AS n FROM e WHERE category = 'file' AND type IN ('file_edit', 'file_write') GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT session_id, count(*) AS tool_calls, CAST(sum(CASE WHEN category = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(DISTINCT type) AS unique_tools,
      count(DISTINCT CASE WHEN category = 'file' THEN data END) AS unique_files, max(CASE WHEN type = 'git_commit' THEN 1 ELSE 0 END) AS has_commit,
      CAST(coalesce(floor((floor(epoch(max(created_at))) - floor(epoch(min(created_at)))) / 60), 0) AS BIGINT) AS duration_min, CAST(sum(CASE WHEN type = 'external_ref' THEN 1 ELSE 0 END) AS BIGINT) AS sources_indexed,
      CAST(floor(coalesce(sum(bytes_avoided), 0) / 1024) AS BIGINT) AS kib_avoided, CAST(sum(CASE WHEN type IN ('file_search', 'file_glob') THEN 1 ELSE 0 END) AS BIGINT) AS search_queries,
      max_by(data, id) FILTER (WHERE type = 'git_commit') AS latest_commit FROM e GROUP BY 1)
    SELECT r.*, coalesce(f.m, 0) AS max_file_edits, coalesce(m.compact_count, 0) AS compact_count, least(unique_files, errors) AS edit_test_cycles FROM r LEFT JOIN f USING (session_id) LEFT JOIN session_meta m USING (session_id)""",
    "session_meta",
)
_add("a02_max_file_edits", d.max_file_edits, "SELECT session_id, max(n) AS max_file_edits FROM (SELECT session_id, data, count(*) AS n FROM e WHERE category = 'file' AND type IN ('file_edit', 'file_write') GROUP BY 1, 2) GROUP BY 1")
_add("a03_latest_by_session", d.latest_by_session, "SELECT session_id, count(*) AS events, max_by(project_dir, id) FILTER (WHERE project_dir <> '') AS latest_project, max(id) AS latest_id, max_by(type, id) AS latest_type FROM e GROUP BY 1")
_add("f05_project_sessions", d.project_sessions, "SELECT DISTINCT regexp_replace(replace(project_dir, '\\', '/'), '/+$', '') AS project, session_id FROM e WHERE project_dir <> ''")
_add("a07_bytes_summary", d.bytes_summary, "SELECT session_id, CAST(coalesce(sum(bytes_avoided), 0) AS BIGINT) AS avoided, CAST(coalesce(sum(bytes_returned), 0) AS BIGINT) AS returned, CAST(sum(length(data)) AS BIGINT) AS data_chars FROM e GROUP BY 1")
_add(
    "a24_time_to_commit", d.time_to_commit,
    f", c AS (SELECT session_id, min(created_at) AS f FROM e WHERE {_COMMIT} GROUP BY 1) SELECT session_id, {_up('(epoch_us(f) - epoch_us(started_at)) / 6e7', 1)} AS minutes FROM session_meta JOIN c USING (session_id) WHERE started_at IS NOT NULL AND f IS NOT NULL",
    "session_meta",
)
_meta("a19_session_durations", d.session_durations, f"SELECT session_id, event_count, compact_count, {_up('(epoch_us(last_event_at) - epoch_us(started_at)) / 6e7', 1)} AS duration_min FROM session_meta WHERE started_at IS NOT NULL AND last_event_at IS NOT NULL")
_add(
    "j04_edit_test_cycles", d.edit_test_cycles,
    ", n AS (SELECT session_id, type, lead(type) OVER (PARTITION BY session_id ORDER BY id) AS next FROM e WHERE session_id IS NOT NULL) SELECT session_id, count(*) AS cycles FROM n WHERE type = 'file_write' AND next = 'error_tool' GROUP BY 1",
)
_add("a25_rework", d.rework, "SELECT session_id, data, count(*) AS edits FROM e WHERE type IN ('file_write', 'file_read') AND data <> '' GROUP BY 1, 2 HAVING count(*) > 1")
_add(
    "a31_commits_per_session", d.commits_per_session,
    f""", g AS (SELECT session_id, CAST(sum(CASE WHEN {_COMMIT} THEN 1 ELSE 0 END) AS BIGINT) AS n, max(project_dir) AS p FROM e WHERE type = 'git' GROUP BY 1)
    SELECT m.session_id, coalesce(nullif(g.p, ''), nullif(m.project_dir, ''), '__unknown__') AS project, coalesce(g.n, 0) AS commits FROM session_meta m LEFT JOIN g USING (session_id)""",
    "session_meta",
)
_add("a34_retry_storms", d.retry_storms, "SELECT session_id, count(*) AS retries FROM e WHERE category = 'iteration-loop' OR type = 'retry_detected' GROUP BY 1 HAVING count(*) > 3")
_add("a35_delegating_sessions", d.delegation_per_session, "SELECT session_id, count(*) AS launched FROM e WHERE type = 'subagent_launched' GROUP BY 1 HAVING count(*) > 1")
_add("a12_conversation_days", d.conversation_days, "SELECT session_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT category) AS categories FROM e WHERE created_at IS NOT NULL GROUP BY 1, 2")
_add("a12_span_seconds", d.span_seconds, "SELECT session_id, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 AS seconds, count(*) AS events FROM e WHERE created_at IS NOT NULL GROUP BY 1")
_case = " ".join(f"WHEN type = '{t}' THEN '{n}'" for t, n in d.TOOL_NAMES.items())
_context = ", ".join(f"'{t}'" for t in d.CONTEXT_TYPES)
_add("a20_tool_usage", d.tool_usage, f"SELECT CASE {_case} ELSE type END AS tool, count(*) AS calls FROM e WHERE type NOT IN ({_context}) GROUP BY 1")
_add(
    "f10_command_prefixes", lambda e: d.by_prefix(e, ("bash_outcome", "git", "git_commit"), ("docker", "npm", "git commit", "git", "cd", "rg", "exit_code")),
    "SELECT CASE WHEN lower(data) LIKE 'docker%' THEN 'docker' WHEN lower(data) LIKE 'npm%' THEN 'npm' WHEN lower(data) LIKE 'git commit%' THEN 'git commit' WHEN lower(data) LIKE 'git%' THEN 'git' WHEN lower(data) LIKE 'cd%' THEN 'cd' "
    "WHEN lower(data) LIKE 'rg%' THEN 'rg' WHEN lower(data) LIKE 'exit\\_code%' ESCAPE '\\' THEN 'exit_code' ELSE substr(data, 1, 20) END AS tool, count(*) AS calls FROM e WHERE type IN ('bash_outcome', 'git', 'git_commit') GROUP BY 1",
)
_add(
    "a34_error_tools", d.error_tools,
    "SELECT CASE WHEN lower(data) LIKE '%bash%' THEN 'bash' WHEN lower(data) LIKE '%read%' THEN 'read' WHEN lower(data) LIKE '%edit%' THEN 'edit' WHEN lower(data) LIKE '%write%' THEN 'write' WHEN lower(data) LIKE '%agent%' THEN 'agent' ELSE substr(data, 1, 30) END AS tool, count(*) AS errors FROM e WHERE category = 'error' GROUP BY 1",
)
_add("a22_file_activity", d.file_activity, "SELECT data, count(*) AS touches, min(type) AS op FROM e WHERE type IN ('file_read', 'file_write', 'file_edit') AND data <> '' GROUP BY 1 ORDER BY touches DESC, data LIMIT 20")
_add("a39_hot_files", d.hot_files, "SELECT data, count(*) AS touches FROM e WHERE category = 'file' AND type IN ('file_read', 'file_edit', 'file_write') AND data <> '' GROUP BY 1 HAVING count(*) > 3 ORDER BY touches DESC, data LIMIT 10")


def _values(*types: str) -> str:
    where = f"type IN ({', '.join(repr(t) for t in types)}) AND data <> ''"
    return f"SELECT data, count(*) AS n, {_up(f'count(*) * 100.0::DOUBLE / (SELECT count(*) FROM e WHERE {where})', 1)} AS pct, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM e WHERE {where} GROUP BY 1"


_add("a23_work_modes", lambda e: d.values_of(e, "intent"), _values("intent"))
_add("a23_rule_freshness", lambda e: d.values_of(e, "rule"), _values("rule"))
_add(
    "a33_category_counts", d.category_counts,
    f", k AS (SELECT * FROM (VALUES {', '.join(f'({c!r}, {t!r})' for c, ts in d.CATEGORY_TYPES.items() for t in ts)}) v(category, type)), s AS (SELECT category, type, count(*) AS n FROM e GROUP BY 1, 2) SELECT k.category, k.type, coalesce(s.n, 0) AS n FROM k LEFT JOIN s USING (category, type)",
)
_add(
    "a10_category_previews", d.category_previews,
    """, f AS (SELECT session_id, category, data, min(id) AS first FROM e WHERE data IS NOT NULL AND data <> '' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY first) AS k FROM f),
    p AS (SELECT session_id, category, string_agg(substr(data, 1, 40), '; ' ORDER BY k) AS previews FROM r WHERE k <= 5 GROUP BY 1, 2), c AS (SELECT session_id, category, count(*) AS events FROM e GROUP BY 1, 2)
    SELECT session_id, category, events, previews FROM c LEFT JOIN p USING (session_id, category)""",
)
_add("a36_rejections", d.rejections, "SELECT coalesce(nullif(trim(split_part(data, ':', 1)), ''), 'unknown') AS tool, count(*) AS n FROM e WHERE category = 'rejected-approach' AND data IS NOT NULL AND data <> '' GROUP BY 1")
_MS = ", x AS (SELECT regexp_extract(data, '(?:^|\\s)tool:(\\S+)', 1) AS tool, regexp_extract(data, '(?:^|\\s)duration_ms:(\\d{1,15})(?:\\s|$)', 1) AS ms, regexp_extract(data, '(?:^|\\s)lines:(\\d{1,9})(?:\\s|$)', 1) AS v FROM e) "
_add("a34_latency_by_tool", d.latency_by_tool, _MS + "SELECT tool, count(*) AS calls, CAST(floor(avg(ms::BIGINT) + 0.5) AS BIGINT) AS avg_ms, max(ms::BIGINT) AS max_ms FROM x WHERE tool <> '' AND ms <> '' GROUP BY 1")
_add(
    "a34_latency_p95", d.latency_p95,
    _MS + ", y AS (SELECT ms::BIGINT AS ms, row_number() OVER (ORDER BY ms::BIGINT) - 1 AS k FROM x WHERE ms <> '') SELECT count(*) AS samples, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS avg_ms, max(ms) FILTER (WHERE k = (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM y)) AS p95_ms FROM y",
)
_add("a08_lines_median", d.kv_median, _MS + "SELECT tool, count(*) AS calls, median(v::BIGINT)::DOUBLE AS median_lines, max(v::BIGINT) AS max_lines FROM x WHERE tool <> '' AND v <> '' GROUP BY 1")
_add(
    "a08_json_tool_usage", d.json_tool_usage,
    """, j AS (SELECT json_extract_string(data, '$.tool') AS tool, try_cast(json_extract_string(data, '$.args.limit') AS DOUBLE) AS v FROM (SELECT CASE WHEN json_valid(data) THEN data END AS data FROM e WHERE type = 'mcp_tool_call' AND data LIKE '{%'))
    SELECT tool, count(*) AS calls, median(CASE WHEN v > 0 THEN floor(v) END)::DOUBLE AS median_limit, max(CASE WHEN v > 0 THEN floor(v) END)::DOUBLE AS max_limit FROM j WHERE tool IS NOT NULL GROUP BY 1""",
)
_add(
    "a27_project_activity", d.project_activity,
    "SELECT coalesce(nullif(project_dir, ''), '__unknown__') AS project, count(DISTINCT session_id) AS sessions, count(*) AS events, round(avg(coalesce(attribution_confidence, 0)), 6) AS avg_confidence, CAST(sum(CASE WHEN coalesce(attribution_confidence, 0) >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS high_confidence FROM e GROUP BY 1",
)
_add(
    "a27_attribution_summary", d.attribution_summary,
    f""", t AS (SELECT count(*) AS total, CAST(sum(CASE WHEN coalesce(project_dir, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS unknown, round(sum(coalesce(attribution_confidence, 0)), 4) AS c, sum(CASE WHEN coalesce(attribution_confidence, 0) >= 0.8 THEN 1 ELSE 0 END) AS high FROM e)
    SELECT total, unknown, {_pct('unknown', 'total')} AS unknown_pct, {_pct('c', 'total')} AS confidence_pct, {_pct('high', 'total')} AS high_pct FROM t""",
)
_add(
    "a28_carried_project", d.carried_project,
    ", c AS (SELECT coalesce(last_value(nullif(project_dir, '') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '__unknown__') AS project FROM e WHERE session_id IS NOT NULL) SELECT project, count(*) AS events FROM c GROUP BY 1",
)
_add("a29_hourly", d.hourly, "SELECT CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS events FROM e WHERE created_at IS NOT NULL GROUP BY 1")
_meta("a30_weekly", d.weekly, "SELECT strftime(started_at, '%Y-W%W') AS week, count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events FROM session_meta WHERE started_at IS NOT NULL GROUP BY 1")
_add(
    "a30_weekly_errors", d.weekly_errors,
    f", t AS (SELECT strftime(created_at, '%Y-W%W') AS week, CAST(sum(CASE WHEN type = 'error_tool' THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS total FROM e WHERE created_at IS NOT NULL GROUP BY 1) SELECT week, errors, total, {_pct('errors', 'total')} AS error_rate FROM t",
)
_meta("a19_sessions_by_date", d.sessions_by_date, "SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events, CAST(sum(compact_count) AS BIGINT) AS compacts FROM session_meta WHERE started_at IS NOT NULL GROUP BY 1")
_BURSTS = """, b AS (SELECT session_id, id, created_at AS ts, CASE WHEN epoch_us(created_at) - epoch_us(lag(created_at) OVER w) <= {gap} * 1000000 THEN 0 ELSE 1 END AS new FROM e WHERE {where} AND created_at IS NOT NULL AND session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY ts, id) AS BIGINT) AS run FROM b),
    g AS (SELECT session_id, run, min(id) AS first_id, count(*) AS size, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM r GROUP BY 1, 2) """
_SUB = "type IN ('subagent_launched', 'subagent_completed')"
_add("a26_subagent_bursts", d.bursts, _BURSTS.format(gap=30, where=_SUB) + "SELECT session_id, first_id, size, seconds FROM g")
_add("w05_file_bursts", lambda e: d.bursts(e, 600, ("file_read", "file_edit", "file_write")), _BURSTS.format(gap=600, where="type IN ('file_read', 'file_edit', 'file_write')") + "SELECT session_id, first_id, size, seconds FROM g")
_add(
    "a26_burst_summary", lambda e: d.burst_summary(d.bursts(e, 600, ("file_read", "file_edit", "file_write"))),
    _BURSTS.format(gap=600, where="type IN ('file_read', 'file_edit', 'file_write')")
    + "SELECT CAST(sum(size) AS BIGINT) AS total, CAST(sum(CASE WHEN size >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS bursts, max(size) AS largest, CAST(sum(CASE WHEN size >= 2 THEN size ELSE 0 END) AS BIGINT) AS parallel, CAST(sum(CASE WHEN size < 2 THEN size ELSE 0 END) AS BIGINT) AS sequential, CAST(sum(CASE WHEN size >= 2 THEN (size - 1) * 2 ELSE 0 END) AS BIGINT) AS saved_min FROM g",
)
_add(
    "a26_global_bursts", lambda e: d.bursts(e, 30, keys=()),
    f""", b AS (SELECT id, created_at AS ts, CASE WHEN epoch_us(created_at) - epoch_us(lag(created_at) OVER (ORDER BY created_at, id)) <= 30000000 THEN 0 ELSE 1 END AS new FROM e WHERE {_SUB} AND created_at IS NOT NULL),
    r AS (SELECT *, sum(new) OVER (ORDER BY ts, id) AS run FROM b) SELECT min(id) AS first_id, count(*) AS size, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM r GROUP BY run""",
)
_add(
    "a18_overview", d.overview,
    "SELECT 'events' AS what, count(*) AS n FROM e UNION ALL SELECT 'sessions', count(*) FROM session_meta UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM chunks",
    "session_meta", "sources", "chunks",
)


def _sum(cond: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


_add(
    "a21_ratios", d.ratios,
    f""", t AS (SELECT {_sum("type = 'file_read'")} AS reads, {_sum("type = 'file_write'")} AS writes, {_sum("type IN ('file_read', 'file_glob', 'file_search')")} AS explore, {_sum("type = 'mcp'")} AS sandbox,
      {_sum(f"type NOT IN ({_context})")} AS calls, {_sum("type = 'error_tool'")} AS errors FROM e)
    SELECT *, {_pct('reads', 'writes', '1.0', 1, 'reads')} AS read_write, {_pct('explore', 'explore + writes')} AS explore_pct, {_pct('sandbox', 'calls')} AS sandbox_pct, {_pct('errors', 'calls')} AS error_pct FROM t""",
)
_add("a34_error_resolution", d.error_resolution, f", t AS (SELECT {_sum(chr(99) + 'ategory = ' + repr('error'))} AS errors, {_sum('type = ' + repr('error_resolved'))} AS resolved FROM e) SELECT *, {_pct('resolved', 'errors')} AS rate FROM t")
_add(
    "a35_delegation", d.delegation,
    f""", t AS (SELECT {_sum("type = 'subagent_launched'")} AS launched, {_sum("type = 'subagent_completed'")} AS done FROM e), u AS (SELECT launched, CASE WHEN launched > 0 THEN least(done, launched) ELSE done END AS completed FROM t)
    SELECT *, {_pct('completed', 'launched')} AS rate, completed * 2 AS saved_min FROM u""",
)
_add(
    "a36_governance", d.governance,
    f""", t AS (SELECT {_sum("type = 'rejected'")} AS rejections, {_sum("type IN ('decision', 'decision_question')")} AS decisions, {_sum("type = 'plan_approved'")} AS approved, {_sum("type = 'plan_rejected'")} AS plans_rejected FROM e)
    SELECT *, {_pct('approved', 'approved + plans_rejected')} AS approval_rate FROM t""",
)
_add("a37_git_mix", d.git_mix, "SELECT operation, count(*) AS n FROM (SELECT regexp_extract(data, '(?:^|\\s)git\\s+([a-z-]+)', 1) AS operation FROM e WHERE category = 'git') WHERE operation <> '' GROUP BY 1")
_add(
    "a38_context_health", d.context_health,
    f""", t AS (SELECT count(DISTINCT CASE WHEN type = 'rule' AND data <> '' THEN data END) AS rule_files, {_sum("type IN ('rule', 'rule_content')")} AS rules, count(DISTINCT CASE WHEN category = 'skill' AND data <> '' THEN data END) AS skills,
      {_sum("type = 'blocker'")} AS blockers, {_sum("type = 'blocker_resolved'")} AS resolved FROM e), m AS (SELECT count(*) AS s, coalesce(sum(compact_count), 0) AS c FROM session_meta)
    SELECT rule_files, skills, blockers, resolved, {_pct('rules', 's', '1.0', 2)} AS rules_per_session, CAST(CASE WHEN s > 0 THEN floor(c * 100.0 / s + 0.5) ELSE 0 END AS BIGINT) AS compact_rate, {_pct('resolved', 'blockers')} AS blocker_rate FROM t, m""",
    "session_meta",
)
_CHURN = "count(DISTINCT CASE WHEN type IN ('file_write', 'file_edit') THEN data END) AS edited, count(DISTINCT CASE WHEN type = 'file_read' THEN data END) AS read"
_add("a39_file_churn", d.file_churn, f", t AS (SELECT {_CHURN} FROM e WHERE category = 'file' AND data <> '') SELECT *, {_pct('edited', 'read', '1.0', 2)} AS churn FROM t")
_add(
    "a40_scores", d.scores,
    f""", t AS (SELECT count(*) AS ev, count(DISTINCT CASE WHEN {_COMMIT} THEN session_id END) AS cs, {_sum("type = 'subagent_launched'")} AS launched, {_sum("type = 'subagent_completed'")} AS done0, {_sum("category = 'error'")} AS errors, {_sum("type = 'error_resolved'")} AS resolved,
      count(DISTINCT CASE WHEN category = 'file' AND type IN ('file_write', 'file_edit') AND data <> '' THEN data END) AS edited, count(DISTINCT CASE WHEN category = 'file' AND type = 'file_read' AND data <> '' THEN data END) AS rd, {_sum("category = 'agent-finding'")} AS findings,
      count(DISTINCT CASE WHEN type = 'rule' AND data <> '' THEN data END) AS rules, count(DISTINCT CASE WHEN category = 'skill' AND data <> '' THEN data END) AS skills, {_sum("type = 'plan_approved'")} AS approved, {_sum("type = 'plan_rejected'")} AS rejected, count(DISTINCT CASE WHEN type = 'intent' AND data <> '' THEN data END) AS modes FROM e),
    b AS (SELECT created_at AS ts, id, CASE WHEN epoch_us(created_at) - epoch_us(lag(created_at) OVER (ORDER BY created_at, id)) <= 30000000 THEN 0 ELSE 1 END AS new FROM e WHERE {_SUB} AND created_at IS NOT NULL),
    r AS (SELECT sum(new) OVER (ORDER BY ts, id) AS run FROM b), p AS (SELECT count(*) AS parallel FROM (SELECT run FROM r GROUP BY run HAVING count(*) >= 2)),
    m AS (SELECT count(*) AS s FROM session_meta), w AS (SELECT count(*) AS storms FROM (SELECT session_id FROM e WHERE category = 'iteration-loop' OR type = 'retry_detected' GROUP BY 1 HAVING count(*) > 3)),
    u AS (SELECT *, {_pct('resolved', 'errors')} AS res, CASE WHEN launched > 0 THEN least(done0, launched) ELSE done0 END AS done FROM t, m, w, p)
    SELECT CAST(least(100, floor(CASE WHEN s > 0 THEN cs * 100.0 / s ELSE 0 END * 0.3 + least(100.0, CASE WHEN s > 0 THEN launched * 100.0 / s ELSE 0 END) * 0.2 + (100 - least(100.0, CASE WHEN rd > 0 THEN edited * 100.0 / rd ELSE 0 END)) * 0.2 + res * 0.3 + 0.5)) AS BIGINT) AS productivity,
      CAST(least(100, floor(CASE WHEN errors = 0 THEN 100.0 ELSE res END * 0.4 + (100 - CASE WHEN s > 0 THEN storms * 100.0 / s ELSE 0 END) * 0.3 + (100 - CASE WHEN ev > 0 THEN errors * 100.0 / ev ELSE 0 END) * 0.3 + 0.5)) AS BIGINT) AS quality,
      CAST(least(100, floor({_pct('done', 'launched')} * 0.5 + CASE WHEN parallel > 0 THEN 30.0 ELSE 0 END + least(findings / 5.0, 1.0) * 20 + 0.5)) AS BIGINT) AS delegation,
      CAST(least(100, floor(CASE WHEN rules > 0 THEN 30.0 ELSE 0 END + least(skills * 20, 100) * 0.2 + CASE WHEN approved + rejected > 0 THEN {_pct('approved', 'approved + rejected')} ELSE 50.0 END * 0.25 + CASE WHEN modes > 1 THEN 25.0 ELSE 12.5 END + 0.5)) AS BIGINT) AS context_health, (ev < 50 OR s < 3) AS insufficient FROM u""",
    "session_meta",
)
_add(
    "a09_savings", d.savings,
    f""", t AS (SELECT type, count(*) AS calls, CAST(coalesce(sum(bytes_avoided), 0) AS BIGINT) AS avoided, CAST(coalesce(sum(bytes_returned), 0) AS BIGINT) AS returned FROM e GROUP BY 1)
    SELECT *, {_up('avoided / 1024.0::DOUBLE', 1)} AS avoided_kib, CAST(floor(avoided / 4) AS BIGINT) AS tokens, {_pct('avoided', 'avoided + returned')} AS kept_pct FROM t""",
)
_add(
    "a05_ledger", d.capped_ledger,
    """, t AS (SELECT session_id, count(*) AS calls, CAST(coalesce(sum(bytes_returned), 0) AS BIGINT) AS returned, CAST(sum(CASE WHEN coalesce(bytes_avoided, 0) + coalesce(bytes_returned, 0) > 32768 THEN 2048 ELSE coalesce(bytes_avoided, 0) + coalesce(bytes_returned, 0) END) AS BIGINT) AS counterfactual FROM e GROUP BY 1)
    SELECT *, counterfactual - returned AS saved FROM t""",
)
_add(
    "a15_real_usage", d.real_usage,
    """, t AS (SELECT coalesce(source_hook, '') AS source, count(*) AS events, count(DISTINCT nullif(project_dir, '')) AS projects, count(DISTINCT session_id) AS sessions, round(avg(length(data)), 4) AS avg_chars, max(created_at) AS last FROM e GROUP BY 1)
    SELECT source, events, projects, sessions, avg_chars, events >= 100 AND projects >= 5 AND avg_chars >= 50 AND coalesce(last >= (SELECT max(created_at) FROM e) - INTERVAL 30 DAY, false) AS real FROM t""",
)
_add(
    "a14_kept_out", d.kept_out,
    """, p AS (SELECT CAST(coalesce(sum(bytes_avoided), 0) + coalesce(sum(bytes_returned), 0) AS BIGINT) AS n FROM e), o AS (SELECT session_id, CAST(coalesce(sum(bytes_avoided), 0) AS BIGINT) AS avoided, CAST(coalesce(sum(bytes_returned), 0) AS BIGINT) AS returned FROM e GROUP BY 1)
    SELECT o.*, greatest(0, n - returned) AS kept_out FROM o, p""",
)
