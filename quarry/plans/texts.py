"""Queries of chunking, extraction, state, store and lifecycle operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.words import SPECIAL, STOPWORDS, query_terms, vocabulary_words
from quarry.operators import chunking, extract, state
from quarry.operators.search import unique_chunks
from quarry.plans.dashboard import E, events_of
from quarry.sources import store, web
from quarry.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_C = "c AS (SELECT DISTINCT chunk_id, source_id, coalesce(title, '') AS title, coalesce(content, '') AS content, content_type FROM chunks WHERE chunk_id IS NOT NULL)"


def _add(name: str, make: Callable[..., DataFrame], sql: str | None, *tables: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return make(*[events_of(spark, d, name) if t == "session_events" else unique_chunks(table(spark, d, t)) if t == "chunks" else table(spark, d, t) for t in tables])

    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _now(sources: DataFrame):  # noqa: ANN202
    return sources.agg(F.max("indexed_at").alias("n")).scalar()


# --- chunking -------------------------------------------------------------------------------------------------------
def _kind():  # noqa: ANN202
    return F.when(F.col("doc_kind").isin("note", "howto", "release", "changelog", "issue"), "markdown").otherwise("plain").alias("kind")


_add("c01_chunk_documents", lambda d: chunking.chunk_documents(d.select(F.col("doc_id").cast("string").alias("label"), "text", _kind())), None, "documents")
_add("c05_chunk_json", lambda e: chunking.chunk_documents(e.where("data like '{%'").select(F.col("id").cast("string").alias("label"), F.col("data").alias("text"), F.lit("json").alias("kind"))), None, "session_events")
_add(
    "c04_line_groups", lambda d: chunking.line_groups(d, "doc_id", "text"),
    """WITH l AS (SELECT doc_id AS key, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), g AS (SELECT key, l, unnest(range(0, len(l), 18)) AS p FROM l)
    SELECT key, CAST(p // 18 AS INTEGER) AS group_no, CAST(p + 1 AS INTEGER) AS first_line, array_to_string(l[p + 1 : p + 20], chr(10)) AS content FROM g""",
    "documents",
)
_add("s06_html_to_markdown", lambda c: web.fetched(c.where("content like '%<%'").select(F.col("chunk_id").cast("string").alias("url"), F.lit("text/html").alias("content_type"), F.col("content").alias("body"))), None, "chunks")

# --- extraction -----------------------------------------------------------------------------------------------------
_add(
    "e02_working_directory", lambda e: e.select("id", extract.working_directory("data").alias("dir")).where("dir <> ''"),
    E + """, x AS (SELECT id, regexp_extract(data, '\\bcd\\s+(?:"([^"]+)"|''([^'']+)''|(\\S+))', 0) AS h FROM e) SELECT id, regexp_replace(regexp_replace(h, '^cd\\s+', ''), '^["'']|["'']$', '', 'g') AS dir FROM x WHERE h <> ''""",
    "session_events",
)
_ops = " ".join(f"WHEN regexp_matches(data, '\\bgit\\s+{v}\\b') THEN '{o}'" for v, o in extract.GIT_OPERATIONS)
_parsed = " ".join(f"WHEN p = '{v}' THEN '{o}'" for v, o in extract.GIT_OPERATIONS)
_add(
    "e04_git", lambda e: e.where("contains(data, 'git')").select("id", extract.git_operation("data").alias("operation"), extract.commit_message("data").alias("message")).where("operation is not null"),
    E + f""", x AS (SELECT id, data, regexp_extract(data, '\\bgit(?:\\s+-\\S+(?:\\s+[^\\s-]\\S*)?)*?\\s+([a-z][a-z-]*)\\b', 1) AS p, regexp_extract(data, '\\bgit\\b.*\\bcommit\\b.*?\\s(?:-[a-z]*m|--message)(?:\\s+|=)("[^"]*"|''[^'']*''|\\S+)', 1) AS m FROM e),
    y AS (SELECT id, coalesce(CASE {_parsed} END, CASE {_ops} END) AS operation, regexp_replace(m, '^["'']|["'']$', '', 'g') AS message FROM x) SELECT * FROM y WHERE operation IS NOT NULL""",
    "session_events",
)
_env = extract.ENVIRONMENT.replace("'", "''")
_add(
    "e05_environment", lambda e: e.select("id", extract.environment_command("data").alias("command")).where("command is not null"),
    E + f" SELECT id, regexp_replace(data, '\\bexport\\s+(\\w+)=\\S*', 'export \\1=***', 'g') AS command FROM e WHERE regexp_matches(data, '{_env}')", "session_events",
)
_errors = " ".join(f"WHEN regexp_matches(lower(data), '(?s){p}') THEN '{n}'" for n, p in extract.ERRORS)
_add("e16_error_class", lambda e: e.groupBy(extract.error_class("data").alias("class")).agg(F.count("*").alias("n")), E + f" SELECT CASE {_errors} ELSE 'unknown' END AS class, count(*) AS n FROM e GROUP BY 1", "session_events")
_js = "tool IN ('npm', 'pnpm', 'yarn', 'bun')"


def _says(p: str) -> str:
    return f"regexp_matches(lower(data), '\\b(?:{p})\\b')"


_add(
    "e17_command_class", lambda e: e.groupBy(extract.command_class("data").alias("class"), extract.command_tool("data").alias("tool")).agg(F.count("*").alias("n")).where("class <> 'other'"),
    E + f""", x AS (SELECT data, regexp_extract(lower(trim(data)), '^(?:\\w+=\\S*\\s+)*(?:(?:sudo|time|nice)\\s+)*(\\S*)', 1) AS tool FROM e),
    y AS (SELECT tool, CASE WHEN tool = 'git' THEN 'git' WHEN ({_js} OR tool IN ('pip', 'pip3')) AND {_says('install|add|ci')} THEN 'install' WHEN tool = 'brew' AND {_says('install')} THEN 'install'
      WHEN tool IN ('vitest', 'jest', 'pytest', 'mocha', 'playwright', 'cypress') OR ({_js} AND {_says('test')}) THEN 'test' WHEN tool IN ('eslint', 'tslint', 'ruff', 'flake8', 'pylint') OR ({_js} AND {_says('lint')}) THEN 'lint'
      WHEN tool IN ('prettier', 'black', 'gofmt', 'rustfmt') OR ({_js} AND {_says('format|fmt')}) THEN 'format' WHEN tool IN ('tsc', 'webpack', 'rollup', 'vite', 'esbuild', 'make') OR (({_js} OR tool IN ('cargo', 'go')) AND {_says('build')}) THEN 'build'
      WHEN ({_js} AND {_says('run')}) OR tool IN ('node', 'python', 'python3', 'deno') THEN 'run' ELSE 'other' END AS class FROM x)
    SELECT class, tool, count(*) AS n FROM y WHERE class <> 'other' GROUP BY 1, 2""",
    "session_events",
)


def _ms():  # noqa: ANN202
    return F.regexp_extract("data", r"(?:^|\s)duration_ms:(\d{1,15})(?:\s|$)", 1)


_add(
    "e17_duration_buckets", lambda e: e.where(_ms() != "").groupBy(extract.duration_bucket(_ms().cast("long")).alias("bucket")).agg(F.count("*").alias("n")),
    E + ", x AS (SELECT try_cast(nullif(regexp_extract(data, '(?:^|\\s)duration_ms:(\\d{1,15})(?:\\s|$)', 1), '') AS BIGINT) AS ms FROM e) SELECT CASE WHEN ms < 1000 THEN 'fast' WHEN ms < 10000 THEN 'medium' WHEN ms < 60000 THEN 'slow' ELSE 'timeout' END AS bucket, count(*) AS n FROM x WHERE ms IS NOT NULL GROUP BY 1",
    "session_events",
)
_add(
    "e10_messages", lambda d: d.where("text is not null").groupBy(extract.looks_like_decision("text").alias("decision"), F.coalesce(extract.intent("text"), F.lit("none")).alias("intent")).agg(F.count("*").alias("n")),
    """SELECT regexp_matches(trim(text), '[,;，；、،]') AND regexp_matches(trim(text), '\\p{L}') AND NOT regexp_matches(trim(text), '[?？؟¿]') AND length(trim(text)) BETWEEN 15 AND 500 AS decision,
    CASE WHEN regexp_matches(trim(text), '[?？؟¿]') THEN 'investigate' WHEN length(trim(text)) > 0 AND length(trim(text)) < 60 AND regexp_matches(trim(text), '\\p{L}') THEN 'implement' ELSE 'none' END AS intent, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2""",
    "documents",
)
_add(
    "x20_message_features", lambda d: extract.message_features(d, "doc_id", "text"),
    """WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, len(regexp_extract_all(text, '\\p{L}')) AS letters FROM documents WHERE text IS NOT NULL)
    SELECT doc_id AS key, letters, len(w) AS words, CASE WHEN letters > 0 THEN round(len(regexp_extract_all(text, '\\p{Lu}')) / letters, 6) ELSE 0 END AS upper, len(regexp_extract_all(text, '[A-Za-z0-9_-]+\\.(?:py|ts|js|go|rs|md|json|yaml|sh|sql)\\b')) AS files,
      len(regexp_extract_all(text, '[?？؟¿]')) AS questions, CAST(floor(len(regexp_extract_all(text, '```')) / 2) AS BIGINT) AS fences, len(regexp_extract_all(text, 'https?://')) AS urls, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS distinct_words FROM t""",
    "documents",
)
_add(
    "x16_references", lambda c: extract.references(c, "chunk_id", "content"),
    f"""WITH {_C}, u AS (SELECT chunk_id AS key, lower(unnest(regexp_extract_all(content, 'https?://([^\\s/?#)\\]>"'']+)', 1))) AS host FROM c) SELECT key, host, count(*) AS n FROM u WHERE NOT regexp_matches(host, '^(localhost|127[.]0[.]0[.]1)') GROUP BY 1, 2""",
    "chunks",
)
_add(
    "x05_vocabulary_words", lambda c: c.select(F.explode(F.array_distinct(vocabulary_words("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("chunks")),
    f"WITH {_C}, x AS (SELECT DISTINCT chunk_id, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_-]+')) AS word FROM c) SELECT word, count(*) AS chunks FROM x WHERE length(word) >= 3 AND word NOT IN ({', '.join(repr(w) for w in sorted(STOPWORDS))}) GROUP BY 1",
    "chunks",
)
_stop = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_signs = "'" + SPECIAL.replace("'", "''") + "'"
_add(
    "x01_query_terms", lambda c: c.select("chunk_id", F.array_join(F.array_sort(query_terms("title")), " ").alias("terms")),
    f"""WITH {_C}, q AS (SELECT DISTINCT chunk_id, list_distinct(list_filter(regexp_split_to_array(translate(lower(title), {_signs}, '{" " * len(SPECIAL)}'), '\\s+'), lambda x: x <> '' AND x NOT IN ('and', 'or', 'not', 'near'))) AS w FROM c)
    SELECT chunk_id, array_to_string(list_sort(CASE WHEN len(list_filter(w, lambda x: x NOT IN ({_stop}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({_stop})) ELSE w END), ' ') AS terms FROM q""",
    "chunks",
)

# --- order-dependent ------------------------------------------------------------------------------------------------
_add("st1_stored_events", state.stored_events, None, "session_events")
_add("st2_evicted_events", lambda e: state.evicted_events(e, 200), None, "session_events")
_add("st4_flood_verdicts", lambda e: state.flood_verdicts(e, 3600), None, "session_events")
_add("st5_resolved_errors", state.resolved_errors, None, "session_events")
_add("st6_retry_loops", lambda e: state.retry_loops(e, 2), None, "session_events")
_add(
    "st7_carried_projects", state.carried_projects,
    E + """, k AS (SELECT session_id, id, nullif(project_dir, '') AS own, CASE WHEN attribution_confidence >= 0.9 THEN nullif(project_dir, '') END AS sure, CASE WHEN attribution_confidence >= 0.55 THEN nullif(project_dir, '') END AS likely FROM e WHERE session_id IS NOT NULL),
    c AS (SELECT session_id, id, own, last_value(sure IGNORE NULLS) OVER w AS a, last_value(likely IGNORE NULLS) OVER w AS b FROM k WINDOW w AS (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT session_id, id, coalesce(own, a, b) AS project, own IS NULL AND coalesce(a, b) IS NOT NULL AS carried FROM c""",
    "session_events",
)

# --- filters, order, store, lifecycle -------------------------------------------------------------------------------
_add("f01_sources_like", lambda s: s.where(F.contains(F.lower("label"), F.lit("index:"))).select("id", "label"), "SELECT id, label FROM sources WHERE contains(lower(label), 'index:')", "sources")
_add("f03_code_chunks", lambda c: c.where("content_type = 'code'").select("chunk_id", "title"), f"WITH {_C} SELECT chunk_id, title FROM c WHERE content_type = 'code'", "chunks")
_add("f06_priority_events", lambda e: e.where("priority >= 3 and category = 'file'").select("session_id", "id", "data"), E + " SELECT session_id, id, data FROM e WHERE priority >= 3 AND category = 'file'", "session_events")
_add(
    "f07_event_search", lambda e: e.where("(project_dir = '' or project_dir is not null) and (data ilike '%token%' or category ilike '%token%')").select("id", "category", "data"),
    E + " SELECT id, category, data FROM e WHERE project_dir IS NOT NULL AND (data ILIKE '%token%' OR category ILIKE '%token%')", "session_events",
)
_add("f08_chunk_inventory", lambda c, s: c.join(s.select(F.col("id").alias("source_id"), "label"), "source_id").select("label", "chunk_id", F.octet_length("content").alias("bytes")), f"WITH {_C} SELECT s.label, chunk_id, CAST(strlen(content) AS INTEGER) AS bytes FROM c JOIN sources s ON s.id = c.source_id", "chunks", "sources")
_add("f12_project_names", lambda e, m: e.join(m.select("session_id", F.col("project_dir").alias("p")), "session_id", "left").groupBy(F.coalesce(F.nullif(F.col("project_dir"), F.lit("")), F.nullif(F.col("p"), F.lit("")), F.lit("__unknown__")).alias("project")).agg(F.count("*").alias("n")), E + " SELECT coalesce(nullif(e.project_dir, ''), nullif(m.project_dir, ''), '__unknown__') AS project, count(*) AS n FROM e LEFT JOIN session_meta m USING (session_id) GROUP BY 1", "session_events", "session_meta")


def _last():  # noqa: ANN202
    return F.row_number().over(Window.partitionBy("session_id", "category").orderBy(F.desc("id")))


_add("w07_last_per_category", lambda e: e.withColumn("k", _last()).where("k <= 3").select("session_id", "category", "id", F.col("k").cast("long").alias("k")), E + ", r AS (SELECT session_id, category, id, row_number() OVER (PARTITION BY session_id, category ORDER BY id DESC) AS k FROM e) SELECT * FROM r WHERE k <= 3", "session_events")
_add("k07_byte_budget", lambda c: store.byte_budget(c, "source_id", [F.col("chunk_id")], "content", 8192).select("source_id", "chunk_id", "used"), f"WITH {_C}, r AS (SELECT source_id, chunk_id, CAST(sum(strlen(content)) OVER (PARTITION BY source_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM c) SELECT * FROM r WHERE used <= 8192", "chunks")
_add("u04_distinct_results", lambda c: c.groupBy("source_id", "title", "content").agg(F.min("chunk_id").alias("chunk_id")).select("source_id", "title", "chunk_id"), f"WITH {_C} SELECT source_id, title, min(chunk_id) AS chunk_id FROM c GROUP BY source_id, title, content", "chunks")
_add("s14_current_sources", lambda s: store.current_sources(s).select("id", "label"), "SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY indexed_at DESC NULLS LAST, id DESC) AS k FROM sources WHERE label IS NOT NULL) WHERE k = 1", "sources")
_add("s07_cache_hits", lambda s: store.cache_hits(s, s, _now(s), 7 * 86_400), """WITH k AS (SELECT label, max(indexed_at) AS ts, max_by(chunk_count, indexed_at) AS n FROM sources WHERE label IS NOT NULL GROUP BY 1), h AS (SELECT *, coalesce((SELECT max(indexed_at) FROM sources) - ts < INTERVAL 7 DAY, false) AS hit FROM k)
    SELECT label, hit, CAST(CASE WHEN hit THEN coalesce(n, 0) * 1600 ELSE 0 END AS BIGINT) AS bytes FROM h""", "sources")  # fmt: skip
_add("r13_without_expired", lambda s: store.without_expired(s, _now(s), 30).select("id"), "SELECT id FROM sources WHERE indexed_at >= (SELECT max(indexed_at) FROM sources) - INTERVAL 30 DAY", "sources")
_add("l08_orphans", lambda e, m: store.orphans(e, m).groupBy("session_id").agg(F.count("*").alias("events")), E + " SELECT session_id, count(*) AS events FROM e WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM session_meta WHERE session_id IS NOT NULL) GROUP BY 1", "session_events", "session_meta")
_add("l09_shard_keys", lambda e: e.where("project_dir is not null").select("project_dir", store.shard_key(F.col("project_dir")).alias("shard")).distinct(), E + " SELECT DISTINCT project_dir, left(sha256(regexp_replace(replace(project_dir, '\\', '/'), '/+$', '')), 16) AS shard FROM e WHERE project_dir IS NOT NULL", "session_events")
_add("l01_session_view", lambda e: e.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("events"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last")), E + " SELECT session_id, count(*) AS events, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last FROM e WHERE session_id IS NOT NULL GROUP BY 1", "session_events")
