"""Queries across origins and excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.snippets import snippets
from quarry.operators import timeline as t
from quarry.operators.dashboard import clean_events
from quarry.plans.dashboard import E
from quarry.plans.retrieval import r06_search
from quarry.tables import table


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return clean_events(table(spark, d, "session_events"), list(columns))


def j10_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return t.longest_prefix(table(spark, d, "sources").select(F.col("file_path").alias("path")), table(spark, d, "sources").select(F.regexp_extract("file_path", r"^((?:/[^/]+){2})/", 1).alias("root")))


def r08_timeline(spark: SparkSession, d: str) -> DataFrame:
    found = t.timeline(_events(spark, d, "data", "created_at", "type"), table(spark, d, "chunks"), "registry")
    return found.select("origin", "id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("ts"), "title")


def a13_byte_scopes(spark: SparkSession, d: str) -> DataFrame:
    return t.byte_scopes(_events(spark, d, "session_id", "project_dir", "data", "bytes_avoided", "bytes_returned").where("session_id is not null"))


def w08_current_leg(spark: SparkSession, d: str) -> DataFrame:
    return t.current_leg(_events(spark, d, "session_id", "type"), "intent")


def a45_log_levels(spark: SparkSession, d: str) -> DataFrame:
    return t.line_statistics(table(spark, d, "documents"))


def x11_snippets(spark: SparkSession, d: str) -> DataFrame:
    return r06_search(spark, d).select("query_no", "chunk_id", snippets("content", "text", 600).alias("snippet"))


QUERIES = {f.__name__: f for f in (j10_longest_prefix, r08_timeline, a13_byte_scopes, w08_current_leg, a45_log_levels, x11_snippets)}
ORACLE = {
    "j10_longest_prefix": r"""WITH p AS (SELECT DISTINCT file_path AS path FROM sources WHERE file_path IS NOT NULL), r AS (SELECT DISTINCT regexp_extract(file_path, '^((?:/[^/]+){2})/', 1) AS root FROM sources WHERE file_path IS NOT NULL)
      SELECT p.path, max_by(root, length(root)) AS root FROM p LEFT JOIN r ON root <> '' AND (p.path = root OR starts_with(p.path, root || '/')) GROUP BY 1""",
    "r08_timeline": E
    + """ SELECT 'event' AS origin, id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS ts, type AS title FROM e WHERE contains(lower(data), 'registry') UNION ALL
      SELECT DISTINCT 'chunk', chunk_id, strftime(chunk_ts, '%Y-%m-%d %H:%M:%S'), title FROM chunks WHERE contains(lower(content), 'registry')""",
    "a13_byte_scopes": E
    + """, s AS (SELECT 'all' AS scope, '' AS name, * FROM e WHERE session_id IS NOT NULL UNION ALL SELECT 'project', coalesce(project_dir, ''), * FROM e WHERE session_id IS NOT NULL UNION ALL SELECT 'session', session_id, * FROM e WHERE session_id IS NOT NULL),
      g AS (SELECT scope, name, CAST(sum(length(data)) AS BIGINT) AS chars, CAST(sum(coalesce(bytes_avoided, 0)) AS BIGINT) AS avoided, CAST(sum(coalesce(bytes_returned, 0)) AS BIGINT) AS returned FROM s GROUP BY 1, 2)
      SELECT *, CAST(floor((chars + avoided) / 4) AS BIGINT) AS tokens FROM g""",
    "w08_current_leg": E
    + """, b AS (SELECT session_id, coalesce(max(CASE WHEN type = 'intent' THEN id END) OVER (PARTITION BY session_id), -1) AS start, id FROM e)
      SELECT session_id, CAST(sum(CASE WHEN id >= start THEN 1 ELSE 0 END) AS BIGINT) AS since, CAST(sum(CASE WHEN id >= start THEN 0 ELSE 1 END) AS BIGINT) AS before FROM b GROUP BY 1""",
    "a45_log_levels": r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM l WHERE regexp_matches(l, '^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [A-Z]+ '))
      SELECT regexp_extract(l, '^\S+ \S+ ([A-Z]+) ', 1) AS level, count(*) AS lines, round(avg(try_cast(nullif(regexp_extract(l, 'took (\d{1,9})ms', 1), '') AS BIGINT)), 4) AS mean_ms FROM k GROUP BY 1""",
}
