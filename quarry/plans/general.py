"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.eager import eager_rollup, heavy_keys
from quarry.operators.features import dominant_past_types, entity_features, feature_cells
from quarry.operators.rolling import quiet_days_above, rolling_totals
from quarry.tables import table


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    panel = rolling_totals(table(spark, d, "session_events"))
    return panel.withColumns({"day": F.date_format("day", "yyyy-MM-dd")} | {c: F.round(c, 6) for c in panel.columns if "_avg_" in c})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quiet_days_above(rolling_totals(table(spark, d, "session_events")))


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    features = entity_features(table(spark, d, "session_events"), table(spark, d, "session_meta"))
    cells = feature_cells(features)
    return cells.select("session_id", "type", "n", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), F.round("recency_s", 3).alias("recency_s"), "total")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    features = entity_features(table(spark, d, "session_events"), table(spark, d, "session_meta"))
    return dominant_past_types(feature_cells(features))


def p6_rollup(spark: SparkSession, d: str) -> DataFrame:
    return eager_rollup(table(spark, d, "session_events"), table(spark, d, "session_meta"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(eager_rollup(table(spark, d, "session_events"), table(spark, d, "session_meta")))


QUERIES = {f.__name__: f for f in (p3_rolling, p3_found, p4_features, p4_found, p6_rollup, p6_found)}

_DAILY = """
WITH r AS (SELECT DISTINCT id, project_dir, CAST(created_at AS DATE) AS d, coalesce(bytes_avoided, 0) AS a, coalesce(bytes_returned, 0) AS b
           FROM session_events WHERE project_dir <> '' AND created_at IS NOT NULL AND id IS NOT NULL),
     g AS (SELECT project_dir, d, count(*) AS n, sum(a) AS a, sum(b) AS b FROM r GROUP BY 1, 2),
     s AS (SELECT project_dir, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM g GROUP BY 1),
     c AS (SELECT s.project_dir, s.d, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM s LEFT JOIN g USING (project_dir, d)),
     w AS (SELECT *, sum(a) OVER w7 AS a7, sum(a) OVER w30 AS a30, sum(b) OVER w7 AS b7, sum(b) OVER w30 AS b30 FROM c
           WINDOW w7 AS (PARTITION BY project_dir ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
                  w30 AS (PARTITION BY project_dir ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
"""

_TYPED = """
WITH r AS (SELECT DISTINCT id, session_id, replace(lower(trim(type)), '-', '_') AS t, created_at, coalesce(bytes_avoided, 0) AS v
           FROM session_events WHERE session_id IS NOT NULL AND id IS NOT NULL),
     g AS (SELECT session_id, t, count(*) AS n, max(created_at) AS latest, sum(v) AS total FROM r WHERE t IS NOT NULL GROUP BY 1, 2),
     e AS (SELECT session_id, max(created_at) AS latest, sum(v) AS total FROM r GROUP BY 1)
"""

ORACLE = {
    "p3_rolling": _DAILY
    + """SELECT project_dir, strftime(d, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n_records,
      CAST(a AS BIGINT) AS bytes_avoided, CAST(a7 AS BIGINT) AS bytes_avoided_sum_7, round(a7 / 7.0, 6)::DOUBLE AS bytes_avoided_avg_7,
      CAST(a30 AS BIGINT) AS bytes_avoided_sum_30, round(a30 / 30.0, 6)::DOUBLE AS bytes_avoided_avg_30,
      CAST(b AS BIGINT) AS bytes_returned, CAST(b7 AS BIGINT) AS bytes_returned_sum_7, round(b7 / 7.0, 6)::DOUBLE AS bytes_returned_avg_7,
      CAST(b30 AS BIGINT) AS bytes_returned_sum_30, round(b30 / 30.0, 6)::DOUBLE AS bytes_returned_avg_30 FROM w""",
    "p3_found": _DAILY + "SELECT project_dir, strftime(d, '%Y-%m-%d') AS day FROM w WHERE n = 0 AND a7 / 7.0 > a30 / 30.0",
    "p4_features": _TYPED
    + """SELECT g.session_id, g.t AS type, g.n, strftime(g.latest, '%Y-%m-%d %H:%M:%S') AS latest,
      round((epoch_us(e.latest) - epoch_us(g.latest)) / 1e6, 3) AS recency_s, CAST(g.total AS BIGINT) AS total FROM g JOIN e USING (session_id)""",
    "p4_found": _TYPED
    + "SELECT g.session_id, g.t AS type FROM g JOIN e USING (session_id) WHERE g.n >= 3 AND g.total * 2 > e.total AND g.latest < e.latest",
    "p6_rollup": """
WITH r AS (SELECT DISTINCT id, project_dir, session_id, coalesce(bytes_avoided, 0) AS a, coalesce(bytes_returned, 0) AS b FROM session_events WHERE id IS NOT NULL),
     j AS (SELECT r.*, coalesce(m.event_count, 0) AS ec, coalesce(m.compact_count, 0) AS cc FROM r LEFT JOIN session_meta m USING (session_id)),
     u AS (SELECT 'project_dir' AS field, project_dir AS key_value, * FROM j UNION ALL SELECT 'session_id', session_id, * FROM j)
SELECT field, key_value, count(*) AS n_records, count(*) AS n_joined, CAST(sum(a) AS BIGINT) AS bytes_avoided, CAST(sum(b) AS BIGINT) AS bytes_returned,
       CAST(sum(ec) AS BIGINT) AS event_count, CAST(sum(cc) AS BIGINT) AS compact_count, (SELECT count(*) FROM r) AS n_total
FROM u WHERE key_value IS NOT NULL GROUP BY 1, 2""",
    "p6_found": """
WITH r AS (SELECT DISTINCT id, project_dir, session_id FROM session_events WHERE id IS NOT NULL),
     u AS (SELECT 'project_dir' AS field, project_dir AS key_value FROM r UNION ALL SELECT 'session_id', session_id FROM r)
SELECT field, key_value FROM u WHERE key_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.04 * (SELECT count(*) FROM r)""",
}
