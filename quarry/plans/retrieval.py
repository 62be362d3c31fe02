"""Retrieval queries: the titles of all chunks whose id is divisible by 50, against all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.words import STOPWORDS
from quarry.operators import search as s
from quarry.tables import table


def chosen(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id % 50 = 0 and title is not null").select(F.col("chunk_id").alias("query_no"), F.col("title").alias("text")).distinct()


def misspelt(queries: DataFrame) -> DataFrame:
    """The query words of at least 5 letters without their third."""
    words = queries.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("length(w) >= 5")
    return words.select(F.expr("concat(substring(w, 1, 2), substring(w, 4))").alias("word")).distinct()


def r01_bm25(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return s.bm25(chosen(c), c).select("query_no", "chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def r01_unstemmed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return s.bm25(chosen(c), c, stemmed=False).select("query_no", "chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def r01_every_term(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return s.bm25(chosen(c), c, every=True, stemmed=False).select("query_no", "chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def r02_trigram(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return s.trigram(chosen(c), c).select("query_no", "chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def r03_fusion(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    q = chosen(c)
    return s.fuse(s.bm25(q, c), s.trigram(q, c), c, table(spark, d, "sources"))


def r03_unstemmed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    q = chosen(c)
    fused = s.fuse(s.bm25(q, c, stemmed=False), s.trigram(q, c), c, table(spark, d, "sources"))
    return fused.select("query_no", "label", "title", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def r10_about(spark: SparkSession, d: str) -> DataFrame:
    return s.about(table(spark, d, "chunks"), "session index cache of the query")


def r04_correct(spark: SparkSession, d: str) -> DataFrame:
    return s.correct(misspelt(chosen(table(spark, d, "chunks"))), table(spark, d, "vocabulary"))


def r06_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return s.search(chosen(c), c, table(spark, d, "sources"), table(spark, d, "vocabulary"))


def a41_distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    return s.distinctive_terms(table(spark, d, "chunks"))


def a17_store_stats(spark: SparkSession, d: str) -> DataFrame:
    c = s.unique_chunks(table(spark, d, "chunks"))
    return c.groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum(F.when(F.col("content_type") == "code", 1).otherwise(0)).alias("code_chunks"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


QUERIES = {f.__name__: f for f in (r01_bm25, r01_unstemmed, r01_every_term, r02_trigram, r03_fusion, r03_unstemmed, r10_about, r04_correct, r06_search, a41_distinctive_terms, a17_store_stats)}
_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_C = "c AS (SELECT DISTINCT chunk_id, source_id, coalesce(title, '') AS title, coalesce(content, '') AS content, content_type FROM chunks WHERE chunk_id IS NOT NULL)"
_BM25 = f"""
WITH {_C},
 q0 AS (SELECT DISTINCT chunk_id AS query_no, list_distinct(list_filter(regexp_split_to_array(translate(lower(title), '''"(){{}}[]*:^~`', '              '), '\\s+'), lambda x: x <> '' AND x NOT IN ('and', 'or', 'not', 'near'))) AS w FROM chunks WHERE chunk_id % 50 = 0 AND title IS NOT NULL),
 q1 AS (SELECT query_no, CASE WHEN len(list_filter(w, lambda x: x NOT IN ({_STOP}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({_STOP})) ELSE w END AS w FROM q0),
 q AS (SELECT DISTINCT query_no, array_to_string(list_filter(regexp_split_to_array(strip_accents(x), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> ''), ' ') AS term FROM (SELECT query_no, unnest(w) AS x FROM q1)),
 terms AS (SELECT * FROM q WHERE term <> ''),
 m AS (SELECT DISTINCT len(string_split(term, ' ')) AS m FROM terms),
 k AS (SELECT chunk_id, list_filter(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') AS t, list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') AS b FROM c),
 len AS (SELECT chunk_id, len(t) + len(b) AS length FROM k),
 g AS (SELECT chunk_id, array_to_string(t[i : i + m - 1], ' ') AS term, 5.0::DOUBLE AS w FROM (SELECT chunk_id, t, m, unnest(range(1, len(t) - m + 2)) AS i FROM k, m) UNION ALL
       SELECT chunk_id, array_to_string(b[i : i + m - 1], ' '), 1.0 FROM (SELECT chunk_id, b, m, unnest(range(1, len(b) - m + 2)) AS i FROM k, m)),
 h AS (SELECT term, chunk_id, sum(w) AS tf FROM g WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
 st AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
 tot AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
 sc AS (SELECT query_no, chunk_id, count(*) AS n_terms, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
        FROM terms JOIN h USING (term) JOIN st USING (term) JOIN len USING (chunk_id), tot GROUP BY 1, 2),
"""
_TRIGRAM = f"""
 tq0 AS (SELECT DISTINCT chunk_id AS query_no, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[''"(){{}}\\[\\]*:^~`]', '', 'g'), '\\s+'), lambda x: length(x) >= 3 AND x NOT IN ('and', 'or', 'not', 'near'))) AS w FROM chunks WHERE chunk_id % 50 = 0 AND title IS NOT NULL),
 tterms AS (SELECT DISTINCT query_no, unnest(CASE WHEN len(list_filter(w, lambda x: x NOT IN ({_STOP}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({_STOP})) ELSE w END) AS term FROM tq0),
 tk AS (SELECT chunk_id, lower(title) AS t, lower(content) AS b, greatest(length(title) - 2, 0) + greatest(length(content) - 2, 0) AS length FROM c),
 tx AS (SELECT term, len(list_filter(range(1, length(term)), lambda k: substr(term, 1, k) = substr(term, length(term) - k + 1))) > 0 AS laps FROM (SELECT DISTINCT term FROM tterms)),
 th AS (SELECT term, chunk_id, length, CASE WHEN laps THEN 5.0::DOUBLE * len(list_filter(range(1, length(t) - length(term) + 2), lambda i: substr(t, i, length(term)) = term)) + len(list_filter(range(1, length(b) - length(term) + 2), lambda i: substr(b, i, length(term)) = term))
          ELSE 5.0::DOUBLE * ((length(t) - length(replace(t, term, ''))) // length(term)) + (length(b) - length(replace(b, term, ''))) // length(term) END AS tf
        FROM tx JOIN tk ON contains(t, term) OR contains(b, term)),
 tst AS (SELECT term, count(*) AS df FROM th GROUP BY 1),
 ttot AS (SELECT count(*) AS n, avg(length) AS mean FROM tk),
 tsc AS (SELECT query_no, chunk_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
        FROM tterms JOIN th USING (term) JOIN tst USING (term), ttot GROUP BY 1, 2),
 tr AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, chunk_id) AS rank FROM tsc)"""
ORACLE = {
    "r01_unstemmed": _BM25 + " r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, chunk_id) AS rank FROM sc) SELECT query_no, chunk_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10",
    "r01_every_term": _BM25 + " a AS (SELECT query_no, count(*) AS n_terms FROM terms GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, chunk_id) AS rank FROM sc JOIN a USING (query_no, n_terms)) SELECT query_no, chunk_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10",
    "r02_trigram": f"WITH {_C}," + _TRIGRAM + " SELECT query_no, chunk_id, round(score, 5) AS score, rank FROM tr WHERE rank <= 10",
    "r03_unstemmed": _BM25 + " r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, chunk_id) AS rank FROM sc)," + _TRIGRAM + """,
 l AS (SELECT query_no, chunk_id, rank, 0 AS list FROM r WHERE rank <= 10 UNION ALL SELECT query_no, chunk_id, rank, 1 FROM tr WHERE rank <= 10),
 f AS (SELECT query_no, coalesce(s.label, '') AS label, c.title, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list * 1000000 + rank) AS seen FROM l JOIN c USING (chunk_id) LEFT JOIN sources s ON s.id = c.source_id GROUP BY 1, 2, 3),
 fr AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, seen) AS rank FROM f) SELECT query_no, label, title, round(score, 9) AS score, rank FROM fr WHERE rank <= 3""",
    "r04_correct": """
WITH w AS (SELECT DISTINCT concat(substr(w, 1, 2), substr(w, 4)) AS word FROM (SELECT unnest(regexp_split_to_array(lower(title), '[^\\p{L}]+')) AS w FROM chunks WHERE chunk_id % 50 = 0 AND title IS NOT NULL) WHERE length(w) >= 5),
 o AS (SELECT word FROM w WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM vocabulary WHERE word IS NOT NULL)),
 p AS (SELECT o.word, v.word AS correction, levenshtein(o.word, v.word) AS distance FROM o, vocabulary v WHERE abs(length(o.word) - length(v.word)) <= 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, correction) AS k FROM p WHERE distance <= CASE WHEN length(word) <= 4 THEN 1 WHEN length(word) <= 12 THEN 2 ELSE 3 END)
SELECT word, correction, CAST(distance AS INTEGER) AS distance FROM r WHERE k = 1""",
    "a41_distinctive_terms": f"""
WITH {_C}, x AS (SELECT DISTINCT source_id, chunk_id, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_-]+')) AS word FROM c),
 o AS (SELECT * FROM x WHERE length(word) >= 3 AND word NOT IN ({_STOP})), n AS (SELECT source_id, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3),
 k AS (SELECT source_id, word, count(*) AS df, any_value(n) AS n FROM o JOIN n USING (source_id) GROUP BY 1, 2),
 s AS (SELECT *, round(ln(n / df) + least(length(word) / 20, 0.5) + CASE WHEN contains(word, '_') THEN 1.5 WHEN length(word) >= 12 THEN 0.8 ELSE 0 END, 6) AS score FROM k WHERE df >= 2 AND df <= greatest(3, ceil(n * 0.4))),
 r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, word) AS rank FROM s)
SELECT source_id, word, df, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40""",
    "a17_store_stats": f"WITH {_C} SELECT source_id, count(*) AS chunks, CAST(sum(CASE WHEN content_type = 'code' THEN 1 ELSE 0 END) AS BIGINT) AS code_chunks, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM c GROUP BY 1",
}
