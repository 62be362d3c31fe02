"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.formatting import canonical_keys, collapse_formatting, members
from quarry.llm.leaks import WORDS, leaked_items
from quarry.llm.markup import clean_markup, find_markup
from quarry.llm.packing import fill, pack, split_documents
from quarry.llm.pii import find_personal, redact_personal
from quarry.llm.secrets import find_secrets, redact_secrets
from quarry.llm.terms import term_frequencies, vocabulary_use
from quarry.tables import table


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    return collapse_formatting(table(spark, d, "session_events"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return members(canonical_keys(table(spark, d, "session_events"))).where("id <> keep_id").select("keep_id", "id")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(table(spark, d, "chunks"), table(spark, d, "sources"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return find_markup(table(spark, d, "chunks"), table(spark, d, "sources"))


def _secret_fields(spark: SparkSession, d: str):
    yield "chunks.content", table(spark, d, "chunks"), "chunk_id", "content"
    yield "session_events.data", table(spark, d, "session_events"), "id", "data"


def p5_secrets(spark: SparkSession, d: str) -> DataFrame:
    parts = [find_secrets(rows, key, text).select(F.lit(field).alias("field"), "*") for field, rows, key, text in _secret_fields(spark, d)]
    return parts[0].unionByName(parts[1])


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    parts = [redact_secrets(rows, key, text).select(F.lit(field).alias("field"), "*") for field, rows, key, text in _secret_fields(spark, d)]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_secrets(spark, d).select("field", "row_id", "start_at")


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "chunks"))


def p7_use(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_use(table(spark, d, "vocabulary"), table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_use(spark, d).where("mark is not null").select("word", "mark")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(pack(table(spark, d, "documents"), table(spark, d, "containers")))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing: all tokens placed, no bin overfull, bins within 1 % (and one) of what the tokens need."""
    need = F.ceil(F.col("tokens") / F.col("capacity"))
    sound = (F.col("fullest") <= F.col("capacity")) & (F.col("bins") >= need)
    return p8_fill(spark, d).select("container_id", "items", "tokens", sound.alias("sound"), (F.col("bins") <= need * 1.01 + 1).alias("tight"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(pack(table(spark, d, "documents"), table(spark, d, "containers")))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).where(F.col("common_words") >= WORDS).select("item_id", "doc_id")


def p10_personal(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_personal(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_personal(spark, d).select("doc_id", "kind", "start_at")


QUERIES = {
    f.__name__: f
    for f in (p1_copies, p1_found, p2_clean, p2_found, p5_secrets, p5_redacted, p5_found, p7_terms, p7_use, p7_found, p8_fill, p8_checks, p8_found, p9_leaks, p9_found, p10_personal, p10_redacted, p10_found)
}

_TERMS = """
WITH c AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL),
     t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_-]+')) AS term FROM c),
     f AS (SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS documents FROM t GROUP BY 1)
"""
_USE = (
    _TERMS
    + """, u AS (SELECT v.word, coalesce(f.occurrences, 0) AS occurrences, coalesce(f.documents, 0) AS documents
                 FROM (SELECT DISTINCT word FROM vocabulary WHERE word IS NOT NULL) v LEFT JOIN f ON f.term = v.word),
     m AS (SELECT *, CASE WHEN documents <= 2 THEN 'rare' WHEN documents >= 0.25 * (SELECT count(DISTINCT chunk_id) FROM chunks) THEN 'common' END AS mark FROM u)
"""
)
ORACLE = {
    "p7_terms": _TERMS + "SELECT term, occurrences, documents FROM f",
    "p7_use": _USE + "SELECT word, occurrences, documents, mark FROM m",
    "p7_found": _USE + "SELECT word, mark FROM m WHERE mark IS NOT NULL",
    "p8_checks": """
WITH s AS (SELECT container_id, capacity, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}]+')) AS n FROM documents, containers WHERE text IS NOT NULL)
SELECT container_id, CAST(sum(greatest(1, ceil(n / capacity))) AS BIGINT) AS items, CAST(sum(n) AS BIGINT) AS tokens, TRUE AS sound, TRUE AS tight FROM s GROUP BY 1""",
    "p8_found": """SELECT DISTINCT container_id, doc_id FROM documents, containers
      WHERE len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}]+')) > capacity""",
    "p9_found": """
WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
     a AS (SELECT DISTINCT id, array_to_string(w[n : n + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS n FROM w WHERE len(w) >= 12)),
     b AS (SELECT DISTINCT id, array_to_string(w[n : n + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS n FROM i WHERE len(w) >= 12))
SELECT DISTINCT b.id AS item_id, a.id AS doc_id FROM a JOIN b USING (g)""",
}
