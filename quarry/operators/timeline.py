"""Joins and unions across origins: longest path prefix, timeline, scopes of byte counts, legs of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """path, root: the longest root that is the path or one of its folders; null if none.

    An equi-join on the prefixes of each path (as many as it has folders), not a comparison with every root.
    """
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", "")
    own = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), clean.alias("c")).distinct()
    parts = F.split("c", "/")
    prefixes = own.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("prefix"))
    known = roots.where(F.col(root).isNotNull()).select(F.regexp_replace(F.regexp_replace(root, r"\\", "/"), "/+$", "").alias("prefix")).where("prefix <> ''").distinct()
    best = prefixes.join(known, "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("root"))
    return own.select("path").join(best, "path", "left")


def timeline(events: DataFrame, chunks: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Records and chunks whose text contains `text` (any case), as one list by time: origin, id, at, title."""
    low = text.lower()
    a = events.where(F.contains(F.lower("data"), F.lit(low))).select(F.lit("event").alias("origin"), "id", F.col("created_at").alias("at"), F.col("type").alias("title"))
    b = chunks.where(F.contains(F.lower("content"), F.lit(low))).select(F.lit("chunk").alias("origin"), F.col("chunk_id").alias("id"), F.col("chunk_ts").alias("at"), "title").distinct()
    both = a.unionByName(b)
    return both.orderBy("at", "origin", "id").limit(most) if most else both


def byte_scopes(events: DataFrame) -> DataFrame:
    """Characters and bytes in three scopes: each session, each project, all; tokens are a quarter of characters and kept bytes."""
    chars, avoided, returned = F.sum(F.length("data")), F.sum(F.coalesce("bytes_avoided", F.lit(0))), F.sum(F.coalesce("bytes_returned", F.lit(0)))
    scopes = F.array(F.struct(F.lit("all").alias("scope"), F.lit("").alias("name")), F.struct(F.lit("project").alias("scope"), F.coalesce("project_dir", F.lit("")).alias("name")), F.struct(F.lit("session").alias("scope"), F.col("session_id").alias("name")))
    state = events.groupBy("project_dir", "session_id").agg(chars.alias("chars"), avoided.alias("avoided"), returned.alias("returned"))  # one pass; the scopes roll up the small state
    rolled = state.select("*", F.explode(scopes).alias("s")).groupBy("s.scope", "s.name").agg(F.sum("chars").alias("chars"), F.sum("avoided").alias("avoided"), F.sum("returned").alias("returned"))
    return rolled.withColumn("tokens", F.floor((F.col("chars") + F.col("avoided")) / 4))


def current_leg(events: DataFrame, start: str = "session_start") -> DataFrame:
    """Per session: records before and since its last start record (all since, if it has none)."""
    last = events.groupBy("session_id").agg(F.max(F.when(F.col("type") == start, F.col("id"))).alias("begun"))
    now = F.col("id") >= F.coalesce("begun", F.lit(-1))
    return events.select("session_id", "id").join(last, "session_id").groupBy("session_id").agg(F.sum(F.when(now, 1).otherwise(0)).alias("since"), F.sum(F.when(now, 0).otherwise(1)).alias("before"))


def line_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Levels of log lines with their count and the mean of the milliseconds they say they took."""
    lines = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(text, "\n")).alias("l")).where(F.rlike("l", F.lit(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [A-Z]+ ")))
    took = F.regexp_extract("l", r"took (\d{1,9})ms", 1)
    return lines.groupBy(F.regexp_extract("l", r"^\S+ \S+ ([A-Z]+) ", 1).alias("level")).agg(F.count("*").alias("lines"), F.round(F.avg(F.when(took != "", took.cast("long"))), 4).alias("mean_ms"))
