"""The chunk store as tables: re-indexing by label, ageing, deletion, cache hits. Each function gives the new table; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_sources(sources: DataFrame) -> DataFrame:
    """The last indexed row of each label; ties go to the greater id."""
    newest = F.row_number().over(Window.partitionBy("label").orderBy(F.desc_nulls_last("indexed_at"), F.desc("id")))
    return sources.where("label is not null").withColumn("k", newest).where("k = 1").drop("k")


def reindexed(old: DataFrame, new: DataFrame, label: str = "label") -> DataFrame:
    """old with all rows of the labels in new replaced by those of new."""
    return old.join(new.select(label).distinct(), label, "left_anti").unionByName(new, allowMissingColumns=True)


def without_expired(sources: DataFrame, now: Column, days: int) -> DataFrame:
    return sources.where(F.col("indexed_at") >= now - F.make_dt_interval(F.lit(days)))


def cache_hits(requests: DataFrame, sources: DataFrame, now: Column, ttl_s: int = 86_400, chunk_bytes: int = 1600) -> DataFrame:
    """label, hit, bytes: whether a label was indexed less than ttl_s seconds ago, with an estimate of its bytes."""
    known = sources.groupBy("label").agg(F.max("indexed_at").alias("at"), F.max_by("chunk_count", "indexed_at").alias("chunks"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    hit = F.coalesce((age < ttl_s * 1_000_000) & F.lit(ttl_s > 0), F.lit(False))
    return requests.select("label").distinct().join(known, "label", "left").select("label", hit.alias("hit"), F.when(hit, F.coalesce("chunks", F.lit(0)) * chunk_bytes).otherwise(0).cast("long").alias("bytes"))


def orphans(events: DataFrame, meta: DataFrame, key: str = "session_id") -> DataFrame:
    """Records of sessions that the session table doesn't have."""
    return events.where(F.col(key).isNotNull()).join(meta.select(key).dropna().distinct(), key, "left_anti")


def purged(events: DataFrame, gone: DataFrame, key: str = "session_id") -> DataFrame:
    """Records without those of the keys in gone."""
    return events.join(gone.select(key).distinct(), key, "left_anti")


def shard_key(path: Column, suffix: Column | None = None, fold: bool = False) -> Column:
    """16 hex digits by which a path's records are kept: separators made equal, no slash at the end; `__suffix` behind them names a worktree.

    fold: letter case doesn't count, as on file systems that ignore it.
    """
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", "")
    key = F.left(F.sha2(F.lower(clean) if fold else clean, 256), F.lit(16))
    return key if suffix is None else F.concat(key, F.when(F.coalesce(suffix, F.lit("")) != "", F.concat(F.lit("__"), suffix)).otherwise(""))


def byte_budget(rows: DataFrame, group: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """The first rows of each group whose texts together stay within so many bytes."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.octet_length(text)).over(w)).where(F.col("used") <= budget)
