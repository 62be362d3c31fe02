"""A wide feature table: per entity the count, recency and total of every event type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import bucketed, size_of
from quarry.tables import normal_type, records

#: Blocks that the types are spread over, by hash. Hundreds of types give tens of cells a block.
BLOCKS = 8
#: Bytes of records that one bucket of entities stands for, and the most buckets; each writes one file a block.
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 10_000


def entity_features(
    events: DataFrame,
    entities: DataFrame | None = None,
    entity: str = "session_id",
    kind: str = "type",
    at: str = "created_at",
    value: str = "bytes_avoided",
    key: str = "id",
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per entity with count, recency and total of every type.

    Columns: entity, n_records, latest, total, and per block of types b the map block_b from type to
    <n, latest, recency_s, total> (null where the entity has no record of any of its types;
    flat_features gives plain columns). recency_s: seconds from the type's latest time to the
    entity's latest. entities: a table with a column named as `entity` whose
    entities appear even without records.

    Defined results: redelivered records count once; null entity: left out; types are compared in
    normal form; null type: counts for the entity, not for a type; null value: 0; null
    time: ignored for latest (null if a type has no other); no events: the entities with
    zero counts. Only the named columns are read.

    Plan: records are reduced to one state per entity and type (map-side combining makes hot
    entities harmless); the states are written once, partitioned by block of types and
    bucketed by entity; every block reads its own partition, is aggregated by entity and joined onto the
    complete entity table bucket by bucket, without another exchange.
    """
    spark = events.sparkSession
    rows = records(
        events.where(F.col(entity).isNotNull()),
        key,
        F.col(entity).alias("__entity"),
        normal_type(kind).alias("__kind"),
        F.col(at).cast("timestamp_ntz").alias("__at"),
        F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("__value"),
    )
    state = rows.groupBy("__entity", "__kind").agg(
        F.count("*").alias("n"), F.max("__at").alias("latest"), F.sum("__value").alias("total")
    )
    block_of = F.when(F.col("__kind").isNull(), -1).otherwise(F.pmod(F.xxhash64("__kind"), F.lit(blocks))).cast("int")
    buckets = max(spark.sparkContext.defaultParallelism, min(MOST_BUCKETS, size_of(events.select(entity, kind, at, value)) // BUCKET_BYTES))
    state = bucketed(state.withColumn("__block", block_of), "features", "__entity", buckets, "__block")

    totals = (F.sum("n").alias("n_records"), F.max("latest").alias("latest"), F.sum("total").alias("total"))
    table = state.groupBy("__entity").agg(*totals)
    if entities is not None:
        every = entities.where(F.col(entity).isNotNull()).select(F.col(entity).alias("__entity")).distinct()
        table = table.join(every, "__entity", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_records", "total")})
    cell = F.struct("n", "latest", "total")
    for b in range(blocks):
        features = state.where(F.col("__block") == b).groupBy("__entity").agg(
            F.map_from_entries(F.collect_list(F.struct("__kind", cell))).alias(f"block_{b}")
        )
        table = table.join(features, "__entity", "left")
    seconds = F.unix_micros(F.col("latest").cast("timestamp"))

    def with_recency(_: Column, v: Column) -> Column:
        since = (seconds - F.unix_micros(v["latest"].cast("timestamp"))) / 1e6
        return F.struct(v["n"].alias("n"), v["latest"].alias("latest"), since.alias("recency_s"), v["total"].alias("total"))

    return table.select(
        F.col("__entity").alias(entity), "n_records", "latest", "total", *[F.transform_values(f"block_{b}", with_recency).alias(f"block_{b}") for b in range(blocks)]
    )


def flat_features(table: DataFrame, types: list[str], entity: str = "session_id") -> DataFrame:
    """The feature table with plain columns n_T, latest_T, recency_s_T and total_T for each type T (n and total 0 where there is none)."""
    cells = F.map_concat(*[F.coalesce(b, F.create_map().cast(table.schema[b].dataType)) for b in table.columns if b.startswith("block_")])
    table = table.select(entity, "n_records", "latest", "total", cells.alias("__cells"))
    out = [F.col(c) for c in (entity, "n_records", "latest", "total")]
    for t in types:
        v = F.col("__cells")[F.lit(t)]
        out += [F.coalesce(v["n"], F.lit(0)).alias(f"n_{t}"), v["latest"].alias(f"latest_{t}"), v["recency_s"].alias(f"recency_s_{t}"), F.coalesce(v["total"], F.lit(0)).alias(f"total_{t}")]
    return table.select(*out)


def feature_cells(table: DataFrame, entity: str = "session_id") -> DataFrame:
    """The non-empty cells of a feature table as rows: entity, type, n, latest, recency_s, total and the entity's entity_*."""
    blocks = [c for c in table.columns if c.startswith("block_")]
    cells = F.concat(*[F.coalesce(F.map_entries(b), F.array().cast(f"array<struct<key:string,value:{table.schema[b].dataType.valueType.simpleString()}>>")) for b in blocks])
    rows = table.select(entity, F.col("latest").alias("entity_latest"), F.col("total").alias("entity_total"), F.explode(cells).alias("c"))
    return rows.select(entity, F.col("c.key").alias("type"), "c.value.n", "c.value.latest", "c.value.recency_s", "c.value.total", "entity_latest", "entity_total")


def dominant_past_types(cells: DataFrame, entity: str = "session_id", least: int = 3) -> DataFrame:
    """Types with at least `least` records and over half of the entity's total whose latest time is before the entity's."""
    return cells.where(
        (F.col("n") >= least) & (F.col("total") * 2 > F.col("entity_total")) & (F.col("latest") < F.col("entity_latest"))
    ).select(entity, "type")
