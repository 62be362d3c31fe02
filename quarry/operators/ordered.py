"""Order within hot keys without a task per key: rows are ordered in blocks, and only the edges of blocks are ordered as a whole.

A block is a range of the order (ids or times), so a key's rows spread over as many tasks as it has blocks; of each block one row
goes on to the window over edges. Rows whose key is null are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids in a block, and seconds in a block where the order is time.
IDS, SECONDS = 1_000_000, 600


def _blocked(rows: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.withColumn("__block", block)


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, name: str) -> DataFrame:
    """rows with `name`: the value of the row before in the order of its keys (null before the first)."""
    b = _blocked(rows, keys, block).withColumn("__value", F.struct(value.alias("v")))
    inside = b.withColumn("__before", F.lag("__value").over(Window.partitionBy(*keys, "__block").orderBy(*order)))
    edges = b.groupBy(*keys, "__block").agg(F.max_by("__value", F.struct(*order)).alias("__edge"))
    edges = edges.withColumn("__edge", F.lag("__edge").over(Window.partitionBy(*keys).orderBy("__block")))
    joined = inside.join(edges, [*keys, "__block"])
    return joined.withColumn(name, F.coalesce("__before", "__edge")["v"]).drop("__block", "__value", "__before", "__edge")


def with_carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, name: str) -> DataFrame:
    """rows with `name`: the last value that isn't null, of the row itself or one before it in the order of its keys."""
    b = _blocked(rows, keys, block).withColumn("__value", value)
    own = F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    edges = b.groupBy(*keys, "__block").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__edge"))
    edges = edges.withColumn("__edge", F.last("__edge", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    joined = b.withColumn("__own", own).join(edges, [*keys, "__block"])
    return joined.withColumn(name, F.coalesce("__own", "__edge")).drop("__block", "__value", "__own", "__edge")


def id_block(width: int = IDS, order: str = "id") -> Column:
    return F.floor(F.col(order) / width)
