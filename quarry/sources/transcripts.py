"""Usage records in JSON lines of several hosts, as token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MESSAGE = "type string, uuid string, isSidechain boolean, message struct<model: string, usage: struct<input_tokens: long, output_tokens: long, cache_creation_input_tokens: long, cache_read_input_tokens: long>>"
_ROLLOUT = "type string, payload struct<type: string, model: string, info: struct<last_token_usage: struct<input_tokens: long, cached_input_tokens: long, output_tokens: long, reasoning_output_tokens: long>>>"


_RECORD = "type string, model string, usage struct<inputOther: long, output: long, inputCacheRead: long, inputCacheCreation: long>"
_CHAT = "id string, messageId string, model string, usageMetadata struct<promptTokenCount: long, candidatesTokenCount: long, thoughtsTokenCount: long, cachedContentTokenCount: long>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value of every line that isn't blank, in the order of the file.

    Files are read in splits: lines are numbered within their split and splits follow each other by where they start, so a file of
    any size is read by many tasks.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), "value")
    own = raw.withColumn("n", F.row_number().over(Window.partitionBy("file", "at").orderBy("seq")))
    before = raw.groupBy("file", "at").agg(F.count("*").alias("lines"))
    before = before.withColumn("before", F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = own.join(before, ["file", "at"]).select("file", (F.col("before") + F.col("n") - 1).alias("line_no"), "value")
    return numbered.where("trim(value) <> ''")


def _counts(rows: DataFrame, model: str, **columns: Column) -> DataFrame:
    """Sums per model of the counts, each at least 0; models without any token are left out."""
    whole = {n: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for n, c in columns.items()}
    sums = rows.groupBy(F.coalesce(model, F.lit("")).alias("model")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in whole.items()])
    return sums.where(" + ".join(columns) + " > 0")


def record_usage(rows: DataFrame, seen: int = 0) -> tuple[DataFrame, int]:
    """(token sums per model over usage records after the first `seen`, number of usage records) of one file.

    seen beyond the number of records (the file was cut): the last record only. Other lines and bad lines don't count.
    """
    records = rows.select("line_no", F.from_json("value", _RECORD).alias("j")).where("j.type = 'usage.record'")
    total = records.count()
    first = 0 if seen <= 0 else seen if seen <= total else total - 1
    if first:  # the line of the last record that was seen: records are numbered by their lines
        nth = records.select("line_no").orderBy("line_no").limit(first).agg(F.max("line_no")).first()[0]
        records = records.where(F.col("line_no") > nth)
    u = "j.usage."
    return _counts(records, "j.model", input=F.col(u + "inputOther"), output=F.col(u + "output"), cache_write=F.col(u + "inputCacheCreation"), cache_read=F.col(u + "inputCacheRead")), total


def chat_usage(rows: DataFrame, after: str | None = None) -> tuple[DataFrame, str | None]:
    """(token sums per model over the chat records behind the one with that id, id of the last record that has one) of one file.

    Thoughts count as output; an id that isn't there leaves the last record only; without an id all count.
    """
    records = rows.select("line_no", F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.from_json("value", _CHAT)).alias("j")).where("j is not null and (j.id is not null or j.messageId is not null or j.usageMetadata is not null)")
    records = records.withColumn("key", F.coalesce(F.nullif(F.col("j.id"), F.lit("")), F.nullif(F.col("j.messageId"), F.lit(""))))
    last = records.where("key is not null").agg(F.max_by("key", "line_no")).first()[0] or after
    if after is not None:
        at, end = records.agg(F.min(F.when(F.col("key") == after, F.col("line_no"))), F.max("line_no")).first()
        records = records.where(F.col("line_no") > (at if at is not None else (end or 0) - 1))
    u = "j.usageMetadata."
    output = F.coalesce(F.col(u + "candidatesTokenCount"), F.lit(0)) + F.coalesce(F.col(u + "thoughtsTokenCount"), F.lit(0))
    return _counts(records.where("j.usageMetadata is not null"), "j.model", input=F.col(u + "promptTokenCount"), output=output, cache_read=F.col(u + "cachedContentTokenCount")), last


def message_cursor(rows: DataFrame) -> DataFrame:
    """Per file the uuid of its last line that has one: where the next reading goes on."""
    parsed = rows.select("file", "line_no", F.from_json("value", "uuid string").alias("j")).where("j.uuid is not null")
    return parsed.groupBy("file").agg(F.max_by("j.uuid", "line_no").alias("cursor"))


def message_usage(rows: DataFrame, after: str | None = None) -> DataFrame:
    """Token sums per model over the messages of assistants; bad lines and side chains are left out.

    after: only lines behind the first one with that uuid; an unknown uuid leaves the last line only.
    """
    parsed = rows.select("file", "line_no", F.from_json("value", _MESSAGE).alias("j")).where("j.type = 'assistant' and not coalesce(j.isSidechain, false) and j.message.model is not null")
    if after is not None:
        w = Window.partitionBy("file")
        at = F.min(F.when(F.col("j.uuid") == after, F.col("line_no"))).over(w)
        parsed = parsed.withColumn("from", F.coalesce(at, F.max("line_no").over(w) - 1)).where("line_no > from")
    u = "j.message.usage."
    return parsed.groupBy(F.col("j.message.model").alias("model")).agg(*[F.coalesce(F.sum(u + c), F.lit(0)).alias(n) for n, c in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_write", "cache_creation_input_tokens"), ("cache_read", "cache_read_input_tokens"))], F.count("*").alias("messages"))


def rollout_usage(rows: DataFrame) -> DataFrame:
    """Token sums per model where lines name the model for those that follow; reasoning counts as output."""
    j = rows.select("file", "line_no", F.from_json("value", _ROLLOUT).alias("j"))
    model = F.last(F.when(F.col("j.type").isin("turn_context", "session_meta"), F.col("j.payload.model")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    own = j.withColumn("model", model).where("j.payload.type = 'token_count' and model is not null").select("model", "j.payload.info.last_token_usage.*")
    return own.groupBy("model").agg(F.sum("input_tokens").alias("input"), F.sum(F.coalesce("output_tokens", F.lit(0)) + F.coalesce("reasoning_output_tokens", F.lit(0))).alias("output"), F.sum(F.coalesce("cached_input_tokens", F.lit(0))).alias("cache_read"))
