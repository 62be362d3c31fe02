"""Frequency of every term: recursive radix partitions in the shared folder, each aggregated out of core."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import kept, shared_dir, size_of

#: A maximal run of letters, digits, '_' and '-'.
_TERM = re.compile(r"[\w-]+")
_PARTIAL = "term string, radix long, occurrences long, documents long"
#: Hash bits of each level of partitions, and the most partial rows that one partition may hold.
BITS, MOST_ROWS = 6, 2_000_000
#: The first level has a partition per so many bytes of text, within 2 ** bits and 2 ** 12.
FIRST_BYTES = 64 << 20
#: Distinct terms that a task combines before it hands them on, and DuckDB's memory for a partition.
HELD, MEMORY = 300_000, "512MB"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occurrences: Counter[str] = Counter()
    documents: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        terms = list(occurrences)
        radix = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in terms]
        out = pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(radix, pa.int64()), pa.array(occurrences.values(), pa.int64()), pa.array([documents[t] for t in terms], pa.int64())],
            ["term", "radix", "occurrences", "documents"],
        )
        occurrences.clear()
        documents.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            own = Counter(_TERM.findall(text.lower()))
            occurrences.update(own)
            documents.update(own.keys())
            if len(occurrences) >= HELD:
                yield flush()
    if occurrences:
        yield flush()


def _aggregator(memory: str, spill: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def stream() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute(f"SET memory_limit = '{memory}'")
        if spill:
            os.makedirs(spill, exist_ok=True)
        con.execute(f"SET temp_directory = '{spill and f'{spill}/{uuid.uuid4().hex}'}'")  # '': spill nowhere
        partial = pa.RecordBatchReader.from_batches(first.schema, stream())  # noqa: F841 (read by name)
        result = con.sql(
            "SELECT term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(documents) AS BIGINT) AS documents FROM partial GROUP BY term"
        ).to_arrow_reader(50_000)
        yield from result
        con.close()

    return run


def radix_partitions(partial: DataFrame, bits: int, most_rows: int, root: str, first_bits: int | None = None) -> DataFrame:
    """partial, partitioned by hash bits into files under root; partitions above most_rows are split by the next bits, again and again.

    The column `part` names the final partition by the leading bits of its hashes, others zero: a partition and its children
    never both stay, so names are unique. Each level splits within its parents, so n rows take about log(n / most_rows) / bits
    levels and only rows of oversized partitions are written again. A partition of a single hash stays as it is: it has one row
    per task at most, which is what map-side combining leaves.
    """
    spark, done, level, todo, used = partial.sparkSession, None, 0, partial, 0
    while True:
        step = (first_bits or bits) if level == 0 else bits
        used = min(63, used + step)
        named = todo.withColumn("part", F.col("radix").bitwiseAND(F.lit(-(1 << (63 - used)))))
        path = f"{root}/{level}"
        (named.repartition(1 << step, "part") if level == 0 else named.repartition("part")).write.partitionBy("part").parquet(path)
        table = spark.read.schema(named.schema).parquet(path)
        sizes = table.groupBy("part").agg(F.count("*").alias("n"), F.min("radix").alias("low"), F.max("radix").alias("high"))
        large = [r["part"] for r in sizes.where((F.col("n") > most_rows) & (F.col("low") < F.col("high"))).select("part").collect()] if used < 63 else []
        fit = table.where(~F.col("part").isin(large)) if large else table
        done = fit if done is None else done.unionByName(fit)
        if not large:
            return done
        todo, level = table.where(F.col("part").isin(large)).drop("part"), level + 1


def term_frequencies(
    docs: DataFrame, key: str = "chunk_id", text: str = "content", bits: int = BITS, most_rows: int = MOST_ROWS, memory: str = MEMORY
) -> DataFrame:
    """(term, occurrences, documents) of every distinct term of the collection.

    Terms are maximal runs of letters, digits, '_' and '-' of the lower-cased text. Rows stored twice under one key
    count once; null key or null text: left out; empty text: no terms; no documents: no rows.

    Plan: each task combines its own terms (a term of a third of all words costs one row a task), rows
    are partitioned by hash bits to the shared folder (the first level follows the bytes of the texts), oversized partitions are
    split further by the next bits, and each partition is streamed through a DuckDB aggregate that spills within a fixed memory,
    into the shared folder if workers can open it as a path; else it doesn't spill, since a partition's rows fit the memory.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).dropna().repartition(parts, "__key").distinct()
    partial = unique.select("__text").mapInArrow(_partial, _PARTIAL)
    first = max(bits, min(12, (size_of(docs.select(key, text)) // FIRST_BYTES).bit_length()))
    split = radix_partitions(partial, bits, most_rows, kept(spark, "terms"), first)
    root = shared_dir(spark)
    spill = root.removeprefix("file:").replace("///", "/") + "/quarry/duckdb" if root.startswith(("/", "file:")) else ""
    return (
        split.repartition("part")
        .select("term", "occurrences", "documents")
        .mapInArrow(_aggregator(memory, spill), "term string, occurrences long, documents long")
    )


def vocabulary_use(
    vocabulary: DataFrame, docs: DataFrame, word: str = "word", key: str = "chunk_id", text: str = "content", rare: int = 2, common: float = 0.25, **options
) -> DataFrame:
    """Per word of the vocabulary: word, occurrences, documents, mark (rare: at most `rare` documents; common: at least that share of all; else null).

    Null words are left out, repeated words come once; a word that is no term of any document has zero counts. Without documents every word is rare.
    """
    total = docs.where(F.col(key).isNotNull()).agg(F.count_distinct(key).alias("n")).scalar()
    words = vocabulary.select(F.col(word).alias("word")).dropna().distinct()
    joined = words.join(term_frequencies(docs, key, text, **options).withColumnRenamed("term", "word"), "word", "left")
    n = F.coalesce("documents", F.lit(0))
    mark = F.when(n <= rare, "rare").when(n >= total * common, "common")
    return joined.select("word", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), n.alias("documents"), mark.alias("mark"))
