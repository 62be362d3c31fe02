import re
from collections import Counter

import pytest

from quarry.llm.terms import radix_partitions, term_frequencies, vocabulary_use

SCHEMA = "chunk_id long, content string, term string, word string, radix long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def brute(rows):
    n, docs = Counter(), Counter()
    for _, t in set(rows):
        own = re.findall(r"[\w-]+", t.lower())
        n.update(own)
        docs.update(set(own))
    return {t: (n[t], docs[t]) for t in n}


@pytest.mark.parametrize("most", [4_000_000, 40])
def test_against_brute_force(spark, most):
    rows = [(i, f"the Cache-x {'the ' * (i % 5)} w{i % 97} ünï_{i} {i * 7919 % 512}") for i in range(600)]
    got = {r.term: (r.occurrences, r.documents) for r in term_frequencies(frame(spark, rows + rows[:50]), bits=2, most_rows=most).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "a A b"), (1, "a A b"), (2, ""), (None, "x"), (3, None), (4, "x" * 300_000)]
    assert {r.term[:3]: (r.occurrences, r.documents) for r in term_frequencies(frame(spark, rows)).collect()} == {"a": (2, 1), "b": (1, 1), "xxx": (1, 1)}
    assert term_frequencies(frame(spark, [])).count() == 0


def test_marks(spark):
    rows = [(i, "all " + ("some " if i < 8 else "") + ("quarter " if i < 10 else "")) for i in range(40)]
    words = spark.createDataFrame([("all",), ("some",), ("quarter",), ("none",), (None,), ("all",)], "word string")
    got = {r.word: (r.documents, r.mark) for r in vocabulary_use(words, frame(spark, rows)).collect()}
    assert got == {"all": (40, "common"), "some": (8, None), "quarter": (10, "common"), "none": (0, "rare")}
    assert vocabulary_use(words, frame(spark, [])).where("mark = 'rare'").count() == 4


def test_every_level_makes_partitions_smaller(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(F.col("id").cast("string").alias("term"), F.shiftrightunsigned(F.xxhash64("id"), 1).alias("radix"), F.lit(1).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("documents"))
    hot = spark.range(9_000).select(F.lit("hot").alias("term"), F.lit(12345).cast("long").alias("radix"), F.lit(1).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("documents"))
    root = f"file://{tmp_path}/r"
    got = radix_partitions(rows, 2, 5_000, root)
    sizes = {r["part"]: r["count"] for r in got.groupBy("part").count().collect()}
    assert sum(sizes.values()) == 40_000 and max(sizes.values()) <= 5_000 and len(list((tmp_path / "r").iterdir())) <= 3
    sized = radix_partitions(rows, 2, 5_000, root + "2", 4)
    assert len(list((tmp_path / "r2").iterdir())) == 1 and sized.count() == 40_000
    both = {r["part"]: r["count"] for r in radix_partitions(rows.unionByName(hot), 2, 5_000, root + "3").groupBy("part").count().collect()}
    assert sum(both.values()) == 49_000 and sorted(both.values())[-2] <= 5_000
