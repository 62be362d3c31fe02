"""Scores against SQLite's full-text index; helpers against brute force."""

import itertools
import random
import sqlite3

import pytest

from quarry.functions.snippets import snippets
from quarry.functions.words import distinct_in_order, plain_tokens, stem
from quarry.operators import search as s

WORDS = "index query shard token buffer session daemon parser cache ledger row-level b_c x".split()


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    return [(i, i % 7, " ".join(r.choices(WORDS, k=r.randint(1, 4))), " ".join(r.choices(WORDS, k=r.randint(0, 40))), "prose") for i in range(1, 120)]


@pytest.fixture(scope="module")
def chunks(spark, corpus):
    return spark.createDataFrame(corpus + corpus[:9], "chunk_id long, source_id long, title string, content string, content_type string")


def fts(corpus, tokenize):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table f using fts5(title, content, tokenize='{tokenize}')")
    con.executemany("insert into f(rowid, title, content) values (?, ?, ?)", [(c[0], c[2], c[3]) for c in corpus])
    return con


@pytest.mark.parametrize("kind,tokenize", [("bm25", "porter unicode61"), ("trigram", "trigram")])
def test_scores_match_sqlite(spark, chunks, corpus, kind, tokenize):
    texts = ["shard cache", "row-level ledger", "parser", "daemon daemon", "indexes caching tokens"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_no long, text string")
    got = {(r.query_no, r.chunk_id): r.score for r in getattr(s, kind)(queries, chunks, 1000).collect()}
    con = fts(corpus, tokenize)
    for q, text in enumerate(texts):
        match = " OR ".join(f'"{w}"' for w in distinct_in_order(text.split()))
        want = dict(con.execute("select rowid, -bm25(f, 5.0, 1.0) from f where f match ?", (match,)).fetchall())
        assert {c for n, c in got if n == q} == set(want)
        for c, score in want.items():
            assert abs(got[q, c] - score) < 1e-4
    every = {(r.query_no, r.chunk_id) for r in getattr(s, kind)(queries, chunks, 1000, True).collect()}
    for q, text in enumerate(texts):
        match = " AND ".join(f'"{w}"' for w in distinct_in_order(text.split()))
        assert {c for n, c in every if n == q} == {r[0] for r in con.execute("select rowid from f where f match ?", (match,))}


def test_stem_matches_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(c, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(f, 'row')")
    words = "running caresses ponies relational conditional rational valency hopping hoping agreed plastered motoring happy sky level controlling generalization operator security adoption homologous effective rate cease indices quickly".split()
    for w in words:
        con.execute("delete from f")
        con.execute("insert into f values (?)", (w,))
        assert stem(w) == con.execute("select term from v").fetchone()[0], w
    assert plain_tokens("Row-level naïve_x") == ["row", "level", "naive", "x"]


def test_correct_is_exact(spark):
    r = random.Random(5)
    vocabulary = sorted({"".join(r.choices("abcde", k=r.randint(3, 9))) for _ in range(150)})
    words = sorted({"".join(r.choices("abcde", k=r.randint(3, 9))) for _ in range(60)} | {"xyz", "ab"})

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, old = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
        return d[-1]

    want = {}
    for w in words:
        most = 1 if len(w) <= 4 else 2 if len(w) <= 12 else 3
        best = min(((distance(w, v), v) for v in vocabulary), default=(99, ""))
        if len(w) >= 3 and w not in vocabulary and best[0] <= most:
            want[w] = best
    got = s.correct(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(v,) for v in vocabulary] + [(None,)], "word string"))
    assert {r.word: (r.distance, r.correction) for r in got.collect()} == want


def test_span_and_pairs():
    r = random.Random(1)
    for _ in range(80):
        terms = r.choice([["ab", "cd"], ["a", "bc", "d"]])
        text = "".join(r.choices([*terms, ".", "..", " " * 9], k=r.randint(3, 25)))
        lists = [[i for i in range(len(text)) if text.startswith(t, i)] for t in terms]
        width, pairs = s.closeness(text, terms, 5)
        if all(lists):
            assert width == min(max(c) - min(c) for c in itertools.product(*lists))
            want = 0
            for left, right, t in zip(lists, lists[1:], terms):  # each left one takes the first free right one in reach
                free = list(right)
                for p in left:
                    hit = next((q for q in free if p + len(t) <= q <= p + len(t) + 5), None)
                    if hit is not None:
                        want += 1
                        free.remove(hit)
            assert pairs == want
        else:
            assert (width, pairs) == (None, 0)
    assert s.boost("alpha beta", "", "alpha beta", None) > s.boost("alpha beta", "", "alpha " + "x" * 200 + " beta", None)


def test_stems_and_diacritics(spark):
    chunks = spark.createDataFrame([(1, 1, "", "he runs daily", "prose"), (2, 1, "", "a naïve reader", "prose"), (3, 1, "", "nothing", "prose")], "chunk_id long, source_id long, title string, content string, content_type string")
    queries = spark.createDataFrame([(1, "runs"), (2, "NAIVE reading"), (3, "reader naive")], "query_no long, text string")
    assert {(r.query_no, r.chunk_id) for r in s.bm25(queries, chunks).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert s.about(chunks, "naive readers").first().chunk_id == 2
    files = spark.createDataFrame([("/a", "2025-01-02", "new"), ("/b", "2025-01-02", "same"), ("/c", "2024-01-01", "new")], "file_path string, modified string, content_hash string")
    sources = spark.createDataFrame([(i, p, p, "2025-01-01", "same") for i, p in enumerate(("/a", "/b", "/c", "/d"))], "id long, label string, file_path string, indexed_at string, content_hash string")
    assert [r.label for r in s.stale_sources(sources, files).collect()] == ["/a"]


def test_cascade(spark):
    chunks = spark.createDataFrame([(1, 1, "Cache > Eviction", "the cache evicts cold rows", "prose", ""), (2, 1, "Daemon", "the daemon restarts", "prose", "s9"), (3, 2, "Parser", "def parse(): pass", "code", None), (4, None, None, None, None, None)], "chunk_id long, source_id long, title string, content string, content_type string, session_id string")
    sources = spark.createDataFrame([(1, "docs:A"), (2, "code:b")], "id long, label string")
    vocabulary = spark.createDataFrame([("cache",), ("daemon",), ("parser",)], "word string")
    queries = spark.createDataFrame([(1, "cache eviction"), (2, "daemno"), (3, "zzzzzz"), (4, "")], "query_no long, text string")
    got = {(r.query_no, r.layer): r.chunk_id for r in s.search(queries, chunks, sources, vocabulary, 1).collect()}
    assert got == {(1, "rrf"): 1, (2, "rrf-fuzzy"): 2}
    assert s.search(queries.where("query_no = 1"), chunks, sources, vocabulary, source="CODE").count() == 0
    assert s.search(queries.where("query_no = 2"), chunks, sources, vocabulary, sessions=["other"]).count() == 0
    assert s.bm25(queries.limit(0), chunks).count() == 0
    scores = [r.score for kind in (None, "prose") for r in s.search(queries.where("query_no = 1"), chunks, sources, vocabulary, 1, content_type=kind).collect()]
    assert len(scores) == 2 and scores[0] == scores[1]


def shuffled(spark):
    """Records written to shuffles so far."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def many(spark):
    """600 queries that all meet each of 1,500 chunks, of which a tenth are stored twice."""
    chunks = spark.range(1500).selectExpr("id chunk_id", "id % 7 source_id", "concat('T', id) title", "repeat('alpha beta gamma ', cast(id % 11 + 1 as int)) content", "'prose' content_type")
    queries = spark.range(600).selectExpr("id query_no", "concat('alpha beta t', id) text")
    return queries, chunks.unionByName(chunks.where("chunk_id % 10 = 0"))


RANKED = {
    "r01_bm25": lambda q, c, _: s.bm25(q, c),
    "r01_unstemmed": lambda q, c, _: s.bm25(q, c, stemmed=False),
    "r06_search": lambda q, c, sources: s.search(q, c, sources, q.selectExpr("'alpha' word")),
    "r02_trigram": lambda q, c, _: s.trigram(q, c),
    "r03_unstemmed": lambda q, c, sources: s.fuse(s.bm25(q, c, stemmed=False), s.trigram(q, c), c, sources),
    "r01_every_term": lambda q, c, _: s.bm25(q, c, every=True, stemmed=False),
    "r03_fusion": lambda q, c, sources: s.fuse(s.bm25(q, c), s.trigram(q, c), c, sources),
    "x11_snippets": lambda q, c, sources: s.search(q, c, sources, q.selectExpr("'alpha' word")).select("query_no", snippets("content", "text", 600)),
}


@pytest.mark.parametrize("name", RANKED)
def test_shuffles_no_query_times_chunk(spark, many, name):
    queries, chunks = many
    before = shuffled(spark)
    rows = RANKED[name](queries, chunks, spark.createDataFrame([(i, f"s{i}") for i in range(7)], "id long, label string")).collect()
    assert len({r.query_no for r in rows}) == 600
    assert shuffled(spark) - before < 200_000  # pairs of query and chunk: 900,000 and more


def test_blocks_ties_and_rows_stored_twice(spark, many):
    queries, chunks = many
    whole = [tuple(r) for r in s.bm25(queries.limit(40), chunks, 5).orderBy("query_no", "rank").collect()]
    assert whole == [tuple(r) for r in s.bm25(queries.limit(40), chunks.distinct(), 5, at_once=7).orderBy("query_no", "rank").collect()]
    ties = s.bm25(queries.limit(1).selectExpr("query_no", "'gamma' text"), chunks.selectExpr("chunk_id", "source_id", "'' title", "'gamma x' content", "content_type"), 4)
    assert [r.chunk_id for r in ties.orderBy("rank").collect()] == [0, 1, 2, 3]
