"""Ranked retrieval for a table of queries in one job: term scores, substring scores, fusion, correction, reranking.

Queries: query_no LONG, text STRING. Chunks: chunk_id, source_id, title, content, content_type. Every query meets all chunks.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.words import STOPWORDS, index_tokens, most_edits, query_terms, trigram_terms
from quarry.session import spread, written

# Saturation and length constants of the score, weights of title and content, constant of the fusion; weights and gap of the reranking.
K1, B, TITLE, CONTENT, FUSION = 1.2, 0.75, 5.0, 1.0, 60
TITLE_CODE, TITLE_PROSE, PHRASE, PHRASES, GAP = 0.6, 0.3, 0.5, 4, 30
#: Distinct query terms that go to the tasks at once; more are searched in further passes. Distinct sets of terms likewise.
TERMS_AT_ONCE, SETS_AT_ONCE = 50_000, 200_000
#: Hits and chunks that a task scores at once, rows it gives at once.
SLAB_HITS, SLAB_CHUNKS, ROWS = 1 << 22, 1 << 17, 1 << 20
#: Found chunks whose ids go to all tasks; more are joined by a shuffle.
IDS_SENT = 1_000_000
_HITS = "chunk_id long, key array<long>, block int, length long, terms array<int>, tf array<double>"


def _records(chunks: DataFrame) -> DataFrame:
    """The rows of chunks with empty strings for null texts and a key: rows of one chunk_id that are equal in all that counts have one key (two 64-bit hashes)."""
    same = [c for c in ("source_id", "content_type", "session_id") if c in chunks.columns]
    own = chunks.where("chunk_id is not null").select("chunk_id", *same, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    return own.withColumn("key", F.array(*[F.xxhash64(F.lit(i), "title", "content", *same, *[F.isnull(c) for c in same]) for i in (1, 2)]))


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id with empty strings for null texts; rows stored twice collapse."""
    more = ["session_id"] if "session_id" in chunks.columns else []
    return chunks.where("chunk_id is not null").select("chunk_id", "source_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"), "content_type", *more).distinct()


def _tokens(stemmed: bool):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: index_tokens(t, stemmed))

    return run


def _grams(terms: list[str], first: int, stemmed: bool) -> Callable:
    """A function of title and content: number of index tokens, weighted counts of those terms that occur, by their number; phrases are runs of tokens."""

    def start():
        ids = {t: i for i, t in enumerate(terms, first)}
        sizes: dict[str, set[int]] = {}
        for t in terms:
            words = t.split(" ")
            sizes.setdefault(words[0], set()).add(len(words))

        def count(title: str, content: str, _: int) -> tuple[int, dict[int, float]]:
            found: dict[int, float] = {}
            total = 0
            for text, weight in ((title, TITLE), (content, CONTENT)):
                words = index_tokens(text, stemmed)
                total += len(words)
                for at, w in enumerate(words):
                    for m in sizes.get(w, ()):
                        i = ids.get(w if m == 1 else " ".join(words[at : at + m])) if at + m <= len(words) else None
                        if i is not None:
                            found[i] = found.get(i, 0.0) + weight
            return total, found

        return count

    return start


def _substrings(terms: list[str], first: int) -> Callable:
    """Like _grams: terms wherever their characters occur; the length is given."""

    def start():
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms, first):
            automaton.add_word(t, i)
        if terms:
            automaton.make_automaton()

        def count(title: str, content: str, length: int) -> tuple[int, dict[int, float]]:
            found: dict[int, float] = {}
            for text, weight in ((title, TITLE), (content, CONTENT)):
                for _, i in automaton.iter(text) if terms else ():
                    found[i] = found.get(i, 0.0) + weight
            return length, found

        return count

    return start


def _counted(start: Callable, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = start()
        for batch in batches:
            lengths, offsets, terms, tf = [], [0], [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("title", "content", "length"))):
                length, found = count(*row)
                lengths.append(length)
                terms += found
                tf += found.values()
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (tf, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("key"), pa.array([block] * len(lengths), pa.int32()), pa.array(lengths, pa.int64()), *lists], [f.split(" ")[0] for f in _HITS.split(", ")])

    return run


class _Hits:
    """The hits of all query terms, one row per chunk: written terms, tf, length (of equal size). sets: set_no, set; members: query_no, set_no."""

    def __init__(self, queries: DataFrame, own: DataFrame, terms: DataFrame, counting: Callable, at_once: int):
        """own: chunk_id, key, title, content, length; terms: query_no, term; counting gives the start of a pass for a block of terms.

        A pass reads every chunk once; no text leaves it, only terms, and rows stored twice collapse after it. One row per chunk keeps its hits in one task.
        """
        sets = terms.groupBy("query_no").agg(F.array_sort(F.collect_set("term")).alias("set"))
        self.members = written(sets.withColumn("set_no", F.min("query_no").over(Window.partitionBy("set")).cast("long")), "sets")
        names = sorted(r[0] for r in self.members.select(F.explode("set").alias("term")).distinct().collect())
        self.ids = {t: i for i, t in enumerate(names)}
        own = spread(own)
        rows = None
        for b, first in enumerate(range(0, max(1, len(names)), at_once)):
            part = own.mapInArrow(_counted(counting(names[first : first + at_once], first), b), _HITS)
            rows = part if rows is None else rows.unionByName(part)
        lists = rows.repartition("chunk_id").distinct().groupBy("chunk_id").agg(F.collect_list(F.struct("block", "length", "terms", "tf")).alias("r"))
        lengths = F.flatten(F.transform("r", lambda r: F.array_repeat(r["length"], F.size(r["terms"]))))
        first = F.filter("r", lambda r: r["block"] == 0)
        counts = (F.size(first).alias("n"), F.aggregate(first, F.lit(0).cast("long"), lambda a, r: a + r["length"]).alias("total"))
        self.rows = written(lists.select("chunk_id", F.flatten("r.terms").alias("terms"), F.flatten("r.tf").alias("tf"), lengths.alias("length"), *counts), "hits")
        n, total = self.rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        self.mean = max(1.0, total / max(1, n))
        self.idf = np.zeros(len(names))
        for i, df in self.rows.select(F.explode("terms").alias("i")).groupBy("i").count().collect():
            x = math.log((n - df + 0.5) / (df + 0.5))
            self.idf[i] = x if x > 0 else 1e-6


def _best(sets: list[tuple[int, list[int]]], idf: np.ndarray, mean: float, k: int, every: bool):
    """Of the chunks of a task, slab by slab, the k best for each set of terms: what is left out has k better ones there."""

    def score(ids: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, by_term = ids[order], np.argsort(term, kind="stable")
        s = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))[by_term]
        at = np.repeat(place, counts)[by_term]
        bounds = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
        out: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for no, own in sets:
            spans = [slice(bounds[t], bounds[t + 1]) for t in own]
            here, weights = np.concatenate([at[x] for x in spans]), np.concatenate([s[x] for x in spans])
            if not len(here):
                continue
            if len(here) * 8 < len(ids):
                which, here = np.unique(here, return_inverse=True)
            else:
                which = np.arange(len(ids))
            sums = np.bincount(here, weights, len(which))
            met = np.flatnonzero(np.bincount(here, minlength=len(which)) == len(own) if every else sums > 0)
            which, values = which[met], np.round(sums[met], 9)
            if len(values) > k:  # ties go by chunk_id, in whose order they stand
                least = np.partition(values, len(values) - k)[len(values) - k]
                above = np.flatnonzero(values > least)
                keep = np.concatenate([above, np.flatnonzero(values == least)[: k - len(above)]])
                which, values = which[keep], values[keep]
            out.append((np.full(len(which), no), ids[which], values))
            rows += len(which)
            if rows >= ROWS:
                yield batch(out)
                out, rows = [], 0
        if out:
            yield batch(out)

    def batch(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["set_no", "chunk_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        hits = chunks = 0
        for b in batches:
            lists = [b.column(c) for c in ("terms", "tf", "length")]
            parts.append((b.column("chunk_id").to_numpy(zero_copy_only=False), lists[0].value_lengths().to_numpy(zero_copy_only=False), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)))
            hits, chunks = hits + len(parts[-1][2]), chunks + len(parts[-1][0])
            if hits >= SLAB_HITS or chunks >= SLAB_CHUNKS:
                yield from score(*map(np.concatenate, zip(*parts)))
                parts, hits, chunks = [], 0, 0
        if parts:
            yield from score(*map(np.concatenate, zip(*parts)))

    return run


def _ranked(hits: _Hits, k: int, every: bool, allowed: DataFrame | None) -> DataFrame:
    """query_no, chunk_id, score, rank: the k best chunks of each query, best first; ties by chunk_id.

    Queries with the same terms are scored once, in the tasks that hold the chunks; only each task's best leave it, so what is shuffled
    doesn't grow with queries times hits. every: only chunks with all terms of the query. allowed: chunk_id of the chunks that may be found; statistics don't change by it.
    """
    rows = hits.rows.select("chunk_id", "terms", "tf", "length").where("size(terms) > 0")
    if allowed is not None:
        rows = rows.join(allowed, "chunk_id", "left_semi")
    sets = [(r.set_no, [hits.ids[t] for t in r.set]) for r in hits.members.where("query_no = set_no").select("set_no", "set").collect()]
    found = None
    for first in range(0, max(1, len(sets)), SETS_AT_ONCE):
        part = rows.mapInArrow(_best(sets[first : first + SETS_AT_ONCE], hits.idf, hits.mean, k, every), "set_no long, chunk_id long, score double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("set_no").orderBy(F.desc("score"), "chunk_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.members.select("query_no", "set_no").join(found, "set_no").select("query_no", "chunk_id", "score", "rank")


def _term_hits(queries: DataFrame, chunks: DataFrame, stemmed: bool = True, at_once: int = TERMS_AT_ONCE) -> _Hits:
    words = queries.select("query_no", F.explode(query_terms("text")).alias("word"))
    terms = words.select("query_no", F.array_join(_tokens(stemmed)("word"), " ").alias("term")).where("term <> ''").distinct()
    own = _records(chunks).select(F.col("chunk_id").cast("long"), "key", "title", "content", F.lit(0).alias("length"))
    return _Hits(queries, own, terms, lambda names, first: _grams(names, first, stemmed), at_once)


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 10, every: bool = False, allowed: DataFrame | None = None, stemmed: bool = True, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """query_no, chunk_id, score, rank: chunks by the score of index tokens (stems without diacritics) in title (weight 5) and content (1).

    A query term with inner punctuation is a phrase of consecutive tokens. every: all terms must occur. Statistics are those of
    all chunks, also where only `allowed` ones may be found. Queries without terms have no rows. Plan: chunks are tokenised once,
    only query terms leave the stage (in blocks of at most at_once), and each task gives its best k chunks of each query. Runs the first stage at once.
    """
    return _ranked(_term_hits(queries, chunks, stemmed, at_once), k, every, allowed)


def trigram(queries: DataFrame, chunks: DataFrame, k: int = 10, every: bool = False, allowed: DataFrame | None = None, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """Like bm25, over substrings: a term occurs wherever its characters do; length is the number of trigrams.

    The terms of all queries go to the tasks in blocks of at most at_once; each pass reads every chunk once and shuffles only hits.
    """
    terms = queries.select("query_no", F.explode(trigram_terms("text")).alias("term")).distinct()
    own = _records(chunks).select(F.col("chunk_id").cast("long"), "key", F.lower("title").alias("title"), F.lower("content").alias("content"))
    length = F.greatest(F.length("title") - 2, F.lit(0)) + F.greatest(F.length("content") - 2, F.lit(0))
    return _ranked(_Hits(queries, own.withColumn("length", length), terms, _substrings, at_once), k, every, allowed)


def _found(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """The records (see `_records`) of chunks whose chunk_id is in rows, which are few beside the texts."""
    ids = rows.select("chunk_id").distinct()
    return _records(chunks).join(F.broadcast(ids) if ids.count() <= IDS_SENT else ids, "chunk_id", "left_semi")


def fuse(first: DataFrame, second: DataFrame, chunks: DataFrame, sources: DataFrame, limit: int = 3) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: rows of equal source label and title add up; the row seen first stays.

    query_no, chunk_id, label, title, score, rank; ties go to the row that came first. The two lists are run at once, titles are read for them only.
    """
    lists = written(first.select("query_no", "chunk_id", "rank", F.lit(0).alias("list")).unionByName(second.select("query_no", "chunk_id", "rank", F.lit(1).alias("list"))), "lists")
    own = _found(chunks, lists).select("chunk_id", "key", "source_id", "title").distinct()
    own = own.join(sources.select(F.col("id").alias("source_id"), "label"), "source_id", "left")
    rows = lists.join(own.select("chunk_id", F.coalesce("label", F.lit("")).alias("label"), "title"), "chunk_id")
    seen = F.col("list") * 1_000_000 + F.col("rank")
    merged = rows.groupBy("query_no", "label", "title").agg(F.round(F.sum(1.0 / (FUSION + F.col("rank"))), 12).alias("score"), F.min(F.struct(seen.alias("seen"), "chunk_id")).alias("f"))
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), "f.seen")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_no", "f.chunk_id", "label", "title", "score", "rank")


def correct(words: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """word, correction, distance: for each word of at least 3 characters that the vocabulary lacks, its nearest vocabulary word.

    Within 1, 2 or 3 edits by length; ties go by word. Exact and without comparing all pairs: a word split into edits + 1 pieces
    keeps a piece unchanged in any word that near, at most that many places away; words meet on such pieces only.
    """
    known = vocabulary.select(F.col(word).alias("correction")).dropna().distinct()
    own = words.select(F.lower(word).alias("word")).where("length(word) >= 3").distinct().join(known, F.col("word") == F.col("correction"), "left_anti")
    d = most_edits(F.col("word"))
    n = F.length("word")
    pieces = F.transform(F.sequence(F.lit(0), d), lambda i: F.struct((F.floor(n * i / (d + 1))).cast("int").alias("at"), (F.floor(n * (i + 1) / (d + 1))).cast("int").alias("end")))
    own = own.withColumn("d", d).select("word", "d", F.explode(pieces).alias("p")).select("word", "d", F.col("p.at").alias("at"), F.expr("substring(word, p.at + 1, p.end - p.at)").alias("piece")).where("piece <> ''")
    sizes = own.select(F.length("piece").alias("m")).distinct()
    places = known.join(F.broadcast(sizes), F.length("correction") >= F.col("m")).select("correction", F.explode(F.sequence(F.lit(0), F.length("correction") - F.col("m"))).alias("place"), "m")
    places = places.select("correction", "place", F.expr("substring(correction, place + 1, m)").alias("piece"))
    near = own.join(places, "piece").where((F.abs(F.col("at") - F.col("place")) <= F.col("d")) & (F.abs(F.length("word") - F.length("correction")) <= F.col("d")))
    near = near.select("word", "d", "correction").distinct().withColumn("distance", F.levenshtein("word", "correction")).where(F.col("distance") <= F.col("d"))
    best = near.groupBy("word").agg(F.min(F.struct("distance", "correction")).alias("b"))
    return best.select("word", "b.correction", "b.distance")


def corrected_queries(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_no, text of the queries in which a word was corrected: lower case, stopwords and words under 3 characters left out."""
    words = queries.select("query_no", F.posexplode(F.split(F.trim(F.lower("text")), r"\s+")).alias("pos", "word")).where((F.length("word") >= 3) & ~F.col("word").isin(*sorted(STOPWORDS)))
    fixed = words.join(correct(words.select("word"), vocabulary), "word", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("correction", "word").alias("w")))), lambda s: s["w"]), " ")
    return fixed.groupBy("query_no").agg(text.alias("text"), F.max(F.col("correction").isNotNull()).alias("changed")).where("changed").drop("changed")


def closeness(text: str, terms: list[str], gap: int = GAP) -> tuple[int | None, int]:
    """(width of the tightest window with all terms, occurrences of consecutive terms at most gap characters apart), None and 0 if a term is missing.

    One merge of all places of all terms in order: the last place of each term gives the windows; a term's places wait, first come first served,
    for a place of the term after it, until it is out of reach.
    """
    places: list[tuple[int, int]] = []
    for i, t in enumerate(terms):
        own = [(m.start(), i) for m in re.finditer(f"(?={re.escape(t)})", text)]
        if not own:
            return None, 0
        places += own
    last: dict[int, int] = {}
    waiting: list[deque[int]] = [deque() for _ in terms]
    width, pairs = None, 0
    for at, i in sorted(places):
        last[i] = at
        if len(last) == len(terms):
            here = at - min(last.values())
            width = here if width is None else min(width, here)
        if i:
            ends = waiting[i - 1]
            while ends and ends[0] + gap < at:
                ends.popleft()
            if ends and ends[0] <= at:
                ends.popleft()
                pairs += 1
        waiting[i].append(at + len(terms[i]))
    return width, pairs


def boost(query: str, title: str, content: str, content_type: str | None) -> float:
    """Title hits, proximity and phrase frequency of a result for its query."""
    every = [w for w in query.lower().split() if len(w) >= 2]
    terms = [w for w in every if w not in STOPWORDS] or every
    if not terms:
        return 0.0
    low, text = title.lower(), content.lower()
    out = (TITLE_CODE if content_type == "code" else TITLE_PROSE) * sum(t in low for t in terms) / len(terms)
    width, pairs = closeness(text, terms) if len(terms) > 1 else (None, 0)
    return out if width is None else out + 1 / (1 + width / max(len(text), 1)) + PHRASE * min(1, pairs / PHRASES)


def rerank(results: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """results, which are run at once, with boost and the new rank within each query (the limit was applied before: only the order changes)."""
    results = written(results.drop("content", "content_type"), "results")
    texts = _found(chunks, results).select("chunk_id", "key", "content", "content_type").distinct()

    @F.pandas_udf(T.DoubleType())
    def boosts(q: pd.Series, t: pd.Series, c: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([round(boost(*row), 9) for row in zip(q, t, c, k)], dtype="float64")

    own = results.join(texts, "chunk_id").join(queries.select("query_no", "text"), "query_no")
    own = own.withColumn("boost", boosts("text", "title", "content", "content_type"))
    w = Window.partitionBy("query_no").orderBy(F.desc("boost"), "rank")
    return own.withColumn("place", F.row_number().over(w)).select("query_no", "chunk_id", "label", "title", "content", "text", "score", "boost", F.col("place").alias("rank"))


def search(queries: DataFrame, chunks: DataFrame, sources: DataFrame, vocabulary: DataFrame, limit: int = 3, source: str | None = None, exact_source: bool = False, content_type: str | None = None, sessions: list[str] | None = None, every: bool = False) -> DataFrame:
    """The whole cascade: fuse term and substring results, rerank; queries without a result try again with corrected words.

    source: a part of the label (ASCII case ignored) or, with exact_source, the label; content_type: code or prose; sessions: keep
    unattributed chunks and those of these sessions; every: all terms must occur. Statistics are those of all chunks; what a filter
    leaves out is left out before the limit. layer: rrf, or rrf-fuzzy for corrected queries. Chunks are tokenised once; texts are read again for results only.
    """
    allowed = chunks.where("chunk_id is not null")
    if content_type:
        allowed = allowed.where(F.col("content_type") == content_type)
    if sessions is not None:
        allowed = allowed.where((F.coalesce("session_id", F.lit("")) == "") | F.col("session_id").isin(*sessions))
    if source:
        match = F.col("label") == source if exact_source else F.contains(F.lower("label"), F.lit(source.lower()))
        allowed = allowed.join(sources.where(match).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    allowed = allowed.select("chunk_id") if content_type or sessions is not None or source else None
    fetch = max(2 * limit, 10)

    # a query and its corrected form run in one pass; the corrected one counts where the other finds nothing
    forms = queries.select((F.col("query_no") * 2).alias("query_no"), "text").unionByName(corrected_queries(queries, vocabulary).select((F.col("query_no") * 2 + 1).alias("query_no"), "text"))
    forms = written(forms.repartition(1), "forms")
    fused = fuse(bm25(forms, chunks, fetch, every, allowed), trigram(forms, chunks, fetch, every, allowed), chunks, sources, limit)
    layer = F.pmod("query_no", F.lit(2))
    first = F.min(layer).over(Window.partitionBy(F.floor(F.col("query_no") / 2)))
    kept = fused.withColumn("first", first).where(layer == F.col("first")).drop("first")
    found = rerank(kept, forms, chunks)
    return found.withColumn("layer", F.when(layer == 0, "rrf").otherwise("rrf-fuzzy")).withColumn("query_no", F.floor(F.col("query_no") / 2))


def about(chunks: DataFrame, intent: str, k: int = 5) -> DataFrame:
    """The chunks that bear most on an intent (all its terms, else any): chunk_id, score, rank. Texts under 5,000 characters need no search; callers show them whole."""
    q = chunks.sparkSession.createDataFrame([(0, intent)], "query_no long, text string")
    hits = _term_hits(q, chunks)
    first = _ranked(hits, k, True, None)
    return (_ranked(hits, k, False, None) if first.isEmpty() else first).select("chunk_id", "score", "rank")


def stale_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources whose file has changed since: newer than the index and of another hash. files: file_path, modified, content_hash; missing files keep their chunks."""
    now = files.select("file_path", "modified", F.col("content_hash").alias("now_hash"))
    rows = sources.where("file_path is not null").join(now, "file_path")
    return rows.where((F.col("modified") > F.col("indexed_at")) & ~F.col("content_hash").eqNullSafe(F.col("now_hash"))).select("id", "label", "file_path")


def distinctive_terms(chunks: DataFrame, most: int = 40) -> DataFrame:
    """Per source the terms in at least 2 and at most max(3, 40 %) of its chunks, by rarity and shape; ties go by word. Sources under 3 chunks have none."""
    from quarry.functions.words import vocabulary_words

    own = unique_chunks(chunks).select("source_id", "chunk_id", F.explode(F.array_distinct(vocabulary_words("content"))).alias("word"))
    n = unique_chunks(chunks).groupBy("source_id").agg(F.count("*").alias("n")).where("n >= 3")
    counts = own.groupBy("source_id", "word").agg(F.count("*").alias("df")).join(n, "source_id")
    kept = counts.where((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.4))))
    shape = F.least(F.length("word") / 20, F.lit(0.5)) + F.when(F.contains("word", F.lit("_")), 1.5).when(F.length("word") >= 12, 0.8).otherwise(0.0)
    scored = kept.withColumn("score", F.round(F.log(F.col("n") / F.col("df")) + shape, 6))
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("source_id", "word", "df", "score", "rank")
