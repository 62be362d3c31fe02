"""Evaluation wording inside documents: pigeonhole pieces, exact hits, bit-parallel edit distance."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

_WORD = re.compile(r"[^\W_]+")
#: Words of a passage, edits (characters) it may differ by, and characters of items that go to the tasks at once (0.3 GB of a worker).
WORDS, EDITS, BLOCK_CHARS = 12, 1, 1_000_000


def words(text: str) -> str:
    """The words of text (maximal runs of letters and digits), lower-cased, each followed by a blank."""
    return " ".join(_WORD.findall(text)).lower()


def myers(pattern: str, text: str, most: int) -> int:
    """Least edit distance between pattern and any part of text, or most + 1 if it is greater (Myers 1999, in one word of any length)."""
    m = len(pattern)
    if not m:
        return 0
    eq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        eq[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best = score
            if not best:
                return 0
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return min(best, most + 1)


class Items:
    """The passages of test items, their pieces, and an automaton over all pieces.

    A passage is `size` consecutive words of an item (a shorter item is one passage). A passage is cut into
    edits + 1 pieces; one that occurs with at most `edits` edits keeps at least one piece unchanged, since no character
    belongs to two: the blank between two pieces is that of the right one.
    """

    def __init__(self, items: list[tuple[int, str]], size: int, edits: int):
        import ahocorasick

        self.size, self.edits = size, edits
        self.words = {i: words(t).split() for i, t in items}
        pieces: dict[str, set[tuple[int, int, int]]] = defaultdict(set)  # piece: item, first word of passage, first word of piece
        for i, w in self.words.items():
            n = min(size, len(w))
            cuts = [round(n * k / (edits + 1)) for k in range(edits + 2)]
            for p in range(len(w) - n + 1 if n else 0):
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        pieces[" " + " ".join(w[p + a : p + b]) + " " * (b == n)].add((i, p, p + a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), sorted(where)))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, least edits of a passage, passages found, longest run of common words) for each item with a passage in text."""
        if self.empty:
            return []
        line = f" {words(text)} "
        hits: dict[int, dict[int, int]] = defaultdict(dict)  # item: passage: edits
        tried: set[tuple[int, int, int]] = set()
        for end, (length, where) in self.automaton.iter(line):
            start = end - length + 1
            for item, p, a in where:
                known = hits[item].get(p)
                if known == 0:
                    continue
                w = self.words[item]
                n = min(self.size, len(w))
                passage = " ".join(w[p : p + n])
                before = len(" ".join(w[p:a])) + (a > p)
                at = start + 1 - before
                if (item, p, at) in tried:
                    continue
                tried.add((item, p, at))
                around = line[max(0, at - self.edits) : at + len(passage) + self.edits]
                edits = 0 if passage in around else myers(passage, around, self.edits)
                if edits <= self.edits and (known is None or edits < known):
                    hits[item][p] = edits
        out = []
        for item, passages in hits.items():
            if passages:
                exact = {p for p, e in passages.items() if e == 0}
                out.append((item, min(passages.values()), len(passages), self.longest(item, exact, line)))
        return out

    def longest(self, item: int, exact: set[int], line: str) -> int:
        """The longest run of the item's words that occurs in line, among runs around passages found unchanged."""
        w, best = self.words[item], 0
        n = min(self.size, len(w))
        for p in sorted(exact):
            run = " " + " ".join(w[p : p + n]) + " "
            if run not in line:
                continue  # unchanged as characters, but not at the bounds of words
            best = max(best, n)
            while p + best < len(w) and " " + " ".join(w[p : p + best + 1]) + " " in line:
                best += 1
        return best


_BUILT: dict[str, Items] = {}


def built(name: str, items: list[tuple[int, str]], size: int, edits: int) -> Items:
    """The automaton of a block, built once per worker; a worker holds one block at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(items, size, edits)
    return _BUILT[name]


def _finder(items: list[tuple[int, str]], size: int, edits: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = built(name, items, size, edits)
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for row in known.found(text):
                    docs.append(doc)
                    found.append(row)
            item, least, passages, run_words = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(docs, pa.int64()), pa.array(least, pa.int32()), pa.array(passages, pa.int32()), pa.array(run_words, pa.int32())],
                ["item_id", "doc_id", "edits", "passages", "common_words"],
            )

    return run


def leaked_items(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = WORDS, edits: int = EDITS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Items that occur, whole or in part, in documents: item_id, doc_id, edits, passages, common_words.

    A pair is found when a passage of `size` consecutive words of the item occurs in the document, as words in
    lower case, with at most `edits` character edits. edits: the least among its passages; passages: how many of the
    item's passages occur; common_words: the longest run of words that both have unchanged (0 if none reaches a passage).

    Defined results: null id or text: left out; text without words: nothing found; an item shorter than `size` words is one
    passage; repeated rows of a document or item (same id and text) give one pair; no documents or items: no rows.

    Plan: one pass over the documents, in which each task runs the automaton of all pieces over every text; nothing is
    shuffled but pairs. Items go to the tasks in blocks of at most block_chars characters (measured first); a larger
    set of items takes more passes, never a larger broadcast.
    """
    known = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    chars = known.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    corpus = spread(docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")))
    out = None
    for b in range(blocks):
        block = known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else known
        rows = sorted((r.i, r.t) for r in block.collect())
        part = corpus.mapInArrow(_finder(rows, size, edits), "item_id long, doc_id long, edits int, passages int, common_words int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"), F.max("passages").alias("passages"), F.max("common_words").alias("common_words"))
