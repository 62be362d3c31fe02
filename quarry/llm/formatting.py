"""Duplicates hidden by formatting: canonical text, 128-bit hash, counts with map-side combining."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import spread, written
from quarry.tables import normal_type

#: ASCII characters that are no letter or digit.
_ASCII_DROP = bytes(b for b in range(128) if not chr(b).isalnum())
_PAIR = re.compile(r"(?:^|(?<=[\s,;|]))[\"'`“]?([^\W\d][\w.\-]*)[\"'`”]?\s*[:=]\s*")
_WRAP = re.compile(r"^[^\w]+")
_TOKEN = re.compile(r"[^\W\d][\w.\-]*\x00")
_LEXEME = re.compile(r"[{}\[\]:,]|[^{}\[\]:,\s\"'`]+")
_QUOTES = "\"'`"
#: No more copies of a set than this go through the broadcast side; see `members`.
HOT_SHARE = 20_000


def bare(text: str) -> str:
    """text in one letter case, without anything that is no letter or digit."""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_DROP).decode()
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return "".join(filter(str.isalnum, text))


def _flatten(value: object) -> str:
    """A parsed value as text: members of objects in the order of their bare text, arrays in theirs."""
    if isinstance(value, str):
        return bare(value)
    if isinstance(value, tuple):  # the members of an object
        return "".join(sorted(bare(k) + _flatten(v) for k, v in value))
    if isinstance(value, list):
        return "".join(map(_flatten, value))
    return "null" if value is None else "true" if value is True else "false" if value is False else bare(str(value))


class _Loose:
    """A reader of JSON-like text with any quotes, any case of literals, and junk around punctuation."""

    def __init__(self, text: str):
        self.text, self.at, self.end = text, 0, len(text)

    def peek(self) -> str:
        while self.at < self.end and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at] if self.at < self.end else ""

    def word(self) -> str:
        c = self.peek()
        if c and c in _QUOTES:
            out, i = [], self.at + 1
            while i < self.end:
                if self.text[i] == "\\" and i + 1 < self.end:
                    n = self.text[i + 1]
                    if n == "u" and re.match(r"[0-9a-fA-F]{4}", self.text[i + 2 : i + 6]):
                        out.append(chr(int(self.text[i + 2 : i + 6], 16)))
                        i += 6
                    else:
                        out.append(" " if n in "nrtbf" else n)
                        i += 2
                elif self.text[i] == c:
                    after = self.text[i + 1 : i + 64].lstrip()
                    if not after or after[0] in ",:}]":
                        break
                    out.append(c)
                    i += 1
                else:
                    out.append(self.text[i])
                    i += 1
            else:
                raise ValueError("open quote")
            self.at = i + 1
            return "".join(out)
        m = _LEXEME.match(self.text, self.at)
        if not m or m[0] in "{}[]:,":
            raise ValueError("word expected")
        start = self.at
        self.at = m.end()
        while self.peek() and self.peek() not in "{}[]:,":  # a bare value of several words
            self.at += 1
        return self.text[start : self.at]

    def value(self, depth: int = 0) -> object:
        if depth > 200:
            raise ValueError("too deep")
        c = self.peek()
        if c == "{":
            self.at += 1
            members: list[tuple[str, object]] = []
            while self.peek() != "}":
                if self.peek() == ",":
                    self.at += 1
                    continue
                name = self.word()
                if self.peek() != ":":
                    raise ValueError("no member")
                self.at += 1
                members.append((name, self.value(depth + 1)))
            self.at += 1
            return tuple(members)
        if c == "[":
            self.at += 1
            items: list[object] = []
            while self.peek() != "]":
                if self.peek() == ",":
                    self.at += 1
                    continue
                items.append(self.value(depth + 1))
            self.at += 1
            return items
        return self.word()


_DECODER = json.JSONDecoder(object_pairs_hook=tuple, parse_int=str, parse_float=str, parse_constant=str)


def canonical(data: str) -> str:
    """The form in which two texts are equal when they differ only in case, blanks, punctuation or order of fields."""
    first = data.find("{")
    if first < 0 or (data[:first] and bare(data[:first])):
        first = data.find("[")
        if first >= 0 and (bare(data[:first]) or "{" not in data):
            first = -1  # arrays without objects have no fields: their order is that of the text
    if first >= 0 and (not data[:first] or not bare(data[:first])):
        last = max(data.rfind("}"), data.rfind("]")) + 1
        if last > first and not bare(data[last:]):
            inner = data[first:last]
            try:
                return _flatten(_DECODER.decode(inner))
            except (ValueError, RecursionError):
                try:
                    reader = _Loose(inner)
                    value = reader.value()
                    if not bare(inner[reader.at :]):
                        return _flatten(value)
                except (ValueError, RecursionError):
                    pass
    elif ":" in data or "=" in data:
        n, last = 0, -1

        def mark(m: re.Match) -> str:
            nonlocal n, last
            if m.start() == last:  # what follows a name and its sign is the value, whatever it looks like
                return m[0]
            n, last = n + 1, m.end()
            return m[1] + "\x00"

        marked = _PAIR.sub(mark, _WRAP.sub("", data))
        if n > 1:
            tokens = [t for t in (x.lstrip("-*>`'\"“”‘’«»()[]{}.,;:!?|…—–#&+~") for x in marked.split()) if t and bare(t)]
            if len(tokens) == n and all(map(_TOKEN.match, tokens)):
                return "".join(sorted(map(bare, tokens)))
            if fields := _listed(data):
                return "".join(sorted(map(bare, fields)))
    return bare(data)


def _listed(data: str) -> list[str]:
    """The fields of a text in which separators (comma, semicolon, bar, line break) stand between pairs whose values may hold several words; none if a part is no pair."""
    parts = [p for p in _SEPARATED.findall(data) if bare(p)]
    return parts if len(parts) > 1 and all(map(_FIELD.match, parts)) else []


#: A part up to a separator that isn't in quotes; a name with its sign and something after it.
_SEPARATED = re.compile(r"(?:\"[^\"\n]*\"|(?<!\w)'[^'\n]*'|`[^`\n]*`|[^,;|\n])+")
_FIELD = re.compile(r"^\W*[^\W\d][\w.\-]*[\"'`”]?\s*[:=]\s*\S")


_KEYS = "id long, h1 long, h2 long, proof long"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types: dict[str, bytes] = {}
    for batch in batches:
        ids, h1, h2, proofs = [], [], [], []
        for i, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            head = types.get(kind)
            if head is None:
                head = types[kind] = kind.encode() + b"\x00"
            raw = head + canonical(data).encode("utf-8", "surrogatepass")
            d = xxhash.xxh3_128_digest(raw)
            ids.append(i)
            h1.append(int.from_bytes(d[:8], "big", signed=True))
            h2.append(int.from_bytes(d[8:], "big", signed=True))
            proofs.append(xxhash.xxh64_intdigest(raw, seed=len(raw)) - (1 << 63))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, h1, h2, proofs)], ["id", "h1", "h2", "proof"])


def canonical_keys(records: DataFrame, key: str = "id", kind: str = "type", data: str = "data") -> DataFrame:
    """(id, h1, h2, proof) per record: the 128-bit hash of type and canonical data, and an independent 64-bit proof.

    A record is one id; redelivered rows collapse. Records with null id, type or data are copies of none and left out.
    Written once to the shared folder, since both the counts and the members are taken from it.
    """
    rows = records.select(F.col(key).cast("long").alias("id"), normal_type(kind).alias("kind"), F.col(data).alias("data")).dropna()
    return written(spread(rows).mapInArrow(_hashed, _KEYS).distinct(), "canonical")


def copy_sets(keys: DataFrame) -> DataFrame:
    """One row per set of copies: h1, h2, proof, keep_id (smallest id), copies.

    Counts combine on the map side. A set is the hash with its proof (length-seeded, of another hash function), so
    two texts that collide in 128 bits still make two sets; `collisions` lists such hashes.
    """
    return keys.groupBy("h1", "h2", "proof").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def collisions(sets: DataFrame) -> DataFrame:
    """Hashes under which texts with different proofs were found."""
    return sets.groupBy("h1", "h2").agg(F.count("*").alias("texts")).where("texts > 1").select("h1", "h2", "texts")


def members(keys: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """(keep_id, id, copies) for every record of a set of at least two, including the kept one.

    The few sets that hold more than 1/hot_share of all records (at most hot_share sets, 40 bytes each)
    are broadcast, so their members never meet in one task; all other sets are joined by their hash.
    """
    sets = copy_sets(keys).where("copies > 1")
    least = max(100_000, keys.count() // hot_share)
    hot = sets.where(F.col("copies") > least)
    cold = sets.where(F.col("copies") <= least)
    on = ["h1", "h2", "proof"]
    marked = keys.join(F.broadcast(hot), on, "left")
    rest = marked.where("keep_id is null").drop("keep_id", "copies").join(cold, on)
    out = ["keep_id", "id", "copies"]
    return marked.where("keep_id is not null").select(*out).unionByName(rest.select(*out))


def collapse_formatting(records: DataFrame, key: str = "id", kind: str = "type", data: str = "data") -> DataFrame:
    """One row per distinct record: keep_id and copies (1 where there is no copy)."""
    return copy_sets(canonical_keys(records, key, kind, data)).select("keep_id", "copies")
