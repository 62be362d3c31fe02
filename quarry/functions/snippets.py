"""Excerpts of texts: windows around hits, marks, cuts by bytes, escaping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters around a hit, and of a whole excerpt.
AROUND, MOST = 300, 1500


def cap_bytes(text: str, most: int) -> str:
    """The longest start of text within so many bytes of UTF-8; no character is cut."""
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def snippet(text: str, terms: list[str], most: int = MOST, around: int = AROUND) -> str:
    """Windows around the terms, merged where they meet, marked where text is left out; the start of the text if no term occurs."""
    if len(text) <= most:
        return text
    low = text.lower()
    hits = []
    for t in filter(None, map(str.lower, terms)):
        at = low.find(t)
        while at >= 0:
            hits.append(at)
            at = low.find(t, at + 1)
    if not hits:
        return text[:most] + "…"
    windows: list[list[int]] = []
    for h in sorted(hits):
        a, b = max(0, h - around), min(len(text), h + around)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    out, left = [], most
    for a, b in windows:
        if left <= 0:
            break
        b = min(b, a + left)
        left -= b - a
        out.append(("…" if a else "") + text[a:b] + ("…" if b < len(text) else ""))
    return "\n\n".join(out)


def marked(text: str, terms: list[str], start: str = "\x02", end: str = "\x03") -> str:
    """text with the places of the terms between marks; places that touch or overlap are one."""
    low = text.lower()
    spans = []
    for t in filter(None, map(str.lower, terms)):
        at = low.find(t)
        while at >= 0:
            spans.append((at, at + len(t)))
            at = low.find(t, at + 1)
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], start, text[a:b], end]
        at = b
    return "".join([*out, text[at:]])


def snippets(text: str, query: str, most: int = MOST) -> Column:
    """A column of excerpts of `text` for the words of `query`; null text gives null."""

    @F.pandas_udf(T.StringType())
    def run(t: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else snippet(a, (b or "").split(), most) for a, b in zip(t, q)])

    return run(F.col(text), F.col(query))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
