"""Pages: HTML to Markdown-like text, and dispatch by content type. Nothing is fetched here: pages come as rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROPPED = frozenset(("script", "style", "nav", "header", "footer", "noscript"))
_BREAKS = frozenset(("p", "div", "section", "article", "tr", "ul", "ol", "table", "br", "blockquote"))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.pre = False
        self.href: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _DROPPED:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in _BREAKS:
            self.out.append("\n" if tag == "br" else "\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif re.fullmatch("h[1-6]", tag) or tag in _BREAKS:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(html: str) -> str:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(reader.out))).strip()


def to_markdown(html: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else markdown_of(v))

    return convert(html)


def fetched(pages: DataFrame) -> DataFrame:
    """url, text, kind of pages (url, content_type, body): JSON as it is, HTML as Markdown, all else as plain text."""
    kind = F.when(F.contains(F.lower("content_type"), F.lit("json")), "json").when(F.contains(F.lower("content_type"), F.lit("html")), "markdown").otherwise("plain")
    return pages.withColumn("kind", kind).select("url", F.when(F.col("kind") == "markdown", to_markdown(F.col("body"))).otherwise(F.col("body")).alias("text"), "kind")


def address_class(ip: Column) -> Column:
    """private, block or public for IPv4 and IPv6 texts; null if it is no address."""

    @F.pandas_udf(T.StringType())
    def classify(s: pd.Series) -> pd.Series:
        import ipaddress

        def one(v: str | None) -> str | None:
            try:
                a = ipaddress.ip_address((v or "").split("%")[0])
            except ValueError:
                return None
            a = getattr(a, "ipv4_mapped", None) or a
            if a.is_link_local or a.is_multicast or a.is_unspecified or a.is_reserved and not a.is_private:
                return "block"
            return "private" if a.is_private or a.is_loopback else "public"

        return s.map(one)

    return classify(ip)
