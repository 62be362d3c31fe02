"""Documents to titled chunks: Markdown, plain text, JSON. Sequential grammars, so Arrow batches in Python, a text at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

#: Bytes of a chunk, of a title and of a source; chunks of a source.
CAP, TITLE_CAP, SOURCE_CAP, MOST_CHUNKS = 4096, 256, 8 * 1024 * 1024, 4096
#: Plain text: sections by blank lines if so many, each under so many bytes; else groups of lines with an overlap.
SECTIONS, SECTION_BYTES, GROUP, OVERLAP, TITLE_CHARS = range(3, 201), 5000, 20, 2, 80
#: Names under which array elements identify themselves, in order of preference.
IDENTITY = ("id", "name", "title", "path", "slug", "key", "label")


class Chunk(NamedTuple):
    title: str
    content: str
    has_code: bool


class TooLarge(ValueError):
    """A source beyond the bounds; none of its chunks are kept."""


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def cut(text: str, cap: int) -> str:
    """The longest start of text within cap bytes, no character cut."""
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= cap else raw[:cap].decode("utf-8", "ignore")


def slices(text: str, cap: int) -> Iterator[str]:
    raw = text.encode("utf-8", "surrogatepass")
    at = 0
    while at < len(raw):
        end = min(at + cap, len(raw))
        while end < len(raw) and end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:  # a character wider than the cap
            end = min(at + 4, len(raw))
        yield raw[at:end].decode("utf-8", "surrogatepass")
        at = end


def packed(lines: Iterable[str], title: str, cap: int, has_code: bool = False) -> Iterator[Chunk]:
    """Lines gathered up to cap bytes; a longer line in slices. Titles: the first plain, then numbered."""
    title = cut(title, TITLE_CAP)
    held: list[str] = []
    held_size, part = 0, 1

    def named(suffix: str) -> str:
        return title if part == 1 else f"{title} ({suffix})"

    for line in lines:
        n = size(line)
        if held and (n > cap or held_size + 1 + n > cap):
            yield Chunk(named(str(part)), "\n".join(held), has_code)
            held, held_size, part = [], 0, part + 1
        if n > cap:
            for k, piece in enumerate(slices(line, cap), 1):
                yield Chunk(named(f"{part}.{k}"), piece, has_code)
                part += 1
        else:
            held_size += n + bool(held)
            held.append(line)
    if held:
        yield Chunk(named(str(part)), "\n".join(held), has_code)


def _blocks(lines: list[str]) -> Iterator[tuple[bool, list[str], bool]]:
    """(is a fence, its lines, closed) in order; a fence runs to a line that trims to its own mark."""
    at, plain = 0, []
    while at < len(lines):
        mark = re.match(r"`{3,}", lines[at])
        if not mark:
            plain.append(lines[at])
            at += 1
            continue
        if plain:
            yield False, plain, True
            plain = []
        end = next((i for i in range(at + 1, len(lines)) if lines[i].strip() == mark[0]), None)
        yield True, lines[at : len(lines) if end is None else end + 1], end is not None
        at = len(lines) if end is None else end + 1
    if plain:
        yield False, plain, True


def _section(body: list[str], title: str, cap: int) -> Iterator[Chunk]:
    text = "\n".join(body).strip()
    has_code = any(line.startswith("```") for line in body)
    if size(text) <= cap:
        yield Chunk(title, text, has_code)
    elif has_code:
        for fence, lines, closed in _blocks(text.split("\n")):
            if not fence or not closed:
                yield from packed(lines, title, cap, has_code=fence)
            elif size("\n".join(lines)) <= cap:
                yield Chunk(title, "\n".join(lines), True)
            else:
                first, *inner, last = lines
                for c in packed(inner, title, cap - size(f"{first}\n\n{last}")):
                    yield Chunk(c.title, f"{first}\n{c.content}\n{last}", True)
    else:
        paragraphs = re.split(r"\n\n+", text)
        group: list[str] = []
        part = 0
        for p in [*paragraphs, None]:
            if group and (p is None or size("\n\n".join([*group, p])) > cap):
                part += 1
                name = f"{title} ({part})" if len(paragraphs) > 1 else title
                joined = "\n\n".join(group).strip()
                if size(joined) <= cap:
                    yield Chunk(name, joined, "```" in joined)
                else:
                    yield from (c._replace(has_code="```" in c.content) for c in packed(joined.split("\n"), name, cap))
                group = []
            if p is not None:
                group.append(p)


def markdown(text: str, cap: int = CAP) -> Iterator[Chunk]:
    """Chunks at headings (levels 1 to 4) and rules; titled by the path of headings; fences never cut by a heading."""
    path: list[tuple[int, str]] = []
    body: list[str] = []

    def ready() -> bool:
        return any(line.strip() for line in body)

    def name() -> str:
        return cut(" > ".join(t for _, t in path) or "Untitled", TITLE_CAP)

    for fence, lines, _ in _blocks(text.split("\n")):
        if fence:
            body += lines
            continue
        for line in lines:
            heading = re.match(r"(#{1,4})\s+(.+)$", line)
            if not heading and not re.match(r"[-_*]{3,}\s*$", line):
                body.append(line)
                continue
            if ready():
                yield from _section(body, name(), cap)
                body = []
            if heading:
                level = len(heading[1])
                path = [h for h in path if h[0] < level] + [(level, heading[2].strip())]
                body.append(line)
    if ready():
        yield from _section(body, name(), cap)


def plain(text: str, cap: int = CAP) -> Iterator[Chunk]:
    """Chunks at blank lines where that gives a fair number of small sections, else groups of lines that overlap."""
    parts = re.split(r"\n\s*\n", text)
    if len(parts) in SECTIONS and all(size(p) < SECTION_BYTES for p in parts):
        for p in filter(None, map(str.strip, parts)):
            name = p.split("\n", 1)[0][:TITLE_CHARS]
            yield from [Chunk(name, p, False)] if size(p) <= cap else packed(p.split("\n"), name, cap)
        return
    lines = text.split("\n")
    if len(lines) <= GROUP:
        yield from [Chunk("Output", text, False)] if size(text) <= cap else packed(lines, "Output", cap)
        return
    for at in range(0, len(lines), GROUP - OVERLAP):
        group = lines[at : at + GROUP]
        name = group[0].strip()[:TITLE_CHARS] or f"Lines {at + 1}-{at + len(group)}"
        joined = "\n".join(group)
        yield from [Chunk(name, joined, False)] if size(joined) <= cap else packed(group, name, cap)


def _dump(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _walk(value: object, path: tuple[str, ...], cap: int) -> Iterator[Chunk]:
    title = cut(" > ".join(path) or "(root)", TITLE_CAP)
    if isinstance(value, list):
        yield from _array(value, title, cap)
        return
    whole = _dump(value)
    if isinstance(value, dict) and value and (any(isinstance(v, (dict, list)) for v in value.values()) or size(whole) > cap):
        for k, v in value.items():
            yield from _walk(v, (*path, k), cap)
    elif size(whole) <= cap:
        yield Chunk(title, whole, True)
    else:
        yield from packed([whole], title, cap)


def _array(items: list, prefix: str, cap: int) -> Iterator[Chunk]:
    first = items[0] if items else None
    field = next((f for f in IDENTITY if isinstance(first, dict) and isinstance(first.get(f), (str, int, float)) and not isinstance(first.get(f), bool)), None)
    start, batch, used = 0, [], 4

    def done(end: int) -> Iterator[Chunk]:
        if field is None:
            name = f"[{start}]" if end == start + 1 else f"[{start}-{end - 1}]"
        else:
            ids = [str(x.get(field)) if isinstance(x, dict) else "undefined" for x in items[start:end]]
            name = ", ".join(ids) if len(ids) <= 3 else f"{ids[0]}…{ids[-1]}"
        content = "[\n" + ",\n".join(batch) + "\n]"
        title = cut(f"{prefix} > {name}", TITLE_CAP)
        yield from [Chunk(title, content, True)] if size(content) <= cap else packed([content], title, cap, True)

    for i, item in enumerate(items):
        text = "\n".join("  " + line for line in _dump(item).split("\n"))
        n = size(text)
        if batch and used + 2 + n > cap:
            yield from done(i)
            start, batch, used = i, [], 4
        used += n + (2 if batch else 0)
        batch.append(text)
    if batch:
        yield from done(len(items))


def json_chunks(text: str, cap: int = CAP) -> Iterator[Chunk]:
    """Chunks along the structure of a JSON text, titled by key paths; text that is no JSON (or gives none) as plain text."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        yield from plain(text, cap)
        return
    got = False
    for c in _walk(value, (), cap):
        got = True
        yield c
    if not got:
        yield from plain(text, cap)


FORMATS = {"markdown": markdown, "plain": plain, "json": json_chunks}


def chunk_text(text: str, kind: str, cap: int = CAP) -> list[Chunk]:
    """All chunks of a source, or TooLarge beyond its bounds."""
    if size(text) > SOURCE_CAP:
        raise TooLarge("source")
    out = []
    for c in FORMATS.get(kind, plain)(text, cap):
        out.append(c)
        if len(out) > MOST_CHUNKS:
            raise TooLarge("chunks")
    return out


def _runner(cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for label, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [(label, i, c.title, c.content, "code" if c.has_code else "prose", None) for i, c in enumerate(chunk_text(text, kind, cap))]
                except TooLarge as e:
                    rows.append((label, -1, None, None, None, f"too large: {e}"))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["label", "chunk_no", "title", "content", "content_type", "error"])

    return run


def chunk_documents(docs: DataFrame, label: str = "label", text: str = "text", kind: str = "kind", cap: int = CAP) -> DataFrame:
    """label, chunk_no, title, content, content_type, error: the chunks of each document; kind: markdown, plain or json.

    A document beyond the bounds gives one row with an error and no chunk. Null label or text: left out; null kind: plain.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string"), F.col(text), F.coalesce(F.col(kind), F.lit("plain")))
    return spread(rows).mapInArrow(_runner(cap), "label string, chunk_no int, title string, content string, content_type string, error string")


def line_groups(docs: DataFrame, key: str, text: str, lines: int = GROUP, overlap: int = OVERLAP) -> DataFrame:
    """key, group_no, first_line, content: groups of lines with an overlap, as plain expressions (nothing runs in Python)."""
    split = F.split(F.col(text), "\n", -1)
    step = lines - overlap
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), split.alias("l"))
    rows = rows.select("key", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(step))).alias("at"))
    return rows.select("key", (F.col("at") / step).cast("int").alias("group_no"), (F.col("at") + 1).alias("first_line"), F.array_join(F.slice("l", F.col("at") + 1, lines), "\n").alias("content"))
