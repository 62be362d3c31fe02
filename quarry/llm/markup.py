"""Markup residue: leaves with tag paths, a recurrent labeller with document-wide context, and clean text."""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = str(Path(__file__).with_name("markup_model.npz"))
KINDS = ("html", "markdown", "wiki", "latex")
ROLES = ("text", "heading", "list", "code", "formula", "table", "quote", "drop")
#: Widths of the hashed tag path and the hashed words of a leaf, and its plain numbers.
TAGS, WORDS, NUMBERS = 384, 32, 8
#: A leaf has a kind of markup from this probability.
MARKED = 0.5
#: Ids of code sources are broadcast up to this many (16 bytes each, counted first); beyond, chunks join them over so many salts.
BROADCAST_SOURCES, SALTS = 1_000_000, 32

# File endings of code and configuration.
CODE_FILES = tuple(
    "py pyi sh bash zsh fish ps1 bat cmd js mjs cjs jsx ts tsx json jsonc json5 yaml yml toml ini cfg conf config properties env lock go rs rb php java kt kts scala c h cc cpp hpp cs swift m sql pl pm lua r jl dart ex exs erl hs clj vue svelte css scss less xml gradle tf tfvars hcl proto graphql dockerfile makefile mk cmake nix vim el diff patch csv tsv ipynb".split()
)
# Names of HTML elements.
_ELEMENTS = frozenset(
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option p param picture pre progress q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})([^\n`]*)$", re.M)
_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)([^\n]+?)(?<!`)\1(?!`)")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?)/?>")
_MATH_INSIDE = re.compile(r"[\\^_=+{}<>/]|^[A-Za-z]$")


def blanked(text: str) -> tuple[str, list[tuple[int, int]], list[int], list[int]]:
    """(text with code blanked out, bounds of fenced bodies, starts of fence lines, starts of code spans); offsets stay."""
    bodies, fences, at = [], [], 0
    out = text
    if "```" in text or "~~~" in text:
        marks = list(_FENCE.finditer(text))
        closing = {c: [n for n, m in enumerate(marks) if m[1][0] == c and not m[2].strip()] for c in "`~"}
        i = 0
        while i < len(marks):
            m = marks[i]
            fences.append(m.start())
            own = closing[m[1][0]]
            k = bisect_right(own, i)
            while k < len(own) and len(marks[own[k]][1]) < len(m[1]):
                k += 1
            close = own[k] if k < len(own) else None
            end = marks[close].start() if close is not None else len(text)
            bodies.append((min(m.end() + 1, end), end))
            if close is None:
                break
            fences.append(marks[close].start())
            i = close + 1
        parts, at = [], 0
        for (a, b), fence in zip(bodies, fences[::2]):
            parts += [text[at:fence], re.sub(r"[^\n]", " ", text[fence:b])]
            at = b
            if (line := text.find("\n", b)) >= 0 or b < len(text):
                stop = line if line >= 0 else len(text)
                parts.append(" " * (stop - at))
                at = stop
        out = "".join([*parts, text[at:]])
    spans = []
    if "`" in out:

        def hide(m: re.Match) -> str:
            spans.append(m.start())
            return " " * len(m[0])

        out = _SPAN.sub(hide, out)
    return out, bodies, fences, spans


#: Opening and closing signs of formulas; "\\[2pt]" is a line break. The second kind stays in its line.
_DISPLAY = re.compile(r"(?P<open>(?:(?<!\\)|(?!\\\[\d))\\\[)|(?P<close>\\\])")
_PAREN = re.compile(r"(?P<open>\\\()|(?P<close>\\\))|\n")
_DOLLARS = re.compile(r"(?P<open>(?<![\\$])\$+(?=[^\s$]))|(?P<close>(?<=[^\s\\$])\$+(?!\w))|\n\n")
_BRACES = re.compile(r"\{+|\}+")


def between(signs: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Bounds from each opening sign to the next closing one, whatever stands between; any other sign drops the opening one."""
    start = None
    for m in signs.finditer(text):
        if m.lastgroup == "open" and start is None:
            start = m.start()
        elif m.lastgroup != "open":
            if m.lastgroup == "close" and start is not None and m.start() > start + 2:
                yield start, m.end()
            start = None


def comments(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of HTML comments of any length; one that is never closed ends with its line."""
    at, last = 0, text.rfind("-->")
    while (start := text.find("<!--", at)) >= 0:
        end = text.find("-->", start + 4) + 3 if last >= start + 4 else text.find("\n", start)
        at = end if end > 0 else len(text)
        yield start, at


def templates(text: str) -> list[tuple[int, int]]:
    """Bounds of the outermost {{...}} of any length; others may stand inside, lone braces may not."""
    out: list[tuple[int, int]] = []
    stack: list[int] = []
    for m in _BRACES.finditer(text):
        a, b = m.span()
        if m[0][0] == "{":
            if (b - a) % 2:
                stack.clear()
            stack += range(a + (b - a) % 2, b, 2)
        else:
            for end in range(a + 2, b + 1, 2):
                if stack:
                    start = stack.pop()
                    if end - start > 4:
                        while out and out[-1][0] > start:
                            out.pop()
                        out.append((start, end))
            if (b - a) % 2:
                stack.clear()
    return out


#: What the lexer sees: opening and closing elements, entities, commands, and runs of signs. It names no kind of markup.
_LEX = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*|<!(?:--)?|-->|&(?:[A-Za-z][A-Za-z0-9]*|#\w+);|\\(?:[A-Za-z]+\*?|[^A-Za-z\s])|\*\**|__*|''+|~~*|==*|\[\[*|\]\]*|\{\{*|\}\}*|\|\|*|##*|\$\$*|``*|\^|<|>|--+")
_LEAD = re.compile(r"[ \t]*([-+*:;!>#=|]+|\d{1,3}[.)])([ \t]|$)?")
_ATTRIBUTE = re.compile(r"\s+[A-Za-z-]+\s*=")
_MATH = re.compile(r"[\\^_=+{}<>/]|^[A-Za-z]$")
_INSIDE_WORDS = frozenset("_=#~^*|'")
_VOID = frozenset("br img hr input meta link p li td tr th dt dd option wbr".split())
_PAIRED = frozenset(("*", "**", "***", "_", "__", "___", "''", "'''", "'''''", "~~", "$", "$$", "[", "[[", "{{", "{{{", "`", "``"))
_CLOSERS = {"]": "[", "]]": "[[", "}}": "{{", "}}}": "{{{"}
_CLASSES: dict[str, str] = {"": "^", "\n": "^"}
_SLOTS: dict[object, tuple[int, ...]] = {}
_WORD_SLOTS: dict[str, int] = {}


def _class(c: str) -> str:
    known = _CLASSES.get(c)
    if known is None:
        known = _CLASSES[c] = "a" if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else c if c < "\x7f" else "?"
    return known


def _slots(key: object, *names: str) -> tuple[int, ...]:
    if len(_SLOTS) > 200_000:
        _SLOTS.clear()
    out = _SLOTS[key] = tuple(zlib.crc32(n.encode()) % TAGS for n in names)
    return out


def _word_slot(token: str) -> int:
    if len(_WORD_SLOTS) > 200_000:
        _WORD_SLOTS.clear()
    out = _WORD_SLOTS[token] = zlib.crc32("".join(filter(str.isalpha, token.lower())).encode()) % WORDS
    return out


class Leaves:
    """The leaves (non-blank lines) of a text: bounds, and the inputs of the labeller, kept sparse.

    A leaf's input is its tag path (constructs open where it starts: elements, environments, templates, tables, comments, formulas),
    its signs as the lexer sees them (each run with what stands on both sides, and which runs pair up in the leaf), its hashed words
    and a few numbers. Nothing in it says which kind of markup a sign belongs to; that is for the labeller to learn.
    """

    def __init__(self, text: str):
        self.text = text
        self.plain, self.bodies, fences, spans = blanked(text)
        self.bounds: list[tuple[int, int]] = []
        self.slots: list[list[int]] = []
        self.words: list[list[int]] = []
        self.fence: list[bool] = []
        self.code: list[bool] = []
        numbers: list[tuple[float, ...]] = []
        plain, path, marks, blank = self.plain, [], set(fences), True
        body, nth, at = iter([*self.bodies, (len(text) + 1, 0)]), 0, 0
        first, last = next(body)
        for line in text.split("\n"):
            a, b = at, at + len(line)
            at = b + 1
            if not line or line.isspace():
                blank = True
                continue
            while a >= last and first <= len(text):
                first, last = next(body)
            fence, code = a in marks, first <= a < last
            own: list[int] = []
            signs = 0
            if fence:
                own += _SLOTS.get("fence") or _slots("fence", "fence", "fence2")
            elif not code:
                for depth, name in enumerate(path[:-5:-1]):
                    own += _SLOTS.get(key := ("path", depth, name)) or _slots(key, f"path{depth}:{name}", f"path:{name}")
                signs = self._lex(plain, a, b, path, own)
                while nth < len(spans) and spans[nth] < b:
                    own += _SLOTS.get("span") or _slots("span", "span", "span2")
                    nth += 1
            tokens = line.split()
            self.bounds.append((a, b))
            self.slots.append(own)
            self.words.append([] if code else [_WORD_SLOTS[w] if w in _WORD_SLOTS else _word_slot(w) for w in tokens])
            self.fence.append(fence)
            self.code.append(code)
            size = b - a
            numbers.append((code, min(size, 300) / 300, min(size - len(line.lstrip()), 12) / 12, min(len(tokens), 60) / 20, blank, fence, min(1.0, 4 * signs / size), not numbers))
            blank = False
        self.numbers = np.array(numbers, np.float32).reshape(-1, NUMBERS)

    @staticmethod
    def _lex(plain: str, a: int, b: int, path: list[str], own: list[int]) -> int:
        lead = _LEAD.match(plain, a, b)
        if lead:
            sign = lead[1] if not lead[1][0].isdigit() else "1" + lead[1][-1]
            own += _SLOTS.get(key := ("lead", sign[:4], lead[2] is None)) or _slots(key, f"lead{sign[:4]}{lead[2] is None}", f"lead{sign[0]}{lead[2] is None}")
        opened: dict[str, tuple[int, str]] = {}
        n = 0
        for m in _LEX.finditer(plain, a, b):
            g, (i, j) = m[0], m.span()
            left, right = _class(plain[i - 1 : i] if i > a else ""), _class(plain[j : j + 1] if j < b else "")
            c = g[0]
            if c in _INSIDE_WORDS and left in "a0" and right in "a0" and (c != "*" or len(g) == 1) and c != "|" and len(g) < 3:
                continue
            n += 1
            if c == "<" and len(g) > 1 and g[1] != "!":
                name = g.lstrip("</").lower()
                known = name in _ELEMENTS
                end = g[1] == "/"
                if left == "a":  # the word before it begins with a capital: a type and its parameter
                    k = i
                    while k > a and (plain[k - 1].isalnum() or plain[k - 1] == "_"):
                        k -= 1
                    left = "A" if plain[k].isupper() else "a"
                if right == " " and _ATTRIBUTE.match(plain, j):
                    right = "="
                if right in " ^/=" and plain.find(">", j, b) < 0:
                    right += "open"
                own += _SLOTS.get(key := (g, left, right)) or _slots(key, f"<{end}{known}{left}{right}", f"<{end}{name if known else '?'}", f"<{known}{right}")
                if known and name not in _VOID:
                    if not end:
                        path.append(name)
                    elif name in path:
                        del path[len(path) - 1 - path[::-1].index(name) :]
                continue
            if c == "&":
                known = g[1] == "#" or g[1:] in html.entities.html5
                own += _SLOTS.get(key := (g, known)) or _slots(key, f"&{known}", f"&{known}{g[1] == '#'}")
                continue
            if c == "\\":
                word = len(g) > 1 and g[1].isalpha()
                if g in ("\\begin", "\\end") and right == "{":
                    name = plain[j + 1 : max(j + 1, plain.find("}", j, b))]
                    if g == "\\begin":
                        path.append("\\" + name)
                    elif "\\" + name in path:
                        del path[len(path) - 1 - path[::-1].index("\\" + name) :]
                elif g == "\\[":
                    path.append(g)
                elif g == "\\]" and "\\[" in path:
                    del path[path.index("\\[") :]
                own += _SLOTS.get(key := (g, left, right)) or (_slots(key, f"\\word{left}{right}", f"\\word{right}", g) if word else _slots(key, f"{g}{left}{right}", g))
                continue
            g = g[:5]
            own += _SLOTS.get(key := (g, left, right)) or _slots(key, f"{g}{left}{right}", f"{g}{left}", f"{g}>{right}")
            if g in _CLOSERS and (o := _CLOSERS[g]) in opened or g in opened and (left not in " ^" or g == "$$"):
                at, before = opened.pop(_CLOSERS.get(g, g))
                if c == "$":
                    inside = ("m" if _MATH.search(plain, at, i) or i - at == 1 and plain[at].isalpha() else "t") + _class(plain[at : at + 1]) + left
                elif c == "]":
                    inside = "|" if "|" in plain[at:i] else ""
                else:
                    inside = "s" if " " in plain[at:i] else "w"
                own += _SLOTS.get(key := ("pair", g, before, right, inside)) or _slots(key, f"pair{g}{before in 'a0'}{right in 'a0'}{inside}", f"pair{g}{inside[:1]}")
            elif g in _PAIRED and (right not in " ^" or c in "[{" or g == "$$"):
                opened[g] = j, left
            if g == "{{" or g == "<!--" or g == "{" and right == "|" and left == "^":
                path.append(g)
            elif g == "}}" and "{{" in path or g == "-->" and "<!--" in path or g == "}" and left == "|" and "{" in path:
                start = {"}}": "{{", "-->": "<!--", "}": "{"}[g]
                del path[len(path) - 1 - path[::-1].index(start) :]
            elif g == "$$":
                if "$$" in path:
                    del path[path.index("$$") :]
                else:
                    path.append(g)
        return n

    def inputs(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The inputs of leaves first..last, a row each."""
        return rows_of(self.slots[first:last], self.words[first:last], self.numbers[first:last])


def rows_of(slots: list[list[int]], words: list[list[int]], numbers: np.ndarray) -> np.ndarray:
    x = np.zeros((len(slots), TAGS + WORDS + NUMBERS), np.float32)
    row = np.arange(len(slots))
    x[np.repeat(row, [*map(len, slots)]), np.fromiter(chain.from_iterable(slots), np.int64)] = 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    cells = np.repeat(row, sizes) * WORDS + np.fromiter(chain.from_iterable(words), np.int64)
    counts = np.bincount(cells, minlength=len(slots) * WORDS).reshape(-1, WORDS)
    x[:, TAGS : TAGS + WORDS] = counts * (0.5 / np.sqrt(np.maximum(sizes, 1)))[:, None]
    x[:, TAGS + WORDS :] = numbers
    return x


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class BiLSTM:
    """A bidirectional LSTM on numpy over embedded leaves. Per step and direction: gates = [e, h] W + b in the order input, forget, output, cell."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.hidden = weights["bf"].shape[0] // 4

    @classmethod
    def fresh(cls, width: int, embed: int, hidden: int, outputs: int, seed: int = 7) -> BiLSTM:
        rng = np.random.default_rng(seed)
        w = {"We": (rng.standard_normal((width, embed)) * 0.15).astype(np.float32), "be": np.full(embed, 0.05, np.float32)}
        for d in "fb":
            w[f"W{d}"] = (rng.standard_normal((embed + hidden, 4 * hidden)) / np.sqrt(embed + hidden)).astype(np.float32)
            w[f"b{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        w["Wo"] = (rng.standard_normal((2 * hidden + embed, outputs)) / np.sqrt(2 * hidden + embed)).astype(np.float32)
        w["bo"] = np.zeros(outputs, np.float32)
        return cls(w)

    def embed(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w["We"] + self.w["be"], 0)

    def run(self, x: np.ndarray, mask: np.ndarray, direction: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """Hidden states (batch, steps, hidden); padded steps leave the state as it is. state: [h, c] to begin with, replaced by the last ones."""
        batch, steps, _ = x.shape
        hidden, W, b = self.hidden, self.w[f"W{direction}"], self.w[f"b{direction}"]
        width = x.shape[2]
        pre = x @ W[:width] + b
        h, c = state or (np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32))
        out = np.zeros((batch, steps, hidden), np.float32)
        for t in range(steps) if direction == "f" else range(steps - 1, -1, -1):
            g = pre[:, t] + h @ W[width:]
            s = _sigmoid(g[:, : 3 * hidden])
            i, f, o, z = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :], np.tanh(g[:, 3 * hidden :])
            m = mask[:, t : t + 1]
            c2 = f * c + i * z
            tc = np.tanh(c2)
            h2 = o * tc
            if keep is not None:
                keep.append((t, h, c, i, f, o, z, tc, m))
            c, h = m * c2 + (1 - m) * c, m * h2 + (1 - m) * h
            out[:, t] = h
        if state is not None:
            state[:] = h, c
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.read(self.embed(x), mask)

    def read(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Outputs of embedded leaves (batch, steps, embed)."""
        return np.concatenate([self.run(e, mask, "f"), self.run(e, mask, "b"), e], axis=2) @ self.w["Wo"] + self.w["bo"]


class Labeller:
    """Labels every leaf of texts: probabilities of the four kinds and the role of the block."""

    def __init__(self, path: str = MODEL):
        with np.load(path) as f:
            self.net = BiLSTM({k: f[k] for k in f.files})

    def label(self, leaves: list[Leaves], batch_leaves: int = 8_000) -> list[tuple[np.ndarray, np.ndarray]]:
        """Texts of like length run together; a text is never cut, so its context is the whole document."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, 4)), np.zeros(0, int))] * len(leaves)
        order = sorted((i for i, v in enumerate(leaves) if v.bounds), key=lambda i: len(leaves[i].bounds))
        at = 0
        while at < len(order):
            if len(leaves[order[at]].bounds) > batch_leaves:
                y = self.long_logits(leaves[order[at]], batch_leaves)
                out[order[at]] = _sigmoid(y[:, : len(KINDS)]), y[:, len(KINDS) :].argmax(1)
                at += 1
                continue
            end = at + 1
            while end < len(order) and len(leaves[order[end]].bounds) * (end - at + 1) <= batch_leaves:
                end += 1
            part = order[at:end]
            sizes = np.array([len(leaves[i].bounds) for i in part])
            ends = sizes.cumsum()
            flat = rows_of([v for i in part for v in leaves[i].slots], [v for i in part for v in leaves[i].words], np.concatenate([leaves[i].numbers for i in part]))
            mask = (np.arange(sizes[-1]) < sizes[:, None]).astype(np.float32)
            e = np.zeros((len(part), sizes[-1], self.net.w["be"].shape[0]), np.float32)
            e[mask > 0] = self.net.embed(flat)
            y = self.net.read(e, mask)[mask > 0]
            p, roles = _sigmoid(y[:, : len(KINDS)]), y[:, len(KINDS) :].argmax(1)
            for i, n, stop in zip(part, sizes, ends):
                out[i] = p[stop - n : stop], roles[stop - n : stop]
            at = end
        return out

    def long_logits(self, leaves: Leaves, step: int) -> np.ndarray:
        """The logits of one very long text: the same states, computed `step` leaves at a time so that memory stays bounded."""
        n = len(leaves.bounds)
        parts = [(a, min(a + step, n)) for a in range(0, n, step)]
        back = np.zeros((n, self.net.hidden), np.float32)
        zero = np.zeros((1, self.net.hidden), np.float32)
        state = [zero, zero]
        for a, b in reversed(parts):
            back[a:b] = self.net.run(self.net.embed(leaves.inputs(a, b))[None], np.ones((1, b - a), np.float32), "b", state=state)[0]
        state, out = [zero, zero], []
        for a, b in parts:
            e = self.net.embed(leaves.inputs(a, b))
            ahead = self.net.run(e[None], np.ones((1, b - a), np.float32), "f", state=state)[0]
            out.append(np.concatenate([ahead, back[a:b], e], axis=1) @ self.net.w["Wo"] + self.net.w["bo"])
        return np.concatenate(out)


def kinds_of(probability: np.ndarray) -> list[str]:
    """Kinds that the labeller gives to some leaf."""
    return [k for k, p in zip(KINDS, probability.max(0)) if p >= MARKED] if len(probability) else []


# --- clean text -----------------------------------------------------------------------------------------------------
_INLINE = [
    (re.compile(r"<(?:script|style)\b[^>]*>[\s\S]*?</(?:script|style)\s*>", re.I), ""),
    (re.compile(r"<!--[\s\S]*?-->"), ""),
    (re.compile(r"!\[([^\]\n]*)\]\([^()\s]+[^)\n]*\)"), r"\1"),
    (re.compile(r"\[([^\]\[\n]+)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"(?<![\w\])])\[([^\]\[\n]*[^\W\d][^\]\[\n]*)\]\[[^\]\[\n]*\]"), r"\1"),
    (re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei):[^\[\]\n]*\]\]"), ""),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]"), r"\1"),
    (re.compile(r"\{\{[^{}]++\}\}"), ""),
    (re.compile(r"'{2,5}(?=[^\s'])((?:[^'\n]|'(?!'))*[^\s'])'{2,5}"), r"\1"),
    (re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])((?:[^*\n]|\*(?!\*))*[^\s*])\*\*(?!\*)"), r"\1"),
    (re.compile(r"(?<!\w)__(?=[^\s_])([^\n_]*[^\w\n][^\n_]*?[^\s_])__(?!\w)"), r"\1"),
    (re.compile(r"(?<![\w*\\.)\]/])\*(?=[^\s*.])([^*\n]*?[^\s*])\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![~\w])~~(?=[^\s~])((?:[^~\n]|~(?!~))*[^\s~])~~(?!~)"), r"\1"),
    (re.compile(r"~?\\(?:cite|label|ref|eqref|pageref|index|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:textbf|textit|emph|texttt|underline|url|href|text|mbox|footnote)\*?\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\{\\(?:bf|it|tt|em|sc|rm|sf)\s+([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\\\\[ \t]*$", re.M), ""),
    (re.compile(r"</?(?:ref|nowiki)\b[^<>\n]*>"), ""),
]


def _strip(line: str) -> str:
    kept: list[str] = []

    def keep(m: re.Match) -> str:  # formulas and code spans stay as they are
        kept.append(m[0])
        return f"\ue000{len(kept) - 1}\ue001"

    line = _SPAN.sub(keep, line)
    line = re.sub(r"\$\$[^$]+\$\$|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\$])\$(?![\w$])|\\\[.*?\\\]|\\\(.*?\\\)", lambda m: keep(m) if _MATH_INSIDE.search(m[0].strip("$")) else m[0], line)
    for pattern, by in _INLINE:
        line = pattern.sub(by, line)
    line = _TAG.sub(lambda m: " " if m[2].lower() in ("br", "td", "th", "li") else "" if m[2].lower() in _ELEMENTS else m[0], line)
    line = html.unescape(line) if "&" in line else line
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], line)


#: Elements that begin or end a block of their own; code and what is no text are taken with their bodies.
_BLOCK = re.compile(r"<(?P<end>/?)(?:address|article|aside|blockquote|body|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|tbody|tfoot|thead|title|tr|ul)(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/?>", re.I)
_BODY = re.compile(r"<(?P<end>/?)(?P<name>pre|script|style|h[1-6])(?![\w-])[^<>]*>|\\(?P<tex>begin|end)\{(?P<env>verbatim\*?|lstlisting|minted)\}(?:[ \t]*\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", re.I)


def _without_elements(text: str) -> str:
    return _TAG.sub(lambda m: "" if m[2].lower() in _ELEMENTS else m[0], text)


def _bodies(plain: str) -> Iterator[tuple[str, re.Match, re.Match]]:
    """(name, opening, closing) of elements and environments with a body, none inside another."""
    opening: re.Match | None = None
    for m in _BODY.finditer(plain):
        name = (m["name"] or m["env"]).lower()
        if opening is None:
            opening = None if m["end"] or (m["tex"] or "").lower() == "end" else m
        elif (m["end"] or (m["tex"] or "").lower() == "end") and name == (own := (opening["name"] or opening["env"]).lower()):
            yield own, opening, m
            opening = None
        elif (opening["name"] or "").lower().startswith("h") and not m["end"]:  # a heading that was never closed
            opening = m


def by_lines(leaves: Leaves) -> tuple[str, list[int], list[int]]:
    """(text in which every construct has its own lines, starts of its parts, their starts in the text of the leaves).

    Comments, templates, scripts and styles over several lines are left out, code of several lines stands between fences as it is,
    a heading in one line, and lines are cut at block elements.
    """
    text, plain = leaves.text, blanked(leaves.text)[0]
    cuts: list[tuple[int, int, str]] = []  # start, end, what comes instead

    def before(at: int) -> int:  # the end of what precedes in the line
        while at and text[at - 1] in " \t":
            at -= 1
        return at

    def after(at: int) -> int:
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        return at

    math = sorted((a, b) for signs in (_DISPLAY, _PAREN, _DOLLARS) for a, b in between(signs, plain)) if "{{" in plain else []
    cuts += [(a, b, "") for a, b in (comments(plain) if "<!--" in plain else ()) if "\n" in text[a:b]]
    for a, b in templates(plain) if "{{" in plain else ():
        if "\n" in text[a:b] or "{{" in text[a + 2 : b]:
            i = bisect_right(math, (b, 0)) - 1
            if i < 0 or math[i][1] <= a:
                cuts.append((a, b, ""))
    if "<" in plain or "\\begin{" in plain:
        for name, first, last in _bodies(plain):
            body = text[first.end() : last.start()]
            if name in ("script", "style"):
                cuts.append((first.start(), last.end(), ""))
            elif name.startswith("h"):
                cuts += [(m.start(), m.end(), " ") for m in re.compile(r"\s*\n\s*").finditer(plain, first.end(), last.start())]
            else:
                body = html.unescape(_without_elements(body)) if name == "pre" else body
                body = re.sub(r"\A(?:[ \t]*\n)+|\s+\Z", "", body)
                fence = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
                a, b = before(first.start()), after(last.end())
                cuts.append((a, b, ("\n" if text[a - 1 : a] not in ("", "\n") else "") + (f"{fence}\n{body}\n{fence}" if body else "") + ("\n" if text[b : b + 1] not in ("", "\n") else "")))
        for m in _BLOCK.finditer(plain):  # not in strings of code, where a quote stands beside the element
            if m["end"] or m[0].lower().startswith("<hr"):
                if text[(b := after(m.end())) : b + 1] not in ("", "\n", '"', "'", "`"):
                    cuts.append((m.end(), m.end(), "\n"))
            elif text[(a := before(m.start())) - 1 : a] not in ("", "\n", '"', "'", "`"):
                cuts.append((m.start(), m.start(), "\n"))
    parts, new, old, at, size, tail = [], [0], [0], 0, 0, "\n"
    for a, b, by in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a >= at:
            tail = text[at:a][-1:] or tail
            by = by[1:] if by[:1] == tail == "\n" else by
            tail = by[-1:] or tail
            parts += [text[at:a], by]
            size += a - at + len(by)
            at = b
            new.append(size)
            old.append(at)
    return "".join([*parts, text[at:]]), new, old


_SECTION = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{([^{}]*)\}")
_HEADING = re.compile(r"^\s*#{1,6}\s+|\s+#+\s*$|^\s*=+\s*|\s*=+\s*$")
_ITEM = re.compile(r"^\s*(?:[-+*]+\s+(?:\[[ xX]\]\s+)?|\d{1,3}[.)]\s+|\\item\s*(?:\[[^\]\n]*\]\s*)?|<li[^>]*>)", re.I)


def clean(leaves: Leaves, probability: np.ndarray, roles: np.ndarray) -> str:
    """The text without markup, by the labels of its leaves: headings start with '# ', list items with '- ', code stands between ``` lines.

    A leaf without a kind of markup stays as it is; one with a kind loses its inline marks and is written in its role; formulas keep $ or environments.
    """
    own = probability >= MARKED
    text, new, old = by_lines(leaves) if own.any() else (leaves.text, [0], [0])
    if text != leaves.text:  # a line keeps its labels unless it was cut: then its parts are labelled as texts of their own kind
        starts, lines = [a for a, _ in leaves.bounds], Leaves(text)
        from_ = [max(0, bisect_right(starts, old[i] + a - new[i]) - 1) for a, _ in lines.bounds for i in (bisect_right(new, a) - 1,)]
        counts = Counter(from_)
        again = _labeller(MODEL).label([lines])[0]
        roles = np.array([roles[i] if counts[i] == 1 else again[1][k] for k, i in enumerate(from_)], int)
        own = np.array([own[i] for i in from_], bool).reshape(-1, len(KINDS))
        leaves = lines
    out: list[str] = []
    in_code, last = False, 0
    for (a, b), role, marked, fence in zip(leaves.bounds, roles, own, leaves.fence):
        line, name = leaves.text[a:b], ROLES[role]
        gap = leaves.text[last:a].count("\n")
        if in_code:
            out += [""] * (gap - 1)
        elif gap > 1 and out and out[-1] != "":
            out.append("")
        last = b
        if fence:
            out.append("```" + ("" if in_code else line.strip().strip("`~")))
            in_code = not in_code
        elif in_code:
            out.append(line)
        elif not marked.any() and name not in ("heading", "list"):
            out.append(line.rstrip())
        elif name == "drop":  # elements hide only themselves; what else is dropped is no text
            if marked[0] and not marked[1:].any() and (body := _strip(line).strip()):
                out.append(body)
        elif name == "heading":
            if body := _strip(_HEADING.sub("", _SECTION.sub(r"\1", line))).strip():
                out.append("# " + body)
        elif name == "code":
            out += ["```", html.unescape(_without_elements(line)).strip(), "```"]
        elif name == "list":
            out.append("- " + _strip(_ITEM.sub("", line)).strip())
        elif name == "formula":
            out.append(line.strip())
        else:
            body = re.sub(r"^ {0,3}>\s?|^:+\s*|^;\s*", "", line)
            if name == "table":
                body = " | ".join(c.strip() for c in re.split(r"\|\|?|!!", _strip(body).strip().strip("|!")) if c.strip())
            body = _strip(body).strip()
            if body:
                out.append(body)
    if in_code:
        out.append("```")
    return "\n".join(out).strip("\n")


@lru_cache(maxsize=2)
def _labeller(path: str) -> Labeller:
    return Labeller(path)


def _run(model: str, fields: tuple[str, ...], found: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(model)
        for batch in batches:
            keys, is_code, *texts = (c.to_pylist() for c in batch.columns)
            cleaned, out = [], ([], [], [])
            for field, column in zip(fields, texts):
                leaves = [Leaves("" if code or t is None else t) for code, t in zip(is_code, column)]
                labels = labeller.label(leaves)
                if found:
                    for key, (p, _) in zip(keys, labels):
                        for kind in kinds_of(p):
                            for o, v in zip(out, (key, field, kind)):
                                o.append(v)
                else:
                    cleaned.append([t if code or t is None else clean(own, p, roles) for t, code, own, (p, roles) in zip(column, is_code, leaves, labels)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["chunk_id", "field", "kind"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(c, pa.string()) for c in cleaned]], ["chunk_id", *fields])

    return rows


def _texts(chunks: DataFrame, sources: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    ending = F.lower(F.regexp_extract(F.col("file_path"), r"([^./\\]+)$", 1))
    code = sources.where(ending.isin(*CODE_FILES)).select(F.col("id").alias("__source")).distinct()
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long"), F.col("source_id").alias("__source"), *fields).repartition(parts, "chunk_id").distinct()
    code = code.withColumn("__code", F.lit(True))
    if code.count() <= BROADCAST_SOURCES:
        joined = own.join(F.broadcast(code), "__source", "left")
    else:  # a source may hold a third of the chunks: spread each over salts
        spread = code.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("__salt", F.pmod(F.hash("chunk_id"), F.lit(SALTS))).join(spread, ["__source", "__salt"], "left")
    return joined.select("chunk_id", F.coalesce("__code", F.lit(False)).alias("is_code"), *fields)


def find_markup(chunks: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("content", "title"), model: str = MODEL) -> DataFrame:
    """(chunk_id, field, kind) for each kind of markup (html, markdown, wiki, latex) that occurs in a field, outside code.

    The labeller gives every leaf its kinds from its tag path, signs, words and the document around it; a field has the kinds of its leaves.
    Defined results: null chunk_id: left out; null or empty text: nothing; chunks of a source whose file is code or
    configuration: nothing; unknown or null source: treated as text; a chunk stored twice: once. Whole texts are read.
    """
    return _texts(chunks, sources, fields).mapInArrow(_run(model, fields, True), "chunk_id long, field string, kind string").distinct()


def clean_markup(chunks: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("content", "title"), model: str = MODEL) -> DataFrame:
    """(chunk_id, *fields): clean text with headings, lists, code and formulas kept recognisable; code files and nulls pass unchanged."""
    return _texts(chunks, sources, fields).mapInArrow(_run(model, fields, False), f"chunk_id long, {', '.join(f'{f} string' for f in fields)}")
