"""Trains the labeller of quarry.llm.markup and writes markup_model.npz.

python -m quarry.llm.train_markup [--texts N] [--chunks chunks.parquet --rows N]. Most texts come from a grammar that writes prose with and
without markup of each language, code in fences, and plain lines full of signs that are no markup, so kind and role of every leaf
are known. A bounded sample of stored chunks may be added; its leaves get kinds from the labelling patterns below, which only
this module uses, and no roles. A tenth of both is held out and reported.
"""

from __future__ import annotations

import argparse
import html
import random
import re
from bisect import bisect_right

import numpy as np

from quarry.llm.markup import _DISPLAY, _ELEMENTS, _MATH_INSIDE, _PAREN, KINDS, MODEL, NUMBERS, ROLES, TAGS, WORDS, BiLSTM, Leaves, _sigmoid, between, blanked, comments, templates

#: Texts of the grammar and stored chunks that training reads.
TEXTS, ROWS = 20_000, 4_000
Line = tuple[str, set[str], str]

# --- labelling patterns: kinds of the leaves of stored chunks, for training only --------------------------------------
# LaTeX commands that stand without braces.
_COMMANDS = "item|alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|theta|omega|phi|sum|int|prod|frac|sqrt|leq|geq|neq|times|cdot|ldots|dots|infty|partial|nabla|rightarrow|leftarrow|Rightarrow|in|notin|subset|cup|cap|noindent|newpage|clearpage|maketitle|tableofcontents|par|hline|centering|bigskip|medskip|smallskip|hfill|vfill|quad|qquad|LaTeX|TeX|bf|it|tt|em|sc|rm|sf|large|Large|small|tiny|linebreak|newline|appendix|toprule|midrule|bottomrule|left|right"


_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?)/?>")
_ENTITY = re.compile(r"&(?:([A-Za-z][A-Za-z0-9]{1,31})|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_PATTERNS: list[tuple[str, str, re.Pattern]] = [
    (kind, tag, re.compile(pattern, re.M))
    for kind, tag, pattern in (
        ("html", "comment", r"<!DOCTYPE[^>]*>"),
        ("html", "cut", r"^\s*[a-z-]+=(?:\"[^\"\n]*\"|'[^'\n]*')(?:\s+[a-z-]+=(?:\"[^\"\n]*\"|'[^'\n]*'))*\s*/?>|<(?:img|a|div|span|table|p|td|input|link|meta)\s+[a-z-]+=(?:\"[^\"\n]*\"|'[^'\n]*')[^<>\n]*$"),
        ("markdown", "heading", r"^ {0,3}#{1,6}[ \t]+\S"),
        ("markdown", "setext", r"(?<=\n)(?:={3,}|-{3,})[ \t]*$"),
        ("markdown", "rule", r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$"),
        ("markdown", "link", r"!?\[[^\]\[\n]*\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)"),
        ("markdown", "reference", r"(?<![\w\])])\[[^\]\[\n]*[^\W\d][^\]\[\n]*\]\[[^\]\[\n]*\]|^ {0,3}\[[^\]\[\n]+\]:[ \t]+\S+"),
        ("markdown", "autolink", r"<(?:https?|mailto):[^\s<>]+>"),
        ("markdown", "strong", r"(?<![\w*\\])\*\*(?=[^\s*])(?:[^*\n]|\*(?!\*))*[^\s*\\]\*\*(?!\*)|(?<![\w_\\])__(?=[^\s_])[^\n_]*[^\w\n][^\n_]*?[^\s_\\]__(?!\w)"),
        ("markdown", "em", r"(?<![\w*\\.)\]/])\*(?=[^\s*.])[^*\n]*?[^\s*\\]\*(?![\w*])|(?<![\w_\\*./])_(?=[^\s_])[^_\n]*?[^\s_\\]_(?![\w_*])"),
        ("markdown", "strike", r"(?<![~\w])~~(?=[^\s~])(?:[^~\n]|~(?!~))*[^\s~]~~(?!~)"),
        ("markdown", "task", r"^\s*[-*+][ \t]+\[[ xX]\][ \t]"),
        ("markdown", "bullet", r"^[ \t]*[-+][ \t]+\S"),
        ("markdown", "number", r"^[ \t]*\d{1,3}[.)][ \t]+\S"),
        ("markdown", "quote", r"^ {0,3}>[ \t]?\S"),
        ("markdown", "table", r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{1,}:?[ \t]*)+\|?[ \t]*$|^\|[^|\n]+(?:\|[^|\n]+)+\|[ \t]*$"),
        ("wiki", "heading", r"^(={2,6})[ \t]*[^=\n][^\n]*?[ \t]*\1[ \t]*$"),
        ("wiki", "link", r"\[\[[^\[\]\n]+\]\]"),
        ("wiki", "external", r"(?<!\[)\[(?:https?|ftp)://[^\s\]]+[ \t]+[^\]\n]+\](?!\()"),
        ("wiki", "quotes", r"(?<!')'{2,3}(?=[^\s'])(?:[^'\n]|'(?!'))*[^\s']'{2,3}(?!')"),
        ("wiki", "table", r"^\{\|[^\n]*$|^\|-[-]*[ \t]*[^\n|]*$|^\|\}[ \t]*$|^[|!][^|\n]*(?:\|\||!!)[^\n]*$|^\|\+[^\n]+$"),
        ("wiki", "indent", r"^:{1,5}[ \t]*(?=\S)(?![:=])[^\n]*\S"),
        ("wiki", "definition", r"^;[ \t]*[^\n:]+:[ \t]*\S|^;[ \t]*[A-Z][^\n=]{0,60}$"),
        ("wiki", "magic", r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|FORCETOC)__|^#REDIRECT\b|</?(?:ref|nowiki|gallery|references)\b[^<>\n]*>"),
        ("latex", "command", r"\\[A-Za-z]+\*?[ \t]*(?:\[[^\]\n]*\][ \t]*)?\{[^{}\n]*"),
        ("latex", "symbol", rf"(?<![\w\\:.])\\(?:{_COMMANDS})(?![A-Za-z\\])"),
        ("latex", "break", r"\\\\[ \t]*$|\\\\\[\d"),
        ("latex", "display", r"\$\$[^$]++\$\$"),
        ("latex", "inline", r"(?<![\\$\w])\$(?=[^\s$\d]|\d[^\s$]*[\\^_=+{}])[^$\n]*?(?<=[^\s\\$])\$(?![\w$])"),
        ("latex", "escape", r"(?<!\\)\\[%&#_](?!\w*\\)|(?<=\w)~\\(?=[a-z])"),
        ("latex", "group", r"\{\\(?:bf|it|tt|em|sc|rm|sf|small|large|Large|tiny)\b"),
    )
]
#: Signs that plain text has too; they are part of the tag path so that the labeller sees them, never evidence.
_SIGNS = re.compile(r"(?P<lt>[<>])|(?P<star>\*)|(?P<under>_)|(?P<dollar>\$)|(?P<hat>\^)|(?P<hash>#)|(?P<back>\\)|(?P<tilde>~)|(?P<amp>&)|(?P<square>[\[\]])|(?P<brace>[{}])|(?P<equals>==)|(?P<pipe>\|)|(?P<dash>--)|(?P<quote>'')")


def evidence(text: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[int, int]]]:
    """((kind, tag, start, end) of every exact piece of markup outside code, bounds of fenced bodies)."""
    plain, bodies, fences, spans = blanked(text)
    found = [("markdown", "fence", at, at + 3) for at in fences] + [("markdown", "span", at, at + 1) for at in spans]
    if "<" in plain:
        for m in _TAG.finditer(plain):
            generic = not m[1] and m.start() and (plain[m.start() - 1].isalnum() and not m[3] and re.search(r"(?:^|\W)[A-Z]\w*$", plain[max(0, m.start() - 40) : m.start()]))
            if m[2].lower() in _ELEMENTS and not generic:
                found.append(("html", m[2].lower(), m.start(), m.end()))
    if "&" in plain:
        found += [("html", "entity", m.start(), m.end()) for m in _ENTITY.finditer(plain) if not m[1] or m[1] + ";" in html.entities.html5]
    if "<!--" in plain:
        found += [("html", "comment", *span) for span in comments(plain)]
    if "{{" in plain:
        found += [("wiki", "template", *span) for span in templates(plain)]
    if "\\" in plain:
        found += [("latex", "display", *span) for signs in (_DISPLAY, _PAREN) for span in between(signs, plain)]
    for kind, tag, pattern in _PATTERNS:
        if kind == "latex" and "\\" not in plain and "$" not in plain:
            break
        for m in pattern.finditer(plain):
            if m.end() == m.start():
                continue
            if tag == "inline" and not _MATH_INSIDE.search(m[0][1:-1]):
                continue
            if tag == "setext":
                above = plain[plain.rfind("\n", 0, m.start() - 1) + 1 : m.start() - 1]
                if not above.strip() or above.lstrip()[:1] in "|{=#<\\":
                    continue
            if tag == "table" and kind == "markdown" and ("||" in m[0] or m[0].startswith(("|-", "|}")) and "|" not in m[0][2:]):
                continue
            found.append((kind, tag, m.start(), m.end()))
    if "* " in plain:  # both languages have this bullet: it goes with the other markup of its text
        star = [m for m in re.finditer(r"^[ \t]*\*+[ \t]+\S", plain, re.M)]
        if star:
            wiki = sum(k == "wiki" for k, *_ in found)
            other = sum(k == "markdown" for k, *_ in found)
            found += [("wiki" if wiki > other else "markdown", "bullet", m.start(), m.end()) for m in star]
    return found, bodies


def labelled(text: str) -> tuple[Leaves, np.ndarray]:
    """The leaves of a stored text with their kinds by the patterns."""
    leaves, (found, _) = Leaves(text), evidence(text)
    y, starts = np.zeros((len(leaves.bounds), len(KINDS)), np.float32), [a for a, _ in leaves.bounds]
    for kind, _, a, b in found:
        for i in range(max(0, bisect_right(starts, a) - 1), bisect_right(starts, max(a, b - 1))):
            if leaves.bounds[i][1] >= a:
                y[i, KINDS.index(kind)] = 1
    return leaves, y


# --- the grammar ----------------------------------------------------------------------------------------------------

_NOUNS = "index query shard token buffer session release daemon parser cache ledger cursor schema panel worker stream bucket editor report client".split()
_VERBS = "reads writes drops keeps merges splits sorts loads stores opens checks renders resolves moves".split()
_SYLLABLES = "ka lo mi tu ne ra vo si pe du ga zo fi bu".split()


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def name(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(2, 4))) + self.r.choice(["", "x", "n", "sk", "r"])

    def noun(self) -> str:
        return self.r.choice(_NOUNS)

    def sentence(self) -> str:
        r = self.r
        return r.choice([
            f"The {self.noun()} {r.choice(_VERBS)} the {self.noun()} before {self.name()} {r.choice(_VERBS)} it.",
            f"After {r.randint(2, 900)} runs the {self.noun()} of {self.name()} still {r.choice(_VERBS)}.",
            f"{self.name().capitalize()} {r.choice(_VERBS)} each {self.noun()} and leaves the {self.noun()} alone.",
            f"We moved the {self.noun()} out of {self.name()}, because it {r.choice(_VERBS)} every {self.noun()}.",
        ])

    def sum(self) -> str:
        """The body of a formula, with or without commands."""
        r = self.r
        terms = r.choice([["1", "x"], ["x", "y", "z_1"], ["a", "b^2", "3"], ["\\alpha", "x_i", "\\frac{1}{2}"]])
        return f"{r.choice('xyzabc')} {r.choice(['=', '<', '>'])} " + " ".join(f"{r.choice(terms)} {r.choice('+-')}" for _ in range(r.randint(1, 6) ** r.choice([1, 1, 2]))) + f" {r.randint(1, 9)}"

    def trap(self) -> str:
        """Signs of markup in plain text."""
        r, n = self.r, self.name
        return r.choice([
            f"Values a < b and c > d stay apart in {n()}.", f"Types such as Map<str, int> or List<{self.noun()}> are fine.", f"Ranges like {r.randint(1, 99)}--{r.randint(1, 99)} and ~{r.randint(1, 99)} ms.",
            f"See #{r.randint(1, 999)} and the C# port of {n()}.", f"The regex ^[a-z]+$ matches {n()}.", f"The name {n()}_{n()}_{self.noun()} and __init__ stay.", f"It costs $5 per {self.noun()}, or $7 with a {self.noun()}.",
            f"R&D {r.choice(['keeps', 'runs', 'has'])} {n()} on {r.choice('CDE')}:\\{n()}\\{r.choice([n(), self.noun()])}.", f"Keys look like {n()}.*.{self.noun()} or {self.noun()}_*.", f"Set $HOME/{n()} first; 5 ^ 2 is 25.", f"That makes 2 * 3 * {r.randint(2, 99)} rows.", f"Use {n()}[0] when x == y.",
            f"Write (see [{r.randint(1, 99)}] above) & retry.", f"{self.noun()} | {self.noun()} in {n()}", f"{self.noun()}: {n()} = {r.randint(1, 99)}", f"{n()}@{r.randint(1, 9)}.{r.randint(0, 9)} - done", "//" + n() + "/" + n(), f"'{n()}' and \"{n()}\" differ.",
            f"Mail <{n()}@{n()}.test> or call {n()}->{n()}.", f"A std::vector<int> or Vec<{n().capitalize()}> holds {n()}.", f"Run {n()} <file> [options] --{n()} -v", f"In {n()} a && b || c == d, and x != y.", f"Pass *args and **kwargs to {n()}(*a, **b).",
            f"Set ${{{n().upper()}}} and $PATH, then ~/{n()}.", f"US$5 and US$7, or $10 to $20 for {n()}.", f"[INFO] {n()} started, [WARN] {n()} late", f"arr[0][1] and {n()}[{n()}] differ.", f"The pattern \\d+\\.\\w* matches {n()}\\n.", f"\\\\{n()}\\share and C:\\{n()}\\table",
            f"https://{n()}.test/{n()}_{n()}/a_b_c?x=1&{n()}=2#{n()}", f"@{n()} said :{n()}: to #{n()}.", f"{r.randint(10, 23)}:{r.randint(10, 59)}:0{r.randint(0, 9)} - {n()}: {n()}=={r.randint(1, 9)}", f"key={n()}; other={n()}, {{a: 1, b: {n()}}}", f"The files {n()}_*.log, *.{n()} and __{n()}__ go.", f"{n()}__{n()} and _{n()} and {n()}_",
            f"{n()} | {n()} | {n()}", f"It''s {n()} -- or {n()} --- and {r.randint(2, 9)}*{r.randint(2, 9)}={r.randint(10, 99)}", f"{n()} <3 {n()}, a<b>c? no: x < {n()} > y", f"100% of {n()} at ~{r.randint(1, 9)}.{r.randint(0, 9)}^{r.randint(2, 9)} (see {n()}())", f"#!/bin/sh and #define {n()}", f"Result<{n().capitalize()}, Error> and Option<&str>", f"<{n()}> stands for {n()}, <none> for nothing.", f"{n()}: {{{n()}}} / [{n()}] / ({n()})",
        ])

    def code(self) -> str:
        r, n = self.r, self.name
        return r.choice([f"if {n()} < {r.randint(1, 9)} and {n()} > 0:", f"const t = '<p>' + {n()} + '</p>';", f"# {self.sentence()}", f"{n()} = {r.randint(1, 99)}", f"[{n()}]", f"- {n()}", f"echo \"${n()}\" | grep '{n()}'", f"return f\"{{{n()}}}\"", f"  \"{n()}\": [\"{n()}\", {r.randint(1, 99)}],", "}", f"def {n()}(*args, **kwargs):", "set -eu"])

    def block(self, kind: str) -> list[Line]:
        r, s, n = self.r, self.sentence, self.name

        def line(text: str, role: str = "text") -> Line:
            return text, {kind}, role

        if kind == "plain":
            return [((self.trap() if r.random() < 0.35 else s()) + (" " + s()) * r.randint(0, 2), set(), "text") for _ in range(r.randint(1, 3))]
        if kind == "fence":
            mark = r.choice(["```", "````", "~~~"])
            body = [(self.code(), set(), "code") for _ in range(r.randint(1, 6))]
            return [(mark + r.choice(["", "py", "sh", "yaml", "html"]), {"markdown"}, "code"), *body, (mark, {"markdown"}, "code")]
        if kind == "html":
            return r.choice([
                lambda: [line(f"<h{r.randint(1, 4)}{r.choice(['', ' id=' + chr(39) + n() + chr(39)])}>{s()}</h2>", "heading")],
                lambda: [line("<ul>", "drop"), *[line(f"<li>{s()}</li>", "list") for _ in range(r.randint(1, 4))], line("</ul>", "drop")],
                lambda: [line(f"<p>{s()}</p>")], lambda: [line(f"{s()} <b>{n()}</b> and <a href=\"/{n()}\">{n()}</a>.")], lambda: [line(f"The {n()}&#39;s {n()} is {r.randint(1, 99)}&thinsp;ms.")], lambda: [line(f"{s()} &amp; {n()}&nbsp;{n()}.")], lambda: [line(f"{s()[:-1]}&{r.choice(['mdash', 'ndash', 'hellip', 'rarr', 'copy'])};{s()}")],
                lambda: [line(f"<!-- {n()} -->", "drop")], lambda: [line(f"<img src='{n()}.png'", "drop"), line(f" alt=\"{n()}\">", "drop")], lambda: [line(f"<pre><code>{n()}.{n()}(1) &lt; 3</code></pre>", "code")],
                lambda: [line(f"<div class=\"{n()}\">{s()}<br/>{s()}</div>")], lambda: [line(f"<TABLE><TR><TD>{n()}<TD>{s()}</TABLE>", "table")], lambda: [line(f"{s()}</td>", "table")], lambda: [line(f"<script>var {n()} = 1;</script><span style='x'>{s()}")],
                lambda: [line(f"<{(t := r.choice(['section', 'article', 'blockquote', 'main', 'div', 'center', 'header']))} class={n()}>", "drop"), line(f"<p>{s()}", "text"), (s(), set(), "text"), line(f"{s()}</p>"), line(f"</{t}>", "drop")],
                lambda: [line(f"<dl><dt>{n()}</dt><dd>{s()}</dd></dl>", "list")], lambda: [line("<!DOCTYPE html>", "drop"), line(f"<html><head><title>{n()} {n()}</title></head>", "heading"), line("<body>", "drop"), line(f"<H1>{n()} {n()}</H1>", "heading"), line("</body></html>", "drop")],
                lambda: [line(f"<!-- {n()}", "drop"), line(f"{s()} -->", "drop")], lambda: [line(f"{s()} {n()}&#x{r.randint(1000, 9999)}; {s()}")], lambda: [line(f"Press <kbd>{n()}</kbd>, <i>{n()}</i> or <code>{n()}</code>. {s()}")], lambda: [line(f"<input type='text' name={n()}> <label for={n()}>{n()}</label>")],
                lambda: [line("<table>", "drop"), line(f"<tr><th>{n()}</th><th>{n()}</th></tr>", "table"), line(f"<tr><td>{n()}</td><td>{r.randint(1, 99)}</td></tr>", "table"), line("</table>", "drop")], lambda: [line("<ol>", "drop"), *[line(f"  <li>{s()}", "list") for _ in range(r.randint(1, 3))], line("</ol>", "drop")], lambda: [line(f"{s()}<br>", "text"), line(f"{s()}<br />", "text")], lambda: [line("<hr>", "drop")],
                lambda: [line(f"<blockquote>{s()}</blockquote>", "quote")], lambda: [line(f"<em>{n()}</em> &lt;{n()}&gt; {s()}")],
            ])()
        if kind == "markdown":
            return r.choice([
                lambda: [line(f"{'#' * r.randint(1, 6)} {n()} {n()}", "heading")], lambda: [(f"{n()} {n()}", set(), "heading"), line(r.choice(["=========", "-------"]), "drop")], lambda: [line(r.choice(["***", "---", "* * *"]), "drop")],
                lambda: [line(f"{r.choice('-+')} {s()}", "list") for _ in range(r.randint(1, 4))], lambda: [line(f"{i + 1}. {s()}", "list") for i in range(r.randint(2, 4))], lambda: [line(f"- [{r.choice(' x')}] {s()}", "list") for _ in range(r.randint(1, 3))],
                lambda: [line(f"> {s()}", "quote")], lambda: [line(f"| {n()} | {n()} |", "table"), line("|---|:-:|", "drop"), line(f"| {r.randint(1, 99)} | {s()[:30]} |", "table")], lambda: [line(f"See [{n()} {n()}](https://{n()}.test/{n()}). {s()}")],
                lambda: [line(f"See [{n()}][{n()}]. {s()}")], lambda: [line(f"[{n()}]: https://{n()}.test/{n()}", "drop")], lambda: [line(f"![{n()}](img/{n()}.png)")], lambda: [line(f"{s()} **{n()}** {s()}")], lambda: [line(f"{s()} __{n()} {n()}__ {s()}")],
                lambda: [line(f"{s()} *{n()} {n()}* and ~~{n()}~~.")], lambda: [line(f"Call `{n()}_{n()}()` {n()}. {s()}")],
                lambda: [line(f"{r.choice(['See', s()])} [{n()}]({r.choice(['#', './', '../', '/', 'https://a.test/'])}{n()}{r.choice(['', '.md', '#' + n()])}{r.choice(['', ' ' + chr(34) + n() + chr(34)])}){r.choice(['', '.', ' ' + s()])}")], lambda: [line(f"Go to <https://{n()}.test/{n()}> or <mailto:{n()}@{n()}.test>.")],
                lambda: [line(f"{s()}[^{r.randint(1, 9)}]"), line(f"[^{r.randint(1, 9)}]: {s()}", "drop")][: r.randint(1, 2)], lambda: [line(f"{'#' * r.randint(1, 4)} {s()[:-1]} {'#' * r.randint(1, 4)}", "heading")], lambda: [line(f"{r.randint(1, 9)}) {s()}", "list") for _ in range(r.randint(1, 3))],
                lambda: [line(f"{n()} | {n()}", "table"), line("--- | ---", "drop"), line(f"{n()} | {n()}", "table")], lambda: [line(f"> {s()}", "quote"), line(f"> {r.choice(['> ', ''])}{s()}", "quote")], lambda: [line(f"  {r.choice('-+')} {s()}", "list"), line(f"    - {s()}", "list")], lambda: [line(f"***{n()}*** and _{n()} {n()}_: {s()}")], lambda: [line(f"**{n()}:** {s()}")],
                lambda: [line(f"{s()} _{n()}_ {s()}")], lambda: [line(f"[![{n()}](https://{n()}.test/b.svg)](https://{n()}.test)")], lambda: [line(f"* {s()}", "list") for _ in range(r.randint(1, 3))] + [line(f"**{n()}** {s()}")], lambda: [line(f"{'#' * r.randint(1, 3)} `{n()}` {n()}", "heading")], lambda: [line(f"{s()} ``{n()} {n()}`` {s()}")], 
            ])()
        if kind == "wiki":
            return r.choice([
                lambda: [line(f"{'=' * (k := r.randint(2, 4))} {n()} {n()} {'=' * k}", "heading")], lambda: [line(f"[[{n()}|the {n()}]] {s()}")], lambda: [line(f"{s()} [[{n()}#{n()}]] {s()}")], lambda: [line(f"[[Category:{n()}]]", "drop")], lambda: [line(f"{{{{{n()}|{n()}|size={r.randint(1, 99)}}}}}", "drop")],
                lambda: [line(f"{s()} '''{n()}''' {s()}")], lambda: [line(f":''{n()}'' {s()}")], lambda: [line(f":{s()}")], lambda: [line(f"{{| class=\"{n()}\"", "drop"), line("|-", "drop"), line(f"| {n()} || {n()}", "table"), line("|}", "drop")],
                lambda: [line(f"{{{{{n().capitalize()} {n()}", "drop"), *[line(f"| {n()} = {s()[:r.randint(8, 60)]}", "drop") for _ in range(r.randint(1, 5))], line("}}", "drop")], lambda: [line(f"[[{n()}]] {s()}"), *[line(f"{'*' * r.randint(1, 2)} {s()}", "list") for _ in range(r.randint(1, 3))]], lambda: [line(f";{n()}: {s()}", "quote")],
                lambda: [line(f"{s()} [https://{n()}.test/{n()} {n()} {n()}] {s()}")], lambda: [line(f"{s()}<ref>{n()}, {n()}</ref> {s()}")], lambda: [line(r.choice(["__NOTOC__", "__TOC__", f"#REDIRECT [[{n()}]]"]), "drop")], lambda: [line(f"[[File:{n()}.png|thumb|{n()}]]", "drop")], lambda: [line(f"\'\'\'\'\'{n()} {n()}\'\'\'\'\' {s()}")], lambda: [line(f"\'\'{n()} {n()}\'\' {s()} {{{{{n()}|{n()}}}}}")],
                lambda: [line("{|", "drop"), line(f"|+ {n()}", "table"), line(f"! {n()} !! {n()}", "table"), line("|-", "drop"), line(f"| {n()}", "table"), line(f"| {r.randint(1, 99)}", "table"), line("|}", "drop")], lambda: [line(f"::{s()}", "quote"), line(f":{s()}", "quote")], lambda: [line(f"=== {s()[:-1]} ===", "heading")], lambda: [line(f"{s()} {{{{{n()}}}}}.")],
            ])()
        return r.choice([
            lambda: [line(f"\\{r.choice(['section', 'subsection'])}{{{n()} {n()}}}", "heading")], lambda: [line("\\begin{itemize}", "drop"), *[line(f"\\item {s()}", "list") for _ in range(r.randint(1, 3))], line("\\end{itemize}", "drop")],
            lambda: [line("\\begin{equation}", "formula"), line(f"E = {r.choice('abcxyz')}^2 + \\alpha", "formula"), line("\\end{equation}", "formula")], lambda: [line(f"$$ {(v := r.choice('abcxyz'))}_{{t+1}} = {v}_t \\cdot 2^{{-{r.randint(1, 9)}}} $$", "formula")],
            lambda: [line(f"\\[ \\sum_{{i=1}}^{{n}} {r.choice('abcxyz')}_i \\leq {r.randint(1, 99)} \\]", "formula")], lambda: [line(f"The score is $s_{{{(v := r.choice('abcxyz'))}}} = \\frac{{{v}}}{{k_1 + 1}}$ here. {s()}")],
            lambda: [line(f"{s()}~\\cite{{{n()}}} \\label{{sec:{n()}}}")], lambda: [line(f"{s()} \\textbf{{{n()}}} and \\emph{{{n()}}}.")], lambda: [line(f"{{\\bf {n()}}} {s()} \\url{{{n()}}}\\\\")], lambda: [line(f"Here \\( {r.choice('abc')} \\in \\mathbb{{N}} \\) holds. {s()}")],
            lambda: [line(f"{s()} ${r.choice('abcxyz')}$ and ${r.choice('abcxyz')} {r.choice('<>=+')} {r.randint(0, 99)}$."),], lambda: [line("\\begin{align*}", "formula"), line(f"  {r.choice('abc')} &= {r.randint(1, 9)}{r.choice('xyz')} \\\\", "formula"), line(f"  {r.choice('abc')} &= \\frac{{1}}{{2}}", "formula"), line("\\end{align*}", "formula")],
            lambda: [line(f"\\begin{{tabular}}{{{r.choice(['ll', 'l|r', 'lcr'])}}}", "drop"), line(f"{n()} & {n()} \\\\ \\hline", "table"), line(f"{n()} & {r.randint(1, 99)} \\\\", "table"), line("\\end{tabular}", "drop")], lambda: [line(f"\\documentclass{{{n()}}}", "drop"), line(f"\\usepackage[{n()}]{{{n()}}}", "drop"), line("\\begin{document}", "drop"), line("\\end{document}", "drop")],
            lambda: [line(f"{s()} \\texttt{{{n()}\\_{n()}}} at {r.randint(1, 99)}\\% {s()}")], lambda: [line(f"{s()}\\footnote{{{s()}}} \\ldots")], lambda: [line(f"See Section~\\ref{{sec:{n()}}} and \\eqref{{{n()}}}. {s()}")], lambda: [line("\\[", "formula"), line(f"{r.choice('abc')} = {r.choice('xyz')} + {r.randint(1, 9)}", "formula"), line("\\]", "formula")], lambda: [line("$$", "formula"), line(f"{r.choice('abc')} = {r.choice('xyz')}^2", "formula"), line("$$", "formula")],
            lambda: [line((v := r.choice(["$${}$$", "$$ {} $$", "\\[ {} \\]", "\\[{}\\]"])).format(self.sum()), "formula")], lambda: [line(r.choice(["Here \\( {} \\) holds.", "It is \\({}\\) then.", "So ${}$ at last.", "Then $$ {} $$ follows."]).format(self.sum()))], lambda: [line("$$", "formula"), line(self.sum(), "formula"), line("$$", "formula")],
            lambda: [line("\\begin{enumerate}", "drop"), line(f"  \\item {s()}", "list"), line("\\end{enumerate}", "drop")], lambda: [line(f"{s()} $O(n \\log n)$ {s()}")], lambda: [line(f"\\subsection*{{{s()[:-1]}}}", "heading")], lambda: [line(f"{n()} \\& {n()} \\cite{{{n()},{n()}}}. {s()}")], lambda: [line("\\noindent", "drop"), (s(), set(), "text")], lambda: [line(f"\\begin{{quote}}{s()}\\end{{quote}}", "quote")], lambda: [line(f"${(v := r.choice('abcxyz'))}_{r.randint(0, 9)} = {v}^{{{r.randint(2, 9)}}}$ {s()}")],
        ])()

    def title(self) -> list[Line]:
        """One short line, as titles are: paths of headings, with inline markup or with signs only."""
        r, n = self.r, self.name
        kind = r.choice(["plain", *KINDS])
        e = r.choice({
            "plain": [lambda: n(), lambda: f"{n()} < {n()}", lambda: f"{n()}_{n()}_v2", lambda: f"#{r.randint(1, 999)} {n()}", lambda: f"C# {n()} & {n()}", lambda: f"{n()}/{n()}.sh ({r.randint(1, 9)})", lambda: f"{n()} $5", lambda: f"{n()} -- {n()}", lambda: f"{n()}[{r.randint(0, 9)}]", lambda: f"__{n()}__", lambda: f"{n()}<{n()}>", lambda: f"*.{n()}", lambda: f"${n().upper()}", lambda: f"D:\\{n()}"],
            "html": [lambda: f"<{(t := r.choice(['em', 'b', 'code', 'i', 'span', 'tt']))}>{n()}</{t}>", lambda: f"{n()}<br>{n()}", lambda: f"{n()} &{r.choice(['amp', 'lt', 'mdash', 'nbsp', 'quot', '#39'])}; {n()}", lambda: f"{n()}&mdash;{n()}"],
            "markdown": [lambda: f"**{n()}**", lambda: f"__{n()} {n()}__", lambda: f"_{n()}_", lambda: f"*{n()}*", lambda: f"`{n()}`", lambda: f"[{n()}]({r.choice(['/', '#', 'https://a.test/', ''])}{n()})", lambda: f"~~{n()}~~", lambda: f"## {n()}"],
            "wiki": [lambda: f"'''{n()}'''", lambda: f"''{n()}''", lambda: f"[[{n()}]]", lambda: f"[[{n()}|{n()}]]", lambda: f"{{{{{n()}}}}}", lambda: f"{{{{{n()}|{n()}}}}}"],
            "latex": [lambda: f"\\{r.choice(['emph', 'textbf', 'texttt'])}{{{n()}}}", lambda: f"${r.choice('abcxyz')}_{{{r.choice('abcxyz')}}}$", lambda: f"{n()}~\\ref{{{n()}}}", lambda: f"${r.choice('abcxyz')}^{r.randint(2, 9)}$", lambda: f"{n()} \\& {n()}", lambda: f"\\section{{{n()}}}"],
        }[kind])()
        if kind == "wiki" and r.random() < 0.2:
            return [(f"== {n()} ==", {"wiki"}, "heading")]
        parts = [e] if e.startswith(("## ", "\\section")) else r.choice([[e], [e, n()], [n(), e], ["The", e, n()], [n(), ">", e, n()], [n().capitalize(), n(), ">", e], [self.sentence(), e], [e, self.sentence()]])
        return [(" ".join(parts), set() if kind == "plain" else {kind}, "text")]

    def text(self) -> list[Line]:
        r = self.r
        if r.random() < 0.25:
            return self.title()
        mode = r.random()
        kinds = ["plain"] if mode < 0.3 else [r.choice(KINDS)] if mode < 0.75 else r.sample(KINDS, 2)
        if r.random() < 0.25:
            kinds.append("fence")
        lines: list[Line] = []
        for _ in range(1 if r.random() < 0.2 else r.randint(2, 9)):
            lines += self.block(r.choice(kinds) if r.random() < 0.55 else "plain")
            if r.random() < 0.6:
                lines.append(("", set(), "text"))
        return lines


def sample(grammar: Grammar) -> tuple[Leaves, np.ndarray, np.ndarray]:
    lines = grammar.text()
    leaves = Leaves("\n".join(t for t, _, _ in lines))
    own = [(k, role) for t, k, role in lines if t.strip()]
    y = np.array([[float(kind in k) for kind in KINDS] for k, _ in own], np.float32).reshape(-1, len(KINDS))
    return leaves, y, np.array([ROLES.index(role) for _, role in own], int)


def gradients(net: BiLSTM, x: np.ndarray, mask: np.ndarray, y: np.ndarray, roles: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (log loss of the kinds plus that of the roles, per leaf; role -1: unknown) and its gradient by back-propagation through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    emb = net.embed(x)
    states = [net.run(emb, mask, d, kept[d]) for d in "fb"]
    width, hidden = emb.shape[2], net.hidden
    feed = np.concatenate([*states, emb], axis=2)
    z = feed @ net.w["Wo"] + net.w["bo"]
    n = mask.sum()
    p = _sigmoid(z[..., : len(KINDS)])
    e = np.exp(z[..., len(KINDS) :] - z[..., len(KINDS) :].max(-1, keepdims=True))
    q = e / e.sum(-1, keepdims=True)
    told = (roles >= 0).astype(x.dtype)
    hot = np.eye(len(ROLES), dtype=x.dtype)[np.maximum(roles, 0)]
    loss = float(-((y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).sum(-1) * mask).sum() / n - ((hot * np.log(q + 1e-7)).sum(-1) * mask * told).sum() / n)
    dz = np.concatenate([p - y, (q - hot) * told[..., None]], axis=-1) * (mask / n)[..., None]
    flat = feed.reshape(-1, feed.shape[2])
    g = {"Wo": flat.T @ dz.reshape(-1, dz.shape[2]), "bo": dz.sum((0, 1))}
    back = dz @ net.w["Wo"].T
    de = back[..., 2 * hidden :].copy()
    for d, dh_all in (("f", back[..., :hidden]), ("b", back[..., hidden : 2 * hidden])):
        W = net.w[f"W{d}"]
        gW, gb = np.zeros_like(W), np.zeros_like(net.w[f"b{d}"])
        dh = np.zeros((x.shape[0], hidden), x.dtype)
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, zc, tc, m in reversed(kept[d]):
            dh = dh + dh_all[:, t]
            dh2, dc2 = dh * m, dc * m
            dcell = dc2 + dh2 * o * (1 - tc**2)
            gates = np.concatenate([dcell * zc * i * (1 - i), dcell * c * f * (1 - f), dh2 * tc * o * (1 - o), dcell * i * (1 - zc**2)], axis=1)
            gW[:width] += emb[:, t].T @ gates
            gW[width:] += h.T @ gates
            gb += gates.sum(0)
            de[:, t] += gates @ W[:width].T
            dh = dh * (1 - m) + gates @ W[width:].T
            dc = dc * (1 - m) + dcell * f
        g[f"W{d}"], g[f"b{d}"] = gW, gb
    de *= emb > 0
    g["We"], g["be"] = x.reshape(-1, x.shape[2]).T @ de.reshape(-1, width), de.sum((0, 1))
    return loss, g


def padded(rows: list[tuple[Leaves, np.ndarray, np.ndarray]]):
    steps = max(len(y) for _, y, _ in rows)
    x = np.zeros((len(rows), steps, TAGS + WORDS + NUMBERS), np.float32)
    mask, y, roles = np.zeros((len(rows), steps), np.float32), np.zeros((len(rows), steps, len(KINDS)), np.float32), np.full((len(rows), steps), -1)
    for i, (leaves, b, c) in enumerate(rows):
        n = len(b)
        x[i, :n], y[i, :n], roles[i, :n], mask[i, :n] = leaves.inputs(), b, c, 1
    return x, mask, y, roles


def accuracy(net: BiLSTM, rows: list[tuple[Leaves, np.ndarray, np.ndarray]]) -> tuple[float, float, float]:
    """(precision and recall of the kinds per leaf, share of right roles) on held-out rows."""
    hit = said = true = right = told = 0
    for i in range(0, len(rows), 200):
        x, mask, y, roles = padded(rows[i : i + 200])
        z = net.logits(x, mask)
        p, on = _sigmoid(z[..., : len(KINDS)]) >= 0.5, mask[..., None] > 0
        hit, said, true = hit + (p & (y > 0) & on).sum(), said + (p & on).sum(), true + ((y > 0) & on).sum()
        known = (roles >= 0) & (mask > 0)
        right, told = right + ((z[..., len(KINDS) :].argmax(-1) == roles) & known).sum(), told + known.sum()
    return hit / max(1, said), hit / max(1, true), right / max(1, told)


def main() -> None:
    a = argparse.ArgumentParser()
    a.add_argument("--texts", type=int, default=TEXTS)
    a.add_argument("--chunks")
    a.add_argument("--rows", type=int, default=ROWS)
    a.add_argument("--epochs", type=int, default=8)
    a.add_argument("--embed", type=int, default=40)
    a.add_argument("--hidden", type=int, default=20)
    a.add_argument("--out", default=MODEL)
    args = a.parse_args()
    grammar = Grammar(11)
    rows = [r for r in (sample(grammar) for _ in range(args.texts)) if len(r[1])]
    held, rows = {"grammar": rows[: len(rows) // 10]}, rows[len(rows) // 10 :]
    if args.chunks:
        import pyarrow.parquet as pq

        table = pq.read_table(args.chunks, columns=["content", "title", "content_type"]).slice(0, args.rows).to_pylist()
        texts = [t for r in table if r["content_type"] != "code" for t in (r["content"], r["title"]) if t and t.strip()]
        stored = [(leaves, y, np.full(len(y), -1)) for leaves, y in map(labelled, texts) if len(y) <= 400]
        held["chunks"], rows = stored[: len(stored) // 10], rows + stored[len(stored) // 10 :]
    rows.sort(key=lambda r: len(r[1]))
    net = BiLSTM.fresh(TAGS + WORDS + NUMBERS, args.embed, args.hidden, len(KINDS) + len(ROLES))
    batches = [rows[i : i + 32] for i in range(0, len(rows), 32)]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    step, rng = 0, random.Random(5)
    for epoch in range(args.epochs):
        rng.shuffle(batches)
        total = 0.0
        for batch in batches:
            loss, g = gradients(net, *padded(batch))
            total, step = total + loss, step + 1
            rate = 0.006 * (0.65**epoch) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, w in net.w.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {total / len(batches):.4f}", *(f"{k}: kinds precision {x[0]:.4f}, recall {x[1]:.4f}, roles {x[2]:.4f}" for k, x in ((k, accuracy(net, r)) for k, r in held.items())), sep="; ", flush=True)
        np.savez_compressed(args.out, **{k: w.astype(np.float32) for k, w in net.w.items()})


if __name__ == "__main__":
    main()
