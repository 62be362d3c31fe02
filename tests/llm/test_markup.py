import numpy as np
import pytest

from quarry.llm import markup as m
from quarry.llm import train_markup as t

YES = {
    "html": ["<h2 id='x'>Title</h2>", "a &amp; b", "text<br/>more", "<img src='a.png'\n alt=\"b\">", "<!-- note -->", "x &#39; y"], "markdown": ["# Title", "a **b** c", "see [a](http://x/y)", "- item one\n- item two", "```py\nx\n```", "call `f()` now", "> said", "Title\n====="],
    "wiki": ["== Title ==", "a '''b''' c", "[[Page|text]]", "{{Tpl|a|b}}", "{| class=\"x\"\n|-\n| a || b\n|}"], "latex": ["\\section{X}", "is $a_{i}$ here", "\\begin{itemize}\n\\item a\n\\end{itemize}", "$$ x = 1 $$", "so~\\cite{a} it"],
}
NO = ["Values a < b and c > d are kept apart.", "Types such as Map<str, int> are allowed.", "Ranges like 147--25 and ~300 ms are fine.", "See #379 and the C# port.", "The regex is ^[a-z]+$ there.", "title_x_y stays, and so does __init__.", "It costs $5 per index, or $7 with a panel.", "That makes 2 * 3 * 115 rows.", "Keys look like detoux.*.handle or response_*.", "R&D runs x on D:\\broul\\closure.", "Use client[0] when x == y.", "Write (see [165] above) & retry.", "Set $HOME/x first; 5 ^ 2 is 25.", ""]


@pytest.fixture(scope="module")
def labeller():
    return m.Labeller()


def kinds(labeller, texts):
    return [m.kinds_of(p) for p, _ in labeller.label([m.Leaves(x) for x in texts])]


def test_kinds(labeller):
    for kind, texts in YES.items():
        framed = [f"The index reads the shard before it merges.\n\n{x}\n\nThe daemon keeps the cache." for x in texts]
        assert kinds(labeller, framed) == [[kind]] * len(texts), kind
    assert kinds(labeller, NO) == [[]] * len(NO)
    assert kinds(labeller, ["```html\n<p>a</p> {{x}} \\section{a}\n```"]) == [["markdown"]]


def test_held_out_accuracy(labeller):
    grammar = t.Grammar(991)
    precision, recall, roles = t.accuracy(labeller.net, [r for r in (t.sample(grammar) for _ in range(400)) if len(r[1])])
    assert precision > 0.99 and recall > 0.99 and roles > 0.98


#: Texts in the manner of real pages, none of them from the grammar: their kinds, and lines that the clean text must have.
PAGES = [
    ("html", "<article>\n<h2>Opening hours</h2>\n<p>We open at <strong>nine</strong>.</p>\n<ul>\n  <li>Monday</li>\n  <li>Friday</li>\n</ul>\n</article>", ["# Opening hours", "We open at nine.", "- Monday", "- Friday"]),
    ("html", "Caf&eacute; &amp; bar &mdash; open late.", ["Café & bar — open late."]),
    ("html", "<table border=1>\n<tr><td>Oslo</td><td>709</td></tr>\n</table>", ["Oslo | 709"]),
    ("html", "Water is H<sub>2</sub>O.", ["Water is H2O."]),
    ("markdown", "# Install\n\nDownload the [archive](https://example.org/a.zip) and **unpack** it.\n\n1. Open a shell\n2. Run the script\n", ["# Install", "Download the archive and unpack it.", "- Open a shell", "- Run the script"]),
    ("markdown", "Changes\n-------\n\n- [x] faster start\n- [ ] *less* memory\n", ["- faster start", "- less memory"]),
    ("markdown", "> To be or not to be\n\nsaid ~~he~~ she.", ["To be or not to be", "said he she."]),
    ("markdown", "| City | Pop |\n|------|----:|\n| Oslo | 709 |\n", ["City | Pop", "Oslo | 709"]),
    ("markdown", "Run `make all` first.", ["Run `make all` first."]),
    ("markdown", "![logo](logo.svg) The logo has __three colours__ now.", ["logo The logo has three colours now."]),
    ("wiki", "'''Oslo''' is the capital of [[Norway]].\n\n== History ==\nIt was founded in 1040.{{cn|date=May}}\n\n[[Category:Cities]]", ["Oslo is the capital of Norway.", "# History", "It was founded in 1040."]),
    ("wiki", "{| class=wikitable\n! City !! Pop\n|-\n| Oslo || 709\n|}", ["City | Pop", "Oslo | 709"]),
    ("wiki", ":''See also [[Bergen|the second city]].''", ["See also the second city."]),
    ("latex", "\\section{Methods}\nWe minimise $f(x) = x^2$ over the reals~\\cite{boyd}.\n\\begin{itemize}\n\\item convex\n\\item smooth\n\\end{itemize}", ["# Methods", "We minimise $f(x) = x^2$ over the reals.", "- convex", "- smooth"]),
    ("latex", "\\begin{equation}\n  a^2 + b^2 = c^2\n\\end{equation}\nholds for \\emph{right} triangles.", ["a^2 + b^2 = c^2", "holds for right triangles."]),
    ("latex", "Then \\( n \\to \\infty \\) and $$ \\sum_k a_k < 1 $$", None),
    (None, "Bob paid $5 for 3 * 4 tiles (see #12), e.g. in src/main_loop/__init__.py at 5 > 4.", None),
    (None, "git log --oneline | grep -c 'fix_*' && echo done > out.txt", None),
    (None, "Optional<String> name; Map<K, V> m; a[i][j] = b[j] ^ c; x != y", None),
    (None, "C:\\temp\\new, ~/bin, R&D, AT&T, rock 'n' roll; 50% off -- today only!", None),
]


def test_pages_of_another_hand(labeller):
    """Kinds and structure on pages that no grammar wrote; without the labels there are neither kinds nor clean text."""
    leaves = [m.Leaves(x) for _, x, _ in PAGES]
    labels = labeller.label(leaves)
    got = [m.kinds_of(p) for p, _ in labels]
    want = [[k] if k else [] for k, _, _ in PAGES]
    hit = sum(len(set(a) & set(b)) for a, b in zip(got, want))
    assert hit / sum(map(len, want)) >= 0.9 and hit / sum(map(len, got)) >= 0.9
    lines = [(line, x, labels[i], leaves[i]) for i, (_, x, out) in enumerate(PAGES) for line in out or ()]
    kept = [line in m.clean(own, *label).split("\n") for line, _, label, own in lines]
    assert sum(kept) / len(kept) >= 0.9
    off = [line in m.clean(own, np.zeros_like(label[0]), np.zeros_like(label[1])).split("\n") for line, _, label, own in lines]
    flat = [line in m.clean(own, label[0], np.zeros_like(label[1])).split("\n") for line, _, label, own in lines]
    assert sum(off) / len(off) <= 0.3 and sum(flat) / len(flat) <= 0.7


def test_gradients():
    rng = np.random.default_rng(0)
    net = m.BiLSTM.fresh(t.TAGS + t.WORDS + t.NUMBERS, 6, 4, 12)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = rng.standard_normal((2, 5, t.TAGS + t.WORDS + t.NUMBERS))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], float)
    y, roles = (rng.random((2, 5, 4)) > 0.5).astype(float), rng.integers(0, 8, (2, 5))
    _, g = t.gradients(net, x, mask, y, roles)
    for k in ("We", "be", "Wf", "Wb", "bf", "Wo"):
        i = tuple(rng.integers(0, s) for s in net.w[k].shape)
        old, losses = net.w[k][i], []
        for d in (1e-3, -1e-3):
            net.w[k][i] = old + d
            losses.append(t.gradients(net, x, mask, y, roles)[0])
        net.w[k][i] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[k][i]) < 1e-3


def test_long_texts_in_parts(labeller):
    leaves = m.Leaves("\n".join(line for _ in range(30) for line, _, _ in t.Grammar(5).text()))
    (p, roles), (q, same) = labeller.label([leaves])[0], labeller.label([leaves], 7)[0]
    assert np.abs(p - q).max() < 1e-5 and (roles == same).all()


def test_clean(labeller):
    text = "== Top ==\nSome '''bold''' and [[A|the link]] &amp; more.\n\n# Sub\n- one\n- two **x**\n\n```py\nx = '<p>'\n```\n\\begin{itemize}\n\\item last\n\\end{itemize}\n$$ x^2 $$\n<p>Para <b>b</b></p>"
    leaves = m.Leaves(text)
    got = m.clean(leaves, *labeller.label([leaves])[0])
    assert got == "# Top\nSome bold and the link & more.\n\n# Sub\n- one\n- two x\n\n```py\nx = '<p>'\n```\n- last\n$$ x^2 $$\nPara b"


def test_rows(spark):
    long = "plain words here.\n" * 3000 + "a **b** c"
    chunks = spark.createDataFrame([(1, 1, "# T", "x <b>y</b>", "c"), (1, 1, "# T", "x <b>y</b>", "c"), (2, 2, "t", "<p>code</p>", "c"), (3, None, None, None, "c"), (None, 1, "# T", "x", "c"), (4, 9, "", long, "c"), (5, 1, "", "", "c")], "chunk_id long, source_id long, title string, content string, kind string")
    sources = spark.createDataFrame([(1, "/a/b.md"), (2, "/a/b.py"), (2, "/a/b.py"), (3, None)], "id long, file_path string")
    want = [(1, "content", "html"), (1, "title", "markdown"), (4, "content", "markdown")]
    assert sorted(map(tuple, m.find_markup(chunks, sources).collect())) == want
    cleaned = {r.chunk_id: r for r in m.clean_markup(chunks, sources).collect()}
    assert cleaned[1].content == "x y" and cleaned[2].content == "<p>code</p>" and cleaned[3].content is None and cleaned[5].content == "" and len(cleaned) == 5
    assert m.find_markup(chunks.limit(0), sources).count() == 0


FILLER = "The index reads the shard before it merges the parts of the day. "
LONG = {
    "wiki": ["{{Infobox index\n" + "".join(f"| field{i} = some value of it\n" for i in range(60)) + "}}", "{{Infobox\n| a = " + FILLER * 10 + "{{small|x}}\n}}"],
    "latex": ["$$ x = " + "1 + " * 700 + "1 $$", "\\[ x = " + "1 + " * 700 + "1 \\]", "is \\( " + "1 + " * 150 + "1 \\) here"], "html": ["<!-- " + FILLER * 80 + "\n" + FILLER + "-->"],
}


def test_constructs_of_any_length(labeller):
    for kind, texts in LONG.items():
        for x in texts:
            found, _ = t.evidence(f"{FILLER}\n\n{x}\n\n{FILLER}")
            assert any(k == kind and b - a > 390 and (a, b)[1] - a >= len(x) - 8 for k, _, a, b in found), x[:30]
        framed = [f"The index reads the shard before it merges.\n\n{x}\n\nThe daemon keeps the cache." for x in texts]
        assert kinds(labeller, framed) == [[kind]] * len(texts), kind
    assert m.templates("{{{1|}}} {{a {b} c}} {{}} {{a|{{b}}}}") == [(1, 7), (26, 37)]
    assert list(m.comments("<!-- a --> <!-- b\nc")) == [(0, 10), (11, 17)]


def test_hostile_constructs_in_linear_time():
    from time import process_time

    for text in ("<!-- " * 40_000, "{{a" * 40_000, "{{a\n" * 20_000 + "}}\n" * 20_000, "```\n" * 20_000, "````\n" + "```\n" * 20_000, "<b>" * 40_000, "</b>" * 40_000, "<b " * 40_000, "\\[ " * 60_000, "\\( " * 60_000, "$$" * 60_000):
        at = process_time()
        m.Leaves(text)
        assert process_time() - at < 20, text[:10]


def cleaned(labeller, text):
    leaves = m.Leaves(text)
    return m.clean(leaves, *labeller.label([leaves])[0])


def test_clean_constructs_over_lines(labeller):
    code = "# not a heading\nif a &lt; b:\n    run(a)\n\n\n    # <!-- kept? -->".replace("<!-- kept? -->", "end")
    plain = "```\n# not a heading\nif a < b:\n    run(a)\n\n\n    # end\n```"
    assert cleaned(labeller, f"Some text.\n<pre>\n{code}\n</pre>\nMore text.") == f"Some text.\n{plain}\nMore text."
    assert cleaned(labeller, f"Some text.\n\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}\nMore text.") == f"Some text.\n{plain}\nMore text.".replace("<", "&lt;")
    assert cleaned(labeller, "Before it.\n<!-- a\n# b\nc -->\nThe end <!-- x\ny --> is here.") == "Before it.\n\nThe end  is here."
    assert cleaned(labeller, "{{Infobox\n| a = b\n| c = {{small|d}}\n}}\nThe page is here.") == "The page is here."
    page = "<html><head><title>T</title><style>p {}</style></head><body><h1>Top</h1><p>One <b>two</b>.</p><ul><li>a</li><li>b</li></ul><h2>Sub</h2><p>Three.</p></body></html>"
    assert cleaned(labeller, page) == "T\n# Top\nOne two.\n- a\n- b\n# Sub\nThree."


def test_lines_of_hostile_texts_in_linear_time():
    from time import process_time

    for text in ("<pre>" * 30_000, "<h1>" * 30_000, "<p> </p>" * 20_000, "\\begin{verbatim}" * 10_000, "<!--\n-->" * 20_000, "<script>" * 20_000):
        leaves = m.Leaves(text)
        at = process_time()
        m.by_lines(leaves)
        assert process_time() - at < 10, text[:10]
