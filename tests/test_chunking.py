import json
import random

import pytest

from quarry.operators import chunking as c


def test_markdown_paths_and_fences():
    text = "intro\n\n# A\na\n## B\nb\n```py\n# not a heading\n---\n```\n---\n### C\nc\n# D\n##### five"
    got = list(c.markdown(text))
    assert [g.title for g in got] == ["Untitled", "A", "A > B", "A > B > C", "D"]
    assert [g.has_code for g in got] == [False, False, True, False, False]
    assert "# not a heading\n---" in got[2].content and got[4].content == "# D\n##### five"


def test_bounds_and_content_hold():
    r = random.Random(2)
    for n in range(25):
        lines = []
        for _ in range(r.randint(1, 60)):
            lines.append(r.choice(["", "# h", "## é", "text " * r.randint(1, 60), "```", "ä" * r.randint(1, 900), "x"]))
        text = "\n".join(lines)
        for kind in ("markdown", "plain"):
            got = c.chunk_text(text, kind, 300)
            assert all(c.size(g.content) <= 300 and c.size(g.title) <= c.TITLE_CAP + 12 for g in got)
            kept = "".join("".join(g.content.split()) for g in got)
            for line in lines:
                word = "".join(line.split())[:40]
                if word and not set(word) <= set("`-_*"):
                    assert word in kept


def test_plain_strategies():
    assert [x.title for x in c.plain("a\n1\n\nb\n\nc")] == ["a", "b", "c"]
    assert [x.title for x in c.plain("one\ntwo")] == ["Output"]
    got = list(c.plain("\n".join(f"l{i}" for i in range(40))))
    assert [x.title for x in got] == ["l0", "l18", "l36"] and got[0].content.endswith("l19")


def test_json_titles():
    got = list(c.json_chunks(json.dumps({"users": [{"id": i, "v": "x" * 50} for i in range(6)], "meta": {"a": 1}, "e": {}}), 220))
    assert [g.title for g in got] == ["users > 0, 1", "users > 2, 3", "users > 4, 5", "meta", "e"]
    assert list(c.json_chunks("[1, 2]"))[0].title == "(root) > [0-1]"
    assert list(c.json_chunks("no json"))[0].title == "Output" and list(c.json_chunks("[]"))[0].content == "[]"


def test_too_large():
    with pytest.raises(c.TooLarge):
        c.chunk_text("x" * (c.SOURCE_CAP + 1), "plain")


def test_documents(spark):
    docs = spark.createDataFrame([("a", "# T\nx", "markdown"), ("b", "x" * (c.SOURCE_CAP + 1), None), (None, "x", "plain"), ("c", None, "plain"), ("d", "", "plain")], "label string, text string, kind string")
    got = {(r.label, r.chunk_no): r for r in c.chunk_documents(docs).collect()}
    assert got["a", 0].title == "T" and got["b", -1].error and ("d", 0) in got and len(got) == 3
