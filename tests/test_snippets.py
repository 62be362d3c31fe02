from pyspark.sql import functions as F

from quarry.functions import snippets as s
from quarry.operators.timeline import longest_prefix


def test_excerpts():
    text = "a" * 2000 + "needle" + "b" * 3000 + "needle" + "c" * 2000
    got = s.snippet(text, ["NEEDLE"], 1200)
    assert got.count("needle") == 2 and got.startswith("…") and len(got.replace("…", "").replace("\n", "")) <= 1200
    assert s.snippet("short", ["x"]) == "short" and s.snippet("x" * 2000, ["q"], 10) == "x" * 10 + "…"
    assert s.marked("ab abc", ["ab", "bc"], "<", ">") == "<ab> <abc>" and s.marked("x", [], "<", ">") == "x"
    assert s.cap_bytes("aé€", 3) == "aé" and s.cap_bytes("aé€", 5) == "aé" and s.cap_bytes("", 1) == ""


def test_columns(spark):
    df = spark.createDataFrame([("<a & 'b'>", "a"), (None, "x"), ("y", None)], "t string, q string")
    got = df.select(s.escape_xml(F.col("t")).alias("e"), s.snippets("t", "q").alias("s")).collect()
    assert got[0].e == "&lt;a &amp; &apos;b&apos;&gt;" and [r.s for r in got] == ["<a & 'b'>", None, "y"]


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("/a/b/c.py",), ("/ab",), ("/a/",), (None,), ("C:\\x\\y",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b/",), ("C:/x",), (None,), ("",)], "root string")
    assert {r.path: r.root for r in longest_prefix(paths, roots).collect()} == {"/a/b/c.py": "/a/b", "/ab": None, "/a/": "/a", "C:\\x\\y": "C:/x"}
