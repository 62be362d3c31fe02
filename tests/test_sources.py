import datetime as dt
import json
import sqlite3

from pyspark.sql import functions as F

from quarry.operators import extract
from quarry.sources import files, sqlite, store, transcripts, web


def test_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Ü")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.md").write_text("x")
    (tmp_path / "c.bin").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("y" * 50)
    got = {r.label: r for r in files.read_folder(spark, str(tmp_path), cap=40).collect()}
    assert set(got) == {"file:a.md", "file:sub/d.txt"} and got["file:a.md"].text == "# Ü" and got["file:sub/d.txt"].error and got["file:sub/d.txt"].text is None
    c = files.folder_counts(files.read_folder(spark, str(tmp_path), cap=40)).first()
    assert (c.indexed, c.capped, c.seen) == (1, 1, 2)
    import re

    assert re.search(files.glob_pattern("src/**/x*.py"), "src/a/b/xy.py") and not re.search(files.glob_pattern("src/*.py"), "src/a/b.py") and re.search(files.glob_pattern("dist"), "a/dist/b")
    assert files.ignore_patterns("# c\n\n!keep\n*.log") == ["*.log"]


def test_transcripts(spark, tmp_path):
    usage = {"input_tokens": 3, "output_tokens": 2, "cache_creation_input_tokens": 1, "cache_read_input_tokens": None}
    rows = [{"type": "assistant", "uuid": f"u{i}", "isSidechain": i == 2, "message": {"model": "m", "usage": usage}} for i in range(4)]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, rows), "not json", ""]))
    lines = transcripts.lines(spark, str(tmp_path / "t.jsonl"))
    r = transcripts.message_usage(lines).first()
    assert (r.input, r.output, r.messages) == (9, 6, 3)
    assert transcripts.message_cursor(lines).first().cursor == "u3"
    assert transcripts.message_usage(lines, "u1").first().messages == 1 and transcripts.message_usage(lines, "unknown").first().messages == 1
    roll = [{"type": "session_meta", "payload": {"model": "a"}}, {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 5, "output_tokens": 1, "reasoning_output_tokens": 2}}}}, {"type": "turn_context", "payload": {"model": "b"}}, {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 7, "output_tokens": 1}}}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, roll)))
    got = {r.model: (r.input, r.output) for r in transcripts.rollout_usage(transcripts.lines(spark, str(tmp_path / "r.jsonl"))).collect()}
    assert got == {"a": (5, 3), "b": (7, 1)}


def test_usage_records(spark, tmp_path):
    record = lambda n, m="m": {"type": "usage.record", "model": m, "usage": {"inputOther": n, "output": 1, "inputCacheRead": 2}}
    (tmp_path / "k.jsonl").write_text("\n".join([json.dumps(record(1)), '{"type": "other"}', "broken", json.dumps(record(10)), json.dumps(record(100, "n"))]))
    lines = transcripts.lines(spark, str(tmp_path / "k.jsonl"))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [0, 1, 2, 3, 4]
    read = lambda seen: ({r.model: r.input for r in transcripts.record_usage(lines, seen)[0].collect()}, transcripts.record_usage(lines, seen)[1])
    assert read(0) == ({"m": 11, "n": 100}, 3) and read(1) == ({"m": 10, "n": 100}, 3) and read(3) == ({}, 3) and read(9) == ({"n": 100}, 3)
    chat = [{"id": f"c{i}", "model": "q", "usageMetadata": {"promptTokenCount": 10**i, "candidatesTokenCount": 1, "thoughtsTokenCount": 2}} for i in range(3)]
    (tmp_path / "q.jsonl").write_text("\n".join([*map(json.dumps, chat), "broken", ""]))
    rows = transcripts.lines(spark, str(tmp_path / "q.jsonl"))
    for after, want in ((None, (111, 9)), ("c0", (110, 6)), ("c2", None), ("gone", (100, 3))):
        usage, cursor = transcripts.chat_usage(rows, after)
        got = [(r.input, r.output) for r in usage.collect()]
        assert got == ([want] if want else []) and cursor == "c2"


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = transcripts.lines(spark, str(tmp_path / "big.txt"))
        got = [(r.line_no, r.value) for r in rows.orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, f"line {i}") for i in range(5000)]


def test_sqlite(spark, tmp_path):
    for i in range(2):
        con = sqlite3.connect(tmp_path / f"s{i}.db")
        con.execute("create table ev (id integer, data text)")
        con.execute("insert into ev values (?, 'x')", (i,))
        con.commit()
        con.close()
    sqlite.register(spark)
    got = spark.read.format("sqlitefile").schema("id long, data string, newer string, db_file string").option("path", str(tmp_path / "*.db")).option("table", "ev").load().collect()
    assert sorted((r.id, r.data, r.newer) for r in got) == [(0, "x", None), (1, "x", None)] and len({r.db_file for r in got}) == 2


def test_web(spark):
    html = "<nav>no</nav><h2>T</h2><p>a <b>b</b> <a href='/x'>l</a></p><ul><li>i</li></ul><pre>x  y</pre><script>no</script>"
    pages = spark.createDataFrame([("u", "text/html", html), ("v", "application/json", "{}"), ("w", None, "t"), ("x", "text/html", None)], "url string, content_type string, body string")
    got = {r.url: r for r in web.fetched(pages).collect()}
    assert got["u"].text == "## T\n\na **b** [l](/x)\n\n- i\n\n```\nx  y\n```" and got["v"].kind == "json" and got["x"].text is None
    ips = spark.createDataFrame([(v,) for v in ("10.0.0.1", "8.8.8.8", "169.254.1.1", "::1", "::ffff:10.0.0.1", "x")], "ip string").select("ip", web.address_class(F.col("ip")).alias("c"))
    assert {r.ip: r.c for r in ips.collect()} == {"10.0.0.1": "private", "8.8.8.8": "public", "169.254.1.1": "block", "::1": "private", "::ffff:10.0.0.1": "private", "x": None}


def test_store(spark):
    t = dt.datetime(2025, 1, 1)
    old = spark.createDataFrame([(1, "a", 5, t), (2, "a", 7, t), (3, "b", 1, None), (4, None, 1, t)], "id long, label string, chunk_count int, indexed_at timestamp_ntz")
    assert sorted(r.id for r in store.current_sources(old).collect()) == [2, 3]
    new = spark.createDataFrame([(9, "a", 1, t)], old.schema)
    assert sorted(r.id for r in store.reindexed(old, new).where("label is not null").collect()) == [3, 9]
    hits = {r.label: r for r in store.cache_hits(old.where("label is not null"), old, F.lit(t + dt.timedelta(hours=3)).cast("timestamp_ntz")).collect()}
    assert hits["a"].hit and not hits["b"].hit and hits["b"].bytes == 0


def test_commands(spark):
    df = spark.createDataFrame([("git -C /x commit -am 'fix it'",), ("cd \"/a b\" && FOO=1 sudo npm run build",), ("export K=secret; pip install x",), ("hello",)], "c string")
    got = df.select(extract.git_operation("c").alias("g"), extract.commit_message("c").alias("m"), extract.working_directory("c").alias("d"), extract.environment_command("c").alias("e"), extract.command_class("c").alias("k")).collect()
    assert (got[0].g, got[0].m, got[1].d, got[2].e, got[0].k) == ("commit", "fix it", "/a b", "export K=*** pip install x", "git")
    assert "secret" not in got[2].e and got[3].g is None
