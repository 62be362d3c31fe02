"""State machines against plain models, in batch and as streams."""

import random

from quarry import streaming
from quarry.operators import state

SCHEMA = "id long, session_id string, type string, data_hash string, category string, priority int, project_dir string, attribution_confidence double, bytes_avoided long, created_at timestamp"


def rows(n=300, seed=4):
    import datetime as dt

    r = random.Random(seed)
    return [(i, f"s{r.randint(0, 3)}", r.choice(["a", "b", "file_edit"]), r.choice("xy"), r.choice(["error", "file"]), r.randint(1, 3), r.choice(["", "/p", "/q", None]), r.choice([0.3, 0.6, None]), i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i * 7)) for i in range(n)]


def model(data):
    seen, out = {}, []
    for r in sorted(data):
        last = seen.setdefault(r[1], [])
        if (r[2], r[3]) not in last[-5:]:
            last.append((r[2], r[3]))
            out.append(r[0])
    return out


def test_dedup(spark):
    data = rows()
    df = spark.createDataFrame(data + [(999, None, "a", "x", None, None, None, None, None, None)], SCHEMA)
    assert sorted(r.id for r in state.stored_events(df).collect()) == model(data)
    assert state.stored_events(df.limit(0)).count() == 0


def test_steps():
    s, out = None, []
    for i in range(7):
        s, more = state.loop_step(s, {"session_id": "s", "id": i, "type": "t", "data_hash": "h"})
        out += more
    assert [o["id"] for o in out] == [2, 5]
    s, _ = state.resolution_step(None, {"id": 1, "category": "error", "type": "e", "tool": "read", "session_id": "s"})
    s, out = state.resolution_step(s, {"id": 2, "category": "bash", "type": "bash_outcome", "tool": "bash", "session_id": "s"})
    assert out == [] and s["error"] == [1, "read", 9]
    s, out = state.resolution_step(s, {"id": 3, "category": "file", "type": "file_edit", "tool": "edit", "session_id": "s"})
    assert s["error"] is None and out[0]["error_id"] == 1 and out[0]["after"] == 2
    s, _ = state.resolution_step(s, {"id": 4, "category": "error", "type": "error_tool", "tool": "", "session_id": "s"})
    s, out = state.resolution_step(s, {"id": 5, "category": "file", "type": "file_edit", "tool": "edit", "session_id": "s"})
    assert [o["error_id"] for o in out] == [4]
    s = None
    verdicts = []
    for i in range(10):
        s, out = state.flood_step(s, {"session_id": "s", "id": i, "at": i * 1_000_000})
        verdicts.append(out[0]["verdict"])
    assert verdicts == ["pass"] * 3 + ["slow"] * 5 + ["block"] * 2
    assert state.flood_step(s, {"session_id": "s", "id": 11, "at": 70_000_000})[1][0]["n"] == 1
    s, out = None, []
    for i, p in enumerate([2, 1, 3, 2]):
        s, more = state.evict_step(s, {"session_id": "s", "id": i, "priority": p}, 2)
        out += more
    assert [o["id"] for o in out] == [1, 0]


def test_batches(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).withColumn("data", F.lit(""))
    carried = {r.id: r.project for r in state.carried_projects(df).collect()}
    assert carried == {r.id: r.project for r in state.carried_projects(df, width=7).collect()}
    s, want = {}, {}
    for r in sorted(rows()):
        s[r[1]], (o,) = state.carry_step(s.get(r[1]), {"session_id": r[1], "id": r[0], "project_dir": r[6], "attribution_confidence": r[7]})
        want[r[0]] = o["project"]
    assert carried == want
    last = {}
    for r in sorted(rows()):
        if r[6] and (r[7] or 0) >= 0.55:
            last[r[1]] = r[6]
        assert carried[r[0]] == (r[6] or last.get(r[1]))
    assert state.flood_verdicts(df).count() == 300
    assert state.evicted_events(df, 20).count() == 300 - 4 * 20
    assert state.retry_loops(df, 2).count() > 0 and state.resolved_errors(df).count() > 0


def run(query, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    import datetime as dt

    data = rows(60)
    for k in range(3):  # files in order, one a micro-batch
        spark.createDataFrame(data[k * 20 : k * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = [(10_000, "zz", "a", "x", "file", 1, "/p", 0.9, 1, dt.datetime(2026, 1, 1))]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = run(streaming.windowed_counts(stream()), "w")
    assert sum(r.events for r in counts) == 60
    bursts = run(streaming.session_bursts(stream(), "10 seconds"), "b")
    assert all(r["size"] >= 2 for r in bursts)
    got = run(streaming.stateful(stream(), "session_id", "id", state.dedup_step, "session_id string, id long, type string, data_hash string", ["type", "data_hash"]), "d")
    assert sorted(r.id for r in got) == [*model(data), 10_000]


def test_order_in_blocks(spark):
    from pyspark.sql import functions as F

    from quarry.operators import dashboard as d
    from quarry.operators.ordered import id_block, with_previous

    df = spark.createDataFrame(rows(), SCHEMA).withColumn("type", F.element_at(F.array(F.lit("file_write"), F.lit("error_tool"), F.lit("file_edit")), (F.col("id") % 3 + 1).cast("int")))
    last, want = {}, {}
    for r in sorted(rows()):
        want[r[0]], last[r[1]] = last.get(r[1]), r[0]
    for width in (1, 10, 1_000_000):
        got = with_previous(df, ["session_id"], ["id"], id_block(width), F.col("id"), "before")
        assert {r.id: r.before for r in got.collect()} == want
    a, b = ({r.session_id: r.cycles for r in d.edit_test_cycles(df, w).collect()} for w in (5, 1_000_000))
    assert a == b and sum(a.values()) > 0
    runs = [sorted((r.first_id, r["size"], r.seconds) for r in d.bursts(df, 20, ("file_write", "error_tool", "file_edit"), keys, block).collect()) for keys in (("session_id",), ()) for block in (15, 100_000)]
    assert runs[0] == runs[1] and runs[2] == runs[3] and len(runs[2]) == 1 and runs[2][0][1] == 300
    spread = df.withColumn("created_at", F.timestamp_seconds(F.col("id") * 50))
    assert d.bursts(spread, 20, ("file_write",), (), 15).count() == spread.where("type = 'file_write'").count()
    assert d.bursts(df.limit(0), 20).count() == 0 and d.edit_test_cycles(df.limit(0)).count() == 0


def test_commits_are_commits(spark):
    from quarry.operators import dashboard as d

    df = spark.createDataFrame([("git", "commit"), ("git", "git status"), ("git", "cd x && GIT -C y commit -m 'a'"), ("git_commit", "commit"), ("git", "git push; npm run commit"), ("git", None)], "type string, data string")
    assert [r.c for r in df.select(F_coalesce(d.is_commit()).alias("c")).collect()] == [True, False, True, False, False, False]


def F_coalesce(c):
    from pyspark.sql import functions as F

    return F.coalesce(c, F.lit(False))


def test_rows_by_hand(spark):
    """Rows whose results follow from the rules, not from another engine."""
    import datetime as dt

    from quarry.operators import dashboard as d
    from quarry.operators import extract as x
    from quarry.operators import lifecycle as l
    from pyspark.sql import functions as F

    t = dt.datetime(2025, 1, 1)
    meta = spark.createDataFrame([("a", "/p", t, t + dt.timedelta(minutes=30), 5, 1), ("b", "/q", t + dt.timedelta(days=1), None, 2, 0)], "session_id string, project_dir string, started_at timestamp, last_event_at timestamp, event_count long, compact_count long")
    log = [(1, "a", "git", "git", "git status", 1), (2, "a", "git", "git", "commit", 10), (3, "a", "file_write", "file", "/p/x.py", 11), (4, "a", "error_tool", "error", "Error: no", 12), (5, "b", "resume_opened", "resume", "r", 20), (6, "a", "rejected", "rejected-approach", "Bash: too slow", 21), (7, "a", "resume_opened", "resume", "r", 22), (8, "b", "tool_latency", "tool", "x", 23)]
    events = spark.createDataFrame([(i, s, k, c, v, "/p", 1, 40 * i, t + dt.timedelta(minutes=m)) for i, s, k, c, v, m in log], "id long, session_id string, type string, category string, data string, project_dir string, bytes_avoided long, bytes_returned long, created_at timestamp")
    assert [tuple(r) for r in d.time_to_commit(events, meta).collect()] == [("a", 10.0)]
    assert {r.session_id: r.commits for r in d.commits_per_session(events, meta).collect()} == {"a": 1, "b": 0}
    assert [tuple(r) for r in d.edit_test_cycles(events).collect()] == [("a", 1)]
    assert [tuple(r) for r in d.rejections(events).collect()] == [("Bash", 1)]
    assert {r.session_id: r.claimed for r in l.claims(l.resumes(events)).collect()} == {"a": 5, "b": 7}
    assert {r.session_id: r.consumed for r in l.resumes(events).collect()} == {"a": False, "b": True}
    assert l.latest_session(meta).first()[0] == "b" and l.latest_session_events(events, meta).count() == 2
    assert l.scoped(events, None).count() == 8 and l.scoped(events, "/p/").count() == 8 and l.scoped(events, "/z").count() == 0
    assert [tuple(r) for r in l.marker_bytes(events.where("session_id = 'b'")).collect()] == [("b", None, 1, 200)]
    one = spark.createDataFrame([("*** Begin\n*** Add File: a/b.py\n*** Update File: c.py\n*** Move to: d.py\n*** Update File: c.py",)], "p string")
    assert [tuple(r) for r in one.select(x.patch_targets("p").alias("t")).first().t] == [("a/b.py", "file_write"), ("c.py", "file_edit"), ("d.py", "file_edit")]
    masked = spark.createDataFrame([('{"api_key": "x\\"y", "a": {"Token": 12, "b": "c"}}',)], "j string").select(x.masked_arguments("j")).first()[0]
    assert masked == '{"api_key": "[REDACTED]", "a": {"Token": "[REDACTED]", "b": "c"}}'
    pairs = spark.createDataFrame([('{"b": 1, "a": "x", "c": {"d": 2}}',), ("no",)], "j string").select(x.metadata_pairs("j").alias("p")).collect()
    assert [r.p for r in pairs] == ["a:x b:1", None]
    prices = spark.createDataFrame([("m-1", 5), ("m", 3)], "n string, v int")
    asked = spark.createDataFrame([("m-1",), (" Shop/M-1-preview",), ("m-2",), ("z",), (None,)], "k string")
    assert {r.key: r.value for r in l.catalog_lookup(asked, "k", prices, "n", "v").collect()} == {"m-1": 5, " Shop/M-1-preview": 5, "m-2": 3, "z": None}
    numbers = spark.createDataFrame([(-1.0,), (None,), (float("nan"),), (2.7,)], "x double")
    assert [r.c for r in numbers.select(l.clamped(F.col("x")).alias("c")).collect()] == [0, 0, 0, 2]


def test_shard_keys(spark):
    from pyspark.sql import functions as F

    from quarry.sources.store import shard_key

    df = spark.createDataFrame([("/A/b", "w1"), ("/a/b/", None), ("\\a\\b", "")], "p string, s string")
    plain = [r[0] for r in df.select(shard_key(F.col("p"))).collect()]
    assert plain[0] != plain[1] == plain[2] and all(len(k) == 16 for k in plain)
    folded = [r[0] for r in df.select(shard_key(F.col("p"), F.col("s"), True)).collect()]
    assert folded[0] == folded[1] + "__w1" and folded[1] == folded[2]
