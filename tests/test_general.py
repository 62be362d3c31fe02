"""The general operators against brute force, and their defined results on odd rows."""

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.operators.eager import eager_rollup, heavy_keys
from quarry.operators.features import dominant_past_types, entity_features, feature_cells, flat_features
from quarry.operators.rolling import quiet_days_above, rolling_totals

SCHEMA = "id long, session_id string, type string, project_dir string, bytes_avoided long, bytes_returned long, created_at timestamp_ntz, __entity string, day string, n long, latest string"
T = dt.datetime(2025, 3, 1, 12)


def row(i, s="s1", t="file_read", p="/a", a=10, r=1, at=T, **x):
    return (i, s, t, p, a, r, at, "clash", "clash", 9, "clash")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def day(n):
    return T + dt.timedelta(days=n)


def test_rolling_matches_brute_force(spark):
    rows = [row(i, p="/a" if i % 3 else "/b", a=(i * 37) % 100, at=day((i * i) % 60)) for i in range(1, 80)]
    got = {(r.project_dir, r.day): r for r in rolling_totals(frame(spark, rows + rows[:10])).collect()}
    for p in ("/a", "/b"):
        own = defaultdict(int)
        for r in rows:
            if r[3] == p:
                own[r[6].date()] += r[4]
        first, last = min(own), max(own)
        days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
        assert {d for q, d in got if q == p} == set(days)
        for d in days:
            for w in (7, 30):
                want = sum(own.get(d - dt.timedelta(days=k), 0) for k in range(w))
                assert got[p, d][f"bytes_avoided_sum_{w}"] == want
                assert abs(got[p, d][f"bytes_avoided_avg_{w}"] - want / w) < 1e-9


def test_rolling_odd_rows(spark):
    rows = [row(1), row(1), row(2, p=None), row(3, p=""), row(4, at=None), row(5, a=None, r=None, at=day(1)), row(None, a=99)]
    got = rolling_totals(frame(spark, rows)).orderBy("day").collect()
    assert [(r.n_records, r.bytes_avoided, r.bytes_avoided_sum_7) for r in got] == [(1, 10, 10), (1, 0, 10)]
    assert rolling_totals(frame(spark, [])).count() == 0


def test_quiet_days(spark):
    rows = [row(1, a=0, at=day(0)), row(2, a=700, at=day(40)), row(3, a=0, at=day(60))]
    found = {r.day for r in quiet_days_above(rolling_totals(frame(spark, rows))).collect()}
    assert found == {str(day(k).date()) for k in range(41, 47)}


def test_features(spark):
    rows = [row(1, t=" File-Read ", a=5, at=day(0)), row(2, t="file_read", a=50, at=day(1)), row(3, t="FILE_READ", a=None, at=None), row(4, t="git", a=1, at=day(9)), row(5, t=None, a=2, at=day(3)), row(6, s=None), row(4, t="git", a=1, at=day(9))]
    meta = spark.createDataFrame([("s1",), ("s2",), (None,)], "session_id string")
    table = entity_features(frame(spark, rows), meta)
    ends = {r.session_id: r for r in table.collect()}
    assert set(ends) == {"s1", "s2"} and ends["s2"].n_records == 0 and ends["s1"].total == 58 and ends["s1"].n_records == 5
    cells = {r.type: r for r in feature_cells(table).collect()}
    assert cells["file_read"].n == 3 and cells["file_read"].total == 55 and cells["file_read"].recency_s == 8 * 86400
    assert [(r.session_id, r.type) for r in dominant_past_types(feature_cells(table)).collect()] == [("s1", "file_read")]
    flat = {r.session_id: r for r in flat_features(table, ["file_read", "nothing"]).collect()}
    assert flat["s1"].n_file_read == 3 and flat["s2"].n_file_read == 0 and flat["s1"].n_nothing == 0
    assert feature_cells(entity_features(frame(spark, []), meta)).count() == 0


def test_eager_rollup_equals_the_join(spark):
    rows = [row(i, s=f"s{i % 3}", p="/a" if i % 2 else "", a=i) for i in range(1, 30)] + [row(40, s=None, p=None, a=None)]
    meta = spark.createDataFrame([("s0", 3, 1), ("s1", 5, None), ("s1", 7, 2), (None, 9, 9)], "session_id string, event_count long, compact_count long")
    events = frame(spark, rows + rows[:5])
    joined = frame(spark, rows).join(meta, "session_id", "left").groupBy("project_dir").agg(F.count("*").alias("n"), F.sum(F.coalesce("event_count", F.lit(0))).alias("ec")).collect()
    got = {(r.field, r.key_value): r for r in eager_rollup(events, meta).collect()}
    for r in joined:
        if r.project_dir is not None:
            assert got["project_dir", r.project_dir].n_joined == r.n and got["project_dir", r.project_dir].event_count == r.ec
    assert got["session_id", "s1"].n_records == 10 and got["session_id", "s1"].n_joined == 20 and got["session_id", "s1"].n_total == 30
    assert ("project_dir", None) not in got
    heavy = {(r.field, r.key_value) for r in heavy_keys(eager_rollup(events, meta), 40).collect()}
    assert heavy == {("project_dir", "/a"), ("project_dir", "")}
    assert eager_rollup(frame(spark, []), meta).count() == 0
