import random

from quarry.llm import packing as p

SCHEMA = "doc_id long, text string, capacity string, shard string, piece string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def plain_best_fit(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in range(len(left)) if left[b] >= sizes[i]]
        b = min(fits, key=lambda b: left[b]) if fits else len(left)
        if not fits:
            left.append(capacity)
        left[b] -= sizes[i]
        out[i] = b
    return out, left


def test_best_fit_like_the_plain_one():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.randint(1, 60)
        sizes = [r.randint(0, capacity) for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            sizes = [min(capacity, s // 3) for s in sizes]
        histogram = {s: sizes.count(s) for s in sizes}
        segments, bins = p.best_fit_decreasing(list(histogram.items()), capacity)
        used = [0] * bins
        for s, own in segments.items():
            ranks = [rank for first, items, *_ in own for rank in range(first, first + items)]
            assert sorted(ranks) == list(range(histogram[s]))
            for first, items, at, each in own:
                for k in range(items):
                    used[at + k // each] += s
        assert all(u <= capacity for u in used)
        assert sorted(used) == sorted(capacity - x for x in plain_best_fit(sizes, capacity)[1])


def test_same_bins_at_any_partitioning(spark):
    r = random.Random(8)
    docs = frame(spark, [(i // 2, "w " * r.choice([3, 3, 3, 7, 11, 64, 120])) for i in range(500)] + [(7, "x " * 45)] * 4)
    containers = spark.createDataFrame([(1, 20), (2, 100)], "container_id int, capacity int")
    for group in (1_000_000, 40):
        got = [sorted(map(tuple, p.pack(docs.repartition(n), containers, group=group).select("container_id", "bin_id", "doc_id", "piece", "n_tokens").collect())) for n in (1, 7)]
        assert got[0] == got[1]
        used = {}
        for c, b, _, _, n in got[0]:
            used[c, b] = used.get((c, b), 0) + n
        assert all(u <= (20 if c == 1 else 100) for (c, _), u in used.items())
        loads = sorted(used.values())
        assert group == 1_000_000 or loads == before
        before = loads


def test_pack(spark):
    r = random.Random(5)
    docs = [(i, "w " * r.randint(0, 30)) for i in range(400)] + [(1000, "x " * 95), (1001, ""), (None, "x"), (1002, None), (1003, "a_b c-d «é» 中文。")]
    containers = spark.createDataFrame([(1, "s", 20), (2, "l", 50), (3, "bad", 0), (None, "bad", 9)], "container_id int, label string, capacity int")
    rows = p.pack(frame(spark, docs), containers, group=150).collect()
    for c, capacity in ((1, 20), (2, 50)):
        own = [x for x in rows if x.container_id == c]
        used, pieces = {}, {}
        for x in own:
            used[x.bin_id] = used.get(x.bin_id, 0) + x.n_tokens
            pieces.setdefault(x.doc_id, []).append((x.first_token, x.n_tokens, x.n_pieces))
        assert max(used.values()) <= capacity and sum(used.values()) / (len(used) * capacity) > 0.93
        for d, t in docs:
            if d is not None and t is not None:
                n, own_pieces = len(p.TOKEN.findall(t)), sorted(pieces[d])
                assert sum(k for _, k, _ in own_pieces) == n and len(own_pieces) == own_pieces[0][2] == max(1, -(-n // capacity))
        assert len(pieces[1000]) == -(-95 // capacity) and None not in pieces and 1002 not in pieces
    found = p.split_documents(p.pack(frame(spark, docs), containers)).collect()
    assert {(x.container_id, x.doc_id) for x in found} == {(c, d) for c, cap in ((1, 20), (2, 50)) for d, t in docs if d is not None and t is not None and len(p.TOKEN.findall(t)) > cap}
    assert p.pack(frame(spark, []), containers).count() == 0 and p.pack(frame(spark, docs), containers.limit(0)).count() == 0
    full = p.fill(p.pack(frame(spark, docs), containers)).collect()
    assert all(x.fullest <= x.capacity and x.tokens == sum(len(p.TOKEN.findall(t)) for d, t in docs if d is not None and t is not None) for x in full)


def test_token_counts_agree(spark):
    texts = ["a_b c-d", "x\u00a0y\u3000z\u2028w\x1fv", "…—!? ok", "٣٤ ½ Ⅷ", "", "  ", "naïve Ünder_score 中文字"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    from pyspark.sql import functions as F

    got = {r.i: r.n for r in df.select("i", F.regexp_count("t", F.lit(p.TOKEN_JVM)).alias("n")).collect()}
    assert got == {i: len(p.TOKEN.findall(t)) for i, t in enumerate(texts)}


def test_pieces_restore_the_text():
    text = "  One two, three_x  four!\nfive "
    n = len(p.TOKEN.findall(text))
    assert "".join(p.piece_text(text, k, 2) for k in range(0, n, 2)) == text and p.piece_text("", 0, 3) == ""
