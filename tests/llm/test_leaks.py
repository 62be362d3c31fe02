import random

from quarry.llm import leaks as k

SCHEMA = "doc_id long, text string, item_id string, edits string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "item_id long, text string, doc_id string")


def levenshtein_part(p, t):
    """Least distance of p to a part of t, by the plain table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers():
    r = random.Random(2)
    for _ in range(300):
        p, t = ("".join(r.choices("abc", k=r.randint(0, n))) for n in (9, 30))
        want = levenshtein_part(p, t) if p else 0
        assert k.myers(p, t, 4) == min(want, 5)
    assert k.myers("x" * 200, "y" + "x" * 199 + "z", 3) == 1


def test_found_like_brute_force(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    tests = [(i, " ".join(r.choices(vocab, k=r.randint(12, 40)))) for i in range(8)]
    docs = []
    for d in range(120):
        words = r.choices(vocab, k=60)
        if d % 3 == 0:
            _, t = r.choice(tests)
            w = t.split()
            n = r.randint(8, len(w))
            a = r.randint(0, len(w) - n)
            words[20:20] = w[a : a + n]
        text = r.choice([" ", "\n", ", ", "  "]).join(words)
        docs.append((d, text.upper() if d % 5 == 0 else text))

    def grams(t):
        w = k.words(t).split()
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(i, d) for i, t in tests for d, x in docs if grams(t) & grams(x)}
    got = k.leaked_items(frame(spark, docs + docs[:5]), items(spark, tests + tests[:2])).collect()
    assert {(x.item_id, x.doc_id) for x in got if x.common_words >= 12} == want
    small = k.leaked_items(frame(spark, docs), items(spark, tests), block_chars=200).collect()
    assert {(x.item_id, x.doc_id, x.common_words) for x in small} == {(x.item_id, x.doc_id, x.common_words) for x in got}


def test_edits_and_odd_rows(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, t.replace("three", "thrae")), (2, "x " + t.replace(" ", "--").title()), (3, None), (None, t), (4, ""), (5, t.replace("three", "3").replace("nine", "9")), (6, "a " * 100_000 + t)]
    got = {x.doc_id: x for x in k.leaked_items(frame(spark, docs), items(spark, [(1, t), (2, None), (None, "x"), (3, ""), (4, "!!")])).collect()}
    assert set(got) == {1, 2, 6} and got[1].edits == 1 and got[1].common_words == 0 and got[2].common_words == 13 and got[6].edits == 0
    assert k.leaked_items(frame(spark, []), items(spark, [(1, t)])).count() == 0
    assert k.leaked_items(frame(spark, docs), items(spark, [])).count() == 0


def test_one_edit_anywhere():
    w = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()
    known = k.Items([(1, " ".join(w))], 12, 1)
    line = " ".join(w)
    for i in range(len(line)):
        for text in (line[:i] + line[i + 1 :], line[:i] + "x" + line[i:], line[:i] + "x" + line[i + 1 :]):
            assert [(item, edits <= 1) for item, edits, _, _ in known.found(f"so {text} it")] == [(1, True)], text


def test_recall_of_edited_passages():
    r = random.Random(21)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(300)]
    tests = {i: " ".join(r.choices(vocab, k=r.randint(12, 15))) for i in range(4)}
    known, want, got = k.Items(list(tests.items()), 12, 1), set(), set()
    for d in range(60):
        item = r.choice(list(tests))
        w = tests[item].split()
        a = r.randint(0, len(w) - 12)
        passage = list(" ".join(w[a : a + 12]))
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(passage))
            passage[at : at + 1] = r.choice([[], ["x"], [passage[at], " "], ["q", passage[at]]])
        text = f" {' '.join(r.choices(vocab, k=2))} {''.join(passage)} {' '.join(r.choices(vocab, k=2))} "
        got |= {(d, i) for i, *_ in known.found(text)}
        for i, t in tests.items():
            tw = t.split()
            if any(levenshtein_part(" ".join(tw[p : p + 12]), k.words(text)) <= 1 for p in range(len(tw) - 11)):
                want.add((d, i))
    assert len(want) > 30 and len(got & want) >= 0.99 * len(want) and not got - want
