import random

from quarry.llm import formatting as f

SCHEMA = "id long, type string, data string, h1 string, copies string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def test_canonical_pairs():
    same = [
        ("a:1 b:2", "b=2; a = 1"), ("a:1 b:2", "A: 1\nB: 2"), ("a:1 b:2", "b:2 | a:1"), ("Ab c", "ab\u2009C!"), ("x_y", "`X y`"), ("src/a.go", "(src\\a.go)"),
        ('{"a":1,"b":{"c":[1,2],"d":"x y"}}', "{'B' : {'D' : 'X  y' ,'c' : ['1' ,2]} ,'a' : 1.}"), ('{"a":true}', '{\n "A": TRUE\n}'), ("STRASSE", "straße"), ("e\u0301", "\u00e9"), ("", "..."), ('{"n":"it\'s {x}"}', '{"n": "its x"}'),
        ("auth:k0== lines:7", "lines: 7, auth: k0=="), ("a:1 b:2", "“b: 2, a: 1”"), ("a:1 b:2", '> "b": "2", "a": "1".'), ("a:1 b:2", " - b=2 - a=1"),
    ]
    differ = [("a:1 b:2", "a:2 b:1"), ('{"t":["a","b"]}', '{"t":["b","a"]}'), ('{"from":"a","to":"b"}', '{"from":"b","to":"a"}'), ("a b", "b a"), ("a:1 b:2 c", "b:2 a:1 c"), ("see x:1 y:2", "see y:2 x:1")]
    for a, b in same:
        assert f.canonical(a) == f.canonical(b), (a, b)
    for a, b in differ:
        assert f.canonical(a) != f.canonical(b), (a, b)


def test_reordered_objects_are_equal():
    r = random.Random(1)

    def write(v, loose):
        if isinstance(v, dict):
            items = list(v.items())
            if loose:
                r.shuffle(items)
            q = r.choice("\"'") if loose else '"'
            return "{" + (" , " if loose else ",").join(f"{q}{k.upper() if loose else k}{q}:{write(x, loose)}" for k, x in items) + "}"
        if isinstance(v, list):
            return "[" + ",".join(write(x, loose) for x in v) + "]"
        return f'"{v}"'

    for _ in range(100):
        v = {f"k{i}": r.choice([f"v{r.randint(0, 99)}", {"a": "1", "b": ["x", "y"]}, ["p", "q"]]) for i in range(r.randint(1, 5))}
        assert f.canonical(write(v, False)) == f.canonical(write(v, True))


def test_sets(spark):
    rows = [(5, "File-Read", "x:1 y:2"), (2, " file_read", "Y=2, X=1"), (2, " file_read", "Y=2, X=1"), (9, "git", "x:1 y:2"), (1, None, "x"), (3, "git", None), (None, "git", "z"), (7, "git", ""), (8, "git", " . "), (4, "git", "q" * 200_000), (6, "git", "Q " * 200_000)]
    keys = f.canonical_keys(frame(spark, rows))
    assert sorted((r.keep_id, r.copies) for r in f.copy_sets(keys).collect()) == [(2, 2), (4, 2), (7, 2), (9, 1)]
    found = f.members(keys).where("id <> keep_id").select("keep_id", "id").collect()
    assert sorted(map(tuple, found)) == [(2, 5), (4, 6), (7, 8)]
    assert f.collisions(f.copy_sets(keys)).count() == 0
    assert f.collapse_formatting(frame(spark, [])).count() == 0


def test_collisions_split(spark):
    keys = spark.createDataFrame([(1, 7, 7, 1), (2, 7, 7, 2), (3, 7, 7, 2)], "id long, h1 long, h2 long, proof long")
    assert sorted((r.keep_id, r.copies) for r in f.copy_sets(keys).collect()) == [(1, 1), (2, 2)]
    assert f.collisions(f.copy_sets(keys)).first().texts == 2


def test_hot_set(spark):
    keys = spark.range(1, 250_001).selectExpr("id", "1L h1", "2L h2", "3L proof")
    r = f.members(keys).selectExpr("min(keep_id) a", "max(keep_id) b", "count(*) n").first()
    assert (r.a, r.b, r.n) == (1, 1, 250_000)


def test_values_of_several_words():
    same = ['a: "x y", b: z', "b: z | a: x y", "B = z;A='X  Y'", "b: z\na: x y"]
    assert len({f.canonical(t) for t in same}) == 1
    assert f.canonical("see this: a b, then that") != f.canonical("then that, see this: a b")
    assert f.canonical("a: x y, b: z") != f.canonical("a: z, b: x y")
