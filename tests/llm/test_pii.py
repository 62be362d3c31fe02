import numpy as np
import pytest

from quarry.llm.boost import Boosted
from quarry.llm.pii import Redactor, find_personal, placeholders, redact_personal


@pytest.fixture(scope="module")
def model():
    return Redactor()


YES = [
    ("Reported by ", "Zanaix Mailvik", "name", " on Tuesday."), ("cc ", "z.veskez [at] lafax [dot] test", "email", ""), ("If it fails again, call ", "+999 (0)55 / 01 34 24", "phone", "."), ("The form lists passport ", "935-63-7008", "id_number", ""),
    ("Ship the device to ", "29c Vidailmoor Lane", "address", ", Pumoskford."), ("address changed to '", "P.O. Box 313", "address", ", Sainville'"), ("Adresse de livraison : ", "178, rue du Zokoubrook", "address", ", 40630 Drarmere."), ("mail=", "droxberg87@corp.lapin.example", "email", ""),
]
FURTHER = [
    ("Reach me: my cell is ", "415-867-5309", "phone", ", day or night."), ("Mr. ", "Zhang Wei", "name", " signed the lease."), ("请联系", "张伟", "name", "先生。"), ("担当は", "佐藤健一", "name", "さんです。"), ("Отчёт подготовил ", "Иван Петров", "name", "."), ("住所: ", "東京都港区芝3-4-5", "address", "\n"), ("寄到", "北京市朝阳区建设路12号", "address", "。"), ("Адрес: ", "ул. Ленина, 15", "address", "."),
    ("Contact ", "Amber Novak", "name", " about it."), ("On 2026-03-01 ", "0170 1234567", "phone", " called."), ("Prof. ", "Grace Hopper", "name", " wrote the compiler."), ("Best,\n", "Tom Baker", "name", "\n"), ("Anschrift: ", "Lindenallee 4", "address", ", Bonn"), ("SSN ", "078-05-1120", "id_number", " was printed on it."),
]
NO = ["1600 Amphitheatre rows are cached.", "The Das Protokoll endet heute.","The Amber Falcon release replaces Copper Heron.", "Build 2025.04.08-270 shipped.", "Trace 992-40-7791-02 is lost.", "Pinned nouvar@2.4.1 and constraint@0.4.4.", "Host 10.7.0.12 answers on 8080.", "Decorate it with @cached or @retry.", "Clone git@mq8.plivousk.example:a/b.git first.", "A row locks at once.", ""]


@pytest.mark.parametrize("before,span,kind,after", YES)
def test_found(model, before, span, kind, after):
    text = "Ünï \U0001f600\n" + before + span + after
    assert (len("Ünï \U0001f600\n" + before), kind) in [(a, k) for a, _, k in model.select([text])[0]]


def test_forms_of_other_texts(model):
    got = [(len(b), k) in [(a, kind) for a, _, kind in model.select([b + x + c])[0]] for b, x, k, c in FURTHER]
    assert sum(got) >= 0.9 * len(got), [f for f, ok in zip(FURTHER, got) if not ok]
    street = "Send it to 1600 Amphitheatre Parkway, Mountain View."
    assert all(k != "name" for _, _, k in model.select([street])[0])


def test_scores_are_probabilities(model):
    """On texts of the grammar that training never saw, scores spread and their mean is the share of true cases."""
    from quarry.llm.train_pii import Grammar

    grammar, scores, true = Grammar(4711), [], []
    for _ in range(400):
        text, spans = grammar.text()
        own = [c for c in model.generator.propose(text) if c.kind == "name"]
        if own:
            scores += model.score("name", np.array([c.x for c in own])).tolist()
            true += [(c.start, c.end, "name") in set(spans) for c in own]
    p, y = np.array(scores), np.array(true)
    assert abs(p.mean() - y.mean()) < 0.05 and ((p > 0.1) & (p < 0.9)).mean() > 0.02
    assert (y[p > 0.5].mean() > 0.9) and ((p > 0.5) & y).sum() / y.sum() > 0.9


def test_many_spans_in_linear_time(model):
    from time import process_time

    text = "Ask Anna Miller, call 555-867-5309. " * 6000
    at = process_time()
    assert len(model.select([text])[0]) > 6000 and process_time() - at < 60


def test_not_found(model):
    assert model.select(NO) == [[] for _ in NO]


def test_boosting_learns():
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = Boosted.fit(x[:2000], y[:2000], trees=40)
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    again = Boosted.load(m.state())
    assert np.abs(again.score(x) - m.score(x)).max() < 0.01


def test_rows(spark, model):
    text = "Reported by Zanaix Mailvik on Tuesday."
    long = "The index reads again.\n" * 10_000 + text
    rows = [(1, text, "c"), (1, text, "c"), (2, None, "c"), (None, text, "c"), (3, "", "c"), (4, long, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted((r.doc_id, r.kind, r.start_at) for r in find_personal(df).collect()) == [(1, "name", 12), (4, "name", len(long) - len(text) + 12)]
    red = {r.doc_id: r for r in redact_personal(df).collect()}
    assert red[1].text == "Reported by [NAME] on Tuesday." and red[3].text == ""
    assert find_personal(df.limit(0)).count() == 0
    assert placeholders("a b", []) == "a b"
