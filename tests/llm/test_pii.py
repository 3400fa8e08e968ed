"""Base spans against plain patterns, messages against enumeration, and what the field adds."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from buylens.llm import pii, queries

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = sum(digits[-1::-2])
    return (odd + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def more(llm):
    return llm.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(more):
    return pii.trained(more)


def added(text, model):
    return [(pii.KINDS[k], text[a:b]) for k, a, b, new in pii.spans_of([text], model)[0] if new]


def test_base_spans_on_random_texts():
    rng = random.Random(9)
    pieces = ["a", "é", "@", ".", "-", "+", "(", ")", " ", "\n", "1", "22", "255", "256", "4111111111111111", "a.b@c.d", "x@y", "+1 (517) 555-0938", "10.0.0.1", "_", "%", "0"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert [(pii.KINDS[k], a, b) for k, a, b, new in pii.spans_of([text], pii.Field())[0] if not new] == plain(text), text


def test_query_has_the_base_spans(llm, docs):
    rows = {r.doc_id: r for r in queries.op12_pii(llm, SF).collect()}
    for doc in docs.collect():
        expected = [f"{k}:{a}:{b}" for k, a, b in plain(doc.text or "")]
        row = rows[doc.doc_id]
        assert set(expected) <= set(row.spans.split(",")) | {""}
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x.startswith(k + ":") for x in expected) for k in pii.KINDS]


def test_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(2)
    model = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), rng.normal(size=pii.LABELS), True)
    graph = pii.Graph()
    graph.add([b"+1", b"(517)", b"x5", b"555-5141", b"9"], [False, True, True, False, False], [-1, -1, 2, -1, -1])
    graph.links = [(0, 3), (3, 4)]
    own = model.scores(graph)
    weight = np.zeros((len(own), pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=len(own)):
        score = sum(own[i, k] for i, k in enumerate(y)) + sum(model.chain[y[a], y[b]] for a, b in graph.chain)
        score += sum(model.agree[y[a]] for a, b in graph.links if y[a] == y[b])
        for i, k in enumerate(y):
            weight[i, k] += np.exp(score)
    assert np.allclose(pii.marginals(model, graph), weight / weight.sum(1, keepdims=True), atol=1e-6)


def test_agreement_is_learnt(model):
    assert (model.agree[:4] > 0.5).all()


def test_later_mentions_are_found_by_their_links(model):
    text = "Call +1 (517) 555-0938 now. Some words between. Then (517) 555-0938 again."
    assert ("phone", "(517) 555-0938") in added(text, model)
    assert added("Then (517) 555-0938 again.", model) == []
    assert ("email", "dpkde.84(at)mail7.example.com") in added("From dpkde.84@mail7.example.com and later dpkde.84(at)mail7.example.com, too", model)
    assert ("card", "4918.1871.2863.5271") in added("Card 4918187128635271 and words, 4918.1871.2863.5271.", model)


def test_numbers_that_ran_together(model):
    assert ("phone", "+1 (578) 555-6437") in added("re +1 (578) 555-6437 4918187128635271 of", model)


def test_clean_numbers_are_left_alone(model):
    for text in ("In 1984, 12 of 300 rows.", "Version 2.10.3 of 2024-05-06 at 12:30:55", "id e79f99a2c46965bb42334432917e2a1a93390043", "1,234,567.89 and 1,234,567.89", ""):
        assert added(text, model) == [], text


def test_held_out_accuracy(more):
    """Words of documents outside the sample get the label of their base span from shape and neighbours alone."""
    right = total = 0
    other = pii.trained(more.where("doc_id % 2 = 0"))
    for row in more.where("doc_id % 2 = 1").collect():
        raw = (row.text or "").encode()
        words, seen, lost, _ = pii.labels_of(raw)
        graph = pii.Graph()
        graph.add([raw[a:b] for a, b, _ in words], [j for _, _, j in words], [-1] * len(words))
        best = pii.marginals(other, graph).argmax(1) if words else []
        for label, s, x in zip(best, seen, lost):
            if not x and s >= 0:
                right, total = right + (label == s), total + 1
    assert total > 40 and right >= 0.9 * total, (right, total)


def test_odd_rows(llm, odd, model):
    df = odd.withColumns({"pii": F.lit("clash"), "Added": F.lit(1)})
    out = pii.scanned(df, model)
    assert out.columns == [c for c in df.columns if c != "pii"] + ["pii"]
    assert out.count() == df.count()
    assert pii.scanned(df.limit(0)).collect() == []
    twice = llm.createDataFrame([(1, "a@b.cd 10.0.0.1"), (1, "a@b.cd 10.0.0.1"), (None, "a@b.cd 10.0.0.1")], "doc_id bigint, text string")
    assert len({str(r.pii) for r in pii.scanned(twice, model).collect()}) == 1


def test_long_texts_take_linear_time(model):
    for piece in ("1", "a", "1.", "+1 ", "a@", "(", "12-", "5551234 "):
        start = time.time()
        pii.spans_of([piece * 100_000], model)
        assert time.time() - start < 20, piece
