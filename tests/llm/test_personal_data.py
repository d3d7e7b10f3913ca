"""Personal data: base spans by the patterns themselves, what the model adds, and message passing against enumeration."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklark.llm import personal_data as pd13

from ..conftest import SF

#: The base patterns as they are defined.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """(kind, start, end) by the patterns, as `re` finds them."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items(), 1):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": all(int(g) <= 255 for g in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(3)
    atoms = ["a", "b.c", "@", ".", "-", "+", " ", "\n", "1", "23", "255", "256", "0", "1.2.3.4", "@@", "x@y.z", "+1 (443) 555-5793", "4111 1111 1111 1111", "4111111111111112", "é", "٣", "%", "(", ")", "..", "00.00.000.1"]
    for _ in range(4000):
        text = "".join(r.choices(atoms, k=r.randrange(14)))
        assert pd13.base_spans(text) == plain(text), text
    for row in open_texts():
        assert pd13.base_spans(row) == plain(row)


def open_texts():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()


def test_hostile_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+" * 300_000, "+1 " * 100_000, "x@" * 100_000, "1 " * 200_000 + "me@x.de"):
        base = pd13.base_spans(text)
        pd13.added([text], [base or [(1, 0, 1)]], pd13.Model())


def test_messages_give_exact_beliefs_on_trees():
    r = np.random.default_rng(0)
    unary, edges = r.normal(size=(6, 3)), np.array([(0, 1), (1, 2), (1, 3), (3, 4), (3, 5)])
    pair = r.normal(size=(5, 3, 3))
    want = np.zeros((6, 3))
    for labels in itertools.product(range(3), repeat=6):
        w = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(p[labels[i], labels[j]] for (i, j), p in zip(edges, pair, strict=True)))
        for i, x in enumerate(labels):
            want[i, x] += w
    assert np.allclose(pd13.beliefs(unary, edges, pair, 200), want / want.sum(1, keepdims=True), atol=1e-3)


FOUND = [
    ("call +1 (443) 555-5793 or 443-555-5793 today", ["443-555-5793"]),
    ("call +1 (443) 555-5793 then, long after, " + "word " * 500 + "again (443) 555-5793.", ["(443) 555-5793"]),
    ("443.555.5793 is also +1 (443) 555-5793", ["443.555.5793"]),
    ("reach +49 170 1234567 or 0170 1234567 or 170/1234567", ["0170 1234567", "170/1234567"]),
    ("mail ann.lee@mail4.example.com or Ann.Lee (at) mail4 (dot) example (dot) com", ["Ann.Lee (at) mail4 (dot) example (dot) com"]),
    ("ann@x.example.com, later ann at x dot example dot com", ["ann at x dot example dot com"]),
    ("host 106.158.249.239 alias 106[.]158[.]249[.]239", ["106[.]158[.]249[.]239"]),
    ("card 4111111111111111 typed 4111.1111.1111.1111", ["4111.1111.1111.1111"]),
]
CLEAN = [
    "order 4756555320544448 and 4756555320544448 again",
    "call 443-555-5793",
    "card 4111111111111111 but 4111.1111.1111.1112",
    "host 10.1.23.4 and version 101-2-34 and 10.12.3.400",
    "phone +1 (443) 555-5793 and order 443-555-5794",
    "ann@x.example.com is at x.example.com, look at x.example.com",
    "on 2024-01-02 1234567 people, +1 (443) 555-5793, 2024-01-02",
    "",
]


@pytest.fixture(scope="module")
def model(spark):
    return pd13.train(spark.read.parquet(f"{SF}/documents.parquet"))


def extra(text, model):
    base = pd13.base_spans(text)
    return [text[a:b] for _, a, b in pd13.added([text], [base], model)[0]]


@pytest.mark.parametrize("case", FOUND)
def test_other_writings_of_a_base_span_are_added(model, case):
    assert extra(case[0], model) == case[1]


@pytest.mark.parametrize("text", CLEAN)
def test_what_nothing_supports_stays_out(model, text):
    assert extra(text, model) == [] and extra(text, pd13.Model()) == []


def test_skip_edges_are_few_and_reach_the_base_span():
    text = "+1 (443) 555-5793 " + ("w " * 100 + "443 555 5793 ") * 50
    found = pd13.mentions(text, pd13.base_spans(text))
    skip = pd13.links(found)[1]
    assert {(i, j) for i, j, _ in skip} == {(0, j) for j in range(1, 51)} | {(j, j + 1) for j in range(1, 50)}
    assert len(extra(text, pd13.Model())) == 50


def test_repeats_without_a_base_span_do_not_support_each_other():
    text = "+1 (443) 555-5793 " + "4756555320544448 " * 40 + "(555) 123-4567 " * 40
    assert extra(text, pd13.Model(agree=np.array([3.0, 3.0]))) == []


def test_edges(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (None, "me@x.de", "x"), (4, "é me@x.de", "x"), (4, "é me@x.de", "x"), (5, "word " * 200_000 + "+1 (443) 555-5793", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pd13.personal_data(docs, model)
    assert got.columns == ["doc_id", "text", "spans"] and got.count() == len(rows)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in got.collect()}
    assert spans == {1: [], 2: [], None: [("email", 0, 7, True)], 4: [("email", 2, 9, True)], 5: [("phone", 1_000_000, 1_000_017, True)]}
    assert pd13.personal_data(docs.limit(0), model).count() == 0
    nothing = pd13.train(docs.limit(0))
    assert not nothing.weights.any() and pd13.personal_data(docs, nothing).count() == len(rows)


def test_learning_tells_numbers_that_fail_their_check(spark):
    texts = [f"pay {n} now" for n in range(4111111111111100, 4111111111111200)] + [f"call +1 (443) 555-{n}" for n in range(1000, 1050)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    learnt = pd13.train(docs)
    score = lambda t, a, b: learnt.weights[pd13.features(t, a, b)].sum(0)
    assert score("pay 4111111111111112 now", 4, 20).argmax() == 0
    assert score("call +1 (443) 555-9999", 5, 22).argmax() == 4


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    rows = pd13.op13_personal_data(spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        base = [(list(PATTERNS)[k - 1], a, b) for k, a, b in plain(docs[row.doc_id])]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(row.spans.split(","))
