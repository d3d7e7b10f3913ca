"""Near-duplicate texts and vectors against brute force; components; edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklark.llm import linking, skew
from tracklark.llm.components import components
from tracklark.llm.embedding_duplicates import axes_needed, cosine_at_least, count_needed, embedding_duplicates, lists_needed
from tracklark.llm.near_duplicates import band_plan, jaccard_at_least, near_duplicates, one_of_each_group
from tracklark.llm.skew import join_counted
from tracklark.llm.text import WordHashes, shingles, words

DOCS = "doc_id long, text string, note string"


def runs(text):
    w = words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = [runs(t) for _, t, _ in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, near in enumerate(links):
            root[i] = min([root[i], *(root[j] for j in near)], key=lambda k: rows[k][0])
    return links, root


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(12):
        text = r.choices(vocabulary, k=r.choice([3, 8, 60, 200]))
        for copy in range(base % 5):
            edited = [w if r.random() > 0.01 else r.choice(vocabulary) for w in text]
            rows.append((len(rows) * 3, " ".join(edited) if copy else "  ".join(edited).upper(), "x"))
        rows.append((len(rows) * 3, " ".join(text), "x"))
    # a crowded group of near copies, more than one block
    text = r.choices(vocabulary, k=120)
    for i in range(40):
        edited = list(text)
        edited[r.randrange(120)] = f"new{i}"
        rows.append((1000 + i, " ".join(edited), None))
    return [*rows, (5000, None, None), (5001, "", None), (5002, " \t", None), (5003, "one", None), (5004, "ONE", None), (5005, "one two", None), (5006, "z " * 30_000, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.mark.parametrize(("block", "tile", "most"), [(2048, 384, 64 << 20), (16, 384, 6000), (16, 5, 2000), (2048, 7, 1)])
def test_links_are_those_of_brute_force(docs, monkeypatch, block, tile, most):
    monkeypatch.setattr(linking, "BLOCK", block)  # many blocks, many tiles
    monkeypatch.setattr(linking, "TILE", tile)
    monkeypatch.setattr(linking, "BYTES", most)  # groups of a few texts, or of two
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    links, root = brute(corpus())
    rows = corpus()
    assert {i: got[i].n_links for i, _, _ in rows} == {rows[k][0]: len(links[k]) for k in range(len(rows))}
    assert {i: got[i].component_id for i, _, _ in rows} == {rows[k][0]: rows[root[k]][0] for k in range(len(rows))}
    assert {i for i, r in got.items() if r.kept} == {rows[k][0] for k in set(root)}


def test_one_document_of_each_group_stays(spark, docs):
    again = docs.union(docs.where("doc_id = 1000")).union(spark.createDataFrame([(None, "null id text goes here now", None), (None, "null id text goes here now", None)], DOCS))
    kept = one_of_each_group(again)
    assert kept.columns == docs.columns
    rows = corpus()
    want = sorted(rows[k][0] for k in set(brute(rows)[1]))
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == want
    assert got.count(None) == 1


@pytest.mark.parametrize("ids", [(None, None, None), (7, 7, 7), (None, 7, 7)])
def test_one_of_near_copies_under_null_or_shared_ids(spark, ids):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(i, f"{text} end{k}", None) for k, i in enumerate(ids)] + [(9, "another text of some words", None)]
    got = one_of_each_group(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 2 and [r.doc_id for r in got if r.doc_id != 9] == [max(ids, key=lambda i: i is not None)]
    told = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.kept for r in told) == 2


def test_empty_tables(spark, docs):
    assert near_duplicates(docs.limit(0)).count() == 0
    assert one_of_each_group(docs.limit(0)).count() == 0
    assert one_of_each_group(docs.where("doc_id > 5000 and doc_id < 5003")).count() == 2


def test_band_plan():
    bands, rows = band_plan(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_verifier():
    h = WordHashes()
    sets = [shingles(h.of(words(" ".join(f"w{i}" for i in range(k, k + 100))))).tobytes() for k in (0, 2, 50, 0)]
    want = np.array([[True, True, False, True], [True, True, False, True], [False, False, True, False], [True, True, False, True]])
    for cells in (7, 1 << 20):
        verify = jaccard_at_least(0.8, cells)
        for times in (1, 6):  # one by one, and as a matrix
            asked = np.ones((4 * times, 4 * times), bool)
            asked[0, 1] = False
            assert (verify(sets * times, sets * times, asked) == np.tile(want, (times, times)) & asked).all()


@pytest.mark.parametrize("heavy", [20_000, 10, 1])
def test_joins_with_counted_keys(spark, heavy):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(None, -1)], "key int, value int")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    got = join_counted(rows, counted, ["key"], "n", 301, heavy)
    assert sorted(got.collect()) == sorted(rows.join(counted, "key").collect())
    assert join_counted(rows.limit(0), counted.limit(0), ["key"], "n", 0, heavy).count() == 0


@pytest.mark.parametrize("heavy", [20_000, 40, 1])
def test_components_with_hubs(spark, monkeypatch, heavy):
    monkeypatch.setattr(skew, "HEAVY", heavy)
    n = 400
    edges = [(n, k) for k in range(1, n, 2)] + [(k, 0) for k in range(2, n, 2)] + [(n + 1, n), (2000, 1000)]
    frame = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components(frame).collect()}
    assert got == {k: k % 2 for k in range(2, n)} | {n: 1, n + 1: 1, 2000: 1000}


def test_components(spark):
    edges = [(i + 1, i) for i in range(60) if i % 20 != 19] + [(90, 3), (91, 90), (91, 3)]
    frame = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r.node[0]: r.root[0] for r in components(frame).collect()}
    assert got == {i: i // 20 * 20 for i in range(61) if i % 20} | {90: 0, 91: 0}
    assert components(frame.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("axes", "block", "tile", "most"), [(None, 2048, 384, 64 << 20), (0, 20, 7, 1000), (3, 20, 7, 500)])
def test_embedding_links_are_those_of_brute_force(spark, monkeypatch, axes, block, tile, most):
    monkeypatch.setattr(linking, "BLOCK", block)
    monkeypatch.setattr(linking, "TILE", tile)
    monkeypatch.setattr(linking, "BYTES", most)
    r = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        v = r.standard_normal(16)
        for _ in range(int(r.integers(1, 5))):
            rows.append((len(rows), (v + r.standard_normal(16) * r.choice([0, 0.02, 0.1, 0.2])).astype(np.float32), len(rows) % 2 if r.random() < 0.1 else 0))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1] * np.float32(3), 0), (1003, rows[0][1], 1), (1004, rows[0][1], None)]
    x = np.array([v for _, v, _ in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    label = [y for _, _, y in rows]
    near = (u @ u.T >= 0.98) & np.array([[a == b and a is not None for b in label] for a in label])
    np.fill_diagonal(near, False)
    odd = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [1.0, None] * 8, 0), (2003, [float("nan")] * 16, 0), (2004, [float("inf")] * 16, 0), (2005, [1.0] * 5, 0), (2006, [], 0)]
    frame = spark.createDataFrame([(i, [float(c) for c in v], y) for i, v, y in rows] + odd, VECTORS)
    got = embedding_duplicates(frame.withColumn("node", F.lit("clash")), axes=axes).collect()
    assert sorted((g.vec_id, g.n_links) for g in got) == sorted([(i, int(n)) for (i, _, _), n in zip(rows, near.sum(1), strict=True)] + [(i, 0) for i, _, _ in odd])
    for g in got:
        assert g.kept == (g.vec_id == g.component_id)
    assert embedding_duplicates(frame.limit(0)).count() == 0


def pairs_at(cosine, n, dim=64, seed=5):
    r = np.random.default_rng(seed)
    a = r.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.standard_normal((n, dim))
    side -= (side * a).sum(1)[:, None] * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1)[:, None]


def test_calibration():
    """Pairs at the threshold reach the count, and only they; labels whose lists coincide don't mix."""
    a, b = pairs_at(0.981, 300)
    label = [bytes(8)] * 200 + [b"x" * 8] * 100
    sides = [[k + v.tobytes() for k, v in zip(label, x)] for x in (a, b)]
    assert (cosine_at_least(0.98)(*sides, np.ones((300, 300), bool)) == np.eye(300, dtype=bool)).all()
    assert not cosine_at_least(0.98)(sides[0], [bytes(7) + b"y" + v[8:] for v in sides[1]], np.ones((300, 300), bool)).any()
    assert axes_needed(5000) == 0 < axes_needed(10**8) and lists_needed(0) < 10 < lists_needed(9)
    assert 20 < count_needed() < 45


@pytest.mark.parametrize("axes", [0, 4])
def test_recall_of_planted_pairs(spark, axes):
    """Pairs just at the threshold are found by the sorted lists and the count, with and without cells."""
    a, b = pairs_at(0.98001, 1500, seed=8)
    rows = [(2 * i + k, v.tolist(), 1) for i in range(1500) for k, v in enumerate((a[i], b[i]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = embedding_duplicates(frame, axes=axes).where("n_links > 0").count()
    assert found >= 2 * 1500 - 4


def test_parts():
    assert linking._parts([3, 3, 4], 10) == [0, 0, 0]
    assert linking._parts([3, 3, 4, 1, 9, 1, 1], 10) == [0, 1, 2, 2, 3, 4, 4]
    assert linking._parts([], 10) == []


@pytest.mark.parametrize("most", [64 << 20, 9000, 3000])
def test_payloads_of_a_group_are_bounded(docs, monkeypatch, most):
    """No call of a verifier's group holds more than BYTES, or two texts, and the groups' links stay the same."""
    from tracklark.llm import near_duplicates as module

    monkeypatch.setattr(linking, "BYTES", most)
    real = module.jaccard_at_least

    def watched(threshold):
        verify = real(threshold)

        def check(left, right, wanted):
            assert len({*left, *right}) <= 2 or sum(map(len, {*left, *right})) <= most
            return verify(left, right, wanted)

        return check

    monkeypatch.setattr(module, "jaccard_at_least", watched)
    links, _ = brute(corpus())
    assert {r.doc_id: r.n_links for r in near_duplicates(docs).collect()} == {r[0]: len(x) for r, x in zip(corpus(), links, strict=True)}
