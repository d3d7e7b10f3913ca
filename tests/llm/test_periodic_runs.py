"""Runs of words against brute force, in the operator and in the query."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tracklark.llm.periodic_runs import Grammar, _chunk, op12_periodic_runs, periodic_runs

from ..conftest import SF


def brute(w, least=6, times=4):
    """(start, length, period) by comparing all words q apart, for every q."""
    ids = {}
    a = np.array([ids.setdefault(x, len(ids)) for x in w], np.int64)
    out = []
    for q in range(1, len(a) // times + 1):
        same = np.concatenate([[0], (a[:-q] == a[q:]).astype(int), [0]])
        begins, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, e in zip(begins.tolist(), (ends + q).tolist(), strict=True):
            if e - s >= max(least, times * q) and not any(x <= s and e <= x + n for x, n, _ in out):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(r):
    kinds, n = r.choice([1, 2, 2, 3, 5, 30]), r.choice([0, 1, 5, 6, 7, 12, 30, 80, 150])
    w = [f"w{r.randrange(kinds)}" for _ in range(n)]
    if n and r.random() < 0.6:
        a, p = r.randrange(n), r.randint(1, max(1, n // 5))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [f"w{r.randrange(kinds)}" for _ in range(r.randrange(15))]
    return w * r.choice([1, 1, 1, 2, 4])


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        texts = [repetitive(r) for _ in range(r.randint(1, 6))]
        found, collapsed, sizes = _chunk([" ".join(w).encode() for w in texts], 6, 4)
        for w, f, c, n in zip(texts, found, collapsed, sizes, strict=True):
            runs = brute(w)
            assert [(x["start"], x["length"], x["period"]) for x in f] == runs
            assert (c.decode(), n) == (collapse(w, runs), len(w))


def test_grammar_spells_the_text_and_leaves_no_pair_twice():
    r = random.Random(1)
    words = np.array([r.randrange(6) for _ in range(500)] + [6 + r.randrange(3) for _ in range(200)], np.int64)
    g = Grammar(words, np.array([0, 500]))

    def spell(x):
        return [x] if x < g.terminals else spell(g.left[x - g.terminals]) + spell(g.right[x - g.terminals])

    assert [w for x in g.top for w in spell(x)] == words.tolist()
    used = [*zip(g.left.tolist(), g.right.tolist(), strict=True)]
    assert len(used) == len(set(used))
    pairs = [p for p in zip(g.top.tolist(), g.top[1:].tolist(), strict=False) if p[0] != p[1]]
    assert len(pairs) == len(set(pairs))
    for x, (f, n) in enumerate(zip(g.first.tolist(), g.size[g.terminals :].tolist(), strict=True)):
        assert words[f : f + n].tolist() == spell(x + g.terminals)


def test_edges(spark):
    long = "a b c d " * 50_000
    rows = [(1, None, "x", "k"), (2, "", "x", "k"), (None, " \t\n", "x", "k"), (4, "one", "x", "k"), (5, "ab " * 6, "x", "k"), (5, "ab " * 6, "x", "k"), (6, "A a A a a a a a a a", None, "k"), (7, long, "x", "k"), (8, " x  x  x  x  x  x é", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start string")
    found = periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "start", "runs", "collapsed", "n_words"]
    got = {(r.doc_id, r.text): r for r in found.collect()}
    assert found.count() == len(rows)
    for r in got.values():
        w = (r.text or "").encode().split()
        if len(w) < 1000:
            assert [tuple(x) for x in r.runs] == brute(w) and r.collapsed.encode() == b" ".join(collapse([x.decode() for x in w], brute(w)).encode().split(b" ") if w else [])
    assert [tuple(x) for x in got[7, long].runs] == [(0, 200_000, 4)] and got[7, long].collapsed == "a b c d"
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs(docs, times=3)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    with_runs = 0
    for row in rows:
        w = [x.decode() for x in docs[row.doc_id].encode().split()]
        h, n = zlib.crc32(str(row.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        with_runs += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row.collapsed_sha256 == sha(collapse(w, runs))
    assert with_runs > 10
