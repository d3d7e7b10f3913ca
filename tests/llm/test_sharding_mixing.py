"""Interleaved shards and apportioned mixing against brute force, and their edge cases."""

import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracklark.llm.mixing import WEIGHTS, apportion, mix_documents, mix_plan, n_words, op4_mixing, source_targets, words_taken
from tracklark.llm.oracles import ORACLE_SQL
from tracklark.llm.sharding import op10_sharding, stratified_shards

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_for_edges():
    rows = [(i, f"word{i} " * (i % 9), "en", f"s{i % 3}" if i % 5 else "hot", 1) for i in range(200)]
    return [*rows, (None, None, None, None, None), (None, "", None, None, 0), (7, "a b c", "en", "s1", 5), (7, "a b c", "en", "s1", 5), (8, "x" * 50_000, None, None, 1), (9, "\u00a0 \t\n", "en", "s2", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_for_edges(), DOCS)


def test_shards_match_the_mixture(docs):
    got = stratified_shards(docs.withColumn("shard", F.lit("x")).withColumn("__rank", F.lit(1)).drop("__rank"), 4, ranges=16).toPandas()
    assert len(got) == len(rows_for_edges())
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for source, n in got.source.fillna("?").value_counts().items():
        per = got[got.source.fillna("?") == source].groupby("shard").size().reindex(range(4), fill_value=0)
        assert (abs(per - n / 4) <= 2).all()


def test_fractional_ranks_are_those_of_brute_force(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    h = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64(F.lit(17), F.col("doc_id").cast("string")).alias("h")).collect()}
    place = {}
    for s in "ab":
        own = sorted((i for i, x in rows if x == s), key=lambda i: h[i] % 2**64)
        place |= {i: Fraction(2 * r + 1, 2 * len(own)) for r, i in enumerate(own)}
    got = sorted(stratified_shards(frame, 3, ranges=8).collect(), key=lambda r: (r.shard, r.slot))
    assert [place[r.doc_id] for r in got] == sorted(place.values())


@pytest.mark.parametrize("crowded", [100_000, 7])
def test_equal_rows_stay_together(spark, crowded):
    rows = [(i, f"s{i % 2}", i // 6 if i < 1200 else -1) for i in range(1800)]  # groups of six, and one of a third
    frame = spark.createDataFrame(rows, "doc_id long, source string, text long")
    got = stratified_shards(frame, 4, ranges=64, together=("text",), crowded=crowded).toPandas()
    assert set(got.groupby("shard").size()) == {450}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
        assert abs((g.source == "s0").sum() - 225) <= 2
    split = got[got.text >= 0].groupby("text").shard.nunique()
    assert (split > 1).sum() <= 40 and split.max() <= 2
    assert got[got.text < 0].shard.nunique() <= 3


def test_sharding_query(spark):
    got = op10_sharding(spark, SF).toPandas()
    text = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    assert (got.text_crc32 == [zlib.crc32(text[i].encode()) for i in got.doc_id]).all()
    assert (got["size"] == [len(text[i].encode()) + 1 for i in got.doc_id]).all()
    assert sorted(map(tuple, op10_sharding(spark, SF).toPandas()[["doc_id", "shard", "slot"]].values)) == sorted(map(tuple, got[["doc_id", "shard", "slot"]].values))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert stratified_shards(none).count() == 0
    assert mix_documents(none).count() == 0


def targets_by_rounds(sizes):
    """The contract's own words: share by weight, stop at twice the size, share the excess again."""
    names = sorted(sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    target, excess, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while excess > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / total
        excess = sum(max(0, target[s] - 2 * sizes[s]) for s in names)
        for s in names:
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 5000, "d": 0}, {"a": 1}, {"a": 0, "b": 0}, {f"s{i:02}": (i * 7919) % 3000 for i in range(25)}])
def test_targets_and_quotas(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    rows = {r.source: r for r in apportion(source_targets(frame), 64, 5).collect()}
    want = targets_by_rounds(sizes)
    assert {s: r.target for s, r in rows.items()} == pytest.approx(want)
    house = int(sum(r.target for r in rows.values()) / 64 + 0.5)
    order = sorted(sizes)
    # all quotients, highest first
    quotients = sorted(((-rows[s].target / (2 * k - 1), i) for i, s in enumerate(order) for k in range(1, 2 * rows[s].n_blocks + 1)))
    for m in range(1, 6):
        h = house * m // 5
        given = Counter(order[i] for q, i in quotients[:h] if q < 0)
        assert [rows[s].quotas[m - 1] for s in order] == [given[s] for s in order]


def test_mixing_takes_what_is_due(docs):
    sized = docs.withColumn("size", n_words("text"))
    plan = mix_plan(sized, block_words=4, n_shards=3).withColumn("taken", words_taken()).toPandas()
    assert len(plan) == len(rows_for_edges())
    assert (plan.taken <= 2 * plan["size"]).all()
    for _, g in plan.groupby(plan.source.fillna("?")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 10
    for picks in plan.picks:
        assert all(p.words > 0 and 0 <= p.shard < 3 for p in picks)


def test_small_sources_get_their_targets(spark):
    sizes = {"a": 30, "b": 60, "c": 130, "d": 3000}
    rows = [(i, s, "word " * 10) for s, n in sizes.items() for i in range(n // 10)]
    plan = mix_plan(spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", n_words("text")))
    for r in plan.groupBy("source").agg(F.sum(words_taken()).alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.125), r.source


def test_mixed_texts(spark, docs):
    sized = docs.withColumn("size", n_words("text")).withColumn("__tie", F.crc32(F.col("text").cast("binary")))
    taken = mix_plan(sized, block_words=4, tie="__tie").select(F.sum(words_taken())).first()[0]
    mixed = mix_documents(docs, block_words=4)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(n_words("text"))).first()[0] == taken
    texts = {r.text for r in docs.collect()}
    cut = [r for r in mixed.collect() if r.text not in texts]
    assert all(r.n_chars == len(r.text) for r in cut)


def test_mixing_query_is_stable(spark):
    a, b = (sorted(op4_mixing(spark, SF).collect(), key=str) for _ in range(2))
    assert a == b


def test_small_sources_leave_the_blocks_of_others_as_they_are(spark, same_rows, tmp_path):
    """Sources of 1, 30, 900 and 5,000 words beside large ones: the query equals its SQL, and picks stay bounded."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    own = [(10**6 + i, text(n), "en", source, 1) for i, (n, source) in enumerate([(1, "tiny"), (10, "few"), (20, "few"), (900, "some"), (5000, "more"), (0, "none"), (400_000, "big")])]
    both = docs.unionByName(spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns))
    both.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    view = duckdb.connect()
    view.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(op4_mixing(spark, str(tmp_path)), view.sql(ORACLE_SQL["op4_mixing"]).df())
    sized = both.withColumn("size", n_words("text"))
    rows = mix_plan(sized).select("doc_id", "source", "size", "source_size", "target", F.size("picks").alias("n"), words_taken().alias("taken")).collect()
    assert all(r.n <= 2 * (r.size // 128 + 2) + 16 * 128 for r in rows) and sum(r.n for r in rows) < 20_000
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= (1 if s in ("tiny", "few", "some") else 3 * 128) for s, (target, taken) in by_source.items())


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["size", "target", "picks", "weight", "source_size", "quotas", "n_blocks", "text"]
    docs = spark.createDataFrame([(i, f"a b c {i}" if i % 3 else None, "s", *(f"{n}{i}" for n in names[:-1])) for i in range(30)], f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names[:-1])}")
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert all(r[n] == f"{n}{r.doc_id}" for r in mixed.collect() for n in names[:-1])
    assert mix_documents(docs.limit(0)).count() == 0
