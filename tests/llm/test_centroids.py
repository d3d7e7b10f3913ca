"""Centroid clustering against plain integers in Python, against SQL, and its edge cases."""

import hashlib
import math
import random

import pytest

from tracklark.llm.centroids import cluster_vectors, integers, op11_centroid_clustering
from tracklark.llm.oracles import ORACLE_SQL

from ..conftest import SF

VECTORS = "vec_id long, embedding array<float>, cluster string, note string"


def plain(rows, dimensions, k=8, rounds=10):
    """[(vec_id, cluster, distance, vector)] and the centroids, for (vec_id, floats) with 1024 a unit."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(10**17), min(10**17, math.floor(1024 * x))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((distance(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        made = [[v for (_, v), j in zip(kept, of, strict=True) if j == c] for c in range(len(centroids))]
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(made, centroids, strict=True)]
    return [(i, near(v)[1], near(v)[0], v) for i, v in kept], centroids


def check(spark, rows, dimensions, schema="vec_id long, embedding array<double>", **options):
    frame = spark.createDataFrame([(i, v) for i, v in rows], schema)
    got = cluster_vectors(frame, dimensions=dimensions, **options).collect()
    want, centroids = plain(rows, dimensions, **options)
    text = lambda x: "" if x is None else str(x)
    fits = lambda d: d if d < 2**63 else None
    assert sorted((text(r.vec_id), r.cluster, r.distance, r.centroid) for r in got) == sorted((text(i), c, fits(d), centroids[c]) for i, c, d, _ in want)
    assert {r.inertia for r in got} <= {fits(sum(d for _, _, d, _ in want))}
    assert {(r.cluster, r.cluster_inertia) for r in got} == {(c, fits(sum(d for _, e, d, _ in want if e == c))) for _, c, _, _ in want}
    return got


def test_clusters_are_those_of_plain_integers(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(300)]
    # repeated rows and ids, vectors that are the same, points midway between two
    rows += [*rows[:20], *((5, [float(j)] * 6) for j in range(4)), *((1000 + j, [0.5] * 6) for j in range(30)), (None, [1.0] * 6)]
    check(spark, rows, 6)


@pytest.mark.parametrize("large", [2.0**40, 1e13, 1e300])
def test_large_components_are_exact(spark, large):
    r = random.Random(3)
    rows = [(i, [r.choice([-1, 1]) * r.random() * large if r.random() < 0.5 else r.random() for _ in range(4)]) for i in range(60)]
    check(spark, rows, 4, k=3, rounds=3)


def test_a_centroid_without_vectors_stays(spark):
    """Equal first centroids: ties go to the smaller number, so the others get nothing."""
    rows = [(i, [1.0, 2.0]) for i in range(10)] + [(100 + i, [9.0, float(i)]) for i in range(3)]
    got = check(spark, rows, 2, k=8, rounds=4)
    assert len({r.cluster for r in got}) < 8


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    one = [0.25] * 64
    rows = [(1, one, "mine", "a"), (2, None, "x", "a"), (3, [], "x", "a"), (4, one[:63], "x", "a"), (5, [*one, 1.0], "x", "a"), (6, [*one[:63], nan], "x", "a"), (7, [*one[:63], inf], "x", None), (8, [*one[:63], None], "x", "a"), (None, [0.0] * 64, "x", "a")]
    got = cluster_vectors(spark.createDataFrame(rows, VECTORS))
    assert got.columns == ["vec_id", "embedding", "note", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted((str(r.vec_id), r.distance, r.note) for r in got.collect()) == [("1", 0, "a"), ("None", 0, "a")]
    for none in (spark.createDataFrame(rows[1:3], VECTORS), spark.createDataFrame([], VECTORS)):
        empty = cluster_vectors(none)
        assert empty.columns == got.columns and empty.schema["distance"].dataType == got.schema["distance"].dataType and empty.count() == 0
    floors = spark.createDataFrame([([-0.0001, 0.0009, 0.0010, -1.0],)], "v array<float>").select(integers("v", 4)).first()[0]
    assert floors == [-1, 0, 1, -1024]


def test_query(spark, duck, same_rows):
    found = op11_centroid_clustering(spark, SF).persist()
    same_rows(found, duck.sql(ORACLE_SQL["op11_centroid_clustering"]).df())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centroids = plain(rows, 64)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert {(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in found.collect()} == {(i, c, d, sha[c]) for i, c, d, _ in want}


def test_no_python_and_only_sums_are_shuffled(spark):
    plan = cluster_vectors(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding"), rounds=1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
