"""Centroid clustering of integer vectors with Spark's own expressions: assignment and update are columns, no Python runs.

1. Components become integers, floor(scale * x). Vectors that are null, of another length, or hold null or non-finite
   components take no part.
2. The first centroids are the `k` vectors whose ids have the least seeded sha256 (a bounded top-k by partition).
3. A round joins nothing: centroids are array literals in the plan, `zip_with` and `aggregate` give the squared distance
   to each, and `array_min` over structs (distance, number) chooses, ties going to the smaller number. The update sums each
   component by cluster, partially on every task, so that a task sends `k` rows whatever it holds. A cluster with most of
   the vectors is therefore no hot key.
4. Floors of sums by counts are taken exactly on the driver, from `k` rows.

All arithmetic is exact. Integers are longs if distances and sums are sure to fit, decimals of 38 digits otherwise, where
integers beyond 10**17 count as 10**17 (a component of 10**14 at the usual scale). What doesn't fit a long in the result
is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, table

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
_MOST = 10**17


def integers(vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    x = F.col(vector)
    usable = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(x.isNotNull() & usable, F.transform(x, lambda c: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")))))


def _literal(values: list[int], number: str) -> Column:
    return F.expr(f"cast(array({','.join(map(str, values))}) as array<{number}>)")


def squared_distance(vector: Column, centroid: list[int], number: str = "bigint") -> Column:
    """From a column of integers to a literal centroid."""
    squares = F.zip_with(vector, _literal(centroid, number), lambda a, b: ((a.cast(number) - b) * (a.cast(number) - b)).cast(number))
    return F.aggregate(squares, F.lit(0).cast(number), lambda total, d: (total + d).cast(number))


def nearest(vector: Column, centroids: list[list[int]], number: str = "bigint") -> Column:
    """struct(distance, cluster) of the nearest centroid; of equally near ones the first."""
    return F.array_min(F.array(*(F.struct(squared_distance(vector, c, number).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids))))


def first_centroids(vectors: DataFrame, key: str, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The `k` integer vectors (column `__v`) with the least sha256 of "seed:id"; of equal ids the least vectors. A null
    id counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    order = F.sha2(name.cast("binary"), 256)
    return [list(r["__v"]) for r in vectors.select(order.alias("__o"), "__v").orderBy("__o", "__v").limit(k).collect()]


def fit(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, number: str = "bigint") -> list[list[int]]:
    """`centroids` after `rounds` of assignment and update over the column `__v`; a centroid without vectors stays."""
    sums = [F.sum(F.col("__v")[i].cast(number)).alias(f"s{i}") for i in range(len(centroids[0]))]
    for _ in range(rounds):
        near = nearest(F.col("__v"), centroids, number)["cluster"].alias("cluster")
        for r in vectors.select(near, "__v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(len(sums))]
    return centroids


def cluster_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """The rows whose vectors take part, with `cluster`, `distance` (squared), `cluster_inertia` and `inertia` (distances
    summed over the cluster, and over all) and `centroid` (of the cluster, an array of integers).

    Columns of these names in the input are replaced; others pass unchanged, whatever their names. Repeated rows count
    each. With fewer vectors than `k` there are as many centroids as vectors, and an empty table gives an empty one.
    """
    made = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    kept = [c for c in rows.columns if c not in made]
    vectors = materialize(rows.withColumn("__v", integers(vector, dimensions, scale)).where(F.col("__v").isNotNull()).select(*kept, "__v"))
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.greatest(F.array_max("__v"), -F.array_min("__v"))), F.lit(0)).alias("most")).first()
    number = "bigint" if size["most"] <= 2**27 and size["most"] * size["n"] < 2**62 else "decimal(38,0)"
    centroids = first_centroids(vectors, key, k, seed)
    if not centroids:
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(made, ("int", "bigint", "bigint", "bigint", "array<bigint>"), strict=True)]
        return vectors.select(*kept, *none)
    centroids = fit(vectors, centroids, rounds, number)
    chosen = vectors.withColumn("__near", nearest(F.col("__v"), centroids, number))
    inertia = [0] * len(centroids)
    for r in chosen.groupBy("__near.cluster").agg(F.sum(F.col("__near.distance").cast("decimal(38,0)")).alias("s")).collect():
        inertia[r["cluster"]] = int(r["s"])
    at = F.col("__near.cluster")
    fits = lambda values: F.expr(f"array({','.join(str(v) + 'L' if v < 2**63 else 'cast(null as bigint)' for v in values)})")
    centers = F.expr(f"array({','.join(f'array({",".join(f"{v}L" for v in c)})' for c in centroids)})")
    return chosen.select(*kept, at.alias("cluster"), F.col("__near.distance").try_cast("bigint").alias("distance"), fits(inertia)[at].alias("cluster_inertia"), fits([sum(inertia)])[0].alias("inertia"), centers[at].alias("centroid"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite components in 8 clusters after 10 rounds."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))
