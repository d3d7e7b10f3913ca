"""Embedding near-duplicates by collision-counting projections: vectors of one label at a cosine of 0.98 or more.

Unit vectors at the threshold differ by 0.2, so on a random direction their projections differ by a normal deviate of
at most that scale. Many one-dimensional projections are drawn. Vectors of a label are sorted by each of the first of
them, and the window around a vector in one of these lists proposes those in it (see linking.py: lists are cut into
segments as long as the window, so a window reaches one segment on). For each pair proposed, the projections in which
one is in the window around the other are counted; a pair at the threshold reaches the least count with a probability
of about RECALL, and pairs that reach it are verified by their exact cosine.

A window in one dimension holds a constant share of its list. So that its work stays in proportion to the vectors,
lists of larger tables are split by cells of AXES further projections, as many as keep a window at about NEAR vectors,
and there are as many lists as RECALL then needs: none and a handful for some thousand vectors of a label, about ten
and forty for some hundred millions. Equal vectors of a label are one node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linking import classified, count_links, shared_windows, sketch
from .neighbours import valid
from .storage import materialize, table

THRESHOLD = 0.98
RECALL = 0.9999
NEAR = 2048  # vectors that a window should hold at most, if projections are spread normally
CELL = 1.2  # width of a cell
COUNTED = 48  # projections in which collisions are counted
EARLY = 12  # the first of them, which most pairs don't survive
WINDOW = 1.5  # half a window, in units of the distance at the threshold
_P = math.erf(WINDOW / math.sqrt(2))  # probability of a collision at the threshold


def _distance(threshold: float) -> float:
    return math.sqrt(2 - 2 * threshold)


def axes_needed(vectors: int, threshold: float = THRESHOLD) -> int:
    """Projections by whose cells lists of `vectors` vectors are split."""
    held = vectors * min(1.0, 2 * WINDOW * _distance(threshold) * 0.2821)  # 0.2821: mean density of a normal variable
    return max(0, math.ceil(math.log(max(held, 1) / NEAR) / -math.log(min(0.9, CELL * 0.2821))))


def lists_needed(axes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Sorted lists in one of which at least a pair at the threshold collides with probability `recall`."""
    shift = np.abs(np.random.default_rng(0).standard_normal(200_000)) * _distance(threshold) / CELL
    share = _P * float(np.maximum(0, 1 - shift).mean()) ** axes
    return math.ceil(math.log(1 - recall) / math.log(1 - share))


def count_needed(counted: int = COUNTED, recall: float = RECALL) -> int:
    """The most collisions of `counted` that a pair at the threshold reaches with probability `recall`."""
    below = 0.0
    for k in range(counted + 1):
        below += math.comb(counted, k) * _P**k * (1 - _P) ** (counted - k)
        if below > 1 - recall:
            return k
    return counted


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """For each row of `a` and of `b` (projections), in how many columns the row of `b` is in the window around `a`'s."""
    total = np.zeros((len(a), len(b)), np.int8)
    for x, y in zip(a.T, b.T, strict=True):
        total += np.abs(x[:, None] - y[None, :]) <= half
    return total


def cosine_at_least(threshold: float, recall: float = RECALL, seed: int = 23):
    """A verifier of payloads that hold 8 bytes of the label's hash and a vector of doubles."""
    half = np.float32(WINDOW * _distance(threshold))
    least, first = count_needed(COUNTED, recall), count_needed(EARLY, recall)

    def same_kind(left: list[bytes], right: list[bytes], wanted: np.ndarray) -> np.ndarray:
        a, b = (np.stack([np.frombuffer(x, offset=8) for x in s]) for s in (left, right))
        la, lb = (np.sqrt((v * v).sum(1)) for v in (a, b))
        axes = np.random.default_rng(seed).standard_normal((a.shape[1], COUNTED))
        pa_, pb = ((v / n[:, None] @ axes).astype(np.float32) for v, n in ((a, la), (b, lb)))
        i, j = np.nonzero(wanted & (collisions(pa_[:, :EARLY], pb[:, :EARLY], half) >= first))
        linked = np.zeros(wanted.shape, bool)
        for at in range(0, len(i), 20_000):
            x, y = i[at : at + 20_000], j[at : at + 20_000]
            enough = (np.abs(pa_[x] - pb[y]) <= half).sum(1) >= least
            x, y = x[enough], y[enough]
            linked[x, y] = (a[x] * b[y]).sum(1) / (la[x] * lb[y]) >= threshold
        return linked

    def verify(left: list[bytes], right: list[bytes], wanted: np.ndarray) -> np.ndarray:
        kinds = {x[:8] for x in left}
        if len(kinds) == 1 and kinds == {x[:8] for x in right}:
            return same_kind(left, right, wanted)
        linked = np.zeros(wanted.shape, bool)  # labels whose hashes are equal share lists; their vectors don't link
        for kind in kinds:
            x, y = ([k for k, v in enumerate(s) if v[:8] == kind] for s in (left, right))
            if y:
                linked[np.ix_(x, y)] = same_kind([left[k] for k in x], [right[k] for k in y], wanted[np.ix_(x, y)])
        return linked

    return verify


def embedding_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 19, axes: int | None = None) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept, from `vec_id`, `embedding`, `label`; other columns are dropped.

    Vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing;
    nor do vectors of different lengths. Rows that repeat an id are links of each other if their vectors are near.
    Null ids are passed over for component_id where there are others. `axes`: projections that split the lists, by
    default as many as the most frequent label needs.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    partakes = valid("embedding") & F.col("label").isNotNull()
    rows = vectors.where(partakes).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    if axes is None:
        most = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        axes = axes_needed(most, threshold)
    lists = lists_needed(axes, threshold, 1 - (1 - recall) / 2)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            vectors, label = batch.column(1), batch.column(2)
            for dim in pc.unique(pc.list_value_length(vectors)).to_pylist():
                mine = pa.array(np.flatnonzero(pc.list_value_length(vectors).to_numpy() == dim))
                x = np.ascontiguousarray(vectors.take(mine).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                if dim not in drawn:
                    random = np.random.default_rng([seed, dim])
                    normal = random.standard_normal((dim, lists * (axes + 1)))
                    drawn[dim] = normal[:, :lists], normal[:, lists:], random.random(lists * axes) * CELL, random.integers(0, 2**63, (lists, axes), np.int64) | 1
                order, split, shift, by = drawn[dim]
                unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                names = [hashlib.blake2b(f"{k}/{dim}".encode(), digest_size=8).digest() for k in label.take(mine).to_pylist()]
                cell = np.floor((unit @ split + shift) / CELL).astype(np.int64).reshape(len(x), lists, axes)
                hashed = (cell * by).sum(2) ^ np.frombuffer(b"".join(names), "<i8")[:, None]
                hashed = (hashed.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                bands, places = hashed.astype(np.uint32).view(np.int32), (unit @ order).astype(np.float32)
                payloads = [name + v.tobytes() for name, v in zip(names, x, strict=True)]
                nodes = [hashlib.md5(v).digest() for v in payloads]
                made = [batch.column(0).take(mine), pa.array(nodes, pa.binary()), pa.array(list(bands), pa.list_(pa.int32())), pa.array(list(places), pa.list_(pa.float32())), pa.array(map(sketch, bands, places), pa.binary()), pa.array(payloads, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["vec_id", "node", "bands", "places", "sketch", "payload"])

    rows = materialize(rows.mapInArrow(sign, f"vec_id {kind}, node binary, bands array<int>, places array<float>, sketch binary, payload binary"))
    found = materialize(rows.groupBy("node").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("members"), *(F.first(c).alias(c) for c in ("bands", "places", "sketch", "payload"))))
    window = WINDOW * _distance(threshold)
    payloads = lambda needed: needed.join(found.select("node", "payload"), "node")
    links, edges = count_links(shared_windows(found, window), found.select("node", "members", "sketch", F.length("payload").cast("long").alias("size")), payloads, cosine_at_least(threshold, 1 - (1 - recall) / 4), lists, window)
    told = rows.select("vec_id", "node").join(classified(found, links, edges), "node").select("vec_id", "n_links", "component_id")
    others = vectors.where(~partakes).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.union(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their number of links and group."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
