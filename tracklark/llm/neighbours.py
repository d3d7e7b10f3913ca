"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, with shards' results merged.

Vectors are dealt into bands of like length (within a factor of two) and each band into shards of about SHARD rows by a
hash, so that copies of a common vector spread over all shards. Each shard's graph is built by one task and kept as
flat arrays of neighbours; it is written to the shared folder. Every query is sent to every shard's task, which loads
its graph once and searches for the queries as they stream past; the best of all shards are merged with a window over
each query's few rows.

The nearness is the inner product. A coordinate that makes all of a shard's vectors equally long turns it into a
Euclidean distance, for which the graph is made; all that a search finds is scored in double precision on the vectors
as given. Copies within a shard are one vertex.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, table

SHARD = 16_000
M = 16
EF_BUILD = 80
EF_SEARCH = 160
_LINES = 256  # queries that are searched side by side


def _pick(x: np.ndarray, points: np.ndarray, near: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Neighbours for each row of `points` from candidates sorted by distance: those nearer to the point than to any
    neighbour chosen before, then the nearest of the rest. Missing candidates are -1; so are missing neighbours."""
    v = x[np.maximum(near, 0)]
    norms = (v * v).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    rows, width = near.shape
    chosen = np.zeros((rows, width), bool)
    for k in range(width):
        close = (chosen & (between[:, k, :] < distance[:, k, None])).any(1)
        chosen[:, k] = (near[:, k] >= 0) & ~close & (chosen.sum(1) < most)
    order = np.argsort(np.where(chosen, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def _search_layer(x: np.ndarray, square: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries side by side; entry: vertices for each query. Ids and distances, nearest first."""
    n = len(q)
    ids, dist = np.full((n, ef), -1), np.full((n, ef), np.inf, np.float32)
    done = np.zeros((n, ef), bool)
    seen = np.zeros((n, len(x)), bool)
    k = min(ef, entry.shape[1])
    ids[:, :k] = entry[:, :k]
    dist[:, :k] = square[entry[:, :k]] - 2 * np.einsum("nd,nkd->nk", q, x[entry[:, :k]])
    seen[np.arange(n)[:, None], entry[:, :k]] = True
    live = np.arange(n)
    step = min(at_once, ef)
    while len(live):
        waiting = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        best = np.argpartition(waiting, step - 1, axis=1)[:, :step] if step < ef else np.argsort(waiting, axis=1)
        ok = np.take_along_axis(waiting, best, 1) < np.inf
        going = ok.any(1)
        live, best, ok = live[going], best[going], ok[going]
        if not len(live):
            break
        done[live[:, None], best] |= ok
        near = np.where(ok[:, :, None], links[np.maximum(ids[live[:, None], best], 0)], -1).reshape(len(live), -1)
        near.sort(1)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        width = int(fresh.sum(1).max())
        if not width:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
        safe = np.maximum(near, 0)
        row, column = np.nonzero(fresh)
        seen[live[row], near[row, column]] = True
        d = square[safe] - 2 * np.matmul(x[safe], q[live][:, :, None])[:, :, 0]
        d[~fresh] = np.inf
        all_d, all_i = np.concatenate([dist[live], d], 1), np.concatenate([ids[live], near], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[live], ids[live], done[live] = (np.take_along_axis(a, keep, 1) for a in (all_d, all_i, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    ids[np.isinf(dist)] = -1
    return ids, dist


class Graph:
    """Layers from the top down: vertices of each layer, and for each its neighbours (numbers within the layer, -1: none)."""

    def __init__(self, x: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.members, self.links = x, members, links
        self.layers = [x[m] for m in members]
        self.squares = [(v * v).sum(1) for v in self.layers]

    @classmethod
    def build(cls, x: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 3) -> Graph:
        random = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - random.random(len(x))) / np.log(m)).astype(int)
        graph = cls(x, [], [])
        for h in range(int(level.max()) if len(x) else -1, -1, -1):
            members = np.flatnonzero(level >= h)
            v = x[members]
            links = graph._layer(v, 2 * m if h == 0 else m, ef)
            graph.members.append(members)
            graph.links.append(links)
            graph.layers.append(v)
            graph.squares.append((v * v).sum(1))
        return graph

    def entries(self, q: np.ndarray, members: np.ndarray | None = None, width: int = 4) -> np.ndarray:
        """Vertices near the queries in the lowest layer there is, as vertices of the whole graph."""
        at = None
        for v, square, links, own in zip(self.layers, self.squares, self.links, self.members, strict=True):
            start = np.zeros((len(q), 1), np.int64) if at is None else np.searchsorted(own, at)
            found, _ = _search_layer(v, square, links, q, start, width)
            at = own[np.where(found >= 0, found, found[:, :1])]
        return at

    def _layer(self, v: np.ndarray, most: int, ef: int) -> np.ndarray:
        """Neighbours in a layer, from inserting batches that double in size; batches also see their own members."""
        n, square = len(v), (v * v).sum(1)
        links = np.full((n, most), -1)
        order = np.random.default_rng(len(v)).permutation(n)  # vertices are inserted in this order
        at = 0
        while at < n:
            new = order[at : at + min(_LINES, max(1, at))]
            own = min(len(new) - 1, most)
            inside = square[new][None, :] - 2 * v[new] @ v[new].T
            np.fill_diagonal(inside, np.inf)
            pick = np.argsort(inside, axis=1, kind="stable")[:, :own]
            ids, dist = new[pick], np.take_along_axis(inside, pick, 1).astype(np.float32)
            if at:
                entry = np.broadcast_to(order[:1], (len(new), 1))
                found, far = _search_layer(v, square, links, v[new], entry, ef)
                ids, dist = np.concatenate([found, ids], 1), np.concatenate([far, dist], 1)
                by = np.argsort(dist, axis=1, kind="stable")[:, :ef]
                ids, dist = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
            if ids.shape[1]:
                links[new] = _pick(v, v[new], ids, dist + square[new][:, None], most)
                self._back(v, square, links, new, most)
            at += len(new)
        return links

    @staticmethod
    def _back(v: np.ndarray, square: np.ndarray, links: np.ndarray, new: np.ndarray, most: int) -> None:
        """Links back from the new vertices' neighbours; who has too many chooses anew."""
        to, source = links[new].ravel(), np.repeat(new, most)
        real = to >= 0
        to, source = to[real], source[real]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, first, times = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(targets), times.max()), -1)
        extra[np.repeat(np.arange(len(targets)), times), np.arange(len(to)) - np.repeat(first, times)] = source
        for lo in range(0, len(targets), _LINES):
            t = targets[lo : lo + _LINES]
            both = np.concatenate([links[t], extra[lo : lo + _LINES]], 1)
            both.sort(1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            safe = np.maximum(both, 0)
            d = square[safe] + square[t][:, None] - 2 * np.matmul(v[safe], v[t][:, :, None])[:, :, 0]
            d[both < 0] = np.inf
            by = np.argsort(d, axis=1, kind="stable")
            by = by[:, : int((both >= 0).sum(1).max())]
            links[t] = _pick(v, v[t], np.take_along_axis(both, by, 1), np.take_along_axis(d, by, 1), most)

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Vertices near each query (-1: none), nearest first."""
        out = []
        for at in range(0, len(q), _LINES):
            part = q[at : at + _LINES]
            above = Graph.__new__(Graph)
            above.layers, above.squares, above.links, above.members = self.layers[:-1], self.squares[:-1], self.links[:-1], self.members[:-1]
            entry = above.entries(part)
            entry = np.zeros((len(part), 1), np.int64) if entry is None else entry
            entry = np.where(np.concatenate([np.ones((len(entry), 1), bool), entry[:, 1:] != entry[:, :-1]], 1), entry, entry[:, :1])
            out.append(_search_layer(self.layers[-1], self.squares[-1], self.links[-1], part, entry[:, :1], ef)[0])
        return np.concatenate(out) if out else np.zeros((0, ef), np.int64)


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def valid(vector: str) -> Column:
    """Whether a vector takes part: not null, with components that are finite, not all zero."""
    v = F.col(vector)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(usable & F.exists(v, lambda x: x != 0), F.lit(False))


def build_graphs(vectors: DataFrame, shard: int | None = None) -> DataFrame:
    """(dim, band, shard, graph) for distinct rows of `vec_id`, `embedding` (array<double>).

    Vectors of different dimensions don't share a graph, nor do those whose lengths differ by more than a factor of two:
    the longest of a shard would leave too little of the others' distances.
    """
    largest = F.array_max(F.transform("embedding", F.abs))  # squares are taken of shares of it, as they might overflow
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + (x / F.col("largest")) * (x / F.col("largest")))
    dealt = vectors.withColumn("largest", largest).select("vec_id", "embedding", F.size("embedding").alias("dim"), F.floor(F.log2("largest") + F.log2(squares) / 2).cast("int").alias("band"))
    shards = dealt.groupBy("dim", "band").agg(F.ceil(F.count("*") / (shard or SHARD)).alias("shards"))
    dealt = dealt.join(shards, ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        x, first = np.unique(np.stack(group["embedding"].to_list()), axis=0, return_inverse=True)
        first = first.ravel()
        order = np.argsort(first, kind="stable")
        unit = x / np.abs(x).max()
        squares = (unit * unit).sum(1)
        scaled = np.concatenate([unit, np.sqrt(squares.max() - squares)[:, None]], 1) / np.sqrt(squares.max())
        graph = Graph.build(scaled.astype(np.float32))
        arrays = {f"links{i}": a.astype(np.int32) for i, a in enumerate(graph.links)} | {f"members{i}": a.astype(np.int32) for i, a in enumerate(graph.members)}
        saved = _saved(x=x, scaled=scaled.astype(np.float32), ids=group["vec_id"].to_numpy()[order], starts=np.searchsorted(first[order], np.arange(len(x) + 1)), **arrays)
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in ("dim", "band", "shard")}, "graph": [saved]})

    return dealt.select("vec_id", "embedding", "dim", "band", "shard").groupBy("dim", "band", "shard").applyInPandas(build, "dim int, band int, shard long, graph binary")


class _Shard:
    """A shard's graph as it was written."""

    def __init__(self, saved: bytes):
        a = np.load(io.BytesIO(saved))
        layers = sum(n.startswith("links") for n in a.files)
        self.x, self.ids, self.starts = a["x"], a["ids"], a["starts"]
        self.graph = Graph(a["scaled"], [a[f"members{i}"] for i in range(layers)], [a[f"links{i}"] for i in range(layers)])

    def nearest(self, names: np.ndarray, q: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, int, float]]:
        """(number of the query, vec_id, score) of the k best found for each query; not of the query's own row."""
        if len(self.x) <= ef:
            found = np.broadcast_to(np.arange(len(self.x)), (len(q), len(self.x)))
        else:
            unit = q / np.abs(q).max(1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
            found = self.graph.search(np.concatenate([unit, np.zeros((len(q), 1))], 1).astype(np.float32), ef)
        score = np.einsum("nd,nkd->nk", q, self.x[np.maximum(found, 0)])
        score[found < 0] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")
        for i, own in enumerate(names):
            best, last = [], None
            for j in order[i]:
                v, s = found[i, j], score[i, j]
                if v < 0 or (len(best) >= k and s < last):
                    break
                mine = self.ids[self.starts[v] : min(self.starts[v + 1], self.starts[v] + k + 1)]
                if own in mine and np.array_equal(self.x[v], q[i]):
                    mine = mine[mine != own]
                best += [(-s, int(c)) for c in mine]
                last = s
            for s, c in sorted(best)[:k]:
                yield i, c, -float(s)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF_SEARCH, shard: int | None = None) -> DataFrame:
    """The k nearest found for each query: query_id, rank, vec_id, score. Both tables have `vec_id`, `embedding`; other
    columns are ignored.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Equal rows count
    once; rows that share an id but not their vector are candidates each, and queries each. A query's own row is not
    among its results; ties go to the smaller id. Fewer than k rows come back where there are fewer candidates.
    """
    once = lambda t: t.where(F.col("vec_id").isNotNull() & valid("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    graphs = materialize(build_graphs(once(vectors), shard))
    asked = once(queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query_row"), "embedding", F.size("embedding").alias("dim"))
    # every query meets every shard of its dimension: the shards' names go to the queries, a graph is sent once
    names = graphs.groupBy("dim").agg(F.collect_list(F.struct("band", "shard")).alias("at"))
    asked = asked.join(names, "dim").select("query_id", "query_row", "embedding", "dim", F.inline("at"))
    place = ["dim", "band", "shard"]
    rows = asked.select(*place, "query_id", "query_row", "embedding", F.lit(None).cast("binary").alias("graph"))
    rows = rows.unionByName(graphs.select(*place, "graph"), allowMissingColumns=True)
    rows = rows.repartition(*place).sortWithinPartitions(*place, F.col("query_id").isNotNull())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            graph = batch.column(6)
            lo = 0
            while lo < len(keys):
                if keys[lo] != at:  # a shard's first row is its graph
                    at, held = keys[lo], _Shard(graph[lo].as_py())
                    lo += 1
                    continue
                hi = lo
                while hi < len(keys) and keys[hi] == at and hi - lo < _LINES:
                    hi += 1
                part = batch.slice(lo, hi - lo)
                ids, row = part.column(3).to_numpy(), part.column(4).to_numpy()
                q = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                found = list(held.nearest(ids, q, k, max(ef, k + 1)))
                n = np.array([f[0] for f in found], int)
                yield pa.RecordBatch.from_arrays([pa.array(ids[n]), pa.array(row[n]), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query_id", "query_row", "vec_id", "score"])
                lo = hi

    found = rows.mapInArrow(search, "query_id long, query_row long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for each whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
