"""Links between vectors or sets that share a bucket, counted without a row for each pair.

Nodes (classes of equal rows) come with a `sketch`: for each band a hash and, if buckets are sorted lists, a place.
Nodes with the same hash in a band share a bucket; in a sorted list they meet only if their places are at most `window`
apart, so a list is cut into segments as long as the window, and a segment meets itself and the next one.

* Buckets of one node are dropped, and so are buckets with exactly the nodes of a bucket in an earlier band.
* A segment of n nodes is dealt into blocks of about BLOCK nodes by a hash, and each pair of blocks is a task's group,
  so that a bucket with a third of all nodes is many groups of bounded size.
* A pair counts in the first band in which it meets. Groups are first formed from sketches alone; only nodes that have
  a pair left to decide there are sent on with their payloads, to be verified exactly, as tiles of a matrix.
* Nodes know the size of their payload. A group whose payloads take more than BYTES is dealt into parts of half of that
  (or of one node), and each pair of parts with a pair to decide is a group of its own, so that what a task holds is
  bounded in bytes, too, however long the texts are.
* A group returns, for each node with links, their number (in rows) and the least node of its part of the group: the
  rows that leave a group are at most its nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .skew import join_counted
from .storage import drop, materialize

BLOCK = 2048
TILE = 384
BYTES = 64 << 20
#: Payloads of two sides, and which pairs are asked for; gives which of these are links.
Verify = Callable[[list[bytes], list[bytes], np.ndarray], np.ndarray]
KEY = ["band", "hash", "segment", "beside", "i", "j"]
PARTS = ["p", "q"]
_KEY_TYPES = "band int, hash int, segment long, beside boolean, i int, j int"


def sketch(bands: np.ndarray, places: np.ndarray | None = None) -> bytes:
    """One node's hashes and places as bytes."""
    return bands.astype("<i4").tobytes() + (b"" if places is None else places.astype("<f4").tobytes())


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """Rows (band, hash, segment, node, own, above, below) for nodes (node, bands) in buckets that can hold a new pair."""
    rows = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    total = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    found = rows.groupBy("band", "hash").agg(F.count("*").alias("own"), F.bit_xor(F.xxhash64("node")).alias("__x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("__y")).where("own > 1")
    first = found.groupBy("own", "__x", "__y").agg(F.min(F.struct("band", "hash")).alias("__b")).select("__b.band", "__b.hash", "own")
    zero = F.lit(0).cast("long")
    return join_counted(rows, first, ["band", "hash"], "own", total).select("band", "hash", zero.alias("segment"), "node", "own", zero.alias("above"), zero.alias("below"))


def shared_windows(nodes: DataFrame, window: float) -> DataFrame:
    """The same for nodes (node, bands, places), whose buckets are lists sorted by place: `above` and `below` count the
    nodes of the next and of the previous segment."""
    rows = nodes.select("node", F.posexplode(F.arrays_zip("bands", "places")).alias("band", "at")).select("node", "band", "at.bands", F.floor(F.col("at.places") / window).alias("segment")).withColumnRenamed("bands", "hash")
    total = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    counts = rows.groupBy("band", "hash", "segment").agg(F.count("*").alias("n"))
    seen = F.inline(F.array(*(F.struct((F.col("segment") + d).alias("segment"), *(F.when(F.lit(d == e), F.col("n")).otherwise(0).alias(name) for e, name in ((0, "own"), (-1, "above"), (1, "below")))) for d in (0, -1, 1))))
    met = counts.select("band", "hash", seen).groupBy("band", "hash", "segment").agg(*(F.sum(c).alias(c) for c in ("own", "above", "below"))).where("own > 0 and own + above + below > 1")
    return join_counted(rows, met, ["band", "hash", "segment"], "own", total).select("band", "hash", "segment", "node", "own", "above", "below")


def _groups(buckets: DataFrame, block: int) -> DataFrame:
    """A row for each pair of blocks that a node is in: KEY, `side` (whether in the second block), `node`."""
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    rows = buckets.withColumn("__part", F.pmod(F.xxhash64("node", F.lit(2)), parts("own")).cast("int"))
    part, segment = F.col("__part"), F.col("segment")

    def entry(segment, beside: bool, i, j, side):
        return F.struct(segment.alias("segment"), F.lit(beside).alias("beside"), i.alias("i"), j.alias("j"), side.alias("side"))

    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.greatest(parts(n), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(numbers("own"), lambda o: entry(segment, False, F.least(part, o), F.greatest(part, o), part > o))
    above = F.transform(numbers("above"), lambda o: entry(segment, True, part, o, F.lit(False)))
    below = F.transform(numbers("below"), lambda o: entry(segment - 1, True, o, part, F.lit(True)))
    return rows.select("band", "hash", F.inline(F.concat(same, above, below)), "node").select(*KEY, "side", "node")


class _Side:
    def __init__(self, sketches: list[bytes], bands: int, sorted_lists: bool):
        width = 4 * bands
        raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
        self.hashes = np.ascontiguousarray(raw[:, :width]).view("<i4")
        self.places = np.ascontiguousarray(raw[:, width:]).view("<f4") if sorted_lists else None


def _meet(a: _Side, b: _Side, rows: slice, columns: slice, band: int, window: float) -> np.ndarray:
    same = a.hashes[rows, None, band] == b.hashes[None, columns, band]
    if a.places is not None:
        same &= np.abs(a.places[rows, None, band] - b.places[None, columns, band]) <= window
    return same


def _wanted(a: _Side, b: _Side, rows: slice, columns: slice, band: int, window: float, upper: bool) -> np.ndarray:
    """Pairs of a tile that meet in `band` and in no earlier one; of a tile with itself one of each two."""
    found = _meet(a, b, rows, columns, band, window)
    if upper:
        found = np.triu(found, 1)
    for k in range(band):
        if not found.any():
            break
        found &= ~_meet(a, b, rows, columns, k, window)
    return found


def _tiles(n: int, m: int, within: bool) -> Iterator[tuple[slice, slice, bool]]:
    for at in range(0, n, TILE):
        for to in range(at if within else 0, m, TILE):
            yield slice(at, at + TILE), slice(to, to + TILE), within and at == to


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row it is connected with."""
    root = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        least = np.where(reach, root[None, :], len(linked)).min(1)
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


class _Union:
    """Least members of sets of numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _parts(sizes: list[int], most: int) -> list[int]:
    """A part for each node, in order: all in part 0 if they fit `most` bytes, else parts of half of it, or of one node."""
    if sum(sizes) <= most:
        return [0] * len(sizes)
    out, part, held = [], 0, 0
    for size in sizes:
        if held and held + size > most // 2:
            part, held = part + 1, 0
        held += size
        out.append(part)
    return out


def _by_group(batches: Iterator[pa.RecordBatch], n: int, each: Callable[[tuple, list[tuple]], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Calls `each` with the rows of every run that is equal in the first `n` columns and yields what it returns."""
    group: list[tuple] = []
    at = None
    out: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n] != at:
                if len(group) > 1:
                    out += each(at, group)
                group, at = [], row[:n]
            group.append(row[n:])
            if len(out) > 20_000:
                yield made()
                out = []
    if len(group) > 1:
        out += each(at, group)
    if out:
        yield made()


def count_links(buckets: DataFrame, nodes: DataFrame, payloads: Callable[[DataFrame], DataFrame], verify: Verify, bands: int, window: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of nodes (`node`, `members`, `sketch`, `size`) as `verify` finds them from payloads of `size` bytes.

    `payloads` gives (`node`, `payload`) for a table of the nodes that need one. Returns (node, links), the rows of other
    nodes that a node links with, and edges (a, b), a > b, that connect what links connect.
    """
    sorted_lists, reach, most = window is not None, window or 0.0, BYTES

    def sides(group: list[tuple], key: tuple) -> tuple[int, _Side, _Side, bool]:
        within = not key[3] and key[4] == key[5] and key[6:7] == key[7:8]
        cut = len(group) if within else sum(not r[0] for r in group)
        a = _Side([r[2] for r in group[:cut]], bands, sorted_lists) if cut else None
        b = a if within else _Side([r[2] for r in group[cut:]], bands, sorted_lists) if cut < len(group) else None
        return cut, a, b, within

    def narrow(key: tuple, group: list[tuple]) -> list[tuple]:
        cut, a, b, within = sides(group, key)
        if a is None or b is None:
            return []
        used = np.zeros(len(group), bool)
        off = 0 if within else cut
        tiles = []
        for rows, columns, upper in _tiles(cut, len(group) - off, within):
            found = _wanted(a, b, rows, columns, key[0], reach, upper)
            x, y = found.any(1), found.any(0)
            if x.any():
                tiles.append((rows, columns, upper))
                used[rows.start : rows.start + len(x)] |= x
                used[off + columns.start : off + columns.start + len(y)] |= y
        asked = np.flatnonzero(used)
        dealt = _parts([group[k][3] for k in asked], most)
        if not dealt or dealt[-1] == 0:
            return [(*key, 0, 0, group[k][0], group[k][1]) for k in asked]
        part = np.zeros(len(group), np.int64)
        part[asked] = dealt
        met: set[tuple[int, int]] = set()
        for rows, columns, upper in tiles:
            x, y = np.nonzero(_wanted(a, b, rows, columns, key[0], reach, upper))
            met |= set(zip(part[x + rows.start].tolist(), part[y + off + columns.start].tolist(), strict=True))
        of = {p: asked[part[asked] == p].tolist() for p in {p for pair in met for p in pair}}
        out = []
        for p, q in sorted(met):
            if within:
                out += [(*key, p, q, side, group[k][1]) for side, r in ((False, p), (True, q))[: 1 + (p != q)] for k in of[r]]
            else:
                out += [(*key, p, q, side, group[k][1]) for side, r in ((False, p), (True, q)) for k in of[r] if group[k][0] == side]
        return out

    def check(key: tuple, group: list[tuple]) -> list[tuple]:
        cut, a, b, within = sides(group, key)
        if a is None or b is None:
            return []
        off = 0 if within else cut
        members, counts, union = np.array([r[3] for r in group], np.int64), np.zeros(len(group), np.int64), _Union(len(group))
        for rows, columns, upper in _tiles(cut, len(group) - off, within):
            found = _wanted(a, b, rows, columns, key[0], reach, upper)
            x, y = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
            if not len(x):
                continue
            left, right = x + rows.start, y + off + columns.start
            linked = verify([group[k][4] for k in left], [group[k][4] for k in right], found[np.ix_(x, y)]) & found[np.ix_(x, y)]
            if not linked.any():
                continue
            np.add.at(counts, left, (linked * members[right]).sum(1))
            np.add.at(counts, right, (linked.T * members[left]).sum(1))
            both = np.zeros((len(x) + len(y),) * 2, bool)
            both[: len(x), len(x) :], both[len(x) :, : len(x)] = linked, linked.T
            of = np.concatenate([left, right])
            for k, r in enumerate(_roots(both)):
                if k != r:
                    union.join(int(of[k]), int(of[r]))
        names = [r[1] for r in group]
        least: dict[int, bytes] = {}
        for k in np.flatnonzero(counts).tolist():
            r = union.find(k)
            least[r] = min(least.get(r, names[k]), names[k])
        return [(names[k], int(counts[k]), least[union.find(k)]) for k in np.flatnonzero(counts).tolist()]

    one = nodes.select("node", "sketch", "size")
    rows = _groups(buckets, BLOCK).join(one, "node").select(*KEY, "side", "node", "sketch", "size")
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "side", "node")
    narrowed = pa.schema([("band", pa.int32()), ("hash", pa.int32()), ("segment", pa.int64()), ("beside", pa.bool_()), ("i", pa.int32()), ("j", pa.int32()), ("p", pa.int32()), ("q", pa.int32()), ("side", pa.bool_()), ("node", pa.binary())])
    asked = materialize(rows.mapInArrow(lambda b: _by_group(b, len(KEY), narrow, narrowed), f"{_KEY_TYPES}, p int, q int, side boolean, node binary"))
    loaded = nodes.select("node", "sketch", "members").join(payloads(asked.select("node").distinct()), "node")
    rows = asked.join(loaded, "node").select(*KEY, *PARTS, "side", "node", "sketch", "members", "payload")
    rows = rows.repartition(*KEY, *PARTS).sortWithinPartitions(*KEY, *PARTS, "side", "node")
    told = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    found = materialize(rows.mapInArrow(lambda b: _by_group(b, len(KEY) + len(PARTS), check, told), "node binary, links long, root binary"))
    drop(asked)
    edges = found.where("node <> root").select(F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b"))
    return found.groupBy("node").agg(F.sum("links").alias("links")), edges


def classified(found: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """`found` (`node`, `class_id`, `members`) with `n_links`, other rows linked with one of the class, and `component_id`.

    `first` is true of one class of each component: that of the least class_id (null last), then of the least node.
    """
    rooted = found.select("node", "class_id", "members").join(links, "node", "left").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("class_id").isNull(), "class_id", F.col("node").alias("of"))).alias("least"), F.count("*").alias("__n"))
    return join_counted(rooted, least, ["root"], "__n", rooted.count()).select("node", "class_id", "members", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least.class_id").alias("component_id"), (F.col("node") == F.col("least.of")).alias("first"))
