"""N-gram Jaccard join by MinHash banding: near-duplicate texts, on sets of five-word runs, at a similarity of 0.8.

Texts become sets of hashes of all runs of five words (A-Z lowered; a shorter text has one run). Equal texts are one
class. `band_plan` chooses bands so that a pair at the threshold shares a band with the target probability; classes
are shuffled on band hashes, and pairs that share one are verified on their full sets (see linking.py). Links make
components (see components.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linking import classified, count_links, shared_buckets, sketch
from .storage import WORD, materialize, table
from .text import U64, WordHashes, shingles, words

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` hashes with which a pair at `threshold` is found with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


def signature(runs: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """A 32-bit hash for each band from the minima of `bands` x `rows` hash functions."""
    random = np.random.default_rng(seed)
    by, plus = (random.integers(0, 2**64, (bands * rows, 1), np.uint64) for _ in range(2))
    by |= U64(1)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(runs), 2048):
        x = runs[at : at + 2048] * by + plus
        np.minimum(least, x.min(1), out=least)
    h = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T:
        h = (h ^ (column ^ (column >> U64(31)))) * U64(0x9E3779B97F4A7C15)
    return (h >> U64(32)).astype(np.uint32).view(np.int32)


def jaccard_at_least(threshold: float, most_cells: int = 1 << 23):
    """A verifier of payloads that hold sorted distinct 64-bit hashes; few pairs are compared one by one, others as matrices."""

    def linked(na, nb, common):
        return common >= threshold * (na + nb - common) - 1e-9

    def verify(left: list[bytes], right: list[bytes], wanted: np.ndarray) -> np.ndarray:
        a, b = ([np.frombuffer(x, np.uint64) for x in s] for s in (left, right))
        na, nb = (np.array([len(x) for x in s], np.float64) for s in (a, b))
        # sets whose sizes are too far apart can't be near, whatever they hold
        wanted = wanted & (np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :]) - 1e-9)
        i, j = np.nonzero(wanted)
        out = np.zeros(wanted.shape, bool)
        if len(i) <= 2 * (len(a) + len(b)):
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                out[x, y] = linked(na[x], nb[y], len(np.intersect1d(a[x], b[y], assume_unique=True)))
            return out
        every = a + b
        of = np.repeat(np.arange(len(every)), [len(x) for x in every])
        values, code, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        kept = times[code] > 1
        of, code = of[kept], code[kept]
        order = np.argsort(code, kind="stable")
        of, code = of[order], code[order]
        common = np.zeros((len(a), len(b)))
        width = max(1, most_cells // len(every))
        for at in range(0, len(values), width):
            lo, hi = np.searchsorted(code, [at, at + width])
            if lo == hi:
                continue
            c, columns = np.unique(code[lo:hi], return_inverse=True)
            x = np.zeros((len(every), len(c)), np.float32)
            x[of[lo:hi], columns] = 1
            common += x[: len(a)] @ x[len(a) :].T
        return linked(na[:, None], nb[None, :], common) & wanted

    return verify


def _keyed(docs: DataFrame, node: str = "node") -> DataFrame:
    """Documents that have words, with the key of their text as column `node`."""
    return docs.where(F.col("text").rlike(WORD)).withColumn(node, F.unhex(F.md5(F.col("text").cast("binary"))))


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """A row for each different text with words: `node`, `class_id` (least doc_id), `members`, `n_links`, `component_id`, `first`.

    `n_links` counts documents other than one of the class that link with it, copies among them; `component_id` is the
    least doc_id that links reach. Null doc_ids are passed over where there are others. `first` is true of one class of
    each component, that of the least doc_id, also where several texts have it or all ids are null.
    """
    bands, rows = band_plan(threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            made, sizes = [], []
            for t in b.column("text"):
                runs = shingles(hashes.of(words(t.as_py())), n)
                made.append(signature(runs, bands, rows))
                sizes.append(runs.nbytes)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id"), pa.array(map(sketch, made), pa.binary()), pa.array(made, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], ["node", "doc_id", "sketch", "bands", "size"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingles(hashes.of(words(t.as_py())), n).tobytes() for t in part.column("text")], pa.binary())], ["node", "payload"])

    keyed = _keyed(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = keyed.select("node", "doc_id", "text").mapInArrow(sign, f"node binary, doc_id {kind}, sketch binary, bands array<int>, size long")
    found = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("size").alias("size")))

    def payloads(needed: DataFrame) -> DataFrame:
        needed = needed.join(found.select("node", "class_id"), "node")
        texts = keyed.withColumnRenamed("node", "__node").join(needed, (F.col("__node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).select("node", "text").dropDuplicates(["node"])
        return texts.mapInArrow(sets, "node binary, payload binary")

    links, edges = count_links(shared_buckets(found), found, payloads, jaccard_at_least(threshold), bands)
    return classified(found, links, edges)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """A row per document: doc_id, class_id, n_links, component_id, kept (whether it has the least doc_id of its component, in
    one text if several texts have that id or all ids are null).

    Documents without words (null, empty, white space) link with nothing and are kept. Rows that repeat a doc_id and a
    text are links of each other; the column `kept` then says the same of each. Other columns of `docs` play no part.
    """
    keyed = _keyed(docs.select("doc_id", "text")).select("doc_id", "node")
    told = keyed.join(classes(docs, threshold, recall, n), "node").select("doc_id", "class_id", "n_links", "component_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
    bare = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return told.union(bare)


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """`docs`, with its columns, less all documents but one of each component; documents without words stay.

    Columns may have any names but `__node` and `__class`. A text is read in one piece, however long.
    """
    kept = classes(docs, threshold, recall, n).where("first").select(F.col("node").alias("__node"), F.col("class_id").alias("__class"))
    rows = _keyed(docs, "__node").join(kept, "__node").where(F.col("doc_id").eqNullSafe(F.col("__class"))).dropDuplicates(["__node"])
    bare = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return rows.select(*docs.columns).union(bare)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their number of links and group."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
