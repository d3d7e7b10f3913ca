"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes, in 2**BITS slots, of its words and of their first STEM bytes (value 1, the
lower half of the slots), of pairs of neighbours and of pairs with one word between (the upper half, with the value PAIR
and an L1 term of their own: most are rare, and would otherwise be learnt by heart); A-Z are lowered and punctuation
marks dropped. Rates are kept per coordinate, and the L1 terms leave most weights at exactly 0, so that the model is a
short list of slots and weights: at most 2**BITS of each, whatever the input's size, and therefore broadcast. Errors on
toxic texts, the rarer kind, count POSITIVE times. The parameters were chosen by the loss on folds of the training rows.

Learning uses at most TRAIN_ROWS labelled documents, those with the smallest_keys seeded hashes of their ids; their
features are made in parallel and one task runs over them PASSES times. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fold, smallest_keys, table
from .text import U64, WordHashes, mix

BITS = 18
TRAIN_ROWS = 8_000
PASSES = 4
STEM = 5
PAIR = 0.3
ALPHA, BETA, L1, L1_PAIR, L2 = 1.0, 1.0, 12.0, 4.0, 0.05
POSITIVE = 2.0
_MARKS = b".,;:!?\"'()[]{}*_"


class Features:
    """The slots of a text: those of words and stems, and those of pairs, each with repeats."""

    def __init__(self):
        self.hashes, self.stems = WordHashes(), WordHashes()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.encode("utf-8", "surrogatepass").lower().translate(None, _MARKS).split() if text else []
        w = self.hashes.of(tokens)
        stems = self.stems.of([x[:STEM] for x in tokens])
        single = np.concatenate([w * U64(0x9E3779B97F4A7C15), stems * U64(0xD6E8FEB86659FD93)])
        pairs = [mix(w[:-k] + U64(k), w[k:]) for k in (1, 2) if len(w) > k]
        return self.slot(single), self.slot(np.concatenate(pairs) if pairs else w[:0]) + 2 ** (BITS - 1)

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(65 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal with a rate for each slot; slot 2**BITS is the bias, which has no L1 term."""

    def __init__(self):
        self.l1 = np.repeat([L1, L1_PAIR, 0.0], [2 ** (BITS - 1), 2 ** (BITS - 1), 1])
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label
        gradient = error * values * (POSITIVE if label else 1.0)
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient * gradient


def learned(rows: list[tuple[int, np.ndarray]], passes: int = PASSES) -> Ftrl:
    """The model after `passes` over (label, slots) in the order given; untouched unless there are both labels."""
    model = Ftrl()
    made = [(label, np.append(at, 2**BITS), np.append(np.where(at < 2 ** (BITS - 1), 1.0, PAIR), 1.0)) for label, at in rows]
    for _ in range(passes if len({label for label, _ in rows}) == 2 else 0):
        for label, at, values in made:
            model.learn(at, values, label)
    return model


def _labelled(labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most `rows` labelled ids; of several labels for an id the largest counts; nulls are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    return smallest_keys(known, seed, rows, ["doc_id"], F.max("toxic").cast("int").alias("__label"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passes: int = PASSES, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights by slot, and the bias, from labelled documents (`doc_id`, `text`; `doc_id`, `toxic`).

    Without labels of both kinds all weights are 0 and the bias is that of a clean text.
    """
    chosen = _labelled(labels, rows, seed)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most TRAIN_ROWS ids
    texts = texts.groupBy("doc_id", "__label", "__order").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for b in batches:
            slots = [np.unique(np.concatenate(made.of(t.as_py()))).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("__order"), b.column("__label"), pa.array(slots, pa.binary())], ["at", "label", "slots"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        model = learned([(label, np.frombuffer(slots, np.int32)) for _, label, slots in rows], passes)
        w = model.weights()
        at = np.flatnonzero(w[:-1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary()), pa.array([float(w[-1]) if model.n[-1] else -5.0])], ["slots", "weights", "bias"])

    made = texts.mapInArrow(extract, "at long, label int, slots binary").coalesce(1).mapInArrow(fit, "slots binary, weights binary, bias double").collect()
    weights = np.zeros(2**BITS)
    bias = -5.0
    for r in made:
        weights[np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["weights"], np.float64)
        bias = r["bias"]
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """`docs` with the probability, from the whole text, that it is toxic.

    Null and empty texts get the bias's. Repeated rows are scored each, and an empty table gives an empty one. A text is
    read in one piece, however long. A column of the input named as `column` is replaced; others pass unchanged.
    """
    at = np.flatnonzero(model[0]).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((at, model[0][at], model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values, bias = sent.value
        weights = np.zeros(2**BITS)
        weights[slots] = values
        made = Features()
        for b in batches:
            scores = np.empty(b.num_rows)
            for i, t in enumerate(b.column(b.schema.get_field_index("text"))):
                single, pairs = (np.unique(f[weights[f] != 0]) for f in made.of(t.as_py()))
                x = bias + weights[single].sum() + PAIR * weights[pairs].sum()
                scores[i] = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
            yield pa.RecordBatch.from_arrays([*kept(b), pa.array(scores)], names=[*names, column])

    names = [c for c in docs.columns if c != column]
    kept = lambda b: [b.column(b.schema.get_field_index(c)) for c in names]
    schema = docs.select(*names).withColumn(column, F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)


def _fit_on_fold(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    return train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels of ids whose crc32 is divisible by 5 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, _fit_on_fold(spark, docs, sf_dir)).drop("text")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """The documents that score below `threshold`, with their columns; the labels of training folds teach the model."""
    return score(docs, _fit_on_fold(spark, docs, sf_dir), "__toxic").where(F.col("__toxic") < threshold).drop("__toxic")
