"""A trigram language model by deleted interpolation, over all texts.

P2(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's frequency c(v)
(by powers of two, 0 for unseen contexts), and P(w | u, v) = l3(b) c(u, v, w) / c(u, v) + (1 - l3(b)) P2(w | v), where b
is the bucket of c(u, v); P2 alone where (u, v) is unseen. A text's first word has only the end of a text before it, so
its longer context is that one too. The mixture weights of each bucket are learned by expectation-maximisation on
held-out counts: one part of the training documents (HELD) is deleted from all counts, and the weights that make that
part likeliest are found, first those of P2, then l3; the counts used for scoring are those of all training documents.

How it runs. Tokens are never joined one by one:
1. Each task turns its documents into chunks of about CHUNK tokens, those of HELD documents apart: a vocabulary of 64-bit
   word hashes and the texts as numbers in it, written to the shared folder.
2. Each chunk asks for the counts of its distinct words, pairs and triples of words. Requests go to ranges of the hash
   space as sorted blocks; however common an n-gram is, a chunk names it once. A range adds up the training counts that
   the requests carry and answers each chunk in the order of its keys.
3. Chunks meet their answers: those of HELD documents twice to collect evidence, all of them once to score.

Words have 64-bit keys. The hashes of pairs and triples are cut to SPARE bits more than the number of tokens has, so that
at any size an unseen one is taken for another with a chance of at most 2^-SPARE, and a sorted key costs about three bytes.

What is shuffled is proportional to the chunks' distinct n-grams, a few bytes each; the number of ranges follows the
number of tokens. Only the evidence for EM is collected: counts in cells of (bucket, log ratios), at most
48 x 200 x 200 cells and some thousands in practice, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fold, materialize, table
from .text import WordHashes, mix, words

CHUNK = 1_000_000
RANGE = 2_000_000
SPARE = 16  # bits of a pair's or triple's key beyond those of the number of tokens
END = b"\n"  # no word holds white space
STEP = 4  # cells to a factor of two
TRAIN, HELD, OTHER = 0, 1, 2


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, one plane for each byte of the type."""
    plane = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(plane.tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


class Chunk:
    """Texts as numbers; the words, pairs and triples they need, in the order of their hashes."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, roles: np.ndarray):
        self.lengths, self.roles = lengths, roles
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        # number words by the order of their hashes; numbers at each token are short ones, as all of them stay in memory
        order = np.argsort(vocabulary, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.word_keys = vocabulary[order]
        self.word = rank[tokens]
        end = self.word[self.starts + lengths - 1]
        self.context = np.concatenate([[0], self.word[:-1]]).astype(np.int32) if len(tokens) else self.word
        self.context[self.starts] = end
        ends = np.concatenate([[np.uint64(0)], self.word_keys])[end[:1] + 1]  # the key of END; none in an empty chunk
        n_words = len(order)
        self.pair_keys, self.pair = _numbered(self.context, n_words, self.word, lambda x: mix(self.word_keys[x // n_words], self.word_keys[x % n_words]))
        # the pair before each token; at a text's start, two ends
        before = np.concatenate([[0], self.pair[:-1]]).astype(np.int32) if len(tokens) else self.pair
        before[self.starts] = len(self.pair_keys)
        pairs = np.concatenate([self.pair_keys, mix(ends, ends)])
        self.triple_keys, self.triple = _numbered(before, n_words, self.word, lambda x: mix(pairs[x // n_words], self.word_keys[x % n_words]))
        self.trained = np.repeat(roles != OTHER, lengths)

    def parts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and their numbers at each token, for words, pairs and triples."""
        return [(self.word_keys, self.word), (self.pair_keys, self.pair), (self.triple_keys, self.triple)]

    def found(self, counts: list[np.ndarray]) -> list[np.ndarray]:
        """At each token the counts of the word, its context, the pair, the longer context and the triple."""
        words, pairs, triples = counts
        context = words[self.context]
        longer = np.concatenate([[0], pairs[self.pair[:-1]]]) if len(self.pair) else context.copy()
        longer[self.starts] = context[self.starts]
        return [words[self.word], context, pairs[self.pair], longer, triples[self.triple]]


def _numbered(before: np.ndarray, n_words: int, word: np.ndarray, key: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the distinct codes before * n_words + word, and the place of each code's key among them."""
    codes = before.astype(np.int64)
    codes *= n_words
    codes += word
    found, inverse = np.unique(codes, return_inverse=True)
    del codes
    keys = key(found)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return keys[order], rank[inverse]


def _chunks(docs: DataFrame, role: str) -> DataFrame:
    """A row for each chunk, from `doc_id`, `text` and the column `role`; `held` chunks have HELD documents and no others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, held boolean, doc_ids array<{kind}>, roles binary, lengths binary, vocabulary binary, tokens binary, n_tokens long, n_train long"
    names = [x.split()[0] for x in schema.split(", ")]

    class Open:
        """A chunk that still takes documents."""

        def __init__(self):
            self.index: dict[bytes, int] = {}
            self.ids, self.roles, self.lengths, self.parts, self.total = [], [], [], [], 0

        def add(self, doc_id: object, text: str | None, role: int) -> None:
            tokens, index = [*words(text), END], self.index
            for t in tokens:
                if t not in index:
                    index[t] = len(index)
            self.parts.append(np.fromiter(map(index.__getitem__, tokens), np.uint32, len(tokens)))
            self.ids.append(doc_id)
            self.roles.append(role)
            self.lengths.append(len(tokens))
            self.total += len(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, hashes = TaskContext.get().partitionId() << 32, WordHashes()
        open_chunks = {False: Open(), True: Open()}

        def flush(held: bool) -> pa.RecordBatch:
            nonlocal number
            c, open_chunks[held] = open_chunks[held], Open()
            n, r = np.array(c.lengths, np.int32), np.array(c.roles, np.uint8)
            row = [number, held, c.ids, r.tobytes(), n.tobytes(), squeeze(hashes.of(list(c.index))), squeeze(np.concatenate(c.parts)), c.total, int(n[r != OTHER].sum())]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        kinds = [pa.int64(), pa.bool_(), None, *[pa.binary()] * 4, *[pa.int64()] * 2]
        for batch in batches:
            kinds[2] = pa.list_(batch.schema.field(0).type)
            for i, t, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                open_chunks[r == HELD].add(i, t.as_py(), r)
                if open_chunks[r == HELD].total >= CHUNK:
                    yield flush(r == HELD)
        for held, c in list(open_chunks.items()):
            if c.ids:
                yield flush(held)

    return docs.select("doc_id", "text", F.col(role).cast("int").alias("role")).mapInArrow(run, schema)


def _open(row: dict) -> Chunk:
    return Chunk(unsqueeze(row["vocabulary"], np.uint64), unsqueeze(row["tokens"], np.uint32), np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["roles"], np.uint8))


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges of the hash space begin and end in sorted keys."""
    edges = [(i << 64) // ranges for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _answers(chunks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(chunk, held, part, range, counts, held_counts) for part 0 (words), 1 (pairs) and 2 (triples), the counts of HELD
    documents for their chunks only; and rows of chunk -1 with the number of different words trained.

    Keys of pairs and triples are cut to `bits` bits; those of a chunk that get equal are answered with their sum.
    """
    asking = {"chunk": pa.int64(), "held": pa.bool_(), "part": pa.int32(), "range": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    answering = {"chunk": pa.int64(), "held": pa.bool_(), "part": pa.int32(), "range": pa.int32(), "counts": pa.binary(), "held_counts": pa.binary(), "trained": pa.int64()}

    def batch(kinds: dict[str, pa.DataType], *row: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds.values(), strict=True)], list(kinds))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _open(row)
            for part, (keys, of) in enumerate(c.parts()):
                counts = np.bincount(of[c.trained], minlength=len(keys)).astype(np.uint32)
                cuts = _cuts(keys, ranges)
                if part:
                    keys = keys >> np.uint64(64 - bits)
                for i in np.flatnonzero(np.diff(cuts)):
                    lo, hi = cuts[i : i + 2]
                    gaps = np.diff(keys[lo:hi], prepend=np.uint64(0))
                    yield batch(asking, row["chunk"], row["held"], part, int(i), squeeze(gaps), squeeze(counts[lo:hi]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []

        def close() -> Iterator[pa.RecordBatch]:
            part, place = group[0]["part"], group[0]["range"]
            keys = [np.cumsum(unsqueeze(r["keys"], np.uint64), dtype=np.uint64) for r in group]
            sizes = [len(k) for k in keys]
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            n = len(found)
            del found
            inverse = inverse.astype(np.int32)
            times = np.concatenate([unsqueeze(r["counts"], np.uint32) for r in group])
            counts = np.bincount(inverse, times, n).astype(np.int64)
            times[np.repeat([not r["held"] for r in group], sizes)] = 0
            held = np.bincount(inverse, times, n).astype(np.int64)
            at = 0
            for r, size in zip(group, sizes, strict=True):
                mine = inverse[at : at + size]
                at += size
                yield batch(answering, r["chunk"], r["held"], part, place, squeeze(counts[mine]), squeeze(held[mine]) if r["held"] else None, 0)
            yield batch(answering, -1, False, part, place, None, None, int((counts > 0).sum()))

        for row in _rows(batches):
            if group and (row["part"], row["range"]) != (group[0]["part"], group[0]["range"]):
                yield from close()
                group = []
            group.append(row)
        if group:
            yield from close()

    asked = chunks.mapInArrow(ask, "chunk long, held boolean, part int, range int, keys binary, counts binary")
    return asked.repartition("part", "range").sortWithinPartitions("part", "range", "chunk").mapInArrow(add, "chunk long, held boolean, part int, range int, counts binary, held_counts binary, trained long")


def bucket(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 if unseen, else 1 plus the power of two."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int8)


def learn_weights(cells: list[tuple], orders: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, order) by EM from counts in cells of (bucket, log2 ratio for each order but the last, count).

    Ratios are those of an order's estimate to the last order's, in STEPs; a ratio of 0 has the cell NONE. One imagined
    token for each order keeps all weights above 0.
    """
    weights = np.full((64, orders), 1 / orders)
    if not cells:
        return weights
    b, *cells, n = (np.array(x) for x in zip(*cells, strict=True))
    ratio = np.stack([*(np.where(r == NONE, 0, 2.0 ** (r / STEP)) for r in cells), np.ones(len(b))], 1)
    for _ in range(rounds):
        share = weights[b] * ratio
        share *= (n / share.sum(1))[:, None]
        total = np.ones((64, orders))
        np.add.at(total, b, share)
        weights = total / total.sum(1, keepdims=True)
    return weights


NONE = -1000


def steps(estimate: np.ndarray, base: np.ndarray | float) -> np.ndarray:
    """The cells of the ratios of estimates to a base."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(estimate > 0, np.round(STEP * np.log2(estimate / base)), NONE).astype(np.int64)


def short_model(w: np.ndarray, h: np.ndarray, p: np.ndarray, n: int, v: int, weights: np.ndarray) -> np.ndarray:
    """P2 of words with counts w, contexts h and pairs p among n training tokens, v of them different."""
    b = bucket(h)
    model = weights[:, 0][b] * p / np.maximum(h, 1)
    model += weights[:, 1][b] * w / max(1, n)
    model += weights[:, 2][b] / (v + 1)
    return model


def score(docs: DataFrame, role: str) -> DataFrame:
    """`doc_id`, `role`, counts and scores of all texts; `role` is TRAIN, HELD (training, deleted for EM) or OTHER.

    Null and empty texts are one token, the end. Repeated rows count and are scored each, null ids too; other columns,
    whatever their names, aren't read. A text is never cut: a long one is a chunk by itself, so it must fit a task. An
    empty table gives no rows. With no training documents every text has 0 known tokens and the weights' fallback.
    """
    chunks = materialize(_chunks(docs, role))
    sums = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train")), F.coalesce(F.sum(F.when(F.col("held"), F.col("n_train"))), F.lit(0)).alias("n_held")).first()
    n, n_held = sums["n_train"], sums["n_held"]
    ranges = max(1, -(-sums["n_tokens"] // RANGE))
    bits = min(64, sums["n_tokens"].bit_length() + SPARE)
    answers = materialize(_answers(chunks.select("chunk", "held", "roles", "lengths", "vocabulary", "tokens"), ranges, bits))
    trained = answers.where("chunk = -1 and part = 0").agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("v")).first()["v"]
    payload = ("doc_ids", "roles", "lengths", "vocabulary", "tokens")

    def meeting(sent: DataFrame, told: DataFrame, fields: tuple[str, ...]) -> DataFrame:
        """Chunks and behind each of them its answers."""
        told = told.select("chunk", "part", "range", *fields, *(F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in payload))
        none = [F.lit(None).cast("binary").alias(f) for f in fields]
        rows = sent.select("chunk", F.lit(-1).alias("part"), F.lit(-1).alias("range"), *none, *payload).union(told)
        return rows.repartition("chunk").sortWithinPartitions("chunk", "part", "range")

    def met(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[tuple[dict, Chunk, list[list[np.ndarray]]]]:
        """Chunks, with the counts of their words, pairs and triples for each field."""
        row, found = None, None

        def closed() -> tuple[dict, Chunk, list[list[np.ndarray]]]:
            return row, _open(row), [[np.concatenate(x) for x in of] for of in found]

        for r in _rows(batches):
            if r["part"] == -1:
                if row is not None:
                    yield closed()
                row, found = r, [[[] for _ in range(3)] for _ in fields]
            else:
                for k, f in enumerate(fields):
                    found[k][r["part"]].append(unsqueeze(r[f], np.int64))
        if row is not None:
            yield closed()

    both = ("counts", "held_counts")
    held = meeting(chunks.where("held"), answers.where("held and chunk >= 0"), both)
    n_left = max(1, n - n_held)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Counts at the tokens of HELD documents, those documents deleted."""
        for _, c, (counts, deleted) in met(batches, both):
            yield [a - b for a, b in zip(c.found(counts), c.found(deleted), strict=True)]

    def cells(evidence: Callable[[list[np.ndarray]], list[np.ndarray]], names: list[str]) -> list[tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for counts in left(batches):
                found, times = np.unique(np.stack(evidence(counts), 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found.T), pa.array(times.astype(np.int64))], [*names, "n"])

        made = held.mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "n"]))
        return sorted(tuple(x) for x in made.groupBy(names).agg(F.sum("n").alias("n")).collect())

    def short_evidence(counts: list[np.ndarray]) -> list[np.ndarray]:
        w, h, p, _, _ = counts
        return [bucket(h), steps(p / np.maximum(h, 1), 1 / (trained + 1)), steps(w / n_left, 1 / (trained + 1))]

    weights = learn_weights(cells(short_evidence, ["b", "r2", "r1"]), 3)

    def long_evidence(counts: list[np.ndarray]) -> list[np.ndarray]:
        w, h, p, g, t = counts
        return [bucket(g), steps(t / np.maximum(g, 1), short_model(w, h, p, n_left, trained, weights))]

    long_weights = learn_weights(cells(long_evidence, ["b", "r3"]), 2)
    long_weights[0] = 0, 1  # an unseen context says nothing

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c, (counts,) in met(batches, ("counts",)):
            w, h, p, g, t = c.found(counts)
            counts.clear()
            model = short_model(w, h, p, n, trained, weights)
            del h, p
            share = long_weights[:, 0][bucket(g)]
            model = np.log10(share * t / np.maximum(g, 1) + (1 - share) * model)
            del share, g, t
            base = np.log10((w + 1) / (n + trained + 1))
            sums = [np.add.reduceat(x, c.starts) for x in (model, base, (w > 0).astype(np.int64))]
            ids = pa.array(row["doc_ids"], pa_id)
            yield pa.RecordBatch.from_arrays([ids, pa.array(c.roles.astype(np.int32)), pa.array(c.lengths), pa.array(sums[2]), pa.array(np.full(len(ids), n, np.int64)), pa.array(sums[1]), pa.array(sums[0])], ["doc_id", "role", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType
    pa_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind.simpleString())
    parts = meeting(chunks, answers.where("chunk >= 0"), ("counts",))
    return parts.mapInArrow(scores, f"doc_id {kind.simpleString()}, role int, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose id's crc32 leaves 2 modulo 7 are not learned from, those that leave 5 are deleted for EM."""
    part = fold("doc_id", 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(part == 2, OTHER).when(part == 5, HELD).otherwise(TRAIN).alias("role"))
    found = score(docs, "role")
    return found.select("doc_id", (F.col("role") == OTHER).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
