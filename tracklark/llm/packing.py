"""Packing texts into training sequences as vector bin packing.

Every bin has three capacities: tokens, segments and loss-bearing tokens. The next piece for the open bin is the one
whose demand has the largest dot product with the bin's remaining capacities (each as a share of its limit) among
those that fit. When none fits, the piece with the largest product is cut to what is left, so bins are full unless
the segment or loss limit binds. Documents of more than a sequence give whole sequences first.

Each task packs its own partition as a stream: a pool of POOL pieces at most is open, whatever the partition's size,
and only the last bins of a partition may stay short for want of pieces. The result is written to the shared folder,
and the pieces of those last bins are packed once more, by a task for every MERGED of them. Texts are not shuffled. A
task that is run again makes the same sequences, for it reads the same rows in the same order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, table

SEQUENCE = 1024
SEGMENTS = 256
POOL = 2048
MERGED = 4096
_CACHE = 600_000
#: White space but for space, tab and line ends. Fixed values.
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceTokenizer(dict):
    """Ids of texts as little-endian unsigned 32-bit integers, by a byte-level BPE file of the `tokenizers` library.

    The ids are those of `tokenizers`, but its file's vocabulary (in which ids are merge ranks) is run by `tiktoken`,
    which takes a third of the time. A space starts a new word and merges don't cross words, so the ids of a text are
    those of its pieces between spaces; this dictionary keeps pieces' ids. Texts with longer white space are done as a
    whole, and those that spell out an added token by `tokenizers` itself.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = str(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in self.added}
        self.encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        ids = self.encode(" " + piece)
        made = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return made

    def of(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text or text[-1:] == " " or "\n " in text or "\t " in text or "\r " in text or _RARE_SPACE.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, _, rest = text.partition(" ")
        ids = np.array(self.encode(first), "<u4").tobytes()
        return ids + b"".join(map(self.__getitem__, rest.split(" "))) if _ else ids


class Packer:
    """Packs items as they come; `bins()` yields finished sequences, each a list of (item, start, length)."""

    def __init__(self, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL, cut: bool = True):
        self.limits = np.array([tokens, segments, loss or tokens], float)
        self.pool, self.cut = pool, cut
        self.items: list = [None] * (2 * pool)
        self.start, self.end, self.loss_from = (np.zeros(2 * pool, np.int64) for _ in range(3))
        self.free, self.open = list(range(2 * pool))[::-1], np.zeros(2 * pool, bool)
        self.n = 0

    def add(self, item: object, start: int, end: int, loss_from: int) -> None:
        i = self.free.pop()
        self.items[i], self.start[i], self.end[i], self.loss_from[i], self.open[i] = item, start, end, loss_from, True
        self.n += 1

    def _bin(self) -> list[tuple[object, int, int]]:
        """The next sequence; what it takes leaves the pool."""
        at = np.flatnonzero(self.open)
        length = self.end[at] - self.start[at]
        loss = np.maximum(0, self.end[at] - np.maximum(self.start[at], self.loss_from[at]))
        demand = np.stack([length, np.ones(len(at), np.int64), loss], 1)
        left, placed = self.limits.copy(), []
        while len(at) and left[0] > 0 and left[1] > 0:
            product = (demand / self.limits) @ (left / self.limits)
            fits = (demand <= left).all(1)
            k = int(np.argmax(np.where(fits, product, -1.0)))
            n = int(demand[k, 0])
            if not fits[k]:
                if not self.cut:
                    break
                k = int(np.argmax(product))
                n = int(min(demand[k, 0], left[0]))
                i = at[k]
                # loss-bearing tokens are the last ones of an item
                n = min(n, int(max(0, self.loss_from[i] - self.start[i]) + left[2]))
                if n <= 0:
                    break
            i = at[k]
            placed.append((self.items[i], int(self.start[i]), n))
            left -= (n, 1, max(0, int(self.start[i]) + n - max(int(self.start[i]), int(self.loss_from[i]))))
            self.start[i] += n
            if self.start[i] == self.end[i]:
                self.open[i], self.items[i] = False, None
                self.free.append(int(i))
                self.n -= 1
                at, demand = np.delete(at, k), np.delete(demand, k, 0)
            else:  # the bin is full, or its loss limit is
                break
        return placed

    def bins(self, least: int | None = None) -> Iterator[list[tuple[object, int, int]]]:
        while self.n > (self.pool if least is None else least):
            if not (made := self._bin()):
                i = int(np.flatnonzero(self.open)[0])
                raise ValueError(f"an item of {self.end[i] - self.start[i]} tokens can't be placed without a cut")
            yield made


def _emitter(checksum: bool, first: int) -> tuple[Callable, Callable]:
    """Collects the rows of sequences, numbered from `first`, and makes record batches of them."""
    rows: list[tuple] = []
    sequence = first

    def put(made: list[tuple], short: bool) -> None:
        nonlocal sequence
        offset = 0
        for (row, begin, ids, doc_tokens, loss_from), start, n in made:
            piece = ids[4 * start : 4 * (start + n)]
            rows.append((*row, begin + start, n, piece if short or not checksum else None, zlib.crc32(piece), doc_tokens, max(0, start + n - max(start, loss_from)), sequence, offset, short))
            offset += n
        sequence += 1

    def flush(kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        types = [*kinds, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return put, flush


def pack(docs: DataFrame, tokenizer_path: str | None = None, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int | None = None, end_id: int = 0, keep: tuple[str, ...] = ("doc_id",), loss_share: str | None = None, checksum: bool = False) -> DataFrame:
    """A row for each piece of each text: `keep`, `start`, `length`, `ids`, `ids_crc32`, `doc_tokens`, `loss_tokens`, `sequence_id`, `offset`.

    A text is its ids and then `end_id`; null counts as empty. `ids` holds the piece's ids (little-endian, 32 bits); with
    `checksum` it is left out. `loss_share` names a column with the share (0 to 1, null: 1) of a text's last ids that
    bear loss. Repeated rows and ids are packed as rows of their own; of pieces with equal products the one that came
    first into its place in the pool is taken. An empty table gives an empty one. Only the columns named are read, so
    others may have any name; those in `keep` must not be named as the result's.
    """
    schema = docs.select(*keep).schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids", "binary"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("loss_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("__short", "boolean")):
        schema = schema.add(name, kind)
    end = np.array([end_id], "<u4").tobytes()
    docs = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"), (F.lit(1.0) if loss_share is None else F.coalesce(loss_share, F.lit(1.0))).cast("double").alias("__share"))
    limit = min(tokens, loss or tokens)
    width, names = len(keep), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = PieceTokenizer(tokenizer_path), Packer(tokens, segments, loss)
        put, flush = _emitter(checksum, TaskContext.get().partitionId() << 36)
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(width)]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [part.column(i).to_pylist() for i in range(width + 2)]
                for row, text_ids, share in zip(zip(*columns[:-2], strict=True), map(tokenizer.of, columns[-2]), columns[-1], strict=True):
                    ids = text_ids + end
                    n = len(ids) // 4
                    item, start = (row, 0, ids, n, n - round(share * n)), 0
                    while n - start >= limit:  # whole sequences
                        put([(item, start, limit)], False)
                        start += limit
                    if start < n:
                        packer.add(item, start, n, item[4])
                    for made in packer.bins():
                        put(made, False)
                yield flush(kinds, names)
        if kinds is not None:
            for made in packer.bins(0):
                put(made, sum(n for _, _, n in made) < tokens)
            yield flush(kinds, names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs the pieces of short bins: each is an item whose ids are those from `start` on."""
        packer = Packer(tokens, segments, loss)
        put, flush = _emitter(checksum, 1 << 61 | TaskContext.get().partitionId() << 36)
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(width)]
            for *row, start, n, ids, _, doc_tokens, loss_tokens, _, _, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add((row, start, ids, doc_tokens, n - loss_tokens), 0, n, n - loss_tokens)
                for made in packer.bins():
                    put(made, False)
            yield flush(kinds, names)
        if kinds is not None:
            for made in packer.bins(0):
                put(made, False)
            yield flush(kinds, names)

    first = materialize(docs.mapInArrow(run, schema))
    short = first.where("__short")
    tasks = short.select("sequence_id").distinct().count() // MERGED + 1
    merged = short.coalesce(tasks).mapInArrow(again, schema)
    return first.where("not __short").unionByName(merged).drop("__short", *(["ids"] if checksum else []))


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str = "", tokenizer_path: str | None = None) -> DataFrame:
    """The pieces of all texts, with a checksum in place of the ids."""
    made = pack(docs.select("doc_id", "text"), tokenizer_path, checksum=True)
    return made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    return packed_pieces(spark, table(spark, sf_dir, "documents"))
