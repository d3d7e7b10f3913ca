"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of words with smallest period q (words q apart are identical), at least `least` long and `times` times
its period, that no neighbouring word extends with that period. Texts are worked on alone, inside the rows' own tasks:

1. Grammar. Re-Pair over word ids: the most frequent pair of neighbouring symbols is replaced by a new symbol, again and
   again, until no pair occurs twice. A round replaces at once all pairs that are, wherever they occur, more frequent
   than those they overlap with, in all texts of a chunk; the most frequent pair of a text is always among them.
2. Boundaries. A run lies across the boundary of the two halves of exactly one symbol, the lowest that holds it, or
   between two symbols of what is left at the top. For each symbol once (not for each place where it is used), runs
   across its boundary are looked for inside its expansion. A run of four periods has at least two on one side, so near
   the boundary there is a string of G words, G the power of two with G/2 < q <= G, whose next occurrence is q away. Names
   of all strings of 1, 2, 4, ... words that a text repeats give these periods, and then the longest extensions.
3. Translation. A symbol's runs are moved to every place where the symbol is used; branches without runs are not
   followed. What lies inside a longer interval of its period (or overlaps it by a period) is merged with it.

Names are exact numbers, not fingerprints, so that no run is made up or missed. Work and memory grow as n log n at most
with a text's words; a text is a row and must fit a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import WORD, id_text, table

LEAST = 6
TIMES = 4
#: Words that are worked on together; a longer text is a chunk of its own.
CHUNK = 150_000


def _shared(keys: np.ndarray) -> np.ndarray:
    """Where a key occurs that occurs elsewhere too; few others may be among them (a cheap sieve before sorting)."""
    bits = max(8, int(len(keys)).bit_length() + 2)
    slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)


class Grammar:
    """Symbols from `terminals` on have halves `left` and `right`, `size` words, an occurrence at word `first`, and the
    `made` round; `top` are the symbols left, at words `top_at`."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.terminals = total = int(words.max()) + 1 if len(words) else 0
        left, right, first, made = [], [], [], []
        sizes = np.ones(total, np.int64)
        symbols, at, of = words, np.arange(len(words)), np.searchsorted(starts, np.arange(len(words)), "right")
        done: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0
        while len(symbols) > 1:
            place, group, times = self._repeated(symbols, total)
            busy = np.zeros(int(of[-1]) + 1, bool)
            busy[of[place]] = True
            if not busy.all():
                stays = busy[of]
                done.append((symbols[~stays], at[~stays]))
                moved = np.cumsum(stays) - 1
                symbols, at, of, place = symbols[stays], at[stays], of[stays], moved[place]
            if not len(place):
                break
            chosen = self._chosen(place, group, times, len(symbols))
            place, group = place[chosen], group[chosen]
            names, which, n = np.unique(group, return_inverse=True, return_counts=True)
            whole = n == times[names]  # a pair is replaced wherever it occurs, or not in this round
            place, which = place[whole[which]], (np.cumsum(whole) - 1)[which[whole[which]]]
            example = np.empty(int(whole.sum()), np.int64)
            example[which[::-1]] = place[::-1]
            left.append(symbols[example])
            right.append(symbols[example + 1])
            first.append(at[example])
            made.append(np.full(len(example), turn))
            sizes = np.concatenate([sizes, sizes[left[-1]] + sizes[right[-1]]])
            symbols = symbols.copy()
            symbols[place] = total + which
            kept = np.ones(len(symbols), bool)
            kept[place + 1] = False
            symbols, at, of = symbols[kept], at[kept], of[kept]
            total += len(example)
            turn += 1
        done.append((symbols, at))
        flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        self.left, self.right, self.first, self.made, self.size = flat(left), flat(right), flat(first), flat(made), sizes
        top, top_at = flat([s for s, _ in done]), flat([a for _, a in done])
        order = np.argsort(top_at, kind="stable")
        self.top, self.top_at, self.rounds = top[order], top_at[order], turn

    @staticmethod
    def _repeated(symbols: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs that occur twice or more (of a pair of equal symbols every second one of a stretch), with
        the pair's number and how often it occurs."""
        same = symbols[:-1] == symbols[1:]
        n = np.arange(len(same))
        begins = same.copy()
        begins[1:] &= ~same[:-1]
        odd = same & ((n - np.maximum.accumulate(np.where(begins, n, 0))) & 1).astype(bool)
        place = np.flatnonzero(~odd)
        key = symbols[place] * total + symbols[place + 1]
        some = _shared(key)
        place, key = place[some], key[some]
        _, group, times = np.unique(key, return_inverse=True, return_counts=True)
        often = times[group] > 1
        return place[often], group[often], times

    @staticmethod
    def _chosen(place: np.ndarray, group: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """Which places hold a pair more frequent than those that overlap it; ties by a mixed number of the pair."""
        mixed = np.arange(len(times), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rank = np.empty(len(times), np.int64)
        rank[np.lexsort((mixed, times))] = np.arange(1, len(times) + 1)
        by_place = np.zeros(n + 1, np.int64)
        by_place[place + 1] = rank[group]
        mine = by_place[place + 1]
        after = np.append(by_place, 0)[place + 2]
        return (mine > by_place[place]) & (mine > after)


class Names:
    """For strings of 1, 2, 4, ... words that a text repeats: their places in order, and numbers that tell them apart."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(np.bincount(words)[words] > 1) if n else np.zeros(0, np.int64)
        name, reach, dense = words[at], 1, np.full(n, -1, np.int64)
        while len(at):
            self.levels.append((at, name))
            dense[at] = name
            inside = np.flatnonzero(at + reach < n)
            then = dense[at[inside] + reach]
            dense[at] = -1
            inside, then = inside[then >= 0], then[then >= 0]
            key = name[inside] * (int(name.max()) + 1) + then
            some = _shared(key)
            inside, key = inside[some], key[some]
            _, name, times = np.unique(key, return_inverse=True, return_counts=True)
            often = times[name] > 1
            at, name, reach = at[inside[often]], name[often], 2 * reach

    def next_ones(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of strings of G = 2**level words whose next occurrence is q > G/2 and at most G away, and q."""
        at, name = self.levels[level]
        reach = 1 << level
        order = np.argsort(name, kind="stable")
        one, two = at[order[:-1]], at[order[1:]]
        near = (name[order[:-1]] == name[order[1:]]) & (two - one <= reach) & (2 * (two - one) > reach)
        return one[near], (two - one)[near]

    def same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings of 2**level words at `a` and `b` are the same (a is not b)."""
        at, name = self.levels[level]
        i, j = (np.minimum(np.searchsorted(at, x), len(at) - 1) for x in (a, b))
        return (at[i] == a) & (at[j] == b) & (name[i] == name[j])

    def extended(self, start: np.ndarray, end: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of period q, as long as they get inside [lo, hi)."""
        start, end = start.copy(), end.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            step = 1 << level
            fits = np.flatnonzero(end + step <= hi)
            end[fits[self.same(level, end[fits] - q[fits], end[fits])]] += step
            fits = np.flatnonzero(start - step >= lo)
            start[fits[self.same(level, start[fits] - step, start[fits] - step + q[fits])]] -= step
        return start, end


def _across(names: Names, n: int, boundary: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(which, start, end, period) of the runs across boundaries, each inside [lo, hi) of its boundary."""
    out = [np.zeros((4, 0), np.int64)]
    where = np.full(n + 1, -1, np.int64)
    for level in range(len(names.levels)):
        one, q = names.next_ones(level)
        if not len(one):
            continue
        reach = 1 << level
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        for places, backs in ((one, (0, reach // 2)), (one + q, (reach, reach // 2))):
            where[places] = np.arange(len(one))
            for back in backs:
                at = boundary - back
                found = np.where(at >= 0, where[at], -1)
                which = np.flatnonzero(found >= 0)
                asked.append((which, found[which]))
            where[places] = -1
        which, found = (np.concatenate(x) for x in zip(*asked, strict=True))
        start, period = one[found], q[found]
        end = start + period + reach
        fits = (start >= lo[which]) & (end <= hi[which])
        which, start, end, period = which[fits], start[fits], end[fits], period[fits]
        start, end = names.extended(start, end, period, lo[which], hi[which])
        long = end - start >= np.maximum(least, times * period)
        out.append(np.stack([which[long], start[long], end[long], period[long]]))
    return tuple(np.unique(np.concatenate(out, 1), axis=1))


def _everywhere(g: Grammar, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) at all places where the symbols `which` (numbered from 0) of the runs are used."""
    own = np.zeros(len(g.left), bool)
    own[which] = True
    holds = np.zeros(len(g.size), bool)
    by_round = np.searchsorted(g.made, np.arange(g.rounds + 1))
    for r in range(g.rounds):
        part = slice(by_round[r], by_round[r + 1])
        holds[g.terminals :][part] = own[part] | holds[g.left[part]] | holds[g.right[part]]
    waiting = [[] for _ in range(g.rounds)]

    def put(symbols: np.ndarray, at: np.ndarray) -> None:
        kept = holds[symbols]
        symbols, at = symbols[kept] - g.terminals, at[kept]
        turn = g.made[symbols]
        for r in np.unique(turn):
            waiting[r].append((symbols[turn == r], at[turn == r]))

    put(g.top, g.top_at)
    order = np.argsort(which, kind="stable")
    sorted_which = which[order]
    runs, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in range(g.rounds - 1, -1, -1):
        if not waiting[r]:
            continue
        symbols, at = (np.concatenate(x) for x in zip(*waiting[r], strict=True))
        waiting[r] = []
        a, b = np.searchsorted(sorted_which, symbols), np.searchsorted(sorted_which, symbols, "right")
        n = b - a
        picked = order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        runs.append(picked)
        starts.append(np.repeat(at, n) + start[picked] - g.first[which[picked]])
        put(g.left[symbols], at)
        put(g.right[symbols], at + g.size[g.left[symbols]])
    run, begin = np.concatenate(runs), np.concatenate(starts)
    return run, begin, begin + (end - start)[run]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals: those of a period that overlap by that period become one. In the order of start, then period."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    shift = period * (2 * n + 2)
    reach = np.maximum.accumulate(end + shift)
    begins = np.ones(len(start), bool)
    begins[1:] = (start + shift + period)[1:] > reach[:-1]
    heads = np.flatnonzero(begins)
    last = np.append(heads[1:], len(start)) - 1
    start, period = start[heads], period[heads]
    end = reach[last] - shift[heads] if len(heads) else end[:0]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts that lie one after another, a text's ids being in no other text.

    `starts` holds the first word of each text that has words. `times` must be 4 at least.
    """
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    g, names = Grammar(words, starts), Names(words)
    n = len(words)
    ends = np.append(starts[1:], n)
    text = np.searchsorted(starts, g.top_at, "right") - 1
    inner = np.flatnonzero(g.top_at != starts[text])
    boundary = np.concatenate([g.first + g.size[g.left], g.top_at[inner]])
    lo = np.concatenate([g.first, starts[text[inner]]])
    hi = np.concatenate([g.first + g.size[g.terminals :], ends[text[inner]]])
    which, start, end, period = _across(names, n, boundary, lo, hi, least, times)
    below = which < len(g.left)
    run, begin, stop = _everywhere(g, which[below], start[below], end[below])
    every = np.concatenate([begin, start[~below]]), np.concatenate([stop, end[~below]]), np.concatenate([period[below][run], period[~below]])
    return merged(*every, n)


def _chunk(texts: list[bytes], least: int, times: int) -> tuple[list[list[dict]], list[bytes], list[int]]:
    """Runs, collapsed text and number of words of each text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    number = count()
    words = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for s in split:
        words[at : at + len(s)] = np.fromiter(map(defaultdict(number.__next__).__getitem__, s), np.int64, len(s))
        at += len(s)
    begins = np.cumsum(sizes) - sizes
    start, end, period = runs_of(words, begins[sizes > 0], least, times)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    dropped = np.cumsum(change) > 0
    of = np.searchsorted(begins, start, "right") - 1
    # of texts that begin at the same word all but the last are empty
    found: list[list[dict]] = [[] for _ in texts]
    for k, a, b, q in zip(of.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        found[k].append({"start": a - int(begins[k]), "length": b - a, "period": q})
    kept = [[w for w, d in zip(s, dropped[b : b + len(s)].tolist(), strict=True) if not d] if f else s for s, b, f in zip(split, begins.tolist(), found, strict=True)]
    return found, [b" ".join(k) for k in kept], sizes.tolist()


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, chunk: int = CHUNK) -> DataFrame:
    """`docs` with `runs`, an array of structs (start, length, period) by start, then period, `collapsed`, the words joined by
    one space less those that a run holds after its first period, and `n_words`.

    Words are runs of anything but ASCII white space, as they stand. A null or empty text has no runs and collapses to
    the empty text. Repeated rows are each worked on. Columns named like the new ones are replaced; others pass.
    """
    if times < 4:
        raise ValueError("periods are only sure to be found for runs of four periods or more")
    names = [c for c in docs.columns if c not in ("runs", "collapsed", "n_words")]
    schema = docs.select(*names).withColumn("runs", F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>")).withColumn("collapsed", F.lit("")).withColumn("n_words", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                base = int(lengths[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(lengths, base + 6 * chunk, "right")))
                part = b.slice(at, to - at)
                texts = [t or b"" for t in part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
                found, collapsed, n = _chunk(texts, least, times)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], [*names, "runs", "collapsed", "n_words"])
                at = to

    return docs.mapInArrow(run, schema)


def planted(text: str, key: str) -> Column:
    """The text in which every tenth document repeats a stretch of its words, as a hash of its id says; others as they are."""
    h = F.crc32(id_text(key).cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the words as an element of an array of one, so that they are found once
    made = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return F.when((h % 10 == 0) & F.coalesce(F.col(text).rlike(WORD), F.lit(False)), made).otherwise(F.col(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, some of which repeat a stretch. A null doc_id counts as the empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted("text", "doc_id").alias("text"))
    found = periodic_runs(docs).drop("text")
    first = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.withColumn("__r", first)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "__r.start", "__r.length", "__r.period", F.floor(1000 * F.col("__r.length") / F.col("__r.period")).cast("long").alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
