"""Personal data by a skip-chain conditional random field over the mentions of a text.

Patterns give base spans: e-mail addresses, IP addresses, card and phone numbers that pass their checks. They stay whatever
the model says. The model adds mentions that are written in a way no pattern takes, by what the rest of the text says:

* Nodes are mentions: base spans, and other numbers of seven digits or more and address-like strings. Labels are the four
  kinds and "none". A node's features are the form of the mention and the word before it.
* Chain edges join neighbours in the text. Skip edges join mentions at any distance that are the same once separators and
  case are gone (`same`), or of which one is the other's end (`tail`: a phone number without its country code). Each mention
  is joined with the last one before it of the same key, so that skip edges are a few times the mentions.
  Mentions are joined with the last base span of their key too, so that evidence need not pass through all between.
* Base spans are observed. Loopy belief propagation, on all texts of a batch at once, spreads them; a mention with more
  than half of its belief on a kind is added. Numbers that fail a pattern's check are no evidence of anything by themselves.

Weights are learnt by pseudo-likelihood from base spans and the mentions beside them in at most TRAIN_DOCS documents (those
with the least hashes of their ids) and at most TRAIN_ROWS kinds of examples. A mention that shares a key with a base
span, but isn't one, is not used: what it is is the question. PRIOR is what a mention must gain from its neighbours to be
added: learnt weights of forms and chains only count against a kind (forms by half of PRIOR at most), and a skip edge
counts for agreement by what was learnt and 2 * PRIOR. A number that nothing else in its text supports therefore stays out, whatever its form.

All steps are linear in the text's length. Only texts with base spans and other mentions reach the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import id_text, smallest, table

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 20_000
TRAIN_ROWS = 50_000
SLOTS = 4096
PRIOR = 3.0
ROUNDS = 30
NEAR = 40
#: The characters and forms of the base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().\[\]/_-]{0,3}[0-9])*")
_AT = re.compile(r"\s?(?:@|[(\[]\s?at\s?[)\]]|(?<=\s)at(?=\s))\s?", re.I)
_DOT = re.compile(r"\s?(?:\.|[(\[]\s?dot\s?[)\]]|(?<=\s)dot(?=\s))\s?", re.I)
_NAME = re.compile(r"[A-Za-z0-9-]+")

Span = tuple[int, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind from 1, start, end) of what the patterns take, by start, then kind."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        last = m.end() if m else at + 1
        if m:
            found.append((1, begin, last))
        at = text.find("@", last)
    for m in _DOTTED.finditer(text) if "." in text else ():
        groups = m.group().split(".")
        begin = m.start()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in four):
                found.append((2, begin, end))
            begin = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((3, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m.group())) <= 15:
            found.append((4, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def _address(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
    """Address-like strings, with their plain form in lower case."""
    at = lo
    while m := _AT.search(text, at, hi):
        begin, at = m.start(), m.end()
        while begin > lo and m.start() - begin < 64 and text[begin - 1] in _LOCAL:
            begin -= 1
        parts, end = [], at
        name = _NAME.match(text, at, hi)
        while name:
            parts.append(name.group())
            end = name.end()
            dot = _DOT.match(text, end, hi)
            name = _NAME.match(text, dot.end(), hi) if dot else None
        if begin < m.start() and len(parts) > 1:
            yield begin, end, f"{text[begin : m.start()]}@{'.'.join(parts)}".lower()


def _cut(groups: list[re.Match], known: set[str]) -> Iterator[tuple[int, int, str]]:
    """Parts of a number whose digits are known, the longest from each group on, and what lies between them."""
    k = 0
    rest: list[re.Match] = []

    def whole(part: list[re.Match]) -> Iterator[tuple[int, int, str]]:
        d = "".join(g.group() for g in part)
        if len(d) >= 7:
            yield part[0].start(), part[-1].end(), d

    while k < len(groups):
        d, best = "", None
        for j in range(k, len(groups)):
            d += groups[j].group()
            if len(d) > 19:
                break
            name = ".".join(g.group() for g in groups[k : j + 1]) if j == k + 3 else ""
            for key in (name, d, d[1:] if d[0] == "0" and len(d) > 7 else ""):  # the last without a trunk prefix
                if key in known:
                    best = (j, key)
                    break
        if best:
            yield from whole(rest)
            rest = []
            yield groups[k].start(), groups[best[0]].end(), best[1]
            k = best[0] + 1
        else:
            rest.append(groups[k])
            k += 1
    yield from whole(rest)


_GROUP = re.compile(r"[0-9]+")


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """(kind or 0, start, end, key) of a text's mentions in order; a base span that lies in another one is left out."""
    out: list[tuple[int, int, int, str]] = []
    known: set[str] = set()
    for kind, a, b in sorted(base, key=lambda s: (s[1], -s[2])):
        if out and b <= out[-1][2]:
            continue
        key = text[a:b].lower() if kind == 1 else text[a:b] if kind == 2 else _digits(text[a:b])
        out.append((kind, a, b, key))
        known.add(key)
        if kind == 4:
            known |= {key[-n:] for n in range(7, len(key))}
    gaps, at = [], 0
    for _, a, b, _ in list(out):
        gaps.append((at, a))
        at = max(at, b)
    for lo, hi in [*gaps, (at, len(text))]:
        taken = [(0, *x) for x in _address(text, lo, hi)]
        out += taken
        for m in _NUMBER.finditer(text, lo, hi):
            if m.end() - m.start() < 7 or any(a < m.end() and m.start() < b for _, a, b, _ in taken):
                continue
            groups = list(_GROUP.finditer(text, *m.span()))
            for a, b, key in _cut(groups, known):
                if a > lo and text[a - 1] in "+(":
                    a -= 1
                out.append((0, a, b, key))
    return sorted(out, key=lambda x: x[1:3])


def _slot(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) % SLOTS


_BEFORE = re.compile(r"([^\s]{1,24})\s*$")


def features(text: str, start: int, end: int) -> list[int]:
    """Slots of the mention's form, its groups, its separators, and the word before it."""
    own = text[start:end][:200]
    groups = [str(len(g)) for g in _GROUP.findall(own)][:8]
    marks = "".join(sorted({c for c in own if not c.isalnum()}))[:12]
    m = _BEFORE.search(text[max(0, start - 30) : start])
    word = re.sub(r"[^a-z]", "", m.group(1).lower()) if m else ""
    return [_slot("bias"), _slot(f"groups {'-'.join(groups)}"), _slot(f"marks {marks}"), _slot(f"digits {len(_digits(own))}"), _slot(f"begins {own[:1] if own[:1] in '+(' else '-'}"), _slot(f"before {word}")]


def links(found: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Chain edges (i, j) and skip edges (i, j, 0 for `same` or 1 for `tail`), i < j, of a text's mentions."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][1] - found[i][2] <= NEAR]
    skip: list[tuple[int, int, int]] = []
    last: dict[str, int] = {}
    base: dict[str, int] = {}
    for i, (kind, _, _, key) in reversed(list(enumerate(found))):
        if kind:
            base[key] = base[key[-7:]] = i  # for what stands before the first of them
    for j, (kind, _, _, key) in enumerate(found):
        tail = key[-7:] if key.isdigit() and 7 <= len(key) <= 15 else ""
        # with the last mention of the key, and with the last base span of it (the next, if none is before)
        for i in {last.get(key), base.get(key)} - {None, j} if not kind else {last.get(key)} - {None}:
            skip.append((min(i, j), max(i, j), 0))
        for i in {last.get(tail), base.get(tail)} - {None, j} if not kind and tail else ():
            other = found[i][3]
            if other != key and (other.endswith(key) or key.endswith(other)):
                skip.append((min(i, j), max(i, j), 1))
        last[key] = last[tail] = j
        if kind:
            base[key] = base[key[-7:]] = j
    return chain, sorted(set(skip))


class Model:
    """`weights` by slot and label, `chain` by two labels, `agree` for the two kinds of skip edges."""

    def __init__(self, weights: np.ndarray | None = None, chain: np.ndarray | None = None, agree: np.ndarray | None = None):
        n = len(KINDS) + 1
        self.weights = np.zeros((SLOTS, n)) if weights is None else weights
        self.chain = np.zeros((n, n)) if chain is None else chain
        self.agree = np.zeros(2) if agree is None else agree


def fit(examples: list[tuple[list[int], int, list[int], list[int], list[int], int]], rounds: int = 300, l2: float = 0.02) -> Model:
    """Pseudo-likelihood by gradient steps from (slots, label, labels before, labels after, skip labels, times).

    `skip labels` holds kind * 8 + label for each neighbour by a skip edge. Without examples all weights are 0.
    """
    model, n = Model(), len(KINDS) + 1
    if not examples:
        return model
    rows = len(examples)
    slots = np.concatenate([np.array(e[0]) for e in examples])
    of = np.repeat(np.arange(rows), [len(e[0]) for e in examples])
    label = np.array([e[1] for e in examples])
    times = np.array([e[5] for e in examples], float)
    times /= times.sum()
    before, after = np.zeros((rows, n)), np.zeros((rows, n))
    skip = np.zeros((2, rows, n))
    for i, e in enumerate(examples):
        for x in e[2]:
            before[i, x] += 1
        for x in e[3]:
            after[i, x] += 1
        for x in e[4]:
            skip[x // 8, i, x % 8] += 1
    truth = np.eye(n)[label]
    params = {"weights": model.weights, "chain": model.chain, "agree": model.agree}
    moved = {k: np.zeros_like(v) for k, v in params.items()}
    for _ in range(rounds):
        x = np.zeros((rows, n))
        np.add.at(x, of, model.weights[slots])
        x += before @ model.chain + after @ model.chain.T + np.einsum("k,kij->ij", model.agree, skip)
        p = np.exp(x - x.max(1, keepdims=True))
        d = (truth - p / p.sum(1, keepdims=True)) * times[:, None]
        gradient = {"weights": np.zeros_like(model.weights), "chain": before.T @ d + d.T @ after, "agree": np.einsum("kij,ij->k", skip, d)}
        np.add.at(gradient["weights"], slots, d[of])
        for k, v in params.items():
            g = gradient[k] - l2 / rows * v
            moved[k] += g * g
            v += 0.5 * g / (np.sqrt(moved[k]) + 1e-9)
    np.maximum(model.agree, 0, out=model.agree)
    return model


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of labels by node: loopy sum-product on log potentials, all messages at once, halfway damped.

    `edges` has rows (i, j), `potentials` a matrix label of i by label of j for each.
    """
    n, m = unary.shape[1], len(edges)
    if m:
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        matrix = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        sent = np.zeros((2 * m, n))
        for _ in range(rounds):
            gathered = unary.copy()
            np.add.at(gathered, target, sent)
            out = (gathered[source] - sent[back])[:, :, None] + matrix
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            change = np.abs(new - sent).max()
            sent = (sent + new) / 2
            if change < 1e-4:
                break
        unary = unary.copy()
        np.add.at(unary, target, sent)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added(texts: list[str], bases: list[list[Span]], model: Model, prior: float = PRIOR) -> list[list[Span]]:
    """For each text the spans that the model adds to the base spans."""
    n = len(KINDS) + 1
    nodes: list[tuple[int, Span]] = []
    unary, edges, potentials = [], [], []
    for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
        if not base:
            continue
        found = mentions(text, base)
        if not any(m[0] == 0 for m in found):
            continue
        off = len(nodes)
        for kind, a, b, _ in found:
            nodes.append((k, (kind, a, b)))
            if kind:
                x = np.full(n, -1e9)  # observed
                x[kind] = 0
            else:
                x = model.weights[features(text, a, b)].sum(0)
                # without neighbours no kind may come near "none"
                x = np.append(0.0, np.clip(x[1:] - x[0], -prior / 2, 0) - prior)
            unary.append(x)
        chain, skip = links(found)
        edges += [(off + i, off + j) for i, j in chain] + [(off + i, off + j) for i, j, _ in skip]
        potentials += [np.minimum(model.chain, 0)] * len(chain) + [np.eye(n) * (2 * prior + model.agree[t]) for _, _, t in skip]
    out: list[list[Span]] = [[] for _ in texts]
    if not nodes:
        return out
    p = beliefs(np.array(unary), np.array(edges, int).reshape(-1, 2), np.array(potentials).reshape(-1, n, n))
    for (k, (kind, a, b)), q in zip(nodes, p, strict=True):
        best = int(q.argmax())
        if not kind and best and q[best] > 0.5:
            out[k].append((best, a, b))
    return out


def _examples(text: str) -> Iterator[tuple[list[int], int, list[int], list[int], list[int]]]:
    found = mentions(text, base_spans(text))
    chain, skip = links(found)
    before, after = [[] for _ in found], [[] for _ in found]
    near: list[list[int]] = [[] for _ in found]
    for i, j in chain:
        after[i].append(found[j][0])
        before[j].append(found[i][0])
    for i, j, t in skip:
        near[i].append(8 * t + found[j][0])
        near[j].append(8 * t + found[i][0])
    for k, (kind, a, b, _) in enumerate(found):
        if kind or not any(x % 8 for x in near[k]):
            # of neighbours only those whose label is known: base spans, and mentions without a tie to one
            yield features(text, a, b), kind, before[k], after[k], [x for x in near[k] if kind == 0 or x % 8]


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", most_docs: int = TRAIN_DOCS, most_rows: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample of documents; see the module. Rows with the same id and text count once."""
    hashed = docs.select(F.xxhash64(F.lit(13), id_text(key), F.col(text)).alias("__order"), F.col(text).alias("text"))
    cut = smallest(hashed.select("__order"), "__order", most_docs).agg(F.max("__order")).first()[0]
    sample = hashed.where(F.col("__order") <= F.lit(cut)).dropDuplicates(["__order"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [e for t in b.column(b.schema.get_field_index("text")) for e in _examples(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 1 else pa.list_(pa.int32())) for i in range(5)], ["slots", "label", "before", "after", "skip"])

    made = sample.mapInArrow(extract, "slots array<int>, label int, before array<int>, after array<int>, skip array<int>")
    columns = ["slots", "label", "before", "after", "skip"]
    counted = made.groupBy(*columns).agg(F.count("*").alias("times")).withColumn("__order", F.xxhash64(*columns))
    rows = counted.orderBy("__order", *columns).limit(most_rows).collect()
    return fit([tuple(r[c] for c in [*columns, "times"]) for r in rows])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def personal_data(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `spans`, an array of structs (kind, start, end, base) by start, then kind as listed in KINDS.

    Places are code points, the end exclusive. A null or empty text has no spans; each repeated row has its own. A column
    of the input named `spans` is replaced, others pass. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != "spans"]
    schema = docs.select(*names).withColumn("spans", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")).schema
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights.any(1)), model.weights[model.weights.any(1)], model.chain, model.agree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, chain, agree = sent.value
        weights = np.zeros((SLOTS, len(KINDS) + 1))
        weights[at] = values
        learnt = Model(weights, chain, agree)
        for b in batches:
            for begin in range(0, b.num_rows, 1000):
                part = b.slice(begin, 1000)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                bases = [base_spans(t) for t in texts]
                more = added(texts, bases, learnt)
                spans = [[{"kind": KINDS[k - 1], "start": a, "end": e, "base": is_base} for a, k, e, is_base in sorted([(a, k, e, True) for k, a, e in x] + [(a, k, e, False) for k, a, e in y])] for x, y in zip(bases, more, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(spans, pa.list_(SPAN))], [*names, "spans"])

    return docs.mapInArrow(run, schema)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts by kind and digest of base spans, and all spans as text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, train(docs)).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
