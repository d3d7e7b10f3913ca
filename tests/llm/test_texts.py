"""HTML extraction, packing and the pipeline."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracklark.llm import html_text
from tracklark.llm.html_text import extract_text, main_blocks
from tracklark.llm.packing import Packer, PieceTokenizer, pack, packed_pieces
from tracklark.llm.storage import materialize

from ..conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site, header.</header><nav><ul><li><a href=/a>Menu, one</a></ul></nav><!-- <p>comment</p> --><div class="ad">Buy, now.</div>
<div class='cookie-notice'>We use cookies, sure.</div><article><header><h1>Head &amp; line</h1></header><p><b>First,  para&#33;<br>goes\n on.<p>Les.</p>
<blockquote>A quote, with <a href="x">link text</a>, here.</blockquote><form>Subscribe, now.</form><section id="comments"><p>Nice post, thanks. Really, a very long reader comment.</p></section></article>
<aside>Related, things.</aside><footer>&copy; all, rights.</footer></body></html>"""


def test_article_only():
    assert main_blocks(PAGE) == ["Head & line", "First, para! goes on.", "Les.", "A quote, with link text, here."]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [(None, []), ("", []), ("plain < text", ["plain < text"]), ("<p>a<p>b", ["a", "b"]), ("<article><p>cut o", ["cut o"]), ("<article><p class='x", []), ("<script>x", []), ("<div><main><p>One, two.</p><div class=comments>bad, bad.</div></main></div>", ["One, two."]), ("<ul><li>One, item.<li>Two, items.</ul>", ["One, item.", "Two, items."])],
)
def test_odd_pages(page, blocks):
    assert main_blocks(page) == blocks


def test_page_without_article_tag():
    page = '<body><div id="menu"><a>Home</a><a>News</a></div><div class="story"><h2>Title</h2>' + "".join(f"<p>Sentence {i}, with marks. And more of them, here.</p>" for i in range(6)) + "<p>Short.</p></div><div><a>About</a> <a>Contact</a></div></body>"
    blocks = main_blocks(page)
    assert blocks[0] == "Title" and blocks[-1] == "Short." and len(blocks) == 8


LINE = "A sentence of the text, with marks; and more of it, here."
LONG = " ".join([LINE] * 5)
SPLIT = [
    (f"<h1>Title</h1><div class=intro>{LINE}</div><div class=body>{LONG}</div>", ["Title", LINE, LONG]),
    (f"<body><nav>Menu</nav><h1>Title</h1><div class=by>By A. B.</div><div class=body><p>{LINE}<ul><li>one<li>two</ul><p>{LONG}<table><tr><td>x<td>y</table></div><div>(c) us</div>", ["Title", "By A. B.", LINE, "one", "two", LONG, "x", "y"]),
    (f"<div><p>{LINE}</p><blockquote>{LONG}</blockquote><p>{LINE}</p></div>", [LINE, LONG, LINE]),
    (f"<ul><li>{LINE}<li>{LONG}<li>short</ul>", [LINE, LONG, "short"]),
]


@pytest.mark.parametrize(("page", "blocks"), SPLIT)
def test_split_article_without_tag(page, blocks):
    assert main_blocks(page) == blocks


NAMED = [
    (f"<div class='page with-sidebar'><div id=content class=no-sidebar><h2>Title</h2><p>{LONG}</div></div>", ["Title", LONG]),
    (f"<article><div class='post-header'><h1>Title</h1></div><h2 class='section-header'>Part</h2><p>{LONG} <span class=share>Share</span> <a class=related>of it</a> all.<p class=notice>{LINE}</article>", ["Title", "Part", f"{LONG} Share of it all.", LINE]),
    (f"<div class=post><div class=post-header><h1>Title</h1></div><p>{LONG}</div>", ["Title", LONG]),
    (f"<div class=widget><p>{LONG}</p></div>", [LONG]),
    (f"<div class=comments><p>{LONG}</p></div>", [LONG]),
    (f"<article><p>{LINE}</p><div class='comment-list'><p>{LONG}</p></div><div class='related-posts'>{LONG}</div></article>", [LINE]),
]


@pytest.mark.parametrize(("page", "blocks"), NAMED)
def test_names_of_parts(page, blocks):
    assert main_blocks(page) == blocks


PLAIN = f"<body><div class=k1><ul>{'<li><a href=/x>Part</a>' * 6}</ul></div><div class=k2>Buy it.</div><div class=k3><h1>Title</h1><p>{LONG}<p>{LINE}<p>Short.</div><div class=k4><span>About us</span></div>"


def test_ratios_decide(monkeypatch):
    """Without an article element and telling names the ratios alone find the article."""
    want = ["Title", LONG, LINE, "Short."]
    assert main_blocks(PLAIN) == want
    monkeypatch.setattr(html_text, "ratios", lambda path, length, marks: np.ones(len(path)))
    assert main_blocks(PLAIN) != want


def test_ratios_are_those_of_brute_force():
    for page in (PAGE, PLAIN, SPLIT[1][0], NAMED[1][0]):
        read = html_text._Page(page)
        pieces, paths = read.pieces, []
        for e, _, _ in pieces:
            line = []
            while e is not None:
                if e.path != (e.parent.path if e.parent else None):
                    line.append((e.tag, e.path))
                e = e.parent
            paths.append(tuple(line[::-1]))
        texts = [t.strip() for _, _, t in pieces]
        ratio = {}
        for path in set(paths):
            on = [t for t, p in zip(texts, paths) if p == path]
            nodes = max(1, sum(t != "" for t in on))
            ratio[path] = sum(map(len, on)) / nodes * (1 + sum(len(html_text.MARK.findall(t)) for t in on) / nodes)
        line = [ratio[p] for p in paths]
        smooth = [(line[max(0, i - 1)] + 2 * line[i] + line[min(len(line) - 1, i + 1)]) / 4 for i in range(len(line))]
        want = []
        for p in paths:
            on = [i for i, q in enumerate(paths) if q == p]
            want.append((sum(smooth[i] * line[i] for i in on) / len(on)) ** 0.5)
        got = html_text.ratios(np.array([e.path for e, _, _ in pieces]), np.array([len(t) for t in texts], float), np.array([len(html_text.MARK.findall(t)) for t in texts], float))
        assert got == pytest.approx(want)


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x, y.", "<b>" * 100_000 + "<div>x, y.</div>" * 1000, "<div>" * 100_000 + "<li>x, y." * 10_000, "<p>x, y.</q>" * 100_000, "<h1>" * 100_000 + "x, y.", "<article>" * 50_000 + "x, y."])
def test_nested_pages_take_linear_time(page):
    start = time.process_time()
    assert "x, y." in main_blocks(page)[-1]
    assert time.process_time() - start < 30


def test_empty_article_gives_no_text():
    assert main_blocks("<body><nav>Menu</nav><div class=ad>Buy, now.</div><article><h1></h1><p> </article><footer>Us.</footer>") == []


def test_extraction_table(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (None, None, None, None), (2, "v", "<article>" + "<p>x, y.</p>" * 5000, "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(frame).collect()
    assert sorted(len(r.text) for r in got)[::3] == [0, 5000 * 7 - 2]
    assert extract_text(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


ODD = ["", " a", "a ", "a\n b", "a  b", "a   b\n \n c\n ", " <|endoftext|> q<|endoftext|>", "don't stop'll 12,345", "\u00a0x \u00a0 y\u3000 z", "Ünïcode ñ 漢字 🙂🙂", "\t x\ty \r\n z", "x" * 3000]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    mine = PieceTokenizer()
    for t in [*ODD, *ODD]:
        assert mine.of(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing_round_trip(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "w " * 9000), (101, "w " * 9000), (None, "null id")] + [(200 + i, "some words here " * (i % 40)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).coalesce(2)
    got = packed_pieces(spark, frame).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() <= 1024 and len(g) <= 256
    total = got.groupby("sequence_id").length.sum()
    assert (total < 1024).sum() <= 1
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start")
        copies = sum(r[0] == i for r in rows)
        assert mine.length.sum() == len(ids) * copies and (mine.doc_tokens == len(ids)).all()
        for start, n, crc in zip(mine.start, mine.length, mine.ids_crc32):
            assert zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc
    assert packed_pieces(spark, frame.limit(0)).count() == 0


def test_limits_of_bins():
    r = np.random.default_rng(0)
    packer, bins, given = Packer(100, 5, 60, pool=50), [], 0
    for i in range(400):
        n = int(r.integers(1, 100))
        given += n
        packer.add(i, 0, n, int(n * r.random()) if n * 0.6 < 60 else n - 50)
        bins += list(packer.bins())
    ends = {}
    bins += list(packer.bins(0))
    for b in bins:
        assert sum(n for _, _, n in b) <= 100 and len(b) <= 5
        for i, start, n in b:
            ends.setdefault(i, []).append((start, n))
    assert sum(n for p in ends.values() for _, n in p) == given
    assert all(sorted(p)[k][0] + sorted(p)[k][1] == sorted(p)[k + 1][0] for p in ends.values() for k in range(len(p) - 1))


def plain_bins(items, limits, pool, cut=True):
    """The dot-product choice spelled out, over places of the pool: (start, end, loss_from) in, bins out."""
    free, open_, bins = list(range(2 * pool)), {}, []

    def one():
        left, placed = list(limits), []
        while open_ and left[0] > 0 and left[1] > 0:
            best = {}
            for at in sorted(open_):
                name, start, end, loss_from = open_[at]
                need = (end - start, 1, max(0, end - max(start, loss_from)))
                product = sum(n / l * r / l for n, l, r in zip(need, limits, left))
                fits = all(n <= r for n, r in zip(need, left))
                if fits not in best or product > best[fits][0]:
                    best[fits] = (product, at)
            whole = True in best
            at = (best[True] if whole else max((best[f] for f in best), key=lambda b: b[0]))[1]
            name, start, end, loss_from = open_[at]
            n = end - start if whole else min(end - start, left[0], max(0, loss_from - start) + left[2])
            if n <= 0:
                break
            placed.append((name, start, n))
            left = [left[0] - n, left[1] - 1, left[2] - max(0, start + n - max(start, loss_from))]
            open_[at] = (name, start + n, end, loss_from)
            if start + n == end:
                del open_[at]
                free.insert(0, at)
            else:
                break
        bins.append(placed)

    for k, item in enumerate(items):
        open_[free.pop(0)] = (k, *item)
        while len(open_) > pool:
            one()
    while open_:
        one()
    return bins


@pytest.mark.parametrize("loss", [128, 32])
def test_bins_are_those_of_the_plain_choice(loss):
    r = np.random.default_rng(1)
    items = [(0, int(n), int(n * f)) for n, f in zip(r.integers(1, 60, 150), r.random(150))]
    packer, got = Packer(128, 8, loss, pool=20), []
    for k, (start, end, loss_from) in enumerate(items):
        packer.add(k, start, end, loss_from)
        got += list(packer.bins())
    got += list(packer.bins(0))
    assert got == plain_bins(items, (128, 8, loss), 20)  # powers of two: equal products are equal


def test_loss_limit_binds(spark):
    """Conversations: only the replies bear loss, at most 200 ids of a sequence."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "text", F.when(F.col("role") == "assistant", 1.0).otherwise(0.0).alias("share"))
    got = pack(turns, loss=200, loss_share="share").toPandas()
    per = got.groupby("sequence_id")[["length", "loss_tokens"]].sum()
    assert per.loss_tokens.max() == 200 and per.length.max() <= 1024
    assert (per.length < 1024).any() and got.length.sum() == pack(turns).agg(F.sum("length")).first()[0]


def test_last_bins_of_tasks_are_merged(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 50)) for i in range(1000)], "doc_id long, text string").repartition(50)
    total = packed_pieces(spark, docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    assert (total < 1024).sum() <= 1
    tiny = packed_pieces(spark, docs.withColumn("text", F.lit("three short words"))).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    assert (total < 1024).sum() <= 1 and (tiny < 1024).sum() <= 1


def test_loss_share(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g", 0.5), (2, "a b", None)], "doc_id long, text string, s double")
    rows = {r.doc_id: r for r in pack(frame, loss_share="s").collect()}
    assert rows[1].loss_tokens == 4 and rows[2].loss_tokens == rows[2].doc_tokens


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        seen.append(docs)
        assert name == "packing" or docs.columns == columns
    clean, single, mixed, packed = seen
    assert 0 < single.count() <= clean.count() < 200
    # brute force over what the first stage kept: no two of the second's rows are near, and each row gone is near one kept
    from .test_duplicates import brute

    rows = [(r.doc_id, r.text, None) for r in clean.collect()]
    kept = {rows[k][0] for k in set(brute(rows)[1])}
    assert {r.doc_id for r in single.collect()} == kept
    ids = PieceTokenizer()
    assert packed.agg(F.sum("length")).first()[0] == sum(len(ids.of(r.text)) // 4 + 1 for r in mixed.collect())
    again = corpus_pipeline.run(spark, SF)
    assert again.drop("sequence_id", "offset").count() == packed.count()


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null texts, ids and sources, repeated rows, clashing names and an empty table go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (None, "one two three", None, "x", 3)], docs.schema))
    names = ["node", "size", "target", "picks", "weight", "class_id", "score", "sequence_id", "start", "length"]
    odd = odd.select("*", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in names))
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, rows = rows, materialize(stage(spark, rows, SF))
            if name != "packing":
                assert rows.columns == before.columns == odd.columns
                assert rows.where(" or ".join(f"{n} <> '{n}' || coalesce(cast(doc_id AS string), '')" for n in names)).count() == 0


def test_ratios_find_the_article_without_tags_and_names(spark, monkeypatch):
    """The given pages without article and main elements, classes, ids and roles: word by word nearly what they give as
    they stand, and less of it when all ratios are the same."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]

    def bare(page):
        page = re.sub(r"(</?)(?:article|main)\b", r"\1div", page, flags=re.I)
        return re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", "", page, flags=re.I)

    def agreement(found, want):
        a, b = (Counter(" ".join(t).split()) for t in (found, want))
        return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))

    want = [main_blocks(p) for p in pages]
    mean = lambda: np.mean([agreement(main_blocks(bare(p)), w) for p, w in zip(pages, want, strict=True)])
    with_ratios = mean()
    monkeypatch.setattr(html_text, "ratios", lambda path, length, marks: np.ones(len(path)))
    assert with_ratios >= 0.98 and mean() < with_ratios - 0.01
