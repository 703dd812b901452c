"""Operators 3, 6, 9 and 10, and the pipeline."""

import hashlib
import os
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from pyspark.sql import functions as F
from codelode.llm import ann, html_extract, jpeg, media, quality

from tests.llm.test_dedup import brute_groups, brute_sentences
from tests.llm.test_tokens import CLIP, HF, packed

DATA = "/root/testdata/sf0.001"


def test_pages(spark):
    long = "The story of the man who was in the house with the dog and the cat of the town. " * 4
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body><header><p>Site of the day</p></header><nav><a href=x>Home</a></nav><div class='main'><h1>A &amp; B</h1><p>{long}</p><p>Short&nbsp;one.</p><form><p>{long}</p></form></div><aside><p>{long}</p></aside><div id='comments'><p>{long}</p></div><!-- <p>x</p> --><footer>c</footer>"
    assert html_extract.main_text(page) == f"A & B {long.strip()} Short one."
    article = "<body><div class=ad>Buy it</div><article><h1>Head</h1><p>xx yy<br>zz &lt;b&gt; &amp;amp;</p><p>Tiny."
    assert html_extract.main_text(article) == "Head xx yy zz <b> &amp; Tiny."
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain words only"), (4, "w", "plain words only"), (5, "z", "<p" + "x" * 50000)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].text == "" and got[3].n_chars == 0 and got[4].text == "plain words only" and got[1].n_chars == len(got[1].text)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Plain(HTMLParser):
    """Blocks by the standard library's parser: [text, linked characters, bad, in a form, article, heading]."""

    def __init__(self, page):
        super().__init__()
        self.open, self.out, self.now, self.mark, self.head, self.link, self.mute, self.n = [], [], "", False, False, 0, None, 0
        self.in_link = False
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        top = self.open[-1] if self.open else (None, False, False, 0)
        text = " ".join(self.now.split())
        if text:
            self.out.append([text, self.link, top[1] or self.mark, top[2], top[3], self.head])
        self.now, self.link, self.mark, self.head = "", 0, False, False

    def handle_starttag(self, tag, attrs, alone=False):
        if self.mute:
            return
        if tag in "script style noscript template title textarea iframe select button object svg math canvas".split():
            self.mute = tag
        elif tag == "a":
            self.in_link = True
        elif tag in ("br", "hr"):
            self.now += " "
        elif tag not in html_extract.INLINE:
            self.cut()
            self.in_link = False
            a = {k: v or "" for k, v in attrs}
            style = a.get("style", "").replace(" ", "")
            bad = "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in html_extract.ROLES or any(html_extract.MARKS.search(a.get(k, "")) for k in ("class", "id")) or "display:none" in style or "visibility:hidden" in style
            above = self.open[-1] if self.open else (None, False, False, 0)
            if tag in html_extract.CONTAINERS or bad and tag not in ("p", "h1", "h2", "h3"):
                if not alone:
                    self.n += tag in ("article", "main") and not above[1]
                    number = self.n if tag in ("article", "main") and not above[1] else above[3]
                    self.open.append((tag, above[1] or bad or tag in ("nav", "aside", "footer", "menu", "dialog") or tag == "header" and not above[3], above[2] or tag == "form", number))
            else:
                self.mark, self.head = bad, tag in ("h1", "h2", "h3")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        if self.mute:
            self.mute = None if tag == self.mute else self.mute
        elif tag == "a":
            self.in_link = False
        elif tag not in html_extract.INLINE and tag not in ("br", "hr"):
            self.cut()
            self.in_link = False
            names = [x[0] for x in self.open]
            if tag in names:
                del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.mute:
            self.now += data
            self.link += len(data.strip()) if self.in_link else 0


def plain_text(page):
    """The rules once more, block by block."""
    b = Plain(page or "").out
    size = {f: sum(len(x[0]) for x in b if not x[2] and x[3] == f) for f in (False, True)}
    for x in b:
        x[2] = x[2] or x[3] and size[True] <= 4 * size[False]
    seen = [x for x in b if not x[2]]
    framed = any(x[4] for x in seen)
    for x, y in zip(seen, seen[1:]):
        if x[5] and not x[4] and y[4]:
            x[4] = y[4]
    words = [[w.strip(".,;:!?\"'()*#$%&|") for w in x[0].lower().split()] for x in b]
    stops = [sum(w in html_extract.STOP_WORDS for w in ws) for ws in words]
    known = sum(s for s, x in zip(stops, b) if not x[2]) >= 0.02 * sum(len(w) for w, x in zip(words, b) if not x[2])
    label = []
    for x, s, w in zip(b, stops, words):
        density, n = s / len(w), len(x[0])
        if x[2] or x[1] / n > 0.33 or framed and not x[4]:
            label.append(0)
        elif n < (70 if known else 35):
            label.append(None)
        elif density >= 0.2 and n > 200 or x[4] and density >= 0.1 or not known:
            label.append(1)
        else:
            label.append(0 if density < 0.1 and not x[4] else None)
    keep = list(label)
    for i, x in enumerate(b):
        if label[i] is None:
            left = next((j for j in range(i - 1, -1, -1) if label[j] is not None), None)
            right = next((j for j in range(i + 1, len(b)) if label[j] is not None), None)
            near = [j for j in (left, right) if j is not None]
            own = [j for j in near if x[4] and b[j][4] == x[4] and not b[j][2]]
            if x[4] and not own:
                keep[i] = 1
            else:
                keep[i] = max(((-abs(j - i), label[j]) for j in own or near), default=(0, 1))[1]
    return " ".join(x[0] for x, k in zip(b, keep) if k)


STORY = "The story of the man who was in the house with the dog and the cat of the town. " * 4
CASES = {
    "a quote that isn't one": (f"<body><p title=it's>{STORY}</p><p class=x'y>{STORY}", f"{STORY}{STORY}"),
    "a quote that never closes": (f'<body><p>{STORY}</p><p title="x>{STORY}</p><p>{STORY}</p>', f"{STORY}{STORY}{STORY}"),
    "> in quotes": (f'<div title="a > b"><p data-x=\'>\'>{STORY}</p></div>', STORY),
    "an unknown language": (f"<nav>Домой сюда</nav><h1>Слово</h1><p>{'Большая длинная фраза без знакомых слов. ' * 5}</p><footer>Конец</footer>", "Слово " + "Большая длинная фраза без знакомых слов. " * 5),
    "no words between spaces": (f"<nav>首页</nav><p>{'他在房子里和狗在一起。' * 8}</p><aside>{'广告' * 60}</aside>", "他在房子里和狗在一起。" * 8),
    "a heading by its article": (f"<header><h1>Site</h1></header><div><h1>Head</h1><article><p>{STORY}</p></article></div><h2>More</h2>", f"Head {STORY}"),
    "a page in a form": (f"<form id=aspnet><h1>Head</h1><p>{STORY}</p><select><option>x</select></form>", f"Head {STORY}"),
    "a form on a page": (f"<p>{STORY}</p><form><p>{STORY}</p></form>", STORY),
    "marks on any element": (f"<article><p class=advert>{STORY}</p><p>{STORY}</p><blockquote id=ad><p>{STORY}</p></blockquote><h2 class='share'>Share</h2><p>Tiny.</p></article>", f"{STORY}Tiny."),
    "hidden": (f"<article><p hidden>{STORY}</p><div style='display: none'><p>{STORY}</p></div><p title='a hidden gem'>{STORY}</p><section aria-hidden=true>{STORY}</section></article>", STORY),
    "skipped elements": (f"<article><p>{STORY}</p><button>Go<p>{STORY}</p></button><svg><text>x</text></svg><p>End.<script>var x = '<p>';", f"{STORY}End."),
    "menus of links": (f"<div><a href=/a>{STORY}</a></div><p>{STORY}</p>", STORY),
    "none": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page_rules(name):
    page, want = CASES[name]
    assert html_extract.main_text(page) == " ".join(want.split())
    if name != "a quote that never closes":  # the library's parser takes such a tag for text
        assert plain_text(page) == " ".join(want.split())


def test_pages_by_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: plain_text(r.html) for r in pages.collect()}
    got = html_extract.extract(pages).collect()
    assert len(got) == len(want) > 0 and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("piece", ["<a ", "<a x=\"", "<button>", "<!-- ", "<div>", "</p>", "<p class='", "= ", "<svg/>", "</script ", "<td hidden>", "<form><article>", "<"])
def test_hostile_pages(piece):
    """A megabyte of the same piece takes no longer than a megabyte of text should."""
    began = time.process_time()
    html_extract.main_text(f"<div>{piece * (1_000_000 // len(piece))}\"</div></b><p>{STORY}")
    assert time.process_time() - began < 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_files_keep_every_byte(parts):
    parts = [p + b"\xff" * (max(1, -(-len(p) // 576)) * 576 - len(p)) for p in parts]
    files = jpeg.encode_payloads(parts)
    images, coefs = jpeg.decode_files(files)
    assert [jpeg.payload_of(i, c) for i, c in zip(images, coefs)] == parts
    for i, c in zip(images, coefs):
        assert jpeg.pixels(i, c).shape == (i.height, i.width, 3)


def bits_of(values):
    text = "".join(values)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")


def test_general_scans():
    """A grey image of two blocks with zero runs, end-of-band runs, and a scan that makes
    coefficients other than 0, written bit by bit."""
    table = {0x00: 3, 0x01: 3, 0x11: 3, 0x02: 3, 0xF0: 4, 0x10: 4, 0x21: 4}
    codes = jpeg.read_table(jpeg.table_bytes(table))[2]
    sym = lambda s: format(codes[s][0], f"0{codes[s][1]}b")
    dc = jpeg.read_table(jpeg.table_bytes(jpeg.DC_LENGTHS))[2]
    first_dc = [format(dc[3][0], "04b") + "101", format(dc[1][0], "04b") + "0"]  # 5, then 4
    # block 0: k1 = 3 << 1, k3 = -1 << 1, end of band; block 1: nothing (a run of 2 blocks' ends)
    ac = [sym(0x02) + "11", sym(0x11) + "0", sym(0x10) + "0"]
    # refinement: block 0: k1 +bit 1, k2 becomes 1, k3 bit 0, then end; block 1: k1 becomes -1
    more = [sym(0x01) + "1" + "1", sym(0x00) + "0", sym(0x01) + "0", sym(0x00)]
    s = jpeg._segment
    data = b"\xff\xd8" + s(0xDB, b"\0" + b"\1" * 64) + s(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + s(0xC4, b"\0" + jpeg.table_bytes(jpeg.DC_LENGTHS) + b"\x10" + jpeg.table_bytes(table))
    data += jpeg._sos([(1, 0)], 0, 0, 0, 0) + bits_of(first_dc) + jpeg._sos([(1, 0)], 1, 63, 0, 1) + bits_of(ac) + jpeg._sos([(1, 0)], 1, 63, 1, 0) + bits_of(more) + b"\xff\xd9"
    (image,), (coefs,) = jpeg.decode_files([data])
    assert coefs[:, :5].tolist() == [[5, 7, 1, -2, 0], [4, -1, 0, 0, 0]]
    rgb = jpeg.pixels(image, coefs)
    assert rgb.shape == (8, 16, 3) and (rgb[..., 0] == rgb[..., 2]).all()
    flat = np.zeros((2, 64), int)
    flat[:, 0] = 80
    assert (jpeg.pixels(image, flat) == 138).all()
    with pytest.raises(ValueError):
        jpeg.Image(b"nope")


def test_media_rows(table, edges):
    rows = {r.doc_id: r for r in media.store_and_read(table(edges), tensors=True).collect()}
    for i, t in enumerate(edges):
        p = media.payload(t or "")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.rgb) == r.height * r.width * 3
    assert rows[3].feature == rows[4].feature and rows[0].media_sha256 == rows[1].media_sha256
    assert media.store_and_read(table([])).count() == 0
    assert media.payload("")[:1] == b"\xff" and len(media.payload("x" * 577)) == 1152 and os.urandom(1)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 32), (5040, [float("nan")] * 32), (5060, [1.0]), (5080, [float("inf")] + [0.0] * 31), (5100, [None] + [1.0] * 31), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as score")
    got: dict[int, list] = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    s = x[::20] @ x.T
    s[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    top = np.argsort(-s, axis=1)[:, :20]
    assert sorted(got) == list(range(0, 3000, 20)) and all([r.rank for r in v] == list(range(1, 21)) for v in got.values())
    assert np.mean([len({r.vec_id for r in got[20 * i]} & set(t.tolist())) / 20 for i, t in enumerate(top)]) >= 0.9
    for q, v in got.items():
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in v) and [r.score for r in v] == sorted((r.score for r in v), reverse=True)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 3, 1.0), (3, 2, 0.5)]
    assert ann.nearest(few.limit(0)).count() == 0
    # in many blocks, with rows that repeat: every pair of blocks is met once
    again = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, row_block=500, query_block=40, block=200).collect()}
    assert len(again) == 150 * 20 and np.mean([again[q, i + 1][1] >= r.score - 1e-9 for q, v in got.items() for i, r in enumerate(v)]) > 0.95
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(twice).orderBy("rank").collect()] == [(0, 7, 2.0), (0, 7, 2.0), (0, 8, 0.5)]


def test_long_labelled_text(spark, table):
    """A labelled text's vector is that of the same text when it is scored."""
    texts = ["alpha beta " * 50_000 + "gamma " * 30_000, *[f"Some {w} text, of {w} words." for w in ("short", "plain", "odd")]]
    ids = [i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    model = quality.fit(table(texts, ids), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    scored = quality.unit(quality.weigh(quality.features(texts), model.weight) @ model.basis)
    assert np.allclose(model.known, scored, atol=1e-5)


def test_quality(spark, table, edges):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    want = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [(r.predicted, want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want]
    assert judged and np.mean([a == b for a, b in judged]) >= 0.9
    odd = {r.doc_id: r.quality_score for r in quality.classify(table(edges), model).collect()}
    assert odd[0] == odd[1] == odd[2] == 0.0 and odd[3] == odd[4] and len(odd) == len(edges)
    blank = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.classify(table(["a", ""]), blank).collect()} == {0.5, 0.0}
    assert quality.classify(table([]), model).count() == 0


def test_votes(spark, table):
    """Scores against a plain vote: every labelled text, one at a time, no blocks, no partition."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 5}
    place = lambda t: quality.unit(quality.weigh(quality.features([t or ""]), model.weight) @ model.basis)[0].astype(float)
    vectors = {i: place(text[i]) for i in known}
    got = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    for i in sorted(text)[::7]:
        own = place(text[i])
        near = sorted(((float(own @ v), known[j]) for j, v in vectors.items()), reverse=True)
        if not (text[i] or "").strip() or near[24][0] - near[25][0] < 1e-6:
            continue  # empty, or a tie for the last place
        votes = [(max(c, 1e-6) ** 8, q) for c, q in near[:25]]
        assert abs(got[i] - sum(w * q for w, q in votes) / sum(w for w, _ in votes)) < 1e-3, i


def test_repeated_labelled_rows(spark, table):
    """However often a labelled doc_id repeats, one of its texts teaches."""
    ids = [i for i in range(1, 30) if zlib.crc32(str(i).encode()) % 5][:4]
    labels = spark.createDataFrame([(i, i % 2) for i in ids for _ in range(3)], "doc_id long, quality int")
    model = quality.fit(table([f"Text of {i}, or so." for i in ids] * 50 + ["Another text."] * 9, ids * 50 + ids[:1] * 9), labels)
    assert len(model.labels) == len(ids)
    named = table(["Text one.", None]).withColumnRenamed("n", "quality_kept")
    assert {r.quality_kept for r in quality.classify(named, model, prefix="own_").collect()} == {1}


def test_pipeline(spark, tmp_path):
    """Every stage on whole tables, with odd rows, against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("n_removed", F.lit(5))
    odd = [(None, "No id, and quite an ordinary sentence of words that go on."), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "same twice " * 30), (10**6 + 2, "same twice " * 30)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5) for i, t in odd], docs.schema))
    columns = docs.columns
    kept = docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = kept
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept = docs.collect()
        key = lambda r: (r.doc_id, r.text)
        if i < 3:
            assert docs.columns == columns and {r.n_removed for r in kept} == {5}
        if i == 0:
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            source = spark.createDataFrame(given, docs.schema)
            good = {key(r) for r in quality.classify(source, quality.fit(source, labels)).collect() if r.quality_score >= 0.3}
            assert sorted(map(str, kept)) == sorted(str(r) for r in given if key(r) in good) and 0 < len(kept) < len(given)
        if i == 1:
            rows = sorted({key(r) for r in given if r.doc_id is not None})
            label = [x[1] for x in brute_groups([t for _, t in rows], 5)]
            assert sorted(key(r) for r in kept if r.doc_id is not None) == [rows[j] for j in sorted(set(label))]
            assert [r.text for r in kept if r.doc_id is None] == [r.text for r in given if r.doc_id is None]
        if i == 2:
            named = sorted((r for r in given if r.doc_id is not None), key=lambda r: r.doc_id)
            pieces, gone = brute_sentences([r.text for r in named], 12, 20, 40)
            left = {r.doc_id: r for r in kept}
            assert len(kept) == len(given) and any(gone) and all(r.n_chars == len(r.text) for r in kept)
            for r, p, g in zip(named, pieces, gone):
                assert left[r.doc_id].text.split() == " ".join(x for k, x in enumerate(p) if k not in g).split()
        if i == 3:
            packed(kept, 4096)
            for r in given:
                size = len(HF[CLIP].encode(r.text, add_special_tokens=False).ids) + 1
                assert sum(x.length for x in kept if x.doc_id == r.doc_id) == size
    assert corpus_pipeline.run(spark, DATA).count() > 0
