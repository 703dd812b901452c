"""Operators 1, 4 and 8 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import near_dedup, sentence_dedup, substring_dedup
from codelode.llm.components import components
from codelode.llm.suffix_array import Strings, common_prefixes, suffix_array

random.seed(11)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(1, 7))) for _ in range(60)]


def prose(n):
    return " ".join(random.choice(WORDS) + random.choice(["", "", "", ".", ","]) for _ in range(n))


PASSAGE, OTHER = prose(90), prose(70)
BODY = prose(200)
TEXTS = [
    None, "", "  ", "one", "one", "One", PASSAGE, prose(40) + PASSAGE + prose(40), PASSAGE + prose(30), BODY, BODY, BODY[:-6] + "zz zz.", prose(60) + " " + OTHER, OTHER + " " + prose(80), "ab" * 400, "ab" * 400 + "c", "é" * 150 + "x" + "é" * 150, prose(5) + " ".join([OTHER, OTHER]), BODY.upper(),
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=10, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.data())
def test_suffix_arrays(parts, data):
    need = np.array([data.draw(st.integers(1, len(p) - 8)) for p in parts])
    s = Strings(parts)
    order = suffix_array(s, need, 9)
    ends = s.ends[np.searchsorted(s.ends, order, side="right")]
    suffixes = [tuple(s.symbols[i:e].tolist())[:9] for i, e in zip(order, ends)]
    assert suffixes == sorted(suffixes) and len(set(order.tolist())) == len(order)
    assert {int(a + i) for a, n in zip(s.starts, need) for i in range(n)} <= set(order.tolist())
    shared = common_prefixes(s, order, 9)
    for i in range(1, len(order)):
        alike = suffixes[i] == suffixes[i - 1] and len(suffixes[i]) == 9 and 0 not in suffixes[i]
        assert (shared[i] == 9) == alike


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    counts: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - length + 1):
            counts[b[i : i + length]] = counts.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("in_task", [4000, 2])
def test_substrings(table, in_task):
    rows = substring_dedup.remove_repeats(table(TEXTS), in_task=in_task).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(TEXTS))] == brute_spans(TEXTS, 200)


def test_small_batches_and_hot_grams(spark, table, monkeypatch):
    """What is known of a gram carries over from batch to batch, and over parts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = [*TEXTS, *[prose(3) + PASSAGE + prose(3) for _ in range(30)], *[BODY] * 5]
        want = brute_spans(texts, 200)
        for floor in (2000, 1):
            monkeypatch.setattr(substring_dedup, "HOT_FLOOR", floor)
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(table(texts)).collect()}
            assert [got[i] for i in range(len(texts))] == want, floor
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_short_windows(table):
    texts = ["".join(random.choice("ab") for _ in range(random.randint(0, 60))) for _ in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(table(texts), length=12, gram=5).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 12)


def test_anchors_beyond_a_piece(monkeypatch):
    """A text longer than places under the hash can count: its repeats have equal anchors."""
    text = b"".join([random.randbytes(3000), PASSAGE.encode(), random.randbytes(3000), PASSAGE.encode(), random.randbytes(500)])
    monkeypatch.setattr(substring_dedup, "LOW", np.uint64(10))
    f = substring_dedup.Anchors([text, text[1500:]], 200, 100)
    keys = substring_dedup.Rolling(np.frombuffer(text + text[1500:], np.uint8)).windows(100)
    keep = keys >> np.uint64(10)
    want = []
    for base, size in ((0, len(text)), (len(text), len(text) - 1500)):
        want += [i + int(np.argmin(keep[i : i + 101])) for i in range(base, base + size - 199)]
    assert f.at.tolist() == sorted(set(want))


def test_substring_edges(table):
    assert substring_dedup.remove_repeats(table([])).count() == 0
    # rows that share a doc_id or have none are documents of their own; equal rows too
    alone, other = prose(90), prose(90)
    texts, ids = [BODY, PASSAGE + "q" + alone, other, "z" + PASSAGE, prose(80), alone, PASSAGE, PASSAGE, other, None], [None, 1, 1, 1, None, None, 2, 2, None, None]
    want = sorted((i or 0, *x) for i, x in zip(ids, brute_spans(texts, 200)))
    for in_task in (4000, 1):
        rows = substring_dedup.remove_repeats(table(texts, ids), in_task=in_task).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want


def test_very_long_text(table):
    """A text of over 2**24 bytes; its repeats lie beyond that place."""
    text = random.randbytes(17 << 20).hex()[: 17 << 20]
    far = (1 << 24) + 1000
    texts = [text[:far] + PASSAGE + text[far:], "q" + PASSAGE, text[far + 500_000 : far + 500_900]]
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(table(texts)).collect()}
    sizes = [len(PASSAGE), len(PASSAGE), 900]
    assert [(rows[i].n_removed, rows[i].n_spans) for i in (1, 2)] == [(n, 1) for n in sizes[1:]]
    assert (rows[0].n_removed, rows[0].n_spans) == (len(PASSAGE) + 900, 2)
    kept = texts[0].replace(PASSAGE, "").replace(texts[2], "")
    assert rows[0].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def brute_sentences(texts, few, pair, many):
    cut = []
    for t in texts:
        pieces = [p for p in re.sub(r"([.!?][ \t\n\r\f]+|[ \t\r\f]*\n[ \t\n\r\f]*)", "\\1\x01", t or "").split("\x01") if p]
        if pieces and not pieces[0].strip(" \t\n\r\f"):
            pieces = [pieces[0] + (pieces[1] if len(pieces) > 1 else ""), *pieces[2:]]
        cut.append([p for p in pieces if p.strip(" \t\n\r\f")])
    seen, gone = set(), [set() for _ in texts]
    for i, pieces in enumerate(cut):
        for a in range(len(pieces)):
            for n in (1, 2, 3):
                if a + n > len(pieces):
                    continue
                run = tuple(p.rstrip(" \t\n\r\f") for p in pieces[a : a + n])
                words = sum(len(x.split()) for x in run)
                if words >= (many, pair, few)[n - 1] or len(pieces) == n and words >= few:
                    if run in seen:
                        gone[i] |= set(range(a, a + n))
                    seen.add(run)
    return cut, gone


@pytest.mark.parametrize("limits", [(12, 20, 40), (0, 0, 0), (5, 8, 9)])
def test_sentences(table, limits):
    texts = [*TEXTS, "A b c d. E f g h. I j k l. M n.", "Q. A b c d. E f g h. I j k l. Z.", "A b c d. E f g h. I j k l. M n.", "One. Two. Three.", "One. Two. Three. Four.", "One. Two."]
    rows = {r.doc_id: r for r in sentence_dedup.dedup(table(texts), *limits).collect()}
    cut, gone = brute_sentences(texts, *limits)
    for i, t in enumerate(texts):
        assert (rows[i].n_sentences, rows[i].n_removed) == (len(cut[i]), len(gone[i])), i
        if t and cut[i] and not gone[i]:
            assert rows[i].text == t
        elif gone[i]:
            assert rows[i].text.split() == " ".join(p for k, p in enumerate(cut[i]) if k not in gone[i]).split()
    assert rows[0].text is None and rows[1].text == "" and rows[3].source == "s"
    assert sentence_dedup.dedup(table([])).count() == 0


def test_sentence_columns(table):
    """Columns of the added names pass through under a prefix."""
    named = table([BODY, BODY]).withColumnRenamed("n", "n_removed")
    assert [r.n_removed > 0 for r in sentence_dedup.dedup(named).orderBy("doc_id").collect()] == [False, True]
    rows = sentence_dedup.dedup(named, prefix="own_").collect()
    assert {r.n_removed for r in rows} == {1} and {r.own_n_removed == 0 for r in rows} == {True, False}


def brute_groups(texts, width):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(len(s), x, x == i) for i, (s, x) in enumerate(zip(sets, label))]


NEAR = [" ".join(random.choice(WORDS) if random.random() < 0.03 else w for w in BODY.split()) for _ in range(25)]


@pytest.mark.parametrize("common", [32, 1])
def test_near_duplicates(table, common):
    texts = [*TEXTS, *NEAR]
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(texts), width=4, common=common).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_groups(texts, 4)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=14), st.data())
def test_retained_values_lose_no_link(base, extra, data):
    """Whatever is taken for frequent: similar sets share a retained value and pass the sketch test."""
    gone = data.draw(st.sets(st.sampled_from(sorted(base)), max_size=10))
    a, b = base, (base - gone) | extra
    bitmap = np.frombuffer(data.draw(st.binary(min_size=16, max_size=16)), np.uint8)
    if not b or 100 * len(a & b) < 80 * len(a | b):
        return
    x, y = (near_dedup.retained(np.array(sorted(s), np.uint64), bitmap, 80) for s in (a, b))
    assert (np.diff(x.astype(object)) >= 0).all() and len(set(x.tolist()) & set(y.tolist())) > 0
    assert 180 * near_dedup.differences(x, y) <= 20 * (len(a) + len(b))


def test_frequent_values(table):
    """The bitmap holds values that many documents have; its size doesn't depend on the input."""
    often = "one phrase that every page has at its very end"
    bitmap = near_dedup.frequent(table([f"{prose(12)} number{i} {often}" for i in range(400)]), 4)
    flags = np.unpackbits(bitmap, bitorder="little")
    hit = lambda text: flags[(near_dedup.shingle_sets([text.encode()], 4)[0] & np.uint64(len(flags) - 1)).astype(int)]
    assert len(bitmap) == 1 << 22 and hit(often).all() and not hit(prose(30)).any()


@pytest.mark.parametrize("block", [600_000, 1500])
def test_many_documents_of_one_frame(table, monkeypatch, block):
    """Long lists whose members are mostly alike, some of them only to some: in one block and in many."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    plate = words(400)
    texts = [f"{plate} {words(250)}", *[f"{plate} {words(n)}" for n in (4, 30, 60, 92, 92, 110, 4, 4) for _ in range(6)], plate]
    texts += [" ".join(rng.sample(plate.split(" "), 400)) for _ in range(3)]
    found = near_dedup._within_long_lists
    monkeypatch.setattr(near_dedup, "_within_long_lists", lambda *x: found(*x, block=block))
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(texts), width=4, common=3).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_groups(texts, 4)


def test_near_edges(table):
    assert near_dedup.near_duplicates(table([])).count() == 0
    # of no doc_id, and texts that share one
    ids, texts = [None, 7, 7, 7, 9, None, 8, 8], [BODY, BODY, "x", BODY, "x", None, "", BODY + " end"]
    rows = near_dedup.near_duplicates(table(texts, ids), width=4).collect()
    sets = brute_groups(texts, 4)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept, r.chosen) for r in rows) == sorted([
        (0, sets[0][0], 0, True, True), (0, 0, 0, True, True), (7, sets[1][0], 7, True, True), (7, sets[1][0], 7, True, True), (7, 1, 7, True, True), (9, 1, 7, False, False), (8, 0, 8, True, True), (8, sets[7][0], 7, False, False),
    ])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 50), (50, 45)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 45: 40, 50: 40}
