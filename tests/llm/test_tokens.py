"""Operators 2, 5 and 7 against the public libraries, over odd texts."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codelode.llm import bpe, bpe_codec, packing, token_count

GPT, CLIP, MULTI = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HF = {p: Tokenizer.from_file(p) for p in (GPT, CLIP)}
TEXTS = st.lists(st.sampled_from([*"ab'strevlmdLSRE  \n\t\r019éß.,!?*’\u3000\x1c中ΣÇé́İ💥", "<|endoftext|>", "'re", "'LL"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_any_text(texts):
    want = [x.ids for x in HF[GPT].encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode_texts(GPT, texts, bpe.words_spaced)] == want
    assert token_count.count_texts(GPT, texts).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in bpe.encode_texts(MULTI, texts, bpe.words_spaced)] == [TIK.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in bpe.encode_texts(CLIP, texts, bpe.words_alone, packing.prepare)] == [x.ids for x in HF[CLIP].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8), st.integers(16, 40))
def test_chunks_do_not_matter(texts, chunk):
    kinds = token_count._tables()[2]
    text = "\0".join(texts) + "\0"
    kind = kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    kind[np.cumsum([len(t) + 1 for t in texts]) - 1] = token_count.C_END
    assert token_count.match_starts(kind, chunk).tolist() == token_count.match_starts(kind, 1 << 20).tolist()


def test_token_counts(table, edges):
    got = {r.doc_id: r for r in token_count.token_counts(table(edges), GPT).collect()}
    for i, t in enumerate(edges):
        n = len(HF[GPT].encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_count.token_counts(table([]), GPT).count() == 0


def test_round_trip(table, edges):
    got = {r.doc_id: r for r in bpe_codec.byte_bpe(table(edges), MULTI, keep_ids=True).collect()}
    for i, t in enumerate(edges):
        ids = TIK.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_codec.byte_bpe(table([]), MULTI).count() == 0


def test_native_fold_agrees(table):
    words = bpe_codec.encode_native(table(["The tokenizer's naïve wörds, 12345 aaaa\n\n x", None, ""]), MULTI, P.PATTERN)
    rows = words.select("word", "ids", bpe_codec.decode_native(words["ids"], MULTI).alias("back")).collect()
    assert rows
    for r in rows:
        assert r.ids == TIK.encode_ordinary(r.word) and bytes(r.back) == r.word.encode()


def packed(rows, room):
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= room


def test_packing(table, edges):
    rows = packing.best_fit(table(edges), CLIP, room=64).collect()
    packed(rows, 64)
    for i, t in enumerate(edges):
        ids = np.array([*HF[CLIP].encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 64)))
        for r in own:
            assert r.length == min(64, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.best_fit(table([]), CLIP).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=40))
def test_plans(counts):
    plan = packing.plan_rounds(counts, 100)
    bins: dict[int, list] = {}
    seen: dict[int, list] = {}
    for length, low, high, first, at, each in plan:
        for rank in range(low, high):
            seen.setdefault(length, []).append(rank)
            bins.setdefault(first + (rank - low) // each, []).append((at + (rank - low) % each * length, length))
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    total = sum(n * c for n, c in counts.items())
    assert len(bins) <= max(1, total * 11 / 9 / 100 + 6) + sum(c for n, c in counts.items() if n > 50) * 0.5
