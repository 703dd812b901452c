"""Byte-pair encoding by ranked merges, folded over all distinct words of a batch at once.

`Merges` is the rank table; `fold` applies it to many words side by side: every round merges, in
each word, all places of the word's lowest-ranked pair. `Lexicon` keeps what each distinct word
became. Words are told apart by a 64-bit hash of their characters.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import regex

from codelode.llm.flat import Rolling, groups, spread_runs

NONE = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER = range(6)
#: The contractions that the public pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the public pattern tells them apart."""
    out = np.full(0x110000, OTHER, np.uint8)
    rules = [(kind, regex.compile(rule)) for kind, rule in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+"))]
    for low in range(0, 0x110000, 0x800):  # blocks, as the workers' memory is small
        if not 0xD800 <= low < 0xE000:
            points = "".join(map(chr, range(low, low + 0x800)))
            for kind, rule in rules:
                for m in rule.finditer(points):
                    out[low + m.start() : low + m.end()] = kind
    out[[0x1C, 0x1D, 0x1E, 0x1F]] = OTHER  # white space to Python alone
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    return out


class Merges:
    """Pairs of symbols with their ranks, in an open-addressing table."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        bits = max(10, (len(pairs) * 6).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        rank, made = (np.array([v[i] for v in pairs.values()], np.int32) for i in (0, 1))
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            free = self.keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = todo[free & first]
            self.keys[at[take]], self.rank[at[take]], self.made[at[take]] = keys[take], rank[take], made[take]
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(20)).astype(np.int64) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            k = self.keys[at[open_]]
            open_ = open_[(k != keys[open_]) & (k != -1)]
        return self.rank[at], self.made[at]


def fold(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no pair of a word has a rank. Gives the symbols, word after word, and each
    word's number of them. Words must not be empty."""
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    done_s, done_o = [], []
    rank = np.full(len(symbols), NONE, np.int32)
    made = np.zeros(len(symbols), np.int32)
    fresh = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
    while len(symbols):
        rank[fresh], made[fresh] = merges.find(symbols[fresh], symbols[fresh + 1])
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.minimum.reduceat(rank, heads)
        spans = np.diff(np.r_[heads, len(symbols)])
        live = np.repeat(least != NONE, spans)
        if not live.all():
            done_s.append(symbols[~live])
            done_o.append(owner[~live])
            symbols, owner, rank, made = symbols[live], owner[live], rank[live], made[live]
            spans, least = spans[least != NONE], least[least != NONE]
            if not len(symbols):
                break
        hit = rank == np.repeat(least, spans)
        at = np.flatnonzero(hit)
        # of places that overlap, every second one from the left
        run = np.r_[True, (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])]
        order = np.arange(len(at))
        at = at[(order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0]
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        rank[at] = NONE
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        # the pair before a merge, and the merge's own pair with what follows, are new
        symbols, owner, rank, made, changed = symbols[keep], owner[keep], rank[keep], made[keep], changed[keep]
        before = np.zeros_like(changed)
        before[:-1] = changed[1:]
        again = np.flatnonzero(changed | before)
        rank[again] = NONE
        again = again[again + 1 < len(symbols)]
        fresh = again[owner[again] == owner[again + 1]]
    if not done_s:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    symbols, owner = np.concatenate(done_s), np.concatenate(done_o)
    order = np.argsort(owner, kind="stable")
    return symbols[order].astype(np.int32), np.bincount(owner, minlength=n)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer's file, read into tables: `first` has the symbol of each byte, `last` that of
    a byte that ends a word, `whole` the words that are tokens without any merge."""

    def __init__(self, path: str):
        self.whole: dict[bytes, int] = {}
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pairs = {}
            for piece, rank in ranks.items():
                for cut in range(1, len(piece)):
                    a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                    if a is not None and b is not None:
                        pairs[a, b] = (rank, rank)
            self.first = self.last = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
            self.whole = ranks
            self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
            for piece, rank in ranks.items():
                self.pieces[rank] = piece
            self.specials: dict[str, int] = {}
        else:
            with open(path, encoding="utf-8") as f:
                stored = json.load(f)
            model, letters = stored["model"], byte_letters()
            vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
            pairs = {}
            for rank, merge in enumerate(model["merges"]):
                a, b = merge.split(" ") if isinstance(merge, str) else merge
                pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
            self.first, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
            for letter, b in letters.items():
                self.first[b], self.last[b] = vocab[letter], vocab[letter + end]
            self.specials = {x["content"]: x["id"] for x in stored["added_tokens"]}
        self.merges = Merges(pairs)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        known = [self.whole.get(w, -1) for w in words] if self.whole else []
        if any(k >= 0 for k in known):
            direct = np.array(known, np.int64)
            rest = np.flatnonzero(direct < 0)
            starts = np.cumsum(lengths) - lengths
            inner, counts = fold(self.merges, symbols[spread_runs(starts[rest], lengths[rest])], lengths[rest])
            n = np.ones(len(words), np.int64)
            n[rest] = counts
            out = np.empty(int(n.sum()), np.int32)
            at = np.cumsum(n) - n
            out[at[direct >= 0]] = direct[direct >= 0]
            out[spread_runs(at[rest], counts)] = inner
            return out, n
        return fold(self.merges, symbols, lengths)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_spaced(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the public pattern's matches. Whether a match starts at a place follows
    from two characters before and two after it, so all places are decided at once."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[0] = edge[n] = True
    edge[ends] = True
    before = np.r_[np.uint8(OTHER), kind[:-1]]
    after = np.r_[kind[1:], np.uint8(OTHER)]
    first, last = edge[:-1], edge[1:]
    blank, blank_before, blank_after = kind >= SPACE, before >= SPACE, after >= SPACE
    blank &= kind <= BLANK
    blank_before &= (before <= BLANK) & ~first
    blank_after &= (after <= BLANK) & ~last
    group = np.where(kind == QUOTE, OTHER, kind)
    # white space: a run starts, and its last character stands alone or joins what follows
    start = first | (blank & (~blank_before | (~blank_after & ~last)))
    joined = blank_before & (before == SPACE)
    start |= ~blank & ~joined & np.r_[True, group[1:] != group[:-1]]
    quote = np.flatnonzero((kind == QUOTE) & start)
    if len(quote):
        room = np.minimum(np.searchsorted(ends, quote, side="right"), len(ends) - 1)
        room = ends[room] - quote
        padded = np.r_[points, np.zeros(3, points.dtype)]
        for c in CONTRACTIONS:
            fits = room >= len(c)
            for j, letter in enumerate(c[1:], 1):
                fits &= padded[quote + j] == ord(letter)
            at = quote[fits]
            start[at + 1] = False
            if len(c) == 3:
                start[at + 2] = False
            after_it = at + len(c)
            start[after_it[after_it < n]] |= ~blank[after_it[after_it < n]]
    starts = np.flatnonzero(start)
    return starts, np.r_[starts[1:], n]


def words_alone(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of contractions, runs of letters, single numbers and runs of other signs;
    white space is dropped."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    group = np.where(kind == QUOTE, OTHER, np.where(kind == BLANK, SPACE, kind))
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[ends] = True
    start = edge[:-1] | np.r_[True, group[1:] != group[:-1]] | (group == NUMBER)
    quote = np.flatnonzero((kind == QUOTE) & start)
    if len(quote):
        room = ends[np.minimum(np.searchsorted(ends, quote, side="right"), len(ends) - 1)] - quote
        padded = np.r_[points, np.zeros(3, points.dtype)]
        for c in CONTRACTIONS:
            fits = room >= len(c)
            for j, letter in enumerate(c[1:], 1):
                fits &= padded[quote + j] == ord(letter)
            at = quote[fits]
            start[at + 1] = False
            if len(c) == 3:
                start[at + 2] = False
            after_it = at + len(c)
            start[after_it[after_it < n]] = True
    starts = np.flatnonzero(start)
    stops = np.r_[starts[1:], n]
    real = group[starts] != SPACE
    return starts[real], stops[real]


class Lexicon:
    """What each distinct word became, kept between batches; a cache, emptied when it is full."""

    def __init__(self, vocab: Vocabulary, most: int = 3_000_000):
        self.vocab, self.most = vocab, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.pool = [np.zeros(0, np.int32)]
        self.pooled = 0

    def look_up(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's place in start and count; new words are encoded first."""
        keys, sample, inverse = np.unique(Rolling(points).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            words = [text[s:e].encode("utf-8") for s, e in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())]
            ids, counts = self.vocab.encode_words(words)
            where = self.pooled + np.cumsum(counts) - counts
            self.pool.append(ids)
            self.pooled += len(ids)
            put = at[new]
            self.keys = np.insert(self.keys, put, keys[new])
            self.start = np.insert(self.start, put, where)
            self.count = np.insert(self.count, put, counts.astype(np.int32))
            at = np.searchsorted(self.keys, keys)
        return at[inverse]

    def ids(self, places: np.ndarray) -> np.ndarray:
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        return self.pool[0][spread_runs(self.start[places], self.count[places].astype(np.int64))]


@lru_cache(maxsize=4)
def lexicon(path: str) -> Lexicon:
    return Lexicon(vocabulary(path))


def flat_points(parts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The parts joined, their code points, and where each part ends."""
    text = "".join(parts)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return text, points, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))


def encode_texts(path: str, texts: list[str], split, prepare=None, limit: int = 1_000_000) -> list[np.ndarray]:
    """Ids of each text. Special tokens inside a text are cut out first, as by default; `prepare`
    normalises what is left; `split` finds the words."""
    book = lexicon(path)
    specials = book.vocab.specials
    cutter = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
    out: list[np.ndarray] = []
    for a, b in groups(map(len, texts), limit):
        parts, owner, fixed = [], [], []
        for i, text in enumerate(texts[a:b]):
            for j, part in enumerate(cutter.split(text) if cutter and any(s in text for s in specials) else (text,)):
                special = specials.get(part, -1) if j % 2 else -1
                parts.append("" if special >= 0 else prepare(part) if prepare else part)
                owner.append(i)
                fixed.append(special)
        text, points, ends = flat_points(parts)
        starts, stops = split(points, ends)
        places = book.look_up(text, points, starts, stops) if len(starts) else np.zeros(0, np.int64)
        ids = book.ids(places)
        tokens = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(book.count[places], out=tokens[1:])
        bounds = tokens[np.searchsorted(starts, ends)]
        begins = np.r_[0, bounds[:-1]]
        pieces: list[list[np.ndarray]] = [[] for _ in range(b - a)]
        for i, special, s, e in zip(owner, fixed, begins.tolist(), bounds.tolist()):
            pieces[i].append(np.array([special], np.int32) if special >= 0 else ids[s:e])
        out += [p[0] if len(p) == 1 else np.concatenate(p) for p in pieces]
    return out
