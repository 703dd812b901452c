"""Token counts by a compiled finite-state transducer.

The splitting pattern is compiled to a deterministic transducer of 13 states over 12 character
classes; each transition says whether a match starts here and whether one started one character
back (contractions and white space need one character of delay). A text is cut into chunks of
equal length that run side by side. A chunk doesn't know its start state, so it first gives a map
from start state to end state; the maps compose through a parallel prefix scan, and then every
chunk emits its matches. How many tokens a match emits isn't among the 13 states' annotations: merges
would need a state for every word. A word's hash stands for the state that a trie of the words
would reach; its count is written there when the word is first met, by folding the merges, and
read on every later visit.

Results: a null or empty text has no bytes and no tokens; special strings inside a text are single
tokens, as by the library's default; ties and repeated rows are independent; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.bpe import BLANK, LETTER, NUMBER, QUOTE, SPACE, classes, lexicon
from codelode.llm.flat import groups, texts_of

EDGE, WORD, DIGITS, SIGNS, SPACE1, SPACES, BLANK1, BLANKS, APOSTROPHE, Q_R, Q_V, Q_L, CONTRACTED = range(13)
STATES = 13
C_LETTER, C_STMD, C_R, C_V, C_E, C_L, C_NUMBER, C_SPACE, C_BLANK, C_QUOTE, C_OTHER, C_END = range(12)
HERE, BACK = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission, each by state * 12 + class."""
    plain = {**dict.fromkeys((C_LETTER, C_STMD, C_R, C_V, C_E, C_L), WORD), C_NUMBER: DIGITS, C_SPACE: SPACE1, C_BLANK: BLANK1, C_QUOTE: APOSTROPHE, C_OTHER: SIGNS, C_END: EDGE}
    go, emit = np.zeros((STATES, 12), np.int64), np.zeros((STATES, 12), np.uint8)
    for c in range(12):
        to = plain[c]
        body = SIGNS if to == APOSTROPHE else to
        white = c in (C_SPACE, C_BLANK)
        for state in range(STATES):
            nxt, out = to, HERE if c != C_END else 0
            if state == WORD and to == WORD or state == DIGITS and to == DIGITS:
                out = 0
            elif state == SIGNS and body == SIGNS:
                nxt, out = SIGNS, 0
            elif state in (SPACE1, SPACES, BLANK1, BLANKS) and c != C_END:
                if white:
                    nxt, out = (SPACES if c == C_SPACE else BLANKS), 0
                elif state == SPACE1:
                    nxt, out = body, 0
                elif state == SPACES:
                    nxt, out = body, BACK
                elif state == BLANKS:
                    out = HERE | BACK
            elif state == APOSTROPHE:
                if c == C_STMD:
                    nxt, out = CONTRACTED, 0
                elif c in (C_R, C_V, C_L):
                    nxt, out = {C_R: Q_R, C_V: Q_V, C_L: Q_L}[c], 0
                elif body == SIGNS:
                    nxt, out = SIGNS, 0
            elif state in (Q_R, Q_V, Q_L):
                if c == (C_L if state == Q_L else C_E):
                    nxt, out = CONTRACTED, 0
                else:
                    out = BACK | (0 if to == WORD else out)
            go[state, c], emit[state, c] = nxt, out
    return go.ravel(), emit.ravel()


def _fine_classes() -> np.ndarray:
    kind = classes()
    out = np.full(len(kind), C_OTHER, np.uint8)
    for coarse, fine in ((LETTER, C_LETTER), (NUMBER, C_NUMBER), (SPACE, C_SPACE), (BLANK, C_BLANK), (QUOTE, C_QUOTE)):
        out[kind == coarse] = fine
    for letters, fine in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("e", C_E), ("l", C_L)):
        out[[ord(x) for x in letters]] = fine
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["go"], _TABLES["emit"] = compile_splitter()
        _TABLES["kind"] = _fine_classes()
    return _TABLES["go"], _TABLES["emit"], _TABLES["kind"]


def compose(maps: np.ndarray) -> np.ndarray:
    """State maps of chunks to those of all chunks up to each: an inclusive prefix scan."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    return maps


def match_starts(kind: np.ndarray, chunk: int = 1024, settle: int = 16) -> np.ndarray:
    """Where matches start in a stream of classes that ends with C_END."""
    go, emit, _ = _tables()
    n = len(kind)
    chunk = max(settle, min(chunk, n))
    lanes = -(-n // chunk)
    stream = np.full(lanes * chunk, C_END, np.uint8)
    stream[:n] = kind
    columns = np.ascontiguousarray(stream.reshape(lanes, chunk).T).astype(np.int64)
    state = np.repeat(np.arange(STATES), lanes).reshape(STATES, lanes)
    for row in columns[:settle]:
        state = go[state * 12 + row]
    same = (state == state[0]).all(axis=0)
    single, mixed = state[0].copy(), np.flatnonzero(~same)
    for row in columns[settle:]:
        single = go[single * 12 + row]
    ends = np.repeat(single[:, None], STATES, axis=1)
    if len(mixed):  # these have no place yet that all start states lead to
        state = state[:, mixed]
        for row in columns[settle:, mixed]:
            state = go[state * 12 + row]
        ends[mixed] = state.T
    state = np.r_[EDGE, compose(ends)[:-1, EDGE]]
    out = np.empty((chunk, lanes), np.uint8)
    for i, row in enumerate(columns):
        at = state * 12 + row
        out[i] = emit[at]
        state = go[at]
    marks = out.T.ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BACK).astype(bool)
    return np.flatnonzero(starts)


def count_texts(path: str, texts: list[str], limit: int = 3_000_000) -> np.ndarray:
    """The number of tokens of each text."""
    book = lexicon(path)
    specials = book.vocab.specials
    cutter = regex.compile("|".join(map(regex.escape, specials))) if specials else None
    kinds = _tables()[2]
    totals = np.zeros(len(texts), np.int64)
    for a, b in groups(map(len, texts), limit):
        parts, owner = [], []
        for i in range(a, b):
            if cutter and any(s in texts[i] for s in specials):
                cut = cutter.split(texts[i])
                totals[i] += len(cut) - 1
            else:
                cut = [texts[i]]
            parts += cut
            owner += [i] * len(cut)
        text = "\0".join(parts) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        kind = kinds[points]
        kind[ends - 1] = C_END
        starts = match_starts(kind)
        if not len(starts):
            continue
        part = np.searchsorted(ends, starts, side="right")
        stops = np.minimum(np.r_[starts[1:], len(points)], ends[part] - 1)
        places = book.look_up(text, points, starts, stops)
        counts = book.count[places]
        np.add.at(totals, np.asarray(owner), np.bincount(part, counts, len(parts)).astype(np.int64))
    return totals


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = count_texts(path, texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
