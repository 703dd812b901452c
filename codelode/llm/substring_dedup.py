"""Exact substring dedup: bytes under a string of `length` bytes that starts anywhere else.

A string of `length` bytes holds an anchor: the place whose following `gram` bytes have the
smallest hash. Equal strings have equal anchors at equal offsets, so all places of a repeated
string meet at one anchor value, with a context wide enough to hold every string that has this
anchor. Places of equal anchor and equal context repeat throughout. Anchor values with several
contexts need their text: contexts of an anchor value come together in one task (many values in a
batch), where a two-stage suffix array and its common prefixes show the repeated strings. An
anchor value of so many contexts that one task couldn't hold them is dealt out by its strings'
hashes and counted instead.

Results: n_bytes of a null text is 0; texts shorter than `length` stay whole; matches never cross
documents; removed bytes are judged on the input, so the first occurrence goes too; every row is a
document of its own, with rows that share a doc_id, have none, or repeat, which lose all that
they share; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.bitmaps import bitmap, within
from codelode.llm.flat import Rolling, groups, mix
from codelode.llm.suffix_array import Strings, common_prefixes, suffix_array
from codelode.runtime import cut

#: Bits of a place, in the low end of its hash; a place counts from the start of its piece.
LOW = np.uint64(24)
#: A gram with fewer rows is never dealt out.
HOT_FLOOR = 2000


class Anchors:
    """Anchors of a flat array of texts: place, text, hash of the gram, hash of the context."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        n = len(data) - length + 1
        self.begin = np.r_[0, ends[:-1]]
        if n <= 0:
            self.at = self.text = self.low = self.high = np.zeros(0, np.int64)
            self.gram = self.context = np.zeros(0, np.uint64)
            return
        roll = Rolling(data)
        wide = length - gram + 1
        hashes = roll.windows(gram)
        # in pieces, overlapping by a string's other places, whose places fit under the hash
        step = (1 << int(LOW)) - wide + 1
        first = np.empty(n, np.int64)
        for start in range(0, n, step):
            part = hashes[start : start + step + wide - 1]
            least = (part >> LOW << LOW) | np.arange(len(part), dtype=np.uint64)
            size = 1
            while size * 2 <= wide:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < wide:
                least = np.minimum(least[: size - wide], least[wide - size :])
            count = min(step, n - start)
            first[start : start + count] = start + (least[:count] & np.uint64((1 << int(LOW)) - 1)).astype(np.int64)
        room = np.ones(n + length, bool)
        for e in ends:  # strings that would cross an end
            room[max(0, e - length + 1) : e] = False
        at = first[room[:n]]
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        self.at, self.text = at, np.searchsorted(ends, at, side="right")
        self.low = np.maximum(at - (length - gram), self.begin[self.text])
        self.high = np.minimum(at + length, ends[self.text])
        self.gram = hashes[at]
        self.context = mix(roll.of(self.low, self.high) + (at - self.low).astype(np.uint64))


def anchor_rows(docs: DataFrame, length: int, gram: int, only_gram: bool) -> DataFrame:
    """gram, context, doc_id, row and at of every anchor."""
    names = ["gram"] if only_gram else ["gram", "context", "doc_id", "row", "at"]
    kinds = {"gram": "long", "context": "long", "doc_id": "long", "row": "int", "at": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in groups(map(len, texts), 1 << 19):
                f = Anchors(texts[a:b], length, gram)
                columns = {"gram": pa.array(f.gram.view(np.int64))}
                if not only_gram:
                    columns |= {"context": pa.array(f.context.view(np.int64)), "doc_id": pa.array(ids[a:b][f.text], pa.int64()), "row": pa.array(rows[a:b][f.text], pa.int32()), "at": pa.array((f.at - f.begin[f.text]).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([columns[k] for k in names], names)

    return docs.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in names))


def _classify(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram and context; grams in `hot` have contexts in other parts too. kind 0:
    the context occurs more than once. kind 1: the first row of a context whose gram has several;
    kind 2: such a row that is the only one.
    What follows a row decides on it, so the rows of one context's head wait for the next batch."""
    held = None  # the last context's first row, whether it had more rows, whether its gram had others

    def out(gram: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(doc, pa.int64()), pa.array(row, pa.int32()), pa.array(at, pa.int32()), pa.array(gram, pa.int64()), pa.array(kind, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "at", "gram", "kind"])

    for batch in batches:
        if not len(batch):
            continue
        gram, context, doc, row, at = (batch.column(c).to_numpy() for c in ("gram", "context", "doc_id", "row", "at"))
        # the held head comes first; `more` and `other` carry what is known of it
        more0 = other0 = shown0 = False
        if held is not None:
            (g, c, d, r, p), more0, other0, shown0 = held
            gram, context, doc, row, at = np.r_[g, gram], np.r_[c, context], np.r_[d, doc], np.r_[r, row], np.r_[p, at]
        n = len(gram)
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        head = new_gram | np.r_[True, context[1:] != context[:-1]]
        h = np.flatnonzero(head)
        size = np.diff(np.r_[h, n])
        many = size > 1
        many[0] |= more0
        g_of = np.cumsum(new_gram[h]) - 1
        several = np.bincount(g_of)[g_of] > 1
        if other0:
            several |= g_of == 0
        several |= np.isin(gram[h], hot)
        last = len(h) - 1  # stays held: the next batch may go on with it
        cls = np.cumsum(head) - 1
        repeat = many[cls]
        if held is not None and shown0:
            repeat[0] = False
        keep = repeat & ((np.arange(n) != h[last]) | many[last])
        first = np.flatnonzero(several & (np.arange(len(h)) != last))
        kinds = np.where(many[first], 1, 2)
        yield out(*(np.r_[x[keep], x[h[first]]] for x in (gram, doc, row, at)), np.r_[np.zeros(int(keep.sum()), int), kinds])
        i = h[last]
        held = ((gram[i], context[i], doc[i], row[i], at[i]), bool(many[last]), bool(several[last]), bool(many[last]))
    if held is not None and held[2]:
        (g, _, d, r, p), more, _, _ = held
        yield out(*(np.array([x]) for x in (g, d, r, p, 1 if more else 2)))


def repeated_places(parts: list[bytes], offsets: np.ndarray, owners: tuple[np.ndarray, ...], begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as (part, place) of the strings of `length` bytes that start at or before the
    anchor's offset and also start at another place of the corpus; owners (columns that name a
    row) and begin place a part."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    need = np.minimum(offsets + 1, sizes - length + 1)
    s = Strings(parts)
    order = suffix_array(s, need, length)
    shared = common_prefixes(s, order, length)
    part = np.searchsorted(s.ends, order, side="right")
    place = order - s.starts[part]
    run = np.cumsum(shared < length) - 1
    wanted = place < need[part]
    order, part, place, run = order[wanted], part[wanted], place[wanted], run[wanted]
    if not len(run):
        return part, place
    heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    where = begin[part] + place
    differ = np.zeros(len(heads), bool)
    for values in (*(x[part] for x in owners), where):
        differ |= np.minimum.reduceat(values, heads) != np.maximum.reduceat(values, heads)
    hit = np.repeat(differ, np.diff(np.r_[heads, len(run)]))
    return part[hit], place[hit]


def _sorted_spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Places merged to spans, as doc_id, row, low, high."""
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    head = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)][: len(doc)]
    h = np.flatnonzero(head)
    tail = np.r_[h[1:], len(doc)][: len(h)] - 1
    columns = [pa.array(doc[h], pa.int64()), pa.array(row[h], pa.int32()), pa.array(start[h].astype(np.int32)), pa.array((start[tail] + length).astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "low", "high"])


def _search(length: int, batch_bytes: int):
    """Contexts sorted by gram to spans: whole grams are gathered up to batch_bytes."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        parts = table.column("context").to_pylist()
        offsets, doc, row, begin, kind = (table.column(c).to_numpy() for c in ("offset", "doc_id", "row", "begin", "kind"))
        part, place = repeated_places(parts, offsets.astype(np.int64), (doc, row), begin.astype(np.int64), length)
        single = kind[part] == 2  # the others are repeated as a whole and known
        return _sorted_spans(doc[part[single]], row[part[single]], (begin[part[single]] + place[single]).astype(np.int64), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch = whole.slice(a, 500)
                gram = batch.column("gram").to_numpy()
                if size >= batch_bytes:
                    last = held[-1].column("gram")[len(held[-1]) - 1].as_py()
                    split = int(np.searchsorted(gram != last, True)) if (gram != last).any() else len(gram)
                    if split:
                        held.append(batch.slice(0, split))
                        batch = batch.slice(split)
                    if len(batch):
                        yield solve(pa.Table.from_batches(held))
                        held, size = [], 0
                if len(batch):
                    held.append(batch)
                    size += batch.column("context").nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _marks(docs: DataFrame, length: int, gram: int, salts: int = 64) -> DataFrame:
    """doc_id, row; whole: places of anchors whose context repeats; open: places to look into, with
    gram and kind. As many as a document has anchors.

    A gram with over a two-thousandth of all rows is dealt out to `salts` parts. Each part then
    sees some of its contexts, or some places of a context, and takes it for one of several: a
    context that is met only once in a part is looked into with those of the other parts."""
    docs = docs.where("text is not null")
    again = cut(anchor_rows(docs, length, gram, True).groupBy("gram").count().where("count > 1"))
    total = again.agg(F.sum("count")).first()[0] or 0
    limit = max(HOT_FLOOR, total // 2000)
    hot = sorted(r["gram"] for r in again.where(F.col("count") > limit).select("gram").collect())  # two thousand at most
    sent = docs.sparkSession.sparkContext.broadcast(np.array(hot, np.int64))
    is_hot = F.col("gram").isin(hot) if hot else F.lit(False)
    rows = anchor_rows(docs, length, gram, False).withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("context", F.col("doc_id") % 8), F.lit(salts)).cast("int")).otherwise(0))
    each = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    # dealt out before the join: that of a join's own may be dropped (local reads) or split (skew)
    met = rows.repartition("gram", "salt").join(again.select("gram", each.alias("salt")), ["gram", "salt"], "left_semi")
    known = met.sortWithinPartitions("gram", "context").select("gram", "context", "doc_id", "row", "at").mapInArrow(lambda batches: _classify(batches, sent.value), "doc_id long, row int, at int, gram long, kind int")
    return known.groupBy("doc_id", "row").agg(F.collect_list(F.when(F.col("kind") == 0, F.col("at"))).alias("whole"), F.collect_list(F.when(F.col("kind") > 0, F.struct("at", "gram", "kind"))).alias("open"))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 100, in_task: int = 4000) -> DataFrame:
    """doc_id, row, spans: (low, high) of what repeats, for documents in which something does;
    spans may overlap. docs: doc_id and row, which are a document's own, and text. Its join here is
    the one that the caller repeats, so that Spark deals the texts out once."""
    marks = cut(_marks(docs, length, gram))
    counts = marks.select(F.explode("open.gram").alias("gram")).groupBy("gram").count()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(counts.where(F.col("count") > in_task), "gram"))
    wide = length - gram

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 200):
                batch = whole.slice(a, 200)
                rows = []
                for doc, row, text, open_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("open").to_pylist()):
                    for x in open_:
                        low = max(0, x["at"] - wide)
                        rows.append((x["gram"], doc, row, low, x["at"] - low, x["kind"], text[low : x["at"] + length]))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)]
                found = pa.RecordBatch.from_arrays(columns, ["gram", "doc_id", "row", "begin", "offset", "kind", "context"])
                yield found.filter(pa.array(~within(found.column("gram").to_numpy(), sent.value)))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of grams that are dealt out: each string's hash and place."""
        names = ["gram", "hash", "doc_id", "row", "low", "kind"]
        for batch in batches:
            for doc, row, text, open_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("open").to_pylist()):
                dealt = within(np.array([x["gram"] for x in open_], np.int64), sent.value)
                if not dealt.any():
                    continue
                roll = Rolling(np.frombuffer(text, np.uint8))
                for x in np.array(open_, object)[dealt]:
                    start = np.arange(max(0, x["at"] - wide), min(x["at"], len(text) - length) + 1)
                    h = roll.of(start, start + length).view(np.int64)
                    same = lambda value, kind: pa.array(np.full(len(start), value, kind))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([same(x["gram"], np.int64), pa.array(h), same(doc, np.int64), same(row, np.int32), pa.array(start.astype(np.int32)), same(x["kind"], np.int32)], names)

    texts = docs.select("doc_id", "row", "text").join(marks.where(F.size("open") > 0).select("doc_id", "row", "open"), ["doc_id", "row"])
    around = texts.mapInArrow(contexts, "gram long, doc_id long, row int, begin int, offset int, kind int, context binary")
    whole = marks.select("doc_id", "row", F.explode("whole").alias("at")).select("doc_id", "row", F.greatest(F.col("at") - wide, F.lit(0)).alias("low"), (F.col("at") + length).alias("high"))
    searched = around.repartition("gram").sortWithinPartitions("gram").mapInArrow(_search(length, 400_000), "doc_id long, row int, low int, high int")
    found = whole.unionByName(searched)
    if np.any(sent.value):
        dealt = texts.mapInArrow(strings, "gram long, hash long, doc_id long, row int, low int, kind int")
        place = F.struct("doc_id", "row", "low")
        places = dealt.groupBy("gram", "hash").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("gram", "hash")
        found = found.unionByName(dealt.where("kind = 2").join(places, ["gram", "hash"], "left_semi").select("doc_id", "row", "low", (F.col("low") + length).alias("high")))
    return found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 100, in_task: int = 4000, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with keep_text also the
    bytes that are left."""
    given = F.col("doc_id").cast("long")
    # a row's own key; equal rows of one doc_id share it, and all their contexts repeat. The last
    # bit says that there was no doc_id: both joins then need the same columns and deal out once
    row = F.hash("text").bitwiseAND(-2).bitwiseOR(given.isNull().cast("int"))
    keyed = docs.select(F.coalesce(given, F.xxhash64("text")).alias("doc_id"), row.alias("row"), "text")
    spans = repeated_spans(keyed, length, gram, in_task)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column("given").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                text = text or b""
                merged: list[list[int]] = []
                for low, high in sorted((s["low"], min(s["high"], len(text))) for s in spans or ()):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                at, kept = 0, []
                for low, high in merged:
                    kept.append(text[at:low])
                    at = high
                left = b"".join([*kept, text[at:]])
                rows.append((doc, len(text), len(text) - len(left), len(merged), hashlib.sha256(left).hexdigest(), *([left] if keep_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    given = F.when(F.col("row").bitwiseAND(1) == 0, F.col("doc_id"))
    return keyed.join(spans, ["doc_id", "row"], "left").select(given.alias("given"), "text", "spans").mapInArrow(run, schema)
