"""Progressive JPEG in numpy: many images side by side.

Decoding keeps one coefficient array per image and lets every scan add to it: spectral selection
fills bands of a block, successive approximation adds bits to what earlier scans found. Entropy
coded segments (between restart markers) of all images are lanes that decode in lockstep. Then the
coefficients are dequantised, inverse-transformed, chroma is upsampled and converted to RGB.

`encode_payloads` stores bytes losslessly in such a file: one byte is one quantised coefficient of
magnitude byte // 2 + 2 whose sign is the lowest bit, so scans keep every bit of it.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

from codelode.llm.flat import spread_runs

LIMIT = 16  # blocks (or MCUs) between restart markers in files written here


def _zigzag() -> np.ndarray:
    out: list[int] = []
    for s in range(15):
        diagonal = [(y, s - y) for y in range(8) if 0 <= s - y < 8]
        out += [y * 8 + x for y, x in (diagonal if s % 2 else diagonal[::-1])]
    return np.array(out)


ZIGZAG = _zigzag()
_BITS = np.array([int(i).bit_length() for i in range(2048)], np.int64)
_BASIS = np.array([[(np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
#: (zigzag coefficient, pixel)
IDCT = np.einsum("ky,lx->klyx", _BASIS, _BASIS).reshape(64, 64)[ZIGZAG].astype(np.float32)

#: Code lengths of the tables that files written here carry: {symbol: length}.
DC_LENGTHS = dict.fromkeys(range(12), 4)
AC_LENGTHS = {5: 1, 4: 2, 6: 3, 7: 5, 2: 5, 3: 5, 1: 9, 8: 9, 0x00: 9, 0x10: 9, 0x20: 9, 0x30: 9, 0x40: 9, 0x50: 9, 0xF0: 9}


def table_bytes(lengths: dict[int, int]) -> bytes:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(symbols)


@lru_cache(maxsize=256)
def read_table(stored: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """For every 16-bit prefix the code's length (0: none) and symbol; and the code of a symbol."""
    length, symbol, codes = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), {}
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(stored[n - 1]):
            lo = code << (16 - n)
            length[lo : lo + (1 << (16 - n))], symbol[lo : lo + (1 << (16 - n))] = n, stored[at]
            codes[stored[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return length, symbol, codes


def _coder(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes = read_table(table_bytes(lengths))[2]
    value, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        value[s], size[s] = c, n
    return value, size


@lru_cache(maxsize=4096)
def mcu_order(shape: tuple[tuple[int, int, int], ...], across: int, down: int) -> np.ndarray:
    """Storage places (component after component, rows of blocks) of the blocks in MCU order.
    shape: (h, v, offset of the component's blocks) of each component in the scan."""
    parts = []
    my, mx = np.divmod(np.arange(across * down), across)
    for h, v, offset in shape:
        for y in range(v):
            for x in range(h):
                parts.append(offset + (my * v + y) * across * h + mx * h + x)
    return np.stack(parts, axis=1).ravel()


# ---- writing


def pack(codes: np.ndarray, sizes: np.ndarray, per_lane: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lanes of bit strings as stuffed bytes with restart markers. last: lanes that end a scan;
    number: a lane's place in its scan. Gives the bytes and where each lane ends."""
    ends = np.cumsum(sizes)
    upto = np.cumsum(per_lane)
    lane_bits = np.diff(np.r_[0, ends[upto - 1]])
    lane_bytes = (lane_bits + 7) // 8
    lane_at = np.cumsum(lane_bytes) - lane_bytes
    shift = np.repeat(lane_at * 8 - (np.cumsum(lane_bits) - lane_bits), per_lane)
    at = ends - sizes + shift
    total = int(lane_bytes.sum())
    byte, room = at >> 3, 32 - (at & 7) - sizes
    word = codes << room
    out = np.zeros(total + 4)
    for k in range(4):
        piece = (word >> (24 - 8 * k)) & 255
        out += np.bincount(byte + k, piece, total + 4)
    data = out[:total].astype(np.uint8)
    tail = lane_bits & 7
    partial = np.flatnonzero(tail)
    data[lane_at[partial] + lane_bytes[partial] - 1] |= (255 >> tail[partial]).astype(np.uint8)
    full = np.flatnonzero(data == 255)
    extra = np.bincount(np.searchsorted(lane_at, full, side="right") - 1, minlength=len(per_lane))
    size = lane_bytes + extra + np.where(last, 0, 2)
    end = np.cumsum(size)
    place = np.arange(total) + np.repeat((end - size) - lane_at, lane_bytes)
    if len(full):
        before = np.zeros(total, np.int64)
        before[full] = 1
        count = np.cumsum(before) - before
        place += count - np.repeat(count[np.minimum(lane_at, total - 1)], lane_bytes)
    final = np.zeros(int(end[-1]), np.uint8)
    final[place] = data
    mark = np.flatnonzero(~last)
    final[end[mark] - 2], final[end[mark] - 1] = 255, 0xD0 + number[mark] % 8
    return final.tobytes(), end


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _lanes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scans of so many blocks cut into lanes: each lane's blocks, number, end-of-scan mark; and
    lanes of each scan."""
    n = -(-counts // LIMIT)
    number = spread_runs(np.zeros(len(n), np.int64), n)
    last = np.zeros(int(n.sum()), bool)
    last[np.cumsum(n) - 1] = True
    size = np.full(len(last), LIMIT)
    size[last] = counts - (n - 1) * LIMIT
    return size, number, last, n


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _sos(parts: list[tuple[int, int]], lo: int, hi: int, was: int, now: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([lo, hi, was << 4 | now]))


def grid(n_blocks: int) -> tuple[int, int]:
    """MCUs across and down for 4:2:0 images that hold so many blocks."""
    n = max(1, -(-n_blocks // 6))
    across = min(n, 64 if n <= 64 * 4095 else 4095)
    return across, -(-n // across)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as a progressive 4:2:0 JPEG file."""
    shapes = [grid(len(p) // 64) for p in payloads]
    mcus = np.array([a * d for a, d in shapes])
    data = np.frombuffer(b"".join(p + b"\xff" * (int(m) * 384 - len(p)) for p, m in zip(payloads, mcus)), np.uint8).reshape(-1, 64)
    v = ((data >> 1).astype(np.int16) + 2) * (1 - 2 * (data & 1).astype(np.int16))
    first = np.cumsum(mcus * 6) - mcus * 6
    inner = np.concatenate([mcu_order(((2, 2, 0), (1, 1, 4 * a * d), (1, 1, 5 * a * d)), a, d) for a, d in shapes])
    order = inner + np.repeat(first, mcus * 6)
    dc_code, dc_size = _coder(DC_LENGTHS)
    ac_code, ac_size = _coder(AC_LENGTHS)
    size, number, last, n_lanes = _lanes(mcus)
    starts = np.cumsum(size) - size
    # DC, first bits: differences within a lane
    dc = v[order, 0].astype(np.int64).reshape(-1, 6)
    high = dc >> 1
    before = np.empty_like(high)
    luma = np.r_[0, high[:, :4].ravel()[:-1]].reshape(-1, 4)
    before[:, :4] = luma
    before[1:, 4:] = high[:-1, 4:]
    before[starts, 0] = 0
    before[starts, 4:] = 0
    diff = (high - before).ravel()
    bits = _BITS[np.abs(diff)]
    scans = [pack((dc_code[bits] << bits) | _signed(diff, bits), dc_size[bits] + bits, size * 6, last, number)]
    groups = [np.cumsum(n_lanes)]
    # AC bands, all bits but the lowest; then the lowest of DC and of AC
    counts = (mcus[:, None] * np.array([4, 1, 1])).ravel()
    bsize, bnumber, blast, bn = _lanes(counts)
    for lo, hi in ((1, 5), (6, 63)):
        band = v[:, lo : hi + 1].astype(np.int64).ravel()
        a = np.abs(band) >> 1
        bits = _BITS[a]
        value = np.where(band < 0, a ^ ((1 << bits) - 1), a)
        scans.append(pack((ac_code[bits] << bits) | value, ac_size[bits] + bits, bsize * (hi - lo + 1), blast, bnumber))
        groups.append(np.cumsum(bn))
    low = ((dc & 1).astype(np.float32) @ np.float32(1 << np.arange(5, -1, -1))).astype(np.int64)
    scans.append(pack(low, np.full(len(low), 6), size, last, number))
    groups.append(np.cumsum(n_lanes))
    sevens = ((np.abs(v[:, 1:]) & 1).astype(np.float32).reshape(-1, 7) @ np.float32(1 << np.arange(6, -1, -1))).astype(np.int64)
    per_lane = 1 + 9 * bsize
    at = np.cumsum(per_lane) - per_lane
    codes, sizes = np.empty(int(per_lane.sum()), np.int64), np.full(int(per_lane.sum()), 7)
    run = _BITS[bsize] - 1
    codes[at], sizes[at] = (ac_code[run << 4] << run) | (bsize - (1 << run)), ac_size[run << 4] + run
    rest = np.ones(len(codes), bool)
    rest[at] = False
    codes[rest] = sevens.ravel()
    scans.append(pack(codes, sizes, per_lane, blast, bnumber))
    groups.append(np.cumsum(bn))
    cuts = [np.r_[0, end[g - 1]] for (_, end), g in zip(scans, groups)]
    tables = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + table_bytes(DC_LENGTHS) + b"\x10" + table_bytes(AC_LENGTHS)) + _segment(0xDD, struct.pack(">H", LIMIT))
    dc_head, dc_low = _sos([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1), _sos([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0)
    heads = [[_sos([(c, 0)], lo, hi, 0, 1) for c in (1, 2, 3)] for lo, hi in ((1, 5), (6, 63))]
    ac_low = [_sos([(c, 0)], 1, 63, 1, 0) for c in (1, 2, 3)]
    out = []
    for i, (a, d) in enumerate(shapes):
        take = lambda s, k: scans[s][0][cuts[s][k] : cuts[s][k + 1]]
        parts = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payloads[i])), _segment(0xC2, struct.pack(">BHHB", 8, d * 16, a * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), tables, dc_head, take(0, i)]
        for s in (1, 2):
            for c in range(3):
                parts += [heads[s - 1][c], take(s, 3 * i + c)]
        parts += [dc_low, take(3, i)]
        for c in range(3):
            parts += [ac_low[c], take(4, 3 * i + c)]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# ---- reading


class Image:
    """A parsed file: geometry, tables, and scans whose entropy-coded lanes aren't decoded yet."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.scans: list[dict] = []
        self.comment = b""
        tables: dict[int, bytes] = {}
        interval, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while at < len(data):
            if data[at] != 255:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            if marker == 255:
                at += 1
                continue
            size = data[at + 2] << 8 | data[at + 3]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                interval = body[0] << 8 | body[1]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xC2:
                self.height, self.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                self.hmax, self.vmax = max(p[1] for p in parts), max(p[2] for p in parts)
                self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                self.parts, offset = {}, 0
                for k, h, v, q in parts:
                    self.parts[k] = (h, v, q, offset)
                    offset += h * v * self.across * self.down
                self.blocks = offset
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("only progressive Huffman-coded files are read")
            elif marker == 0xDA:
                n = body[0]
                of = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
                lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
                end = _ENDS.search(data, at)
                stop = end.start() if end else len(data)
                lanes = [x.replace(b"\xff\x00", b"\xff") for x in _RESTARTS.split(data[at:stop])]
                at = stop
                if n > 1:
                    order, unit = mcu_order(tuple((self.parts[k][0], self.parts[k][1], self.parts[k][3]) for k, _ in of), self.across, self.down), sum(self.parts[k][0] * self.parts[k][1] for k, _ in of)
                else:
                    order, unit = self.single(of[0][0]), 1
                kinds = tuple(i for i, (k, _) in enumerate(of) for _ in range(self.parts[k][0] * self.parts[k][1])) if n > 1 else (0,)
                self.scans.append({"lo": lo, "hi": hi, "was": bits >> 4, "now": bits & 15, "lanes": lanes, "order": order, "kinds": kinds, "per": (interval or len(order)) * unit, "dc": tuple(tables.get(t >> 4, b"") for _, t in of), "ac": tables.get(0x10 | of[0][1] & 15, b"")})

    def single(self, k: int) -> np.ndarray:
        """Blocks of a component in a scan of its own: those that hold pixels, row by row."""
        h, v, _, offset = self.parts[k]
        wide, high = -(-(-(-self.width * h // self.hmax)) // 8), -(-(-(-self.height * v // self.vmax)) // 8)
        return _rows(wide, high, self.across * h, offset)


_ENDS = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(maxsize=4096)
def _rows(wide: int, high: int, stride: int, offset: int) -> np.ndarray:
    return (offset + np.arange(high)[:, None] * stride + np.arange(wide)).ravel()


class Lanes:
    """Lanes of one kind of scan over many images."""

    def __init__(self, found: list[tuple[dict, int]]):
        data, order, start, begin, count, self.scan = [], [], [], [], [], []
        at = placed = 0
        for i, (scan, base) in enumerate(found):
            order.append(scan["order"] + base)
            left, per, first = len(scan["order"]), scan["per"], placed
            for lane in scan["lanes"]:
                n = min(per, left)
                if n <= 0:
                    break
                data += [lane, _PAD]
                start.append(at)
                at += len(lane) + len(_PAD)
                begin.append(first)
                count.append(n)
                self.scan.append(i)
                first += n
                left -= n
            placed += len(scan["order"])
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        wide = self.bytes.astype(np.uint32)
        self.window = np.zeros(len(wide), np.int64)
        self.window[:-3] = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        self.order = np.concatenate(order)
        self.pos, self.begin, self.count = np.array(start, np.int64) * 8, np.array(begin, np.int64), np.array(count, np.int64)
        self.scan = np.array(self.scan, np.int64)

    def peek(self, pos: np.ndarray, n: int = 16) -> np.ndarray:
        return (self.window[pos >> 3] >> (32 - n - (pos & 7))) & ((1 << n) - 1)

    def bits(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.window[pos >> 3] >> (32 - n - (pos & 7))) & ((1 << n) - 1)


_PAD = b"\0" * 8


class Tables:
    def __init__(self, stored: list[bytes]):
        distinct = list(dict.fromkeys(stored))
        read = [read_table(x) if x else read_table(bytes(16)) for x in distinct]
        self.length = np.concatenate([x[0] for x in read]).astype(np.int64)
        self.symbol = np.concatenate([x[1] for x in read]).astype(np.int64)
        self.both = self.symbol << 8 | self.length
        number = {x: i << 16 for i, x in enumerate(distinct)}
        self.base = np.array([number[x] for x in stored], np.int64)


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def _dc_first(found: list[tuple[dict, int]], coefs: np.ndarray) -> None:
    kinds, now = found[0][0]["kinds"], found[0][0]["now"]
    lanes = Lanes(found)
    tables = [Tables([s["dc"][k] for s, _ in found]) for k in range(max(kinds) + 1)]
    by_size = np.argsort(-lanes.count, kind="stable")
    pos, begin, count, scan = lanes.pos[by_size], lanes.begin[by_size], lanes.count[by_size], lanes.scan[by_size]
    last = np.zeros((max(kinds) + 1, len(pos)), np.int64)
    for j in range(int(count[0])):
        n = int(np.searchsorted(-count, -j, side="left"))  # lanes of more than j blocks
        k = kinds[j % len(kinds)]
        key = lanes.peek(pos[:n]) + tables[k].base[scan[:n]]
        size = tables[k].symbol[key]
        p = pos[:n] + tables[k].length[key]
        last[k, :n] += _extend(lanes.bits(p, size), size)
        pos[:n] = p + size
        coefs[lanes.order[begin[:n] + j], 0] = last[k, :n] << now


def _dc_more(found: list[tuple[dict, int]], coefs: np.ndarray) -> None:
    lanes = Lanes(found)
    bits = np.unpackbits(lanes.bytes)
    at = lanes.order[spread_runs(lanes.begin, lanes.count)]
    coefs[at, 0] |= bits[spread_runs(lanes.pos, lanes.count)].astype(coefs.dtype) << found[0][0]["now"]


def _ac_first(found: list[tuple[dict, int]], coefs: np.ndarray) -> None:
    lanes = Lanes(found)
    table = Tables([s["ac"] for s, _ in found])
    lo, hi, now = (np.array([s[x] for s, _ in found], np.int64)[lanes.scan] for x in ("lo", "hi", "now"))
    pos, begin, left, base = lanes.pos.copy(), lanes.begin.copy(), lanes.count.copy(), table.base[lanes.scan]
    k, to = lo.copy(), lanes.order[begin] * 64
    base, flat = base.copy(), coefs.reshape(-1)
    while len(pos):
        both = table.both[lanes.peek(pos) + base]
        pos += both & 255
        run, size = both >> 12, (both >> 8) & 15
        if size.all():
            value = lanes.bits(pos, size)
            pos += size
            k += run
            flat[to + k] = (value - (value < (1 << (size - 1))) * ((1 << size) - 1)) << now
            k += 1
            moved = np.flatnonzero(k > hi)
            skip = None
        else:
            hit = size > 0
            more = np.where(hit, size, np.where(run < 15, run, 0))
            value = lanes.bits(pos, more)
            pos += more
            k += run
            w = np.flatnonzero(hit)
            flat[to[w] + k[w]] = (_extend(value[w], size[w]) << now[w]).astype(flat.dtype)
            k += 1
            ended = ~hit & (run < 15)
            skip = np.where(ended, (1 << run) + value, (k > hi).astype(np.int64))
            moved = np.flatnonzero(skip)
        if len(moved):
            jump = 1 if skip is None else skip[moved]
            begin[moved] += jump
            left[moved] -= jump
            k[moved] = lo[moved]
            alive = left > 0
            if alive.all():
                to[moved] = lanes.order[begin[moved]] * 64
            else:
                pos, begin, left, base, k, lo, hi, now = (x[alive] for x in (pos, begin, left, base, k, lo, hi, now))
                to = lanes.order[begin] * 64


def _ac_more(found: list[tuple[dict, int]], coefs: np.ndarray) -> None:
    lanes = Lanes(found)
    table = Tables([s["ac"] for s, _ in found])
    lo, hi, now = (np.array([s[x] for s, _ in found], np.int64)[lanes.scan] for x in ("lo", "hi", "now"))
    bits = np.unpackbits(lanes.bytes)
    base, pos, run = table.base[lanes.scan], lanes.pos.copy(), np.zeros(len(lanes.pos), np.int64)
    place = np.arange(64)
    for j in range(int(lanes.count.max())):
        live = np.flatnonzero(lanes.count > j)
        need = live[run[live] == 0]
        done = np.zeros(len(pos), bool)
        if len(need):
            key = lanes.peek(pos[need]) + base[need]
            symbol = table.symbol[key]
            ends = (symbol & 15 == 0) & (symbol >> 4 < 15)
            at, more = need[ends], symbol[ends] >> 4
            p = pos[at] + table.length[key[ends]]
            run[at] = (1 << more) + lanes.bits(p, more)
            pos[at] = p + more
            for i in need[~ends]:
                block = coefs[lanes.order[lanes.begin[i] + j]]
                pos[i], run[i] = _refine(block, bits, int(pos[i]), int(lo[i]), int(hi[i]), int(now[i]), table, int(base[i]))
                done[i] = True
        rows = live[~done[live]]
        if len(rows):  # blocks within an end-of-band run: one bit for each coefficient that isn't 0
            at = lanes.order[lanes.begin[rows] + j]
            block = coefs[at]
            known = (block != 0) & (place >= lo[rows, None]) & (place <= hi[rows, None])
            n = known.sum(axis=1)
            flags = bits[spread_runs(pos[rows], n)].astype(bool)
            r, c = np.nonzero(known)
            r, c = r[flags], c[flags]
            coefs[at[r], c] += np.sign(block[r, c]) << now[rows[r]].astype(coefs.dtype)
            pos[rows] += n
            run[rows] -= 1


def _refine(block: np.ndarray, bits: np.ndarray, pos: int, lo: int, hi: int, now: int, table: Tables, base: int) -> tuple[int, int]:
    """One block with coefficients that become other than 0 in this scan; the place after it and
    the length of an end-of-band run that starts within it, this block not counted."""
    k, plus = lo, 1 << now
    number = lambda at, n: int("".join(map(str, bits[at : at + n])) or "0", 2)

    def fix(k: int, pos: int) -> int:
        if bits[pos]:
            block[k] += plus if block[k] > 0 else -plus
        return pos + 1

    while k <= hi:
        key = number(pos, 16) + base
        symbol = int(table.symbol[key])
        pos += int(table.length[key])
        run, size = symbol >> 4, symbol & 15
        value = 0
        if size:
            value = plus if bits[pos] else -plus
            pos += 1
        elif run < 15:
            left = (1 << run) + number(pos, run) - 1
            pos += run
            while k <= hi:
                if block[k]:
                    pos = fix(k, pos)
                k += 1
            return pos, left
        while k <= hi:
            if block[k]:
                pos = fix(k, pos)
            elif run == 0:
                break
            else:
                run -= 1
            k += 1
        if value and k <= hi:
            block[k] = value
        k += 1
    return pos, 0


def decode_files(files: list[bytes]) -> tuple[list[Image], list[np.ndarray]]:
    """The images and their quantised coefficients, (blocks, 64) in zigzag order."""
    images = [Image(f) for f in files]
    sizes = np.array([i.blocks for i in images])
    bases = np.cumsum(sizes) - sizes
    coefs = np.zeros((int(sizes.sum()), 64), np.int32)
    for number in range(max(len(i.scans) for i in images)):
        kinds: dict[tuple, list[tuple[dict, int]]] = {}
        for image, base in zip(images, bases.tolist()):
            if number < len(image.scans):
                s = image.scans[number]
                dc = s["lo"] == 0
                kinds.setdefault((dc, s["was"] > 0, s["now"] if dc else 0, s["kinds"] if dc else ()), []).append((s, base))
        for (dc, more, _, _), found in kinds.items():
            ((_dc_more if more else _dc_first) if dc else (_ac_more if more else _ac_first))(found, coefs)
    return images, [coefs[b : b + n] for b, n in zip(bases.tolist(), sizes.tolist())]


def pixels(image: Image, coefs: np.ndarray) -> np.ndarray:
    """Full-resolution RGB, (height, width, 3) bytes."""
    planes = []
    for h, v, q, offset in image.parts.values():
        wide, high = image.across * h, image.down * v
        block = coefs[offset : offset + wide * high].astype(np.float32) * image.quant[q]
        plane = (block @ IDCT).reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8) + np.float32(128)
        if (h, v) != (image.hmax, image.vmax):
            plane = np.repeat(np.repeat(plane, image.vmax // v, axis=0), image.hmax // h, axis=1)
        planes.append(np.clip(np.rint(plane), 0, 255)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    out = np.empty((*y.shape, 3), np.uint8)
    for c, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, c] = np.clip(np.rint(plane), 0, 255)
    return out


def payload_of(image: Image, coefs: np.ndarray) -> bytes:
    """The bytes that encode_payloads stored."""
    n = int(image.comment.split()[1])
    v = coefs.reshape(-1)[:n]
    return (((np.abs(v) - 2) << 1) | (v < 0)).astype(np.uint8).tobytes()
