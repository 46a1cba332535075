"""Progressive JPEG media columns in numpy.

The reader accumulates spectral-selection and successive-approximation scans into arrays of quantised
coefficients. All restart intervals of a batch of images that share a scan's parameters and table
are decoded side by side: one numpy step reads one symbol of each interval. Coefficients go through
an inverse transform in exact integers, chroma is brought to full resolution by repetition, and the
result is an RGB tensor.

The writer stores bytes losslessly: byte k of 64 becomes coefficient k, in zigzag order, of one block
(its value plus 2, so that no coefficient vanishes when its last bit is held back). Blocks fill a 4:2:0
image: luma first, then the two chroma planes. Per plane there are five scans: DC and two AC bands
without their last bit, then the last bits of DC and AC.

DC scans of several components may be interleaved, as common encoders write them; blocks that only fill up
their last macro blocks are read and left out. Images with arithmetic coding, 12-bit samples or sampling other
than 1 and 2, files that are not progressive and broken files are refused with a ValueError; a column of media
gets an error in the row of such a file, and the other rows are as ever.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from curatrix.llm import common

#: Blocks between restart markers in what is written.
RESTART = 16
#: Bytes of payload that are coded together.
PART = 1 << 20
SHIFT = 2
MARK = b"payload "


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag index."""
    cells = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([u * 8 + v for u, v in cells])


ZIGZAG = _zigzag()

# ---------------------------------------------------------------- Huffman tables


def _table(values: list[int], lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, length); lengths must not fall."""
    out, code, last = {}, 0, lengths[0]
    for v, n in zip(values, lengths, strict=True):
        code <<= n - last
        out[v] = (code, n)
        code, last = code + 1, n
    return out


def _segment(kind: int, table: dict[int, tuple[int, int]]) -> bytes:
    counts = [0] * 17
    for _, n in table.values():
        counts[n] += 1
    return bytes([kind, *counts[1:], *table])


#: DC sizes; AC sizes of a first scan by how common they are in text; runs of block ends in a last-bit scan.
DC = _table(list(range(10)), [4] * 10)
AC = _table([6, 5, 7, 8, 1, 4, 3, 2], [1, 2, 3, 4, 5, 6, 7, 8])
ENDS = _table([r << 4 for r in range(6)], [3] * 6)

_LOOKUP: dict[bytes, np.ndarray] = {}


def _lookup(counts: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits that may come next: symbol * 256 + code length; length 0 where no code fits."""
    key = counts + values
    if key not in _LOOKUP:
        out, code, at = np.zeros(1 << 16, np.int32), 0, 0
        for n, k in enumerate(counts, 1):
            for v in values[at : at + k]:
                out[code << (16 - n) : (code + 1) << (16 - n)] = v << 8 | n
                code += 1
            at += k
            code <<= 1
        _LOOKUP[key] = out
    return _LOOKUP[key]


# ---------------------------------------------------------------- writer


def _packed(values: np.ndarray, sizes: np.ndarray, interval: np.ndarray, n: int, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of ``n`` intervals and the offsets of the intervals in them.

    Codes (value, size up to 16 bits) come interval by interval. Each interval is filled up with ones;
    0xFF is followed by 0; a restart marker of its number follows unless it is ``last`` of its scan."""
    bits = np.bincount(interval, sizes, n).astype(np.int64)
    room = (bits + 7) // 8 + np.where(last, 0, 2)
    first = np.concatenate([[0], np.cumsum(room)])
    ends = np.cumsum(sizes)
    begin = np.concatenate([[0], np.cumsum(bits)])
    at = ends - sizes - begin[interval] + first[interval] * 8
    wide = values.astype(np.int64) << (24 - sizes - (at & 7))
    byte = at >> 3
    total = int(first[-1])
    out = np.bincount(byte, wide >> 16, total + 3)
    out += np.bincount(byte + 1, (wide >> 8) & 255, total + 3)
    out += np.bincount(byte + 2, wide & 255, total + 3)
    out = out[:total].astype(np.uint8)
    pad = -bits % 8
    tail = first[:-1] + (bits + 7) // 8
    padded = pad > 0
    out[tail[padded] - 1] |= ((1 << pad[padded]) - 1).astype(np.uint8)
    data = np.ones(total, bool)
    markers = tail[~last]
    out[markers], out[markers + 1] = 0xFF, 0xD0 + number[~last] % 8
    data[markers] = data[markers + 1] = False
    where = np.arange(total) + np.concatenate([[0], np.cumsum((out == 0xFF) & data)[:-1]]) if total else np.zeros(0, np.int64)
    size = total + int(((out == 0xFF) & data).sum())
    final = np.zeros(size, np.uint8)
    final[where] = out
    return final, np.append(where, size)[np.minimum(first, total)]


def _codes(table: dict[int, tuple[int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(top, np.int64), np.zeros(top, np.int64)
    for v, (c, n) in table.items():
        code[v], size[v] = c, n
    return code, size


_SIZE = np.array([0, *[int(i).bit_length() for i in range(1, 512)]])


def _scan(kind: str, c: np.ndarray, interval: np.ndarray, fresh: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One scan of blocks ``c`` (n, 64): entropy-coded bytes and offsets by interval. ``fresh``: first of its interval."""
    n = len(last)
    if kind == "dc":
        high = (c[:, 0] >> 1).astype(np.int64)
        diff = np.where(fresh, high, high - np.concatenate([[0], high[:-1]]))
        s = _SIZE[np.abs(diff)]
        code, size = _codes(DC, 16)
        return _packed(code[s] << s | np.where(diff < 0, diff + (1 << s) - 1, diff), size[s] + s, interval, n, last, number)
    if kind == "dc bit":
        return _packed(c[:, 0] & 1, np.ones(len(c), np.int64), interval, n, last, number)
    if kind == "ac bit":
        code, size = _codes(ENDS, 256)
        blocks = np.bincount(interval, minlength=n)
        r = _SIZE[blocks] - 1
        head, head_size = code[r << 4] << r | (blocks - (1 << r)), size[r << 4] + r
        # 63 bits of each block in seven fields; the head of the interval goes before its first block
        body = ((c[:, 1:] & 1).reshape(-1, 7, 9) @ (1 << np.arange(8, -1, -1))).astype(np.int64)
        values, sizes = np.zeros((len(c), 8), np.int64), np.full((len(c), 8), 9, np.int64)
        values[:, 1:] = body
        values[:, 0], sizes[:, 0] = np.where(fresh, head[interval], 0), np.where(fresh, head_size[interval], 0)
        return _packed(values.reshape(-1), sizes.reshape(-1), np.repeat(interval, 8), n, last, number)
    lo, hi = (1, 6) if kind == "ac low" else (6, 64)
    high = (c[:, lo:hi] >> 1).astype(np.int64).reshape(-1)
    s = _SIZE[high]
    code, size = _codes(AC, 16)
    return _packed(code[s] << s | high, size[s] + s, np.repeat(interval, hi - lo), n, last, number)


#: Scans of a plane: kind, first and last coefficient, high and low bit, AC table.
SCANS = (("dc", 0, 0, 0, 1, 0), ("ac low", 1, 5, 0, 1, 0), ("ac high", 6, 63, 0, 1, 0), ("dc bit", 0, 0, 1, 0, 0), ("ac bit", 1, 63, 1, 0, 1))


def _shape(blocks: int) -> tuple[int, int]:
    """Macro blocks across and down that hold so many blocks; no side of an image passes 65,520."""
    macro = -(-blocks // 6)
    across = -(-macro // 4095)
    return across, -(-macro // across)


def padded(raw: bytes) -> bytes:
    """``raw`` and zeros up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload (a positive multiple of 64 bytes)."""
    shapes = [_shape(len(p) // 64) for p in payloads]
    planes, sizes = [], []
    for p, (w, h) in zip(payloads, shapes, strict=True):
        planes.append(p.ljust(w * h * 384, b"\0"))
        sizes += [4 * w * h, w * h, w * h]
    c = np.frombuffer(b"".join(planes), np.uint8).reshape(-1, 64).astype(np.int16) + SHIFT
    sizes = np.array(sizes)
    plane = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fresh = place % RESTART == 0
    interval = np.cumsum(fresh) - 1
    per = -(-sizes // RESTART)
    until = np.cumsum(per)
    last = np.zeros(len(interval) and int(until[-1]), bool)
    last[until - 1] = True
    number = np.arange(len(last)) - np.repeat(until - per, per)
    coded = []
    for kind, *_ in SCANS:
        data, offsets = _scan(kind, c, interval, fresh, last, number)
        coded.append((data.tobytes(), offsets[np.concatenate([[0], until])].tolist()))

    def seg(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body

    tables = seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC4, _segment(0x00, DC) + _segment(0x10, AC) + _segment(0x11, ENDS)) + seg(0xDD, struct.pack(">H", RESTART))
    heads = [[seg(0xDA, bytes([1, comp, ac, ss, se, ah << 4 | al])) for _, ss, se, ah, al, ac in SCANS] for comp in (1, 2, 3)]
    out = []
    for i, (p, (w, h)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", seg(0xFE, MARK + str(len(p)).encode()), tables, seg(0xC2, frame)]
        for comp in range(3):
            for (data, offsets), head in zip(coded, heads[comp], strict=True):
                parts += (head, data[offsets[3 * i + comp] : offsets[3 * i + comp + 1]])
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# ---------------------------------------------------------------- reader


@dataclass
class Plane:
    id: int
    h: int
    v: int
    quant: int
    across: int = 0
    down: int = 0
    at: int = 0  # of its first block among all blocks


@dataclass
class Image:
    width: int = 0
    height: int = 0
    planes: list[Plane] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class Batch:
    """Coefficients (zigzag order) of many images, accumulated scan by scan."""

    def __init__(self, files: list[bytes]):
        self.raw = np.frombuffer(b"".join(files) + b"\0\0\0\0", np.uint8)
        self.images: list[Image] = []
        self.blocks = 0
        # scans of the same parameters and place in their files: lanes (byte, first block, blocks)
        self.scans: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)
        self.targets: list[int] = []  # blocks of the interleaved scans, which are not in the order of a plane
        ff = np.flatnonzero((self.raw[:-1] == 0xFF) & (self.raw[1:] != 0))
        at = 0
        for f in files:
            self._parse(f, at, ff[np.searchsorted(ff, at) : np.searchsorted(ff, at + len(f))])
            at += len(f)
        keep = np.ones(len(self.raw), bool)
        keep[1:] = ~((self.raw[:-1] == 0xFF) & (self.raw[1:] == 0))
        self.moved = np.concatenate([[0], np.cumsum(keep)])
        plain = np.append(self.raw[keep], np.zeros(64, np.uint8)).astype(np.int32)
        self.wide = plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]
        self.coef = np.zeros(self.blocks * 64, np.int16)
        for key in sorted(self.scans, key=lambda k: k[0]):
            self._decode(key, self.scans[key])

    def _parse(self, f: bytes, base: int, markers: np.ndarray) -> None:
        img, tables, restart, order, at = Image(), {}, 0, 0, 2
        if f[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        end = False
        marks = (markers - base).tolist()
        next_mark = 0
        while at < len(f):
            if at + 4 > len(f) and f[at + 1 :] != b"\xd9":
                raise ValueError("the file ends inside a segment")
            marker, size = f[at + 1], 0
            if end := marker == 0xD9:
                break
            (size,) = struct.unpack_from(">H", f, at + 2)
            body = f[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC2:
                bits, img.height, img.width, n = struct.unpack_from(">BHHB", body)
                img.planes = [Plane(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if bits != 8 or any(p.h > 2 or p.v > 2 for p in img.planes):
                    raise ValueError("only 8-bit samples with sampling factors 1 and 2")
                hm, vm = max(p.h for p in img.planes), max(p.v for p in img.planes)
                for p in img.planes:
                    p.across = -(-(-(-img.width * p.h // hm)) // 8)
                    p.down = -(-(-(-img.height * p.v // vm)) // 8)
                    p.at = self.blocks
                    self.blocks += p.across * p.down
            elif marker in (0xC0, 0xC1, 0xC3, 0xC9, 0xCA):
                raise ValueError("only progressive Huffman-coded files")
            elif marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("only 8-bit quantisation tables")
                    img.quants[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
                    body = body[65:]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xFE:
                img.comment = body
            elif marker == 0xDA:
                n = body[0]
                part = [next((p for p in img.planes if p.id == body[1 + 2 * i]), None) for i in range(n)]
                if not part or None in part or len(body) < 4 + 2 * n:
                    raise ValueError("a scan of components that are not there")
                ss, se, bits = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
                if not ss <= se < 64 or (n > 1 and se):
                    raise ValueError("only DC scans may be interleaved")
                need = ss > 0 or not bits >> 4  # later bits of DC need no table
                found = [tables.get(body[2 + 2 * i] >> 4) if ss == 0 else tables.get(0x10 | body[2 + 2 * i] & 15) for i in range(n)]
                if need and None in found:
                    raise ValueError("a scan without its table")
                if n > 1:
                    blocks = len(self._mixed(img, part))
                    layout = tuple(t for p, t in zip(part, found, strict=True) for _ in range(p.h * p.v))
                    key = (order, ss, se, bits >> 4, bits & 15, (tuple(k for k, p in enumerate(part) for _ in range(p.h * p.v)), layout if need else None))
                    each, first = len(layout), len(self.targets)
                    self.targets += self._mixed(img, part)
                else:
                    plane = part[0]
                    blocks, each, first = plane.across * plane.down, 1, plane.at
                    key = (order, ss, se, bits >> 4, bits & 15, found[0] if need else None)
                order += 1
                lanes, start, done = self.scans[key], at, 0
                while next_mark < len(marks) and marks[next_mark] < at:
                    next_mark += 1
                while True:
                    take = min(restart * each or blocks, blocks - done)
                    lanes.append((base + start, first + done, take))
                    done += take
                    if next_mark == len(marks):
                        raise ValueError("the file ends inside a scan")
                    mark = marks[next_mark]
                    if not 0xD0 <= f[mark + 1] <= 0xD7:
                        break
                    start = mark + 2
                    next_mark += 1
                at = mark
        if not end or not img.planes or any(p.quant not in img.quants for p in img.planes):
            raise ValueError("the file is not whole")
        self.images.append(img)

    def _mixed(self, img: Image, part: list[Plane]) -> list[int]:
        """Blocks of an interleaved scan in its order; -1 for those that only fill up a macro block."""
        hm, vm = max(p.h for p in img.planes), max(p.v for p in img.planes)
        right, down = -(-img.width // (8 * hm)), -(-img.height // (8 * vm))
        y, x = (a.reshape(-1, 1) for a in np.divmod(np.arange(right * down), right))
        columns = []
        for p in part:
            v, h = (a.reshape(1, -1) for a in np.divmod(np.arange(p.h * p.v), p.h))
            row, col = y * p.v + v, x * p.h + h
            columns.append(np.where((row < p.down) & (col < p.across), p.at + row * p.across + col, -1))
        return np.concatenate(columns, 1).reshape(-1).tolist()

    def _interleaved(self, pos, first, count, low, high, kinds, luts) -> None:
        """A DC scan of several components: ``kinds`` of the blocks of a macro block, each with its own prediction."""
        targets = np.array(self.targets, np.int64)
        before = np.zeros((max(kinds) + 1, len(pos)), np.int64)
        for b in range(int(count[0])):
            n = int(np.searchsorted(-count, -b))
            kind, at = kinds[b % len(kinds)], targets[first[:n] + b]
            there = at >= 0
            if high:
                bit = (self._peek(pos[:n]) >> 15) << low
                self.coef[at[there] * 64] |= bit[there].astype(np.int16)
                pos[:n] += 1
                continue
            s, p = self._symbol(pos[:n], luts[b % len(kinds)])
            v = self._peek(p) >> (16 - s)
            before[kind, :n] += np.where(v < (1 << s) >> 1, v - (1 << s) + 1, v)
            pos[:n] = p + s
            self.coef[at[there] * 64] = before[kind, :n][there] << low

    def _peek(self, pos: np.ndarray) -> np.ndarray:
        at = pos >> 3
        if len(at) and int(at.max()) >= len(self.wide):
            raise ValueError("the data of a scan end too early")
        return (self.wide[at] >> (8 - (pos & 7))) & 0xFFFF

    def _decode(self, key: tuple, lanes: list[tuple[int, int, int]]) -> None:
        _, ss, se, high, low, table = key
        start, first, count = (np.array(x, np.int64) for x in zip(*lanes, strict=True))
        order = np.argsort(-count, kind="stable")
        pos, first, count = self.moved[start[order]] * 8, first[order], count[order]
        if table and isinstance(table[0], tuple):
            kinds, layout = table
            self._interleaved(pos, first, count, low, high, kinds, [_lookup(*t) for t in layout] if layout else None)
            return
        lut = _lookup(*table) if table else None
        if ss == 0 and high:
            self._dc_bits(pos, first, count, low)
        elif ss == 0:
            self._dc(pos, first, count, low, lut)
        elif high:
            self._ac_bits(pos, first, count, ss, se, low, lut)
        else:
            self._ac(pos, first, count, ss, se, low, lut)

    def _symbol(self, pos: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = lut[self._peek(pos)]
        size = e & 255
        if not size.all():
            raise ValueError("a code that is in no table")
        return e >> 8, pos + size

    def _dc_bits(self, pos, first, count, low) -> None:
        for b in range(int(count[0])):
            n = int(np.searchsorted(-count, -b))  # lanes of more than b blocks
            self.coef[(first[:n] + b) * 64] |= ((self._peek(pos[:n] + b) >> 15) << low).astype(np.int16)

    def _dc(self, pos, first, count, low, lut) -> None:
        before = np.zeros(len(pos), np.int64)
        for b in range(int(count[0])):
            n = int(np.searchsorted(-count, -b))
            s, p = self._symbol(pos[:n], lut)
            v = self._peek(p) >> (16 - s)
            before[:n] += np.where(v < (1 << s) >> 1, v - (1 << s) + 1, v)
            pos[:n] = p + s
            self.coef[(first[:n] + b) * 64] = before[:n] << low

    def _ac(self, pos, first, count, ss, se, low, lut) -> None:
        at, end = first * 64 + ss, (first + count) * 64
        while len(at):
            sym, p = self._symbol(pos, lut)
            s = sym & 15
            plain = s.all()
            if plain and not (sym >> 4).any():
                v = self._peek(p) >> (16 - s)
                self.coef[at] = np.where(v < 1 << (s - 1), v - (1 << s) + 1, v) << low
                pos = p + s
                at = at + 1
            else:
                r = sym >> 4
                n = np.where(s > 0, s, np.where(r < 15, r, 0))
                v = self._peek(p) >> (16 - n)
                pos = p + n
                at = at + np.where(s > 0, r, np.where(r == 15, 16, 0))
                some = s > 0
                sv, vv = s[some], v[some]
                self.coef[at[some]] = np.where(vv < 1 << (sv - 1), vv - (1 << sv) + 1, vv) << low
                at = at + some
                ends = (s == 0) & (r < 15)
                at = np.where(ends, ((at - ss) // 64 + (1 << np.where(ends, r, 0)) + np.where(ends, v, 0)) * 64 + ss, at)
            # past the band: on to the next block
            if (over := ((at - ss) & 63) > se - ss).any():
                at = np.where(over, ((at - ss) // 64 + 1) * 64 + ss, at)
            if (done := at >= end).any():
                at, end, pos = at[~done], end[~done], pos[~done]

    def _ac_bits(self, pos, first, count, ss, se, low, lut) -> None:
        ends = np.zeros(len(pos), np.int64)  # blocks that a run of block ends still covers
        one = 1 << low
        steps = np.arange(se - ss + 1)
        for b in range(int(count[0])):
            n = int(np.searchsorted(-count, -b))
            pos, first, ends = pos[:n], first[:n], ends[:n]
            at = (first + b) * 64 + ss
            wait, run, value = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)

            def ask(need: np.ndarray) -> None:
                """Reads the next symbol where nothing is pending."""
                i = np.flatnonzero(need)  # noqa: B023
                if not len(i):
                    return
                sym, p = self._symbol(pos[i], lut)  # noqa: B023
                s, r = sym & 15, sym >> 4
                stop = (s == 0) & (r < 15)
                v = self._peek(p)
                k = np.where(stop, r, s)
                v = v >> (16 - k)
                pos[i] = p + k  # noqa: B023
                ends[i] = np.where(stop, (1 << np.where(stop, r, 0)) + v, 0)  # noqa: B023
                wait[i], run[i] = ~stop, r  # noqa: B023
                value[i] = np.where(s > 0, np.where(v == 1, one, -one), 0)  # noqa: B023

            ask(ends == 0)
            band = self.coef[at[:, None] + steps]
            if (ends > 0).all() and band.all():
                where = pos[:, None] + steps
                bits = (self.wide[where >> 3] >> (23 - (where & 7))) & 1
                self.coef[at[:, None] + steps] = band + np.where(band > 0, bits, -bits) * one
                pos += len(steps)
            else:
                for k in range(len(steps)):
                    if k:
                        ask((ends == 0) & ~wait)
                    c = self.coef[at + k].astype(np.int64)
                    full = c != 0
                    bit = np.where(full, self._peek(pos) >> 15, 0)
                    pos += full
                    c += np.where(c > 0, bit, -bit) * one
                    place = ~full & wait & (run == 0)
                    c = np.where(place, value, c)
                    run -= ~full & wait
                    wait &= ~place
                    self.coef[at + k] = c
            ends = np.maximum(ends - 1, 0)

    # ------------------------------------------------------------ pictures

    def pixels(self) -> np.ndarray:
        """(blocks, 8, 8) samples: exact integer arithmetic, so equal blocks give equal samples."""
        flat = self.coef.reshape(-1, 64).astype(np.float64)
        for img in self.images:
            for p in img.planes:
                q = img.quants[p.quant]
                if (q != 1).any():
                    flat[p.at : p.at + p.across * p.down] *= q
        natural = np.empty_like(flat)
        natural[:, ZIGZAG] = flat
        out = np.empty(natural.shape, np.uint8)
        for i in range(0, len(out), 4096):  # products and sums of integers below 2**53
            out[i : i + 4096] = np.clip(np.floor((natural[i : i + 4096] @ _INVERSE + 0.5 * _SCALE) / _SCALE) + 128, 0, 255)
        return out.reshape(-1, 8, 8)

    def rgb(self) -> list[np.ndarray]:
        """A (height, width, 3) tensor of bytes for each image; one plane gives grey."""
        blocks = self.pixels()
        out: list[np.ndarray | None] = [None] * len(self.images)
        alike: dict[tuple, list[int]] = defaultdict(list)
        for i, img in enumerate(self.images):
            alike[(img.width, tuple((p.h, p.v, p.across) for p in img.planes), img.height % 16)].append(i)
        for members in alike.values():
            # images of one width, whole macro blocks high, are worked on as one tall image
            tall = [members] if self.images[members[0]].height % 16 == 0 else [[i] for i in members]
            for group in tall:
                imgs = [self.images[i] for i in group]
                hm, vm = max(p.h for p in imgs[0].planes), max(p.v for p in imgs[0].planes)
                full = []
                for k, plane in enumerate(imgs[0].planes):
                    parts = [blocks[g.planes[k].at : g.planes[k].at + g.planes[k].across * g.planes[k].down] for g in imgs]
                    x = np.concatenate(parts).reshape(-1, plane.across, 8, 8).swapaxes(1, 2).reshape(-1, plane.across * 8)
                    full.append(x.repeat(vm // plane.v, 0).repeat(hm // plane.h, 1))
                height, width = (sum(g.height for g in imgs), imgs[0].width)
                full = [f[:height, :width] for f in full]
                if len(full) == 1:
                    image = np.repeat(full[0][..., None], 3, 2)
                else:
                    y, cb, cr = full[0].astype(np.float32), full[1].astype(np.float32) - 128, full[2].astype(np.float32) - 128
                    image = np.empty((height, width, 3), np.uint8)
                    for j, v in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
                        image[..., j] = np.clip(np.rint(v), 0, 255)
                at = 0
                for i, g in zip(group, imgs, strict=True):
                    out[i] = image[at : at + g.height]
                    at += g.height
        return out

    def payloads(self) -> list[bytes | None]:
        """What :func:`encode` stored, from the coefficients; None for other files."""
        data = (self.coef - SHIFT).astype(np.uint8).tobytes()
        out: list[bytes | None] = []
        for img in self.images:
            at, size = img.planes[0].at * 64, img.comment[len(MARK) :]
            out.append(data[at : at + int(size)] if img.comment.startswith(MARK) and size.isdigit() else None)
        return out


_SCALE = 1 << 16


def _inverse() -> np.ndarray:
    """(64 frequencies, 64 samples) of the two-dimensional inverse transform, as integers."""
    x, u = np.arange(8), np.arange(8)[:, None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64) * _SCALE)


_INVERSE = _inverse()

# ---------------------------------------------------------------- columns


def _parts(sizes: list[int]):
    """Ranges of items of about PART bytes together."""
    at = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= PART:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


@pandas_udf(BinaryType())
def stored(texts: pd.Series) -> pd.Series:
    """A progressive JPEG that holds the text's UTF-8 bytes, padded. Null: as an empty text."""
    payloads = [padded((t or "").encode("utf-8", "surrogatepass")) for t in texts]
    out: list[bytes] = []
    for lo, hi in _parts([len(p) for p in payloads]):
        out += encode(payloads[lo:hi])
    return pd.Series(out)


def _read(files: list[bytes | None]) -> list[tuple[np.ndarray, Batch | None, int, str | None]]:
    """For each file its tensor, the batch and place in which it was read, and why it could not be. None: an empty tensor."""
    out: list[tuple[np.ndarray, Batch | None, int, str | None]] = [(np.zeros((0, 0, 3), np.uint8), None, 0, None)] * len(files)
    some = [i for i, m in enumerate(files) if m is not None]
    try:
        batch = Batch([files[i] for i in some])
        for k, (i, x) in enumerate(zip(some, batch.rgb(), strict=True)):
            out[i] = (x, batch, k, None)
    except (ValueError, IndexError, KeyError, struct.error) as e:
        if len(some) > 1:  # the others must not suffer
            for i in some:
                out[i] = _read([files[i]])[0]
        else:
            out[some[0]] = (*out[some[0]][:3], str(e) or type(e).__name__)
    return out


def _each(media: pd.Series):
    for lo, hi in _parts([len(m or b"") for m in media]):
        yield from _read([None if m is None else bytes(m) for m in media[lo:hi]])


_TENSOR = StructType([StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("rgb", BinaryType()), StructField("error", StringType())])


@pandas_udf(_TENSOR)
def tensor(media: pd.Series) -> pd.DataFrame:
    """Full-resolution RGB tensor (height, width, 3) of each file, row by row, and an error for what is no
    progressive JPEG or broken. Null, and files with an error: an empty tensor."""
    rows = [(*x.shape[:2], x.tobytes(), error) for x, _, _, error in _each(media)]
    return pd.DataFrame(rows, columns=[f.name for f in _TENSOR])


_READ = StructType(
    [StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("feature", StringType()), StructField("error", StringType())]
)


@pandas_udf(_READ)
def read_back(media: pd.Series) -> pd.DataFrame:
    """Digest of the stored payload, and a feature of the picture: its size, the sums of the channels, a checksum.

    All are null for null, and beside the error for what can't be read or holds no payload."""
    rows: list[tuple] = []
    held: dict[int, list[bytes]] = {}
    for x, batch, k, error in _each(media):
        if batch is None:
            rows.append((None, None, None, None, error))
            continue
        if id(batch) not in held:
            held = {id(batch): batch.payloads()}
        payload = held[id(batch)][k]
        if payload is None:
            rows.append((None, None, None, None, "no payload is stored in this file"))
            continue
        sums = ",".join(str(int(s)) for s in x.reshape(-1, 3).sum(0, dtype=np.int64))
        feature = f"{x.shape[1]}x{x.shape[0]}:{sums}:{zlib.crc32(np.ascontiguousarray(x)):08x}"
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature, None))
    out = pd.DataFrame(rows, columns=[f.name for f in _READ])
    return out.astype({"payload_bytes": "Int64", "tail_crc32": "Int64"})


def media_columns(docs: DataFrame, text: str = "text", media: str = "media", tensors: str = "tensor") -> DataFrame:
    """``docs`` with each text stored as a progressive JPEG in ``media`` and its RGB tensor, read back, in ``tensors``.

    Null and empty texts are 64 zero bytes; very long ones are one large picture; repeated rows are alike; an
    empty table stays empty. Columns of these names are replaced, all others stay."""
    common.small_batches(docs.sparkSession)
    return docs.withColumn(media, stored(F.col(text))).withColumn(tensors, tensor(F.col(media)))


def op3_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a progressive JPEG and read back: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null and empty texts are stored as 64 zero bytes with n_bytes 0; very long ones are one large picture; equal
    texts give equal rows; an empty table gives none."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    held = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), stored(F.col("text")).alias("media"))
    return held.select(
        "doc_id",
        "n_bytes",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        read_back(F.col("media")).alias("r"),
    ).select("doc_id", "n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32", "media_bytes", "media_sha256", "r.feature")
