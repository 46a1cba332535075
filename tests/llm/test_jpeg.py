import hashlib
import struct
import zlib

import numpy as np
import pytest

from curatrix.llm import jpeg
from tests.llm import cases


def test_payloads_come_back():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 64 * n).astype(np.uint8).tobytes() for n in (1, 2, 5, 6, 7, 60, 97, 1500)]
    payloads += [b"\xff" * 640, b"\0" * 6400, b"plain text " * 640]
    files = jpeg.encode(payloads)
    batch = jpeg.Batch(files)
    assert batch.payloads() == payloads
    assert [jpeg.Batch([f]).payloads()[0] for f in files] == payloads
    for a, b in zip(batch.rgb(), [jpeg.Batch([f]).rgb()[0] for f in files], strict=True):
        assert (a == b).all()


def test_very_long_payload_is_wide():
    p = bytes(range(256)) * 4 * 1700
    f = jpeg.encode([p])
    batch = jpeg.Batch(f)
    assert batch.images[0].width == 32 and batch.payloads() == [p]


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        if n:
            self.s += f"{value:0{n}b}"

    def bytes(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")


def code(table, out, symbol):
    out.put(*table[symbol])


def amount(v):
    v = int(v)
    s = abs(v).bit_length()
    return s, v if v >= 0 else v + (1 << s) - 1


def plain_scan(blocks, ss, se, high, low, table):
    """A one-block-at-a-time writer of AC scans for any coefficients, with runs of block ends."""
    out, ends, held = Bits(), 0, ""

    def flush():
        nonlocal ends, held
        if ends:
            r = ends.bit_length() - 1
            code(table, out, r << 4)
            out.put(ends - (1 << r), r)
            out.s += held
            ends, held = 0, ""

    for b in blocks:
        v = [int(np.sign(x)) * (abs(int(x)) >> low) for x in b]
        new = [k for k in range(ss, se + 1) if (abs(v[k]) == 1 if high else v[k])]
        last, run, bits = (new[-1] if new else -1), 0, ""
        for k in range(ss, se + 1):
            if high and abs(v[k]) > 1:
                bits += str(abs(v[k]) & 1)
                continue
            if not v[k]:
                run += 1
                if run == 16 and k < last:
                    flush()
                    code(table, out, 0xF0)
                    out.s += bits
                    run, bits = 0, ""
                continue
            flush()
            if high:
                code(table, out, run << 4 | 1)
                out.s += "1" if v[k] > 0 else "0"
            else:
                s, x = amount(v[k])
                code(table, out, run << 4 | s)
                out.put(x, s)
            out.s += bits
            run, bits = 0, ""
        if run or bits:
            ends += 1
            held += bits
            if ends == 300:
                flush()
    flush()
    return out.bytes()


@pytest.mark.parametrize("density", [0.02, 0.3, 0.9])
def test_any_coefficients(density):
    """Zero runs, block-end runs, signs and newly significant coefficients, against a plain writer."""
    rng = np.random.default_rng(int(density * 100))
    width, height = 40, 24
    n = 15
    c = (rng.integers(-60, 61, (n, 64)) * (rng.random((n, 64)) < density)).astype(int)
    symbols = sorted({r << 4 | s for r in range(16) for s in range(8)} | {r << 4 for r in range(15)})
    table = jpeg._table(symbols, [9] * len(symbols))
    dc_table = jpeg._table(list(range(10)), [4] * 10)
    dc, before = Bits(), 0
    for b in c:
        s, x = amount((b[0] >> 1) - before)
        before = b[0] >> 1
        code(dc_table, dc, s)
        dc.put(x, s)
    bit = Bits()
    for b in c:
        bit.put(int(b[0]) & 1, 1)

    def seg(m, body):
        return bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body

    quant = rng.integers(1, 9, 64).astype(np.uint8)
    file = b"\xff\xd8" + seg(0xDB, b"\0" + quant.tobytes()) + seg(0xC2, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    file += seg(0xC4, jpeg._segment(0, dc_table) + jpeg._segment(0x10, table))
    for ss, se, high, low, data in (
        (0, 0, 0, 1, dc.bytes()),
        (1, 5, 0, 2, plain_scan(c, 1, 5, 0, 2, table)),
        (6, 63, 0, 2, plain_scan(c, 6, 63, 0, 2, table)),
        (1, 63, 2, 1, plain_scan(c, 1, 63, 2, 1, table)),
        (0, 0, 1, 0, bit.bytes()),
        (1, 63, 1, 0, plain_scan(c, 1, 63, 1, 0, table)),
    ):
        file += seg(0xDA, bytes([1, 1, 0, ss, se, high << 4 | low])) + data
    batch = jpeg.Batch([file + b"\xff\xd9"])
    assert (batch.coef.reshape(n, 64) == c).all()
    image = batch.rgb()[0]
    assert image.shape == (height, width, 3)
    # the first block by the textbook formula
    f = np.zeros(64)
    f[jpeg.ZIGZAG] = c[0] * quant
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    want = np.clip(np.rint(basis.T @ f.reshape(8, 8) @ basis) + 128, 0, 255)
    assert np.abs(image[:8, :8, 0] - want).max() <= 1


def textbook(block):
    """Samples of a block of coefficients in zigzag order."""
    f = np.zeros(64)
    f[jpeg.ZIGZAG] = block
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.clip(np.floor(basis.T @ f.reshape(8, 8) @ basis + 0.5) + 128, 0, 255)


def colours(y, cb, cr):
    return np.clip(np.rint(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)), 0, 255)


def test_colours_of_a_stored_payload():
    """The picture worked out from the bytes by the formulas: byte k of a block is coefficient k, chroma at half size."""
    rng = np.random.default_rng(3)
    payload = rng.integers(0, 256, 64 * 6).astype(np.uint8)
    blocks = [textbook(b.astype(int) + jpeg.SHIFT) for b in payload.reshape(6, 64)]
    y = np.block([[blocks[0], blocks[1]], [blocks[2], blocks[3]]])
    cb, cr = (np.kron(b, np.ones((2, 2))) for b in blocks[4:])
    image = jpeg.Batch(jpeg.encode([payload.tobytes()])).rgb()[0]
    assert image.shape == (16, 16, 3)
    assert np.abs(image - colours(y, cb, cr)).max() <= 2  # samples may differ by one


@pytest.mark.parametrize("restart", [0, 2])
def test_interleaved_scans_of_a_colour_picture(restart):
    """20 by 12 points, 4:2:0, DC of all three planes in one scan with its own tables, as common encoders write it."""
    rng = np.random.default_rng(8 + restart)
    width, height = 20, 12
    planes = {1: (3, 2, rng.integers(-60, 61, (2, 4))), 2: (2, 1, rng.integers(-60, 61, (1, 2))), 3: (2, 1, rng.integers(-60, 61, (1, 2)))}
    tables = {0: jpeg._table(list(range(10)), [4] * 10), 1: jpeg._table([3, 4, 5, 6, 7, 8, 0, 1, 2, 9], [2, 3, 3, 4, 5, 6, 7, 8, 9, 10])}
    order = [(1, 2 * r + v, 2 * m + h) for r in range(1) for m in range(2) for v in range(2) for h in range(2)]
    macros = [[(1, v, 2 * m + h) for v in range(2) for h in range(2)] + [(2, 0, m), (3, 0, m)] for m in range(2)]
    assert len(order) == 8

    def seg(m, body):
        return bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body

    first, later, before = [Bits()], [Bits()], {1: 0, 2: 0, 3: 0}
    for i, macro in enumerate(macros):
        if restart and i and i % (restart // 2) == 0:
            first.append(Bits()), later.append(Bits())
            before = {1: 0, 2: 0, 3: 0}
        for plane, row, col in macro:
            v = int(planes[plane][2][row, col])
            s, x = amount((v >> 1) - before[plane])
            before[plane] = v >> 1
            code(tables[min(plane - 1, 1)], first[-1], s)
            first[-1].put(x, s)
            later[-1].put(v & 1, 1)

    def data(parts):
        out = parts[0].bytes()
        for i, p in enumerate(parts[1:]):
            out += bytes([0xFF, 0xD0 + i % 8]) + p.bytes()
        return out

    file = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    file += seg(0xC4, jpeg._segment(0, tables[0]) + jpeg._segment(1, tables[1])) + (seg(0xDD, struct.pack(">H", restart // 2)) if restart else b"")
    file += seg(0xDA, bytes([3, 1, 0x00, 2, 0x10, 3, 0x10, 0, 0, 0x01])) + data(first) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])) + data(later) + b"\xff\xd9"
    image = jpeg.Batch([file]).rgb()[0]

    def samples(plane):
        return np.block([[textbook([v] + [0] * 63) for v in row] for row in planes[plane][2]])

    want = colours(samples(1), np.kron(samples(2), np.ones((2, 2))), np.kron(samples(3), np.ones((2, 2))))[:height, :width]
    assert image.shape == (height, width, 3) and np.abs(image - want).max() <= 2


def test_bad_media_are_rows_with_an_error(spark):
    good = jpeg.encode([jpeg.padded(b"some text")])[0]
    bad = [b"", b"no jpeg", good[:-2], good[:200], good[:40], b"\xff\xd8\xff\xd9", good.replace(b"\xff\xc2", b"\xff\xc0", 1), b"\xff\xd8" + bytes(range(256))]
    rng = np.random.default_rng(1)
    for _ in range(40):
        x = bytearray(good)
        for k in rng.integers(2, len(x), 3):
            x[k] = int(rng.integers(256))
        jpeg._read([bytes(x), good])  # never fails
    df = spark.createDataFrame([(i, m) for i, m in enumerate([good, None, *bad, good])], "i int, m binary")
    rows = df.select("i", jpeg.tensor("m").alias("t"), jpeg.read_back("m").alias("r")).orderBy("i").collect()
    assert [r.t.error is None and r.t.height > 0 for r in rows] == [True, False] + [False] * len(bad) + [True]
    assert all(r.t.error and r.r.error for r in rows[2:-1]) and rows[1].t.error is None and rows[1].t.rgb == b""
    assert rows[0].r.payload_bytes == rows[-1].r.payload_bytes == 64


def test_media_columns(spark):
    docs = cases.docs(spark)
    out = jpeg.media_columns(docs)
    rows = out.collect()
    assert len(rows) == len(cases.ROWS) and set(docs.columns) < set(out.columns)
    assert all(r.tensor.error is None and len(r.tensor.rgb) == r.tensor.height * r.tensor.width * 3 > 0 for r in rows)
    assert jpeg.media_columns(cases.docs(spark, [])).count() == 0


def test_documents(spark, small):
    text = dict(cases.texts(small))
    for r in jpeg.op3_progressive_jpeg(spark, small).collect():
        raw = text[r.doc_id].encode()
        p = jpeg.padded(raw)
        media = jpeg.encode([p])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_edge_rows(spark, tmp_path):
    cases.docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = jpeg.op3_progressive_jpeg(spark, str(tmp_path)).collect()
    assert len(rows) == len(cases.ROWS)
    assert {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {64}
    tensors = cases.docs(spark).select(jpeg.tensor(jpeg.stored("text")).alias("t")).select("t.*").collect()
    assert all(len(t.rgb) == t.height * t.width * 3 for t in tensors)
    with pytest.raises(ValueError):
        jpeg.Batch([b"no jpeg"])
