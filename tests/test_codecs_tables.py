"""Image codecs against encoders written here, focus modes, table operators that can fail or rank."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicq.functions import kernels as K
from mosaicq.operators import images, spatial, tables
from mosaicq.sources import images as codec
from mosaicq.sources import readers


def lzw(data):
    """The format's variable-width codes, high bits first, a width ending one code early."""
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    following = 258
    for k in range(len(data)):
        byte = data[k : k + 1]
        if word + byte in table:
            word += byte
            continue
        put(table[word], width)
        table[word + byte] = following
        following += 1
        width = max(9, min(12, (following + 0).bit_length())) if following + 1 > 511 else 9
        if following >= 4094:
            put(256, width)
            table, width, following = {bytes([k]): k for k in range(256)}, 9, 258
        word = byte
    if word:
        put(table[word], width)
        following += 1
        width = max(9, min(12, following.bit_length())) if following + 1 > 511 else 9
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def packed_bits(data):
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while at + n < len(data) and data[at + n] == data[at] and n < 128:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            out += bytes([0, data[at]])
        at += n
    return bytes(out)


def tiff(body, shape, compression, predictor):
    h, w = shape
    entries = [(256, 4, w), (257, 4, h), (258, 3, 16), (259, 3, compression), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body)), (317, 3, predictor)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + directory


@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
def test_packed_tiff(compression, predictor):
    rng = np.random.default_rng(1)
    for a in (rng.integers(0, 60000, (37, 41)), rng.integers(0, 3, (60, 70)), np.zeros((50, 50), int)):
        a = a.astype("<u2")
        plain = a if predictor == 1 else np.diff(a, axis=1, prepend=a[:, :1] * 0).astype("<u2")
        body = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packed_bits}[compression](plain.tobytes())
        (got,) = codec.decode_tiff(tiff(body, a.shape, compression, predictor))
        assert (got == a).all()


def test_png_filters():
    rng = np.random.default_rng(2)
    for kind, step in (("u1", 1), (">u2", 2)):
        a = rng.integers(0, 200 if step == 1 else 60000, (25, 19)).astype(kind)
        assert (codec.decode_png(codec.encode_png(a.astype(np.uint8) if step == 1 else a.astype("<u2"))) == a).all()
        raw = np.frombuffer(a.tobytes(), np.uint8).reshape(25, -1).astype(int)
        lines = b""
        for y in range(25):
            up = raw[y - 1] if y else raw[0] * 0
            left, corner = (np.concatenate([np.zeros(step, int), r[:-step]]) for r in (raw[y], up))
            guess = [raw[y] * 0, left, up, (left + up) // 2, None][y % 5]
            if guess is None:
                p = left + up - corner
                d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
                guess = np.choose(d.argmin(0), [left, up, corner])
            lines += bytes([y % 5]) + ((raw[y] - guess) % 256).astype(np.uint8).tobytes()

        def chunk(name, body):
            return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 19, 25, 8 * step, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
        assert (codec.decode_png(png) == a).all()
    with pytest.raises(ValueError):
        codec.decode_tiff(tiff(b"", (1, 1), 7, 1))


def test_focus_modes(spark):
    sharp, flat = np.indices((20, 20)).sum(0) % 2 * 1000, np.full((20, 20), 500)
    rows = [(1, 1, "c", z, 20, 20, a.astype("<u2").tobytes()) for z, a in enumerate((flat, sharp, flat))]
    df = spark.createDataFrame(rows, "cycle int, tile int, channel string, z int, height int, width int, pixels binary")
    got = {m: np.frombuffer(images.focus_stacked(df, mode=m).first().pixels, "<u2").reshape(20, 20) for m in images.FOCUS}
    assert (got["sharpest"] == sharp).all() and (got["max"] == np.maximum(sharp, flat)).all() and set(np.unique(got["mean"])) == {333, 667}
    assert K.sharpest(np.stack([flat, sharp])).shape == (20, 20)


def test_missing_keys_raise(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, 10)], "k int, w int")
    assert tables.looked_up(left.where("k = 1"), right, "k").collect()[0].w == 10
    with pytest.raises(Exception, match="no row for k 2"):
        tables.looked_up(left, right, "k").collect()


def test_row_ids_are_dense(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(5000)]
    got = tables.with_row_ids(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.row_id)] == sorted(rows) and sorted(r.row_id for r in got) == list(range(5000))


def test_offsets_of_files_with_dots(spark):
    long = spark.createDataFrame([(1, "a.tif", -3, 12), (2, "b.c.tif", 0, 0)], "cycle int, file string, dy int, dx int")
    back = readers.offsets_long(readers.offsets_wide(long, ["a.tif", "b.c.tif"]))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_suppression_within_groups(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(40), rng.randrange(40), float(rng.randrange(9)), rng.choice("ab")) for i in range(400)]
    for group in ([], ["g"]):
        kept = []
        for i, y, x, s, g in sorted(rows, key=lambda r: (-r[3], r[0])):
            if not any((y - q) ** 2 + (x - p) ** 2 <= 9 and (not group or g == h) for _, q, p, _, h in kept):
                kept.append((i, y, x, s, g))
        got = spatial.suppress_within(spark.createDataFrame(rows, "id long, y int, x int, sum double, g string"), 3, group=group)
        assert sorted(r.id for r in got.collect()) == sorted(k[0] for k in kept)


def test_padded_and_pasted(spark):
    planes = spark.createDataFrame([(1, 1, "c", 0, 5), (1, 2, "c", 0, 6), (1, 2, "c", 1, 7)], "cycle int, tile int, channel string, z int, v int")
    assert sorted(((r.tile, r.z, r.v) for r in tables.padded_stacks(planes).collect()), key=str) == [(1, 0, None), (1, 1, 5), (2, 0, 6), (2, 1, 7)]
    px = spark.createDataFrame([(t, y, x, 10 * t) for t in (1, 2) for y in range(4) for x in range(6)], "tile int, y int, x int, value int")
    at = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 0, 4, 0, 1)], "tile int, y0 int, x0 int, grid_r int, grid_c int")
    got = {(r.y, r.x): r.value for r in tables.pasted(px, at, 4, 9, 4, 6, bleed=1).collect()}
    assert [got[0, x] for x in range(9)] == [10] * 5 + [20] * 4 and len(got) == 36


def mat_array(name, values, packed):
    """A version 5 matrix element; short names and data stand in their tags."""

    def element(kind, data):
        if len(data) <= 4:
            return struct.pack("<I", len(data) << 16 | kind) + data.ljust(4, b"\0")
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 1, len(values))) + element(1, name.encode())
    body += element(9, struct.pack(f"<{len(values)}d", *values)) if not packed else element(2, bytes(values))
    return struct.pack("<II", 14, len(body)) + body


def test_mat_files(spark, tmp_path):
    packed = zlib.compress(mat_array("a_longer_name", [1.5, -2.0], False))
    raw = b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack("<H2s", 0x0100, b"IM")
    raw += mat_array("x", [3.25], False) + struct.pack("<II", 15, len(packed)) + packed + mat_array("n", [7], True)
    assert readers.decode_mat(raw) == {"x": [3.25], "a_longer_name": [1.5, -2.0], "n": [7.0]}
    (tmp_path / "p.mat").write_bytes(raw)
    assert {r.name: list(r["values"]) for r in readers.read_mat(spark, f"file://{tmp_path}").collect()} == readers.decode_mat(raw)
