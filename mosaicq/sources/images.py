"""Images as rows: small codecs for grey TIFF and PNG, and a data source over image folders."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IMAGE = "path string, page int, height int, width int, pixels binary"
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 16: 8}


def to_array(pixels: bytes, height: int, width: int) -> np.ndarray:
    """Pixels are little-endian unsigned 16-bit, row by row."""
    return np.frombuffer(pixels, "<u2").reshape(height, width)


def encode_tiff(image: np.ndarray) -> bytes:
    """One grey 16-bit page in one strip."""
    image = np.ascontiguousarray(image, "<u2")
    h, w = image.shape
    data = image.tobytes()
    entries = [(256, 4, w), (257, 4, h), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(data))]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + directory


def _unpacked_bits(raw: bytes) -> bytes:
    """Run lengths: n < 128 literal bytes follow n, n > 128 repeats the next one 257 - n times."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpacked_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, one short of a width's end; 256 starts anew, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = max(width, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


#: The format's numbers of ways to compress.
_UNPACK = {1: bytes, 5: _unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}


def decode_tiff(raw: bytes) -> list[np.ndarray]:
    """All pages of a grey TIFF of 8 or 16 bits: plain, LZW, Deflate or PackBits strips, with or without differences."""
    order = "<" if raw[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", raw, 2)
    if magic != 42:
        raise ValueError("not a classic TIFF file")
    pages = []
    while at:
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            size = _SIZES.get(kind, 0) * count
            where = at + 2 + 12 * k + 8
            if size > 4:
                (where,) = struct.unpack_from(order + "I", raw, where)
            if kind in (3, 4):
                tags[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", raw, where)
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
        unpack = _UNPACK.get(tags.get(259, (1,))[0])
        if unpack is None or tags.get(277, (1,))[0] != 1 or 273 not in tags:
            raise ValueError("only grey strips, plain or packed by LZW, Deflate or PackBits")
        depth = tags.get(258, (8,))[0]
        body = b"".join(unpack(raw[a : a + b]) for a, b in zip(tags[273], tags[279]))
        page = np.frombuffer(body, f"{order}u{depth // 8}").reshape(tags[257][0], tags[256][0])
        if tags.get(317, (1,))[0] == 2:  # each pixel as the difference from the one before
            page = np.cumsum(page, axis=1, dtype=page.dtype.newbyteorder("="))
        pages.append(page.astype("<u2"))
    return pages


_PNG = b"\x89PNG\r\n\x1a\n"


def encode_png(image: np.ndarray) -> bytes:
    """A grey PNG of 8 bits (uint8) or 16 bits."""
    depth = 8 if image.dtype == np.uint8 else 16
    rows = np.ascontiguousarray(image, ">u2" if depth == 16 else "u1")
    h, w = rows.shape
    plain = b"".join(b"\0" + r.tobytes() for r in rows)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(plain)) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """A grey PNG of 8 or 16 bits without interlacing."""
    at, body, head = len(_PNG), b"", None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        data = raw[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", data) if kind == b"IHDR" else head
        body += data if kind == b"IDAT" else b""
        at += 12 + size
    if raw[: len(_PNG)] != _PNG or head is None or head[2] not in (8, 16) or head[3] or head[6]:
        raise ValueError("only grey PNG of 8 or 16 bits without interlacing")
    w, h, step = head[0], head[1], head[2] // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w * step), np.int64)
    for y, line in enumerate(rows):
        how, now, up = line[0], line[1:].astype(np.int64), out[y]
        if how == 0:
            out[y + 1] = now
        elif how == 2:
            out[y + 1] = (now + up) % 256
        elif how == 1:
            out[y + 1] = (np.cumsum(now.reshape(-1, step), axis=0) % 256).ravel()
        else:
            for x in range(w * step):
                a, b, c = (out[y + 1, x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if how == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                out[y + 1, x] = (now[x] + guess) % 256
    found = out[1:].astype(np.uint8)
    return found if step == 1 else np.ascontiguousarray(found).view(">u2").astype("<u2")


def decode_image(raw: bytes) -> list[np.ndarray]:
    """Pages of a TIFF, or the one of a PNG."""
    return [decode_png(raw).astype("<u2")] if raw[: len(_PNG)] == _PNG else decode_tiff(raw)


def read_tiles(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """(path, page, height, width, pixels) of every page, decoded in Arrow batches."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = [(p, k, *page.shape, page.tobytes()) for p, raw in zip(frame["path"], frame["content"]) for k, page in enumerate(decode_image(raw))]
            yield pd.DataFrame(rows, columns=["path", "page", "height", "width", "pixels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, IMAGE)


def to_pixels(images: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: keys, y, x, value."""
    kinds = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        import pandas as pd

        for frame in batches:
            for row in frame.itertuples(index=False):
                a = to_array(row.pixels, row.height, row.width)
                y, x = np.indices(a.shape)
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "value": a.ravel().astype(np.int32)})

    return images.select(*keys, "height", "width", "pixels").mapInPandas(run, f"{kinds}, y int, x int, value int")


class TileSource(DataSource):
    """format('tiles'): pages of TIFF files in a folder, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return IMAGE

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


class TileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".tif", ".tiff", ".png"))]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.value) as f:
            for k, page in enumerate(decode_image(f.read())):
                yield (partition.value, k, page.shape[0], page.shape[1], page.tobytes())


def masks_to_rows(images: DataFrame, label: str = "label") -> DataFrame:
    """(label, row, col) of the true pixels of mask images."""
    px = to_pixels(images, [label]).where("value > 0")
    return px.select(label, F.col("y").alias("row"), F.col("x").alias("col"))
