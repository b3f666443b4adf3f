"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table (a skippable frame of
compressed and plain sizes, count, descriptor and magic number), and an index maps each record to
(bundle, frame, offset in the plain frame). A record is read by its frame alone.

Equal payloads (SHA-1 and length) are stored once: the smallest page id is the response, the others
revisit it. Digests are counted on rows without payloads, so a payload that a third of all pages
share costs small rows only; the pages themselves are shuffled once, by (id, digest), which spreads
evenly. Tasks write bundles of their own attempt into the shared folder and return index rows, which
are committed as a table: what a lost attempt left behind is never read.

Defined results: null payload is empty; a null id never becomes the response of a group that has an
id; exact repeats of a response (same id and payload) are responses too; only id, url and payload
columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicq.llm.shared_files import open_shared
from mosaicq.workspace import fresh_path, materialise

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3

# Fixed values of the seekable format and of RFC 4648.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_RESERVED = re.compile(r"[%<>\x00-\x20\x7f]")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 5 hexadecimal digits are 4 letters."""
    hexed = F.sha1(payload)

    def group(i: Column) -> Column:
        v = F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), F.call_function("shiftright", v, F.lit(s)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[group(F.lit(i)) for i in range(8)])


class Bundle:
    """Writes one bundle: frames of records, then the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.open = bytearray()
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of the record."""
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self._flush()
        at = len(self.frames), len(self.open), len(record)
        self.open += record
        self.size += len(record)
        return at

    def _flush(self) -> None:
        packed = self.zip.compress(bytes(self.open))
        self.stream.write(packed)
        self.frames.append((len(packed), len(self.open)))
        self.open.clear()

    def close(self) -> None:
        if self.open:
            self._flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class Reader:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        file.seek(size - 9 - count * width)
        table = file.read(count * width)
        self.places, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.places.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            at, packed, plain = self.places[number]
            self.file.seek(at)
            self.last = number, self.unzip.decompress(self.file.read(packed), max_output_size=plain)
        return self.last[1]


def _escaped(m: re.Match) -> str:
    return f"%{ord(m[0]):02X}"


def _uri(text: str) -> str:
    """An address without what could end its header."""
    return _CONTROL.sub(_escaped, text)


def _name(text: str) -> str:
    """An id as part of an urn, from which it can be read back."""
    return _RESERVED.sub(_escaped, text)


def encode_record(page: str, url: str, digest: str, n_bytes: int, first: str | None, payload: bytes) -> bytes:
    """One WARC 1.1 record; first names the response that a revisit refers to."""
    kind = "response" if first is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_name(page)}>", f"WARC-Target-URI: {_uri(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_name(first)}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload); a response's payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    payload = rest[: int(headers["Content-Length"])]
    if headers["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f"sha1:{found}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return headers, payload


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record a row; returns the index: record, bundle, frame, offset, length."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    light = rows.select("id", "digest", "n_bytes").distinct()
    firsts = light.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.min("id").alias("first"))
    roles = light.join(firsts, ["digest", "n_bytes"]).where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    roles = roles.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("n_bytes").alias("r_bytes"), F.col("first").cast("string").alias("first"))
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")) & (F.col("n_bytes") == F.col("r_bytes"))
    told = rows.join(roles, same, "left").select("page", "url", "digest", "n_bytes", "first", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        bundle, name, n = None, "", 0
        for batch in batches:
            out = []
            for page, url, digest, n_bytes, first, body in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    name, n = f"{folder}/bundle-{own}-{n:04d}.warc.zst", n + 1
                    bundle = Bundle(open_shared(name, write=True), frame_bytes)
                out.append((page, name, *bundle.add(encode_record(page or "", url, digest, n_bytes, first, body or b""))))
                if bundle.size >= bundle_bytes:
                    bundle.close()
                    bundle = None
            page, where, frame, offset, length = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.string()), pa.array(where, pa.string()), pa.array(frame, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["record", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return materialise(told.mapInArrow(run, "record string, bundle string, frame long, offset long, length long"), "warc-index")


def read_archive(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the index, read from its frame: headers as columns, and the payload."""
    spark = index.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, index.select("bundle").distinct().count() // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 + with_payload)]
            for bundle, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if bundle != name:
                    if reader:
                        reader.file.close()
                    name, reader = bundle, Reader(open_shared(bundle))
                head, payload = decode_record(reader.frame(frame)[offset : offset + length])
                refers = head.get("WARC-Refers-To")
                values = (unquote(head["WARC-Record-ID"][10:-1]) or None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"], refers and unquote(refers[10:-1]), payload)
                for col, v in zip(cols, values):
                    col.append(v)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            names = ["record", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: len(cols)])
        if reader:
            reader.file.close()

    schema = "record string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    return index.repartition(parts, "bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, schema)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages and read the archives back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archive(pages, fresh_path(spark, "warc"))
    return read_archive(index, with_payload=False).select(F.col("record").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
e AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST(('0x' || substr(x, CAST((i // 4) * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
