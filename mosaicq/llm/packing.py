"""Best-fit packing: bounded-space online best-fit of token pieces into sequences.

A fixed number of bins is open. A bitset (one integer) has a bit for every free space that some open
bin offers; the lowest bit at or above a piece's length names the best fit. When one bin too many is
open, the fullest closes. A task packs a block of pieces in decreasing order of length (Spark sorts
and spills), so what it holds is the open bins alone, however long the block.

Texts are tokenised once, the pieces' sizes and checksums go to a table in the shared folder, and only
these small rows are dealt out: evenly, by no key, so no source, text or copy can overload a task.

Defined results: null and empty texts become the single end id; the string of an added token of the
vocabulary is that token; repeated rows are packed one by one
(``row`` tells them apart); only id and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicq.workspace import materialise

CAPACITY = 2048
END_ID = 0
#: Fixed value: the token that byte_bpe_50k.json adds to its ranks, with its id.
ADDED_TOKENS = {"<|endoftext|>": 50256}
#: Bins open at a time in a task.
OPEN_BINS = 4096
#: Pieces that one task packs, and pieces of a batch: the long ones of a batch must find their bins open.
BLOCK, BATCH = 1 << 16, 1 << 13


def default_ranks() -> str:
    """The byte-level vocabulary as ranks; its ids, with ADDED_TOKENS, equal those of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoder(ranks_path: str, pattern: str | None = None, added: dict[str, int] = ADDED_TOKENS):
    """A function from text to ids, over a file of base64 tokens and ranks; added tokens are split off first."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    found = tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return partial(found.encode, allowed_special=set(added), disallowed_special=())


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones, after a first one that may be shorter."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(a, capacity) for a in range(head, n, capacity)]


class BestFit:
    """Bounded-space online best-fit over integer sizes."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, first_id: int = 0):
        self.capacity, self.limit, self.next = capacity, open_bins, first_id
        self.spaces = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces ^= 1 << free
        self.n_open -= 1
        return found

    def _put(self, free: int, name: int) -> None:
        if not self.bins[free]:
            self.spaces |= 1 << free
        self.bins[free].append(name)
        self.n_open += 1

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of this size, at most the capacity."""
        fits = self.spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            free, name = self.capacity, self.next
            self.next += 1
        if free > size:
            self._put(free - size, name)
            if self.n_open > self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
        return name, self.capacity - free


def tokenise(docs: DataFrame, id_col: str, text_col: str, capacity: int, ranks_path: str) -> DataFrame:
    """(row, id, piece, start, length, ids_crc32) of every piece."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(ranks_path)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(END_ID)
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "row", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"id {id_type}, row long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, block: int = BLOCK, batch: int = BATCH, ranks_path: str | None = None) -> DataFrame:
    """Every piece of every row with its sequence and its place there."""
    pieces = materialise(tokenise(docs, id_col, text_col, capacity, ranks_path or default_ranks()), "packing-pieces")
    n = pieces.count()
    parts = max(1, -(-n // block))
    batches_each = max(1, -(-n // (parts * batch)))
    schema = f"{pieces.schema.simpleString()[7:-1].replace(':', ' ')}, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins, first_id=TaskContext.get().partitionId() << 40)
        for rows in batches:
            places = [bins.place(n) for n in rows.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([s for s, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())],
                names=[*rows.schema.names, "sequence_id", "offset"],
            )

    turn = F.pmod(F.xxhash64("row", "piece"), F.lit(batches_each))
    dealt = pieces.repartition(parts).sortWithinPartitions(turn, F.desc("length"), "row", "piece")
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
