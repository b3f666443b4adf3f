"""Maximal periodic runs of words by Lyndon roots.

Every run has a Lyndon root that is the longest Lyndon word at its start under one of two opposite orders
of the words. A stack of such words is kept while a text is scanned right to left, once an order: the
word at i grows over its right neighbours as long as the suffix at i is smaller than theirs. Suffixes are
compared, and roots extended to both sides, by longest common extensions: a few words one by one, then a
binary search over rolling hashes, whose answer is verified word by word; no suffix array.

A text is cut first where no wanted run can be: inside a run of at least max(6, 4 * period) words every
five consecutive words stand again elsewhere in the text, so the scan takes only the stretches of words
whose fives recur. A text is one row and is scanned in its task; nothing is shuffled.

Defined results: null and empty texts have no words and no runs; a null id alters nothing; repeated rows
are answered one by one; only the id and text columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Fives recur in every run of LEAST_WORDS words and LEAST_PERIODS periods: length >= 2 * period + 4.
_FIVE = 5
#: Words compared one by one before the binary search.
_PLAIN = 8
# A Mersenne prime and a base below it for the rolling hash of words, an odd factor for hashes of fives.
_PRIME, _BASE, _ODD = (1 << 61) - 1, 1_000_003_000_019, 0x9E3779B97F4A7C15


class Words:
    """A text as numbers, with longest common extensions."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.array = np.array(ids, np.int64)
        self.prefix = list(accumulate(ids, lambda h, w: (h * _BASE + w + 1) % _PRIME, initial=0))
        self.power = list(accumulate(range(self.n), lambda p, _: p * _BASE % _PRIME, initial=1))

    def _equal(self, i: int, j: int, length: int) -> bool:
        h, p = self.prefix, self.power[length]
        return (h[i + length] - h[i] * p - h[j + length] + h[j] * p) % _PRIME == 0

    def right(self, i: int, j: int) -> int:
        """Equal words from i and from j > i on."""
        ids, most = self.ids, self.n - j
        k, plain = 0, min(most, _PLAIN)
        while k < plain and ids[i + k] == ids[j + k]:
            k += 1
        if k < plain or k == most:
            return k
        low, high = k, most
        while low < high:
            mid = (low + high + 1) >> 1
            if self._equal(i, j, mid):
                low = mid
            else:
                high = mid - 1
        return self._verified(self.array[i : i + low], self.array[j : j + low], low)

    def left(self, i: int, j: int) -> int:
        """Equal words before i and before j > i."""
        ids = self.ids
        k, plain = 0, min(i, _PLAIN)
        while k < plain and ids[i - 1 - k] == ids[j - 1 - k]:
            k += 1
        if k < plain or k == i:
            return k
        low, high = k, i
        while low < high:
            mid = (low + high + 1) >> 1
            if self._equal(i - mid, j - mid, mid):
                low = mid
            else:
                high = mid - 1
        return self._verified(self.array[i - low : i][::-1], self.array[j - low : j][::-1], low)

    @staticmethod
    def _verified(a: np.ndarray, b: np.ndarray, length: int) -> int:
        """The length, if the words are equal so far; else where hashes were equal and words are not."""
        same = a == b
        return length if same.all() else int(same.argmin())


def runs_of(ids: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least max(least, periods * period) words, by start and period."""
    words, n = Words(ids), len(ids)
    found: set[tuple[int, int, int]] = set()
    last: dict[int, tuple[int, int]] = {}  # the verified run of a period that was met last
    for sign in (1, -1):
        last.clear()
        after = [0] * (n + 1)  # where the longest Lyndon word ends
        for i in range(n - 1, -1, -1):
            j, own = i + 1, ids[i]
            while j < n:
                other = ids[j]
                if own == other:
                    start, end = last.get(j - i, (n, 0))
                    same = end - j if start <= i and j < end else words.right(i, j)
                    if j + same >= n:
                        break  # the suffix at j ends first and is smaller
                    smaller = (ids[i + same] - ids[j + same]) * sign < 0
                else:
                    smaller = (own - other) * sign < 0
                if not smaller:
                    break
                j = after[j]
            after[i] = j
            if j < n and own == ids[j]:
                period = j - i
                start, end = last.get(period, (n, 0))
                if start <= i and j < end:
                    continue
                end = j + words.right(i, j)
                start = i - words.left(i, j)
                if end - start >= 2 * period:
                    last[period] = (start, end)
                    if end - start >= max(least, periods * period):
                        found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words in which every five stand again elsewhere; equal words have equal keys."""
    n = len(keys) - _FIVE + 1
    if n < 2:
        return []
    fives = np.zeros(n, np.uint64)
    odd = np.uint64(_ODD)
    for k in range(_FIVE):
        fives = (fives ^ (fives >> np.uint64(29))) * odd + keys[k : k + n]
    order = np.sort(fives)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.searchsorted(twice, fives)
    again = twice[np.minimum(at, len(twice) - 1)] == fives
    edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    return [(int(a), int(b) + _FIVE - 1) for a, b in zip(edges[::2], edges[1::2])]


def word_runs(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """runs_of a list of words; least and periods are at least the module's, on which the cutting rests."""
    if len(words) < least:
        return []
    keys = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for a, b in stretches(keys):
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        out += [(a + start, length, period) for start, length, period in runs_of(ids, least, periods)]
    return out


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a stretch repeated to the end, where the id's checksum asks for it."""
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = words
    if runs:
        stays = np.ones(len(words), bool)
        for s, length, p in runs:
            stays[s + p : s + length] = False
        kept = [words[i] for i in np.flatnonzero(stays)]
    best: tuple = (None,) * 4
    for s, length, p in runs:  # by start, then period: only a greater exponent replaces
        if best[0] is None or length * best[2] > best[1] * p:
            best = (s, length, p, 1000 * length // p)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_KINDS = [pa.int64()] * 5 + [pa.string()] * 2


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: bool = False, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(id_col, number of runs, the one of the greatest exponent, digests of all runs and of the text without repeats) of every row."""
    if least < LEAST_WORDS or periods < LEAST_PERIODS:
        raise ValueError(f"runs have at least {LEAST_WORDS} words and {LEAST_PERIODS} periods")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if alter:
                    words = altered(words, key.as_py())
                out.append(described(words, word_runs(words, least, periods)))
            columns = zip(*out) if out else ((),) * len(_KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], names=["id", *(c.split()[0] for c in _COLUMNS.split(", "))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, {_COLUMNS}").withColumnRenamed("id", id_col)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of them altered by their id's checksum."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), alter=True)
