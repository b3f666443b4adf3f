"""Benchmark decontamination: a BM25 inverted index of test items, queried by every passage.

Impacts are BM25 weights divided by the item's score for its own text, so one threshold in (0, 1] fits
all items. Items are numbered so that alike ones are neighbours and form blocks; each term keeps the
largest impact of each block, at two widths. Passages are overlapping windows of words, every one a
query: its bounds (the block maxima of its words, over wide and then over narrow blocks) are summed
for all windows of a batch at once, and where some block's bound reaches the threshold, block-max
WAND over the postings finds every item at or above it. What is found is verified: the words of the item that lie in 5-word shingles of the window,
as shares of its question and of its answer.

The index is built of bounded shards of items, by tasks, as files in the shared folder; document
frequencies and lengths are counted over all items first. Documents are read once, however many shards
there are: a task numbers the words of a slice of bounded bytes and passes these numbers through one
shard after the other, a few of which it keeps loaded. Documents are never shuffled, so frequent leaks, sources or
copies cannot overload a task.

Defined results: null and empty texts hold no item, items without words are never found; repeated
items and rows are reported one by one; ids of any type; without items nothing is found; a text's other
columns are not read by ``find`` and come back unchanged from ``without_leaks``.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicq.llm.shared_files import open_shared
from mosaicq.workspace import fresh_path, materialise

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.4
SHINGLE = 5
STRIDE = 32
SHARD_ITEMS, WIDE_BLOCKS, NARROW_BLOCKS = 2048, 25, 256
CHUNK_WORDS = 100_000
#: Shards that a task keeps loaded.
LOADED_SHARDS = 4
#: Bytes of texts whose words are numbered together.
SLICE_BYTES = 4 << 20
#: The same where shards are loaded anew for each slice: loading one must be little beside searching it.
RELOAD_BYTES = 32 << 20
_MARKS = (re.compile("answer:", re.IGNORECASE | re.ASCII), re.compile(r"\?"))

#: Digits and letters stay, A-Z are lower-cased, bytes of non-ASCII letters stay, the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return [w for w in raw.translate(_TABLE).split(b" ") if w]


def split_item(text: str) -> int:
    """How many words of an item are its question: up to the last question mark or answer mark, else two thirds."""
    n = len(words_of(text.encode()))
    for mark in _MARKS:
        at = max((m.start() for m in mark.finditer(text)), default=-1)
        if at >= 0 and 0 < (head := len(words_of(text[: at + 1].encode()))) < n:
            return head
    return max(1, n - n // 3)


class Batch:
    """Texts as numbers of their words, which are numbered in order of appearance."""

    def __init__(self, texts: list[bytes]):
        numbers: dict[bytes, int] = {}
        self.rows = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int32) for t in texts]
        self.words = list(numbers)


class Index:
    """Postings of one shard with block maxima, which are made anew when it is unpickled."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_length: float):
        rows = [(key, words_of(text.encode()), split_item(text)) for key, text in items]
        rows = [r for r in rows if r[1]]
        rows.sort(key=lambda r: (max(sorted(set(r[1])), key=lambda w: df.get(w, 1)), r[1]))
        self.keys = [r[0] for r in rows]
        self.words = [r[1] for r in rows]
        self.n_question = [r[2] for r in rows]
        self.block = max(1, -(-len(rows) // NARROW_BLOCKS))
        self.longest = max((len(w) for w in self.words), default=0)
        self.vocab: dict[bytes, int] = {}
        self.postings: list[list[tuple[int, float]]] = []
        for i, found in enumerate(self.words):
            tf: dict[bytes, int] = {}
            for w in found:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(found) / mean_length)
            weight = {w: math.log(1 + (n_items - df.get(w, 1) + 0.5) / (df.get(w, 1) + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                term = self.vocab.setdefault(w, len(self.postings))
                if term == len(self.postings):
                    self.postings.append([])
                self.postings[term].append((i, x / own))
        self._bound()

    def _bound(self) -> None:
        """The largest impacts of each term: in narrow blocks, in wide ones, in all."""
        n_blocks = max(1, -(-len(self.keys) // self.block))
        self.block_max = np.zeros((len(self.postings) + 1, n_blocks), np.float32)
        sizes = [len(p) for p in self.postings]
        if sizes:
            item, impact = (np.array(c) for c in zip(*(e for p in self.postings for e in p)))
            np.maximum.at(self.block_max, (np.repeat(np.arange(len(sizes)), sizes), item // self.block), impact.astype(np.float32))
        per_wide = -(-n_blocks // WIDE_BLOCKS)
        self.wide_max = np.maximum.reduceat(self.block_max, np.arange(0, n_blocks, per_wide), axis=1)
        self.list_max = [max(x for _, x in p) for p in self.postings]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("block_max", "wide_max", "list_max")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._bound()

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items at or above the threshold: block-max WAND, document at a time."""
        end = len(self.keys)
        lists = [self.postings[t] for t in terms]
        cursors = [[p[0][0], k, 0] for k, p in enumerate(lists)]  # item, list, position
        out = []

        def advance(cursor: list[int], item: int) -> None:
            entries, at = lists[cursor[1]], cursor[2]
            while at < len(entries) and entries[at][0] < item:
                at += 1
            cursor[2], cursor[0] = at, entries[at][0] if at < len(entries) else end

        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for n, (item, k, _) in enumerate(cursors):
                if item == end:
                    break
                bound += self.list_max[terms[k]]
                if bound >= threshold - 1e-9:
                    pivot = n
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum(float(self.block_max[terms[c[1]], block]) for c in cursors[: pivot + 1]) < threshold - 1e-6:
                target = min((block + 1) * self.block, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                for c in cursors[: pivot + 1]:
                    advance(c, max(target, item + 1))
            elif cursors[0][0] == item:
                score = sum(lists[c[1]][c[2]][1] for c in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    out.append((item, score))
                for c in cursors[: pivot + 1]:
                    advance(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    advance(c, item)

    def overlap(self, item: int, window: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and the answer's words inside shingles of the window."""
        own, size = self.words[item], min(SHINGLE, len(self.words[item]))
        there = {tuple(window[i : i + size]) for i in range(len(window) - size + 1)}
        covered = [False] * len(own)
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in there:
                covered[i : i + size] = [True] * size
        q = self.n_question[item]
        question, answer = covered[:q], covered[q:]
        return sum(question) / len(question), sum(answer) / len(answer) if answer else 1.0

    def search(self, batch: Batch, threshold: float) -> list[list[tuple[int, float, int, int]]]:
        """For each text, (item, score, first word, words) of every window and item at or above the threshold."""
        out: list[list[tuple[int, float, int, int]]] = []
        none = len(self.postings)
        terms = np.array([self.vocab.get(w, none) for w in batch.words], np.int32)
        at = 0
        while at < len(batch.rows):
            group, n = [], 0
            while at < len(batch.rows) and (not group or n < CHUNK_WORDS):
                group.append(terms[batch.rows[at]])
                n += len(group[-1])
                at += 1
            out += self._search(group, threshold)
        return out

    def _search(self, group: list[np.ndarray], threshold: float) -> list[list[tuple[int, float, int, int]]]:
        none = len(self.postings)
        span = -(-self.longest // STRIDE) + 1
        segments = [-(-len(g) // STRIDE) for g in group]
        first = np.concatenate([[0], np.cumsum(segments)]).astype(np.int64)
        found: list[list[tuple[int, float, int, int]]] = [[] for _ in group]
        if not first[-1]:
            return found
        ids = np.full(first[-1] * STRIDE, none, np.int32)
        for g, s in zip(group, first):
            ids[s * STRIDE : s * STRIDE + len(g)] = g
        # A word counts once a segment; sums of each segment, then of each window of segments inside its text.
        rows = np.sort(ids.reshape(-1, STRIDE), axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
        sums = np.zeros((first[-1] + 1, self.wide_max.shape[1]), np.float64)
        step = 512
        for a in range(0, len(rows), step):
            sums[a + 1 : a + step + 1] = self.wide_max[rows[a : a + step]].sum(1)
        np.cumsum(sums, axis=0, out=sums)
        owner = np.repeat(np.arange(len(group)), segments)
        starts = np.arange(first[-1])
        ends = np.minimum(starts + span, first[owner + 1])
        likely = np.nonzero((sums[ends] - sums[starts]).max(1) >= threshold - 1e-4)[0]
        for a in range(0, len(likely), 128):
            some = likely[a : a + 128]
            at = some[:, None] + np.arange(span)
            bags = np.where(at[:, :, None] < ends[some][:, None, None], rows[np.minimum(at, len(rows) - 1)], none).reshape(len(some), -1)
            bags.sort(axis=1)
            bags[:, 1:][bags[:, 1:] == bags[:, :-1]] = none
            bounds = self.block_max[bags].sum(1).max(1)
            for s, bag in zip(some[bounds >= threshold - 1e-4], bags[bounds >= threshold - 1e-4]):
                doc = int(owner[s])
                hits = self.retrieve([int(t) for t in bag if t != none], threshold)
                lo = (int(s) - int(first[doc])) * STRIDE
                found[doc] += [(item, score, lo, min(int(ends[s] - s) * STRIDE, len(group[doc]) - lo)) for item, score in hits]
        return found

    def leaks(self, batch: Batch, threshold: float) -> list[list[tuple[int, float, float, float, int, int]]]:
        """For each text, the verified items: (item, score, question and answer shares, window), best window each."""
        out = []
        for row, hits in zip(batch.rows, self.search(batch, threshold)):
            best: dict[int, tuple[int, float, float, float, int, int]] = {}
            for item, score, lo, n in hits:
                q, a = self.overlap(item, [batch.words[w] for w in row[lo : lo + n]])
                found = (item, score, q, a, lo, n)
                if q >= QUESTION_SHARE and a >= ANSWER_SHARE and (item not in best or (q + a, score) > (best[item][2] + best[item][3], best[item][1])):
                    best[item] = found
            out.append([best[i] for i in sorted(best)])
        return out


@lru_cache(maxsize=LOADED_SHARDS)
def _loaded(uri: str) -> tuple[Index, pa.Array]:
    """A shard and its items' ids."""
    with open_shared(uri) as f:
        index = pickle.loads(f.read())
    return index, pa.array(index.keys, index.key_type)


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_items: int = SHARD_ITEMS) -> list[str]:
    """The files of the indexes of about shard_items items each, with statistics over all items."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bare = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bag = F.array_distinct(F.filter(F.split(bare, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""))
    length = F.size(F.filter(F.split(bare, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""))
    rows = materialise(rows.where(length > 0).withColumns({"n": length, "row": F.monotonically_increasing_id()}), "decontam-items")
    n_items, mean = rows.agg(F.count("*"), F.avg("n")).first()
    if not n_items:
        return []
    words = rows.select("row", F.explode(bag).alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    counts = words.join(df, "word").groupBy("row").agg(F.collect_list("word").alias("words"), F.collect_list("df").alias("dfs"))
    parts = -(-n_items // shard_items)
    folder = fresh_path(items.sparkSession, "decontam-index")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[dict]] = {}
        names, key_type = [], None
        for batch in batches:
            key_type = batch.schema.field("id").type
            for r in batch.to_pylist():
                found.setdefault(r["shard"], []).append(r)
        for part in found.values():
            part.sort(key=lambda r: (r["text"], str(r["id"])))
            known = {w.encode(): n for r in part for w, n in zip(r["words"], r["dfs"])}
            index = Index([(r["id"], r["text"]) for r in part], known, n_items, mean)
            index.key_type = key_type
            names.append(f"{folder}/{uuid.uuid4().hex}")
            with open_shared(names[-1], write=True) as f:
                f.write(pickle.dumps(index))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    shard = F.pmod(F.xxhash64("text", "row"), F.lit(parts))
    dealt = rows.join(counts, "row").withColumn("shard", shard).select("shard", "id", "text", "words", "dfs").repartition(parts, "shard")
    files = materialise(dealt.mapInArrow(build, "file string"), "decontam-shards")
    return sorted(r["file"] for r in files.collect())


def _slices(column: pa.Array, n_shards: int) -> Iterator[tuple[int, Batch]]:
    """(first row, texts) of a column in parts of bounded bytes, larger ones if the shards can't all stay loaded."""
    most = SLICE_BYTES if n_shards <= LOADED_SHARDS else RELOAD_BYTES
    texts, at, held = [], 0, 0
    for row, raw in enumerate(column.cast(pa.binary())):
        texts.append(raw.as_py() or b"")
        held += len(texts[-1])
        if held >= most:
            yield at, Batch(texts)
            texts, at, held = [], row + 1, 0
    if texts:
        yield at, Batch(texts)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row for each text and item it holds: scores, shares and the window in words."""
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {id_type}, item {item_type}, score double, question_overlap double, answer_overlap double, first_word long, n_words long"
    files = shards(items, item_col, shard_items=shard_items)
    if not files:
        return docs.sparkSession.createDataFrame([], schema).withColumnsRenamed({"id": id_col, "item": item_col})
    kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column(1), len(files)):
                for file in files:
                    index, keys = _loaded(file)
                    found = [(first + i, *row) for i, some in enumerate(index.leaks(texts, threshold)) for row in some]
                    if found:
                        at, item, *rest = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(at, pa.int64())), keys.take(pa.array(item, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds))],
                            names=["id", "item", "score", "question_overlap", "answer_overlap", "first_word", "n_words"],
                        )

    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of docs that hold no item, columns unchanged."""
    at = docs.columns.index(text_col)
    files = shards(items, item_col, shard_items=shard_items)
    if not files:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for first, texts in _slices(batch.column(at), len(files)):
                for file in files:
                    clean[first : first + len(texts.rows)] &= [not found for found in _loaded(file)[0].leaks(texts, threshold)]
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
