"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's subwords are its character n-grams, hashed into buckets; a text is the mean of all its
subwords' embeddings, a linear layer and a softmax follow. Embeddings and layer are trained by
stochastic gradient descent in numpy, inside one task, on a bounded sample: at most ``per_language``
whole texts of each language, whatever the number of languages, chosen by a hash of the id. What that
task receives of a long text are its subword weights (at most one entry a bucket) and those of a few
short extracts, made where the text is: its memory is bounded by the sample's rows, not by their lengths. A
held-back part of the sample fits the softmax temperature (calibrated scores) and the score below
which an answer should be rejected; whole texts and short extracts take part in both.

As mean and layer are linear, a trained model is one row of class scores per bucket (a fixed size,
whatever the corpus), and a word's row is computed once and cached; prediction is one scan of whole
texts without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0 and not accepted;
rows of the held-out fold and rows without a language are never learned from; a null id counts as
the empty string in the fold; without any labelled row everything is ``und``; repeated rows are
predicted one by one; only the id, text and language columns are read.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.workspace import broadcast_if_few, materialise

UNKNOWN = "und"
#: Whole texts learned from, of each language: the bound of the sample.
PER_LANGUAGE = 1000
#: Short extracts learned from, of each text, and their most words.
EXTRACTS, EXTRACT_WORDS = 8, 12
#: In place of a bag's number: the text itself, where it is shorter than its bags.
WHOLE = -1
BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
#: Passes over the sample; a small sample is passed until so many texts, in all and of each class, were seen.
EPOCHS, LEAST_SEEN, LEAST_OF_CLASS, RATE = 4, 4000, 200, 2.0
CALIBRATION_SHARE = 0.2
#: Accepted answers of the calibration part are right in at least this share.
ACCEPT_PRECISION = 0.99
CACHED_WORDS, CHUNK_WORDS = 300_000, 100_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters; empty if there is no letter."""
    found = _WORD.findall(text.lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


def subwords(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of its word in found) of the n-grams of all words, their edges marked."""
    codes = np.frombuffer("".join(f"<{w}>" for w in found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(w) + 2 for w in found])
    buckets, owners = [], []
    for n in GRAMS:
        m = max(0, len(codes) - n + 1)
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _bag(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = np.unique(subwords(found)[0], return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


def _sums(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; ends[k] is where the k-th stretch ends."""
    total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


class Model:
    """Scores per bucket, classes, temperature and the least accepted score."""

    def __init__(self, classes: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, accept: float = 0.0):
        self.classes, self.table, self.bias, self.temperature, self.accept = classes, table, bias, temperature, accept
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.classes) + 1))

    def _learn(self, fresh: list[str]) -> None:
        """Remember the summed scores and the number of the subwords of words not seen yet."""
        buckets, owner = subwords(fresh)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(fresh))
        self.rows = np.concatenate([self.rows, np.column_stack([_sums(self.table[buckets[order]], np.cumsum(counts)), counts])])
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))

    def logits(self, bags: list[list[str]]) -> np.ndarray:
        """A row of class scores for each list of words, none of them empty."""
        if len(self.known) > CACHED_WORDS:
            self._reset()
        flat = [w for found in bags for w in found]
        if fresh := sorted(set(flat) - self.known.keys()):
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        total = _sums(self.rows[at], np.cumsum([len(found) for found in bags]))
        return total[:, :-1] / total[:, -1:] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(class, score, accepted) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
        where, bags, n = [], [], 0
        for i, text in enumerate(texts):
            found = words(text) if text and self.classes else []
            if found:
                where.append(i)
                bags.append(found)
                n += len(found)
            if bags and (n > CHUNK_WORDS or i + 1 == len(texts)):
                x = self.logits(bags) / self.temperature
                p = np.exp(x - x.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for j, k, best in zip(where, p.argmax(1), p.max(1)):
                    out[j] = self.classes[k], float(best), bool(best >= self.accept)
                where, bags, n = [], [], 0
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, classes=np.array(self.classes, dtype=np.str_), table=self.table, bias=self.bias, rest=np.array([self.temperature, self.accept]))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        z = np.load(io.BytesIO(raw), allow_pickle=False)
        return cls([str(x) for x in z["classes"]], z["table"], z["bias"], *map(float, z["rest"]))


@lru_cache(maxsize=2)
def _loaded(raw: bytes) -> Model:
    """A worker's model, with the words that it has met in earlier tasks."""
    return Model.load(raw)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def sample_bags(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags of a text with letters: of all of it, then of EXTRACTS short extracts; none without letters."""
    found = words(text)
    if not found:
        return []
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    starts, sizes = rng.integers(len(found), size=EXTRACTS), 1 + rng.integers(EXTRACT_WORDS, size=EXTRACTS)
    return [_bag(found), *(_bag(found[a : a + n]) for a, n in zip(starts, sizes))]


def fit(rows: list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]], seed: int = 0) -> Model:
    """Train on (language, bags of a text) rows; the same rows in the same order give the same model."""
    classes = sorted({lang for lang, _ in rows})
    if not classes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    number = {c: i for i, c in enumerate(classes)}
    rng = np.random.default_rng(seed)
    emb = (rng.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM
    layer, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    order = rng.permutation(len(rows))
    n_held = int(len(rows) * CALIBRATION_SHARE) if len(rows) >= 20 else 0
    held, train = order[:n_held], order[n_held:]
    epochs = max(EPOCHS, -(-max(LEAST_SEEN, LEAST_OF_CLASS * len(classes)) // max(1, len(train))))
    steps, step = epochs * len(train) * 2, 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            lang, bags = rows[i]
            k = number[lang]
            for ids, weight in (bags[0], bags[1 + int(rng.integers(EXTRACTS))]):
                rate = np.float32(RATE * (1 - step / steps))
                step += 1
                mean = weight @ emb[ids]
                g = _softmax(mean @ layer + bias).astype(np.float32)
                g[k] -= 1
                back = layer @ g
                layer -= rate * np.outer(mean, g)
                bias -= rate * np.float32(0.02) * g
                emb[ids] -= rate * weight[:, None] * back
    model = Model(classes, emb @ layer, bias.astype(np.float64))
    if n_held:
        pairs = [(bag, number[rows[i][0]]) for i in held for bag in rows[i][1][:2]]
        _calibrate(model, np.array([w @ model.table[ids] + model.bias for (ids, w), _ in pairs], np.float64), np.array([k for _, k in pairs]))
    return model


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Temperature of least log loss; least score above which answers are precise enough (scores x, classes y)."""

    def scores(t: float) -> np.ndarray:
        e = np.exp((x - x.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    model.temperature = float(min(np.geomspace(0.05, 500, 90), key=lambda t: -np.log(scores(t)[np.arange(len(y)), y] + 1e-12).sum()))
    p = scores(model.temperature)
    best, right = p.max(1), p.argmax(1) == y
    down = np.argsort(-best, kind="stable")
    precise = np.cumsum(right[down]) / np.arange(1, len(y) + 1) >= ACCEPT_PRECISION
    model.accept = float(best[down][np.nonzero(precise)[0].max()]) if precise.any() else 1.0


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, per_language: int = PER_LANGUAGE) -> bytes:
    """A model of the labelled rows outside the held-out fold, as bytes of a fixed size."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id")) != held_out))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # Rows are drawn by id and text, so that rows of one id, or without any, are drawn one by one; exactly repeated
    # rows are one. A little more than wanted is drawn, so that few texts are ordered; the window makes it exact.
    rows = rows.withColumn("draw", draw)
    counts = rows.select(F.col("lang").alias("of"), "draw").distinct().groupBy("of").agg(F.count("*").alias("n"))
    counts = broadcast_if_few(materialise(counts, "language-counts"))
    drawn = rows.join(counts, F.col("lang") == F.col("of")).where(F.col("draw") * F.col("n") < 1.3 * per_language + 20).dropDuplicates(["lang", "draw"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    sample = drawn.withColumn("nth", nth).where(F.col("nth") <= per_language).select("text", "lang", "nth")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang, nth in zip(*(c.to_pylist() for c in batch.columns)):
                raw, made = text.encode("utf-8", "surrogatepass"), sample_bags(text)
                if made and len(raw) <= 6 * sum(len(ids) for ids, _ in made):
                    out.append((lang, nth, WHOLE, raw, b""))
                else:
                    out += [(lang, nth, k, ids.astype("<u2").tobytes(), weight.astype("<f4").tobytes()) for k, (ids, weight) in enumerate(made)]
            cols = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["lang", "nth", "k", "ids", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple[str, int], list] = {}
        for b in batches:
            for lang, nth, k, ids, weight in zip(*(c.to_pylist() for c in b.columns)):
                if k == WHOLE:
                    texts[lang, nth] = list(enumerate(sample_bags(ids.decode("utf-8", "surrogatepass"))))
                else:
                    texts.setdefault((lang, nth), []).append((k, (np.frombuffer(ids, "<u2"), np.frombuffer(weight, "<f4"))))
        got = [(lang, [bag for _, bag in sorted(texts[lang, nth], key=lambda x: x[0])]) for lang, nth in sorted(texts)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(got).dump()], pa.binary())], names=["model"])

    whole = materialise(sample.mapInArrow(bags, "lang string, nth int, k int, ids binary, weight binary"), "language-sample")
    if whole.isEmpty():
        return fit([]).dump()
    return bytes(whole.repartition(1).mapInArrow(run, "model binary").first()["model"])


def predict(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, accepted of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(shared.value)
        for batch in batches:
            got = own.predict(batch.column(1).to_pylist())
            lang, score, accepted = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that never saw the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "accepted")
