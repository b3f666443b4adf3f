"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (exact copies and reorderings of repeats are one row),
columns are n-grams, dealt out in blocks by their hash. Within a block, sorted by column, each column's
rows are multiplied with each other and the products of a pair are accumulated: its overlap count.
What the sizes of two sets demand bounds the work:

* ``need(n, m) = ceil(3 (n + m) / 7)`` shared n-grams are necessary for 100 * shared >= 75 * union, so
  only the first ``n - ceil(3 n / 4) + 1`` columns of a row enter the product (in an order of all
  columns in which frequent ones come last; any order is right, this one is fast);
* a pair is discarded if its accumulated overlap, with all it could share outside the columns
  accumulated, stays below its need, or if no shared column stands early enough in both rows;
* two sets differ in at least as many n-grams as their parity sketches differ in cells: a pair of a
  long column whose sketches differ in more cells than its need allows is discarded.

The pairs that remain are counted exactly on the whole sets. A column with many rows (a copied passage,
a large group of near copies) isn't squared: its rows are first linked to two leaders, then those outside
its largest component to members of that; what is one component then needs no further pair, and only
pairs between different components of a column are multiplied, the smaller ones against all. A row and
the place of the column in it bound the size of a similar set, so these meet by column and class of
sizes: unlike sets that share a passage are not paired. So components are exact without all pairs of a
group. Rows of sets with very many copies get their component where they are (a bounded broadcast).

N-grams and sets are 64-bit hashes: two given texts are confused with a chance of about 2^-64 a pair.

Defined results: null, empty and blank texts have no shingle and are linked with nothing; repeated
rows are exact copies; a null id counts last among a component's ids; only id and text are read; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicq.llm.components import components, heavy_from, with_each
from mosaicq.workspace import arrow_rows, materialise

SHINGLE = 5
#: Columns with up to so many rows are multiplied at once.
SHORT = 16
#: N-grams of a text chunk whose counts are looked at together, and the least count that is reported.
CHUNK_GRAMS, REPORT = 1 << 20, 2
#: The most frequent n-grams that the column order knows (a fixed size, 16 bytes each).
FREQUENT = 1 << 19
#: Longs of a set's sketch: the parity of its n-grams in each of so many times 64 cells.
SKETCH = 32
#: Bits of the filter of row ids whose sets are needed whole: so many an id, within these bounds.
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Sizes of a class are within this ratio.
CLASS_RATIO = 1.02
WORD_CACHE = 200_000
#: Rows of a batch of texts or of pairs with their whole sets: what a task holds of them at a time.
BATCH_ROWS = 2000
SEEN_NODES = 500_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


_SKETCH = [f"s{k}" for k in range(SKETCH)]


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORD_CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(raw: bytes, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of a shorter text, of the whole sequence."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(SHINGLE, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total += _mix(h[k : len(h) - size + 1 + k] + _MULT[k]) * _MULT[-1 - k]
    return np.unique(_mix(total))


def node_of(grams: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), len(grams))).astype(np.int64))


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """Parity of the n-grams of each cell, as SKETCH longs."""
    odd = np.bincount((grams >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_size(n):
    return n - (3 * n + 3) // 4 + 1


def need(n, m):
    return (3 * (n + m) + 6) // 7


def _sets(batches: Iterator[pa.RecordBatch], column: int):
    """(batch, [set of each row])."""
    hashes = _Hashes()
    for batch in batches:
        yield batch, [shingles(x.as_py() or b"", hashes) for x in batch.column(column).cast(pa.binary())]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def signatures(rows: DataFrame) -> DataFrame:
    """(id, n, node, sketch) of every row, and (gram, count) of n-grams that some chunk has repeatedly."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            grams, counts = grams[counts >= REPORT], counts[counts >= REPORT]
            held.clear()
            none = pa.nulls(len(grams), kind)
            empty = pa.nulls(len(grams), pa.int64())
            return pa.RecordBatch.from_arrays([none, empty, empty, pa.array(grams.astype(np.int64)), pa.array(counts, pa.int64()), *[empty] * SKETCH], names=names)

        names, kind = ["id", "n", "node", "gram", "count", *_SKETCH], None
        for batch, sets in _sets(batches, 1):
            kind = batch.column(0).type
            nodes = [node_of(s) if len(s) else None for s in sets]
            empty = pa.nulls(len(sets), pa.int64())
            sketches = np.array([sketch_of(s) for s in sets], np.int64).reshape(len(sets), SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), empty, empty, *[pa.array(sketches[:, k]) for k in range(SKETCH)]], names=names)
            for node, s in zip(nodes, sets):
                if node is not None and node not in seen:
                    if len(seen) > SEEN_NODES:
                        seen.clear()
                    seen.add(node)
                    held.append(s)
                    size += len(s)
                    if size >= CHUNK_GRAMS:
                        yield frequent()
                        size = 0
        if held:
            yield frequent()

    return rows.mapInArrow(run, f"id {id_type}, n long, node long, gram long, count long, " + ", ".join(f"{c} long" for c in _SKETCH))


def incidence(rows: DataFrame, grams: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(gram, node, size and place) of the first columns of every distinct set of a task."""
    shared = rows.sparkSession.sparkContext.broadcast((grams, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        seen: set[int] = set()
        for _, sets in _sets(batches, 1):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0
            for s in sets:
                node = node_of(s) if len(s) else None
                if node is None or node in seen:
                    continue
                if len(seen) > SEEN_NODES:
                    seen.clear()
                seen.add(node)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
                p = prefix_size(len(s))
                out.append((s[:p].astype(np.int64), np.full(p, node, np.int64), (np.int64(len(s)) << np.int64(32)) | np.arange(p, dtype=np.int64)))
                held += p
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["gram", "node", "meta"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["gram", "node", "meta"])

    return rows.mapInArrow(run, "gram long, node long, meta long")


def product(columns: DataFrame) -> DataFrame:
    """Multiply the columns of each block; columns of a block arrive sorted.

    Rows by kind: 'pair' (a, b, sizes x and y, shared columns k, ok if one stands early enough), 'long'
    (a row of a long column: gram, a, size x, place y) and 'node' (a, k shared columns of short ones).
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, node, meta = (np.zeros(0, np.int64) for _ in range(3))
        open_long = None
        for batch in batches:
            gram, node, meta = (np.concatenate([c, batch.column(k).to_numpy()]) for k, c in enumerate((gram, node, meta)))
            if not len(gram):
                continue
            tail = np.searchsorted(gram, gram[-1])
            if len(gram) - tail > 4 * SHORT + 4096:
                done = _multiply(gram, node, meta, (open_long, int(gram[-1])))
                open_long = int(gram[-1])
                gram, node, meta = (c[:0] for c in (gram, node, meta))
            else:
                done = _multiply(gram[:tail], node[:tail], meta[:tail], (open_long,))
                gram, node, meta = gram[tail:], node[tail:], meta[tail:]
            yield from done
        if len(gram):
            yield from _multiply(gram, node, meta, (open_long,))

    ordered = columns.repartition("gram").sortWithinPartitions("gram", "meta", "node")
    return ordered.mapInArrow(blocks, "kind string, gram long, a long, b long, x long, y long, k long, ok boolean")


def _table(kind: str, n: int, **cols: np.ndarray) -> pa.RecordBatch:
    empty = pa.nulls(n, pa.int64())
    arrays = [pa.array([kind] * n, pa.string()), *[pa.array(cols[c]) if c in cols else empty for c in ("gram", "a", "b", "x", "y", "k")], pa.array(cols["ok"]) if "ok" in cols else pa.nulls(n, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "gram", "a", "b", "x", "y", "k", "ok"])


def _multiply(gram: np.ndarray, node: np.ndarray, meta: np.ndarray, cut: tuple[int | None, ...]) -> Iterator[pa.RecordBatch]:
    """Products of whole columns (sorted); columns that arrive in parts (cut) are long."""
    if not len(gram):
        return
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])  # copies from different tasks are neighbours
    gram, node, meta = gram[fresh], node[fresh], meta[fresh]
    starts = np.nonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))[0]
    sizes = np.diff(np.append(starts, len(gram)))
    size = np.repeat(sizes, sizes)
    far = size > SHORT
    for whole in cut:
        if whole is not None:
            far |= gram == whole
    if far.any():
        yield _table("long", int(far.sum()), gram=gram[far], a=node[far], x=meta[far] >> 32, y=meta[far] & 0xFFFFFFFF)
    near = (size > 1) & ~far
    if not near.any():
        return
    gram, node, n, at = gram[near], node[near], meta[near] >> 32, meta[near] & 0xFFFFFFFF
    who, times = np.unique(node, return_counts=True)
    yield _table("node", len(who), a=who, k=times.astype(np.int64))
    parts = []
    for d in range(1, SHORT):
        same = np.nonzero(gram[d:] == gram[:-d])[0]
        if not len(same):
            break
        i, j = same, same + d
        fits = (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (node[i] != node[j])
        i, j = i[fits], j[fits]
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        early = np.minimum(n[i] - at[i], n[j] - at[j]) >= need(n[i], n[j])
        parts.append((node[i], node[j], n[i], n[j], early))
    if not parts:
        return
    a, b, x, y, ok = (np.concatenate(c) for c in zip(*parts))
    if not len(a):
        return
    order = np.lexsort((b, a))
    a, b, x, y, ok = a[order], b[order], x[order], y[order], ok[order]
    first = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))[0]
    k = np.diff(np.append(first, len(a)))
    yield _table("pair", len(first), a=a[first], b=b[first], x=x[first], y=y[first], k=k.astype(np.int64), ok=np.logical_or.reduceat(ok, first))


def _enough(k: Column, x: Column, y: Column) -> Column:
    """Whether k shared first columns leave the pair a chance: the rest of either set bounds the rest."""
    rest = F.greatest(x, y) * 3
    return k + F.floor((rest + 3) / 4) - 1 >= F.floor((3 * (x + y) + 6) / 7)


def _alike(x: Column, y: Column, left: str, right: str) -> Column:
    """Whether the sketches (columns with these prefixes) allow sets of sizes x and y to be similar."""
    cells = sum((F.bit_count(F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col(f"{left}{_SKETCH[0]}").bitwiseXOR(F.col(f"{right}{_SKETCH[0]}"))))
    return cells <= x + y - 2 * F.floor((3 * (x + y) + 6) / 7)


def size_class(n: Column) -> Column:
    """Classes of sizes (from 1) within CLASS_RATIO of each other."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS_RATIO))).cast("int")


def partner_classes(x: Column, y: Column) -> Column:
    """The classes of the sizes m that a set similar to one of x columns, which shares its column y first, can have.

    At most x - y columns are shared, at least 3 (x + m) / 7 must be; and m is within 3/4 and 4/3 of x.
    """
    low = F.ceil(x * 3 / 4).cast("long")
    high = F.least(F.floor(x * 4 / 3), F.floor((x - y) * 7 / 3) - x).cast("long")
    return F.when(high >= low, F.sequence(size_class(low), size_class(high))).otherwise(F.array().cast("array<int>"))


def whole_sets(rows: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(node, grams) of the wanted nodes, most or fewer: rows pass a filter by id.

    Few others pass it too, and a node may come twice (of repeated ids): neither does harm in a join
    whose result is a set of links, and so the sets are shuffled there alone.
    """
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ID * most).bit_length()))
    words = wanted.select(F.explode(F.array(*[_bit(F.col("id"), s, n_bits) for s in (1, 2)])).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("bits"))
    got = words.toArrow()
    table = np.zeros(n_bits // 64, np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = shared.value, _Hashes()
        seen: set[int] = set()
        for batch in batches:
            mask = np.ones(batch.num_rows, bool)
            for c in (1, 2):
                p = batch.column(c).to_numpy()
                mask &= (bits[p >> 6] >> (p & 63)) & 1 == 1
            nodes, grams = [], []
            for raw in batch.column(0).filter(pa.array(mask)).cast(pa.binary()):
                s = shingles(raw.as_py() or b"", hashes)
                node = node_of(s) if len(s) else None
                if node is not None and node not in seen:
                    if len(seen) > SEEN_NODES:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    grams.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(grams, pa.binary())], names=["node", "grams"])

    picked = rows.select("text", _bit(F.col("id"), 1, n_bits).alias("p"), _bit(F.col("id"), 2, n_bits).alias("q"))
    return picked.mapInArrow(run, "node long, grams binary")


def _bit(key: Column, seed: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), F.lit(n_bits))


def _grams(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a column, as views of its bytes."""
    for value in column:
        yield np.frombuffer(value.as_buffer(), np.uint64)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, with what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok, share = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
            for k, (p, q) in enumerate(zip(_grams(batch.column(2)), _grams(batch.column(3)))):
                at = np.searchsorted(p, q)
                share[k] = (p[np.minimum(at, len(p) - 1)] == q).sum()
                ok[k] = 7 * share[k] >= 3 * (len(p) + len(q))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(share[ok])], names=["a", "b", "shared"])

    n = pairs.count()
    right = _with_set(pairs.select("a", "b"), "b", "a", sets, "q", _parts(pairs, "b", n))
    return _with_set(right, "a", "b", sets, "p", _parts(pairs, "a", n)).select("a", "b", "p", "q").mapInArrow(run, "a long, b long, shared long")


def _parts(pairs: DataFrame, key: str, n: int) -> DataFrame:
    """(_h, _parts) of the nodes of very many pairs, at most MOST_HEAVY rows."""
    limit = heavy_from(n)
    parts = pairs.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= limit).select(F.col(key).alias("_h"), F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    return F.broadcast(parts)


def _with_set(pairs: DataFrame, key: str, other: str, sets: DataFrame, name: str, parts: DataFrame) -> DataFrame:
    """pairs with the set of the node in a column; a node of very many pairs meets them in parts, with a copy of its set each."""
    every = F.coalesce("_parts", F.lit(1))
    told = pairs.join(parts, F.col(key) == F.col("_h"), "left").withColumn("_part", F.pmod(F.xxhash64(other), every).cast("int")).drop("_h", "_parts")
    each = sets.join(parts, F.col("node") == F.col("_h"), "left").select(F.col("node").alias(key), F.col("grams").alias(name), F.explode(F.sequence(F.lit(0), every - 1)).alias("_part"))
    return told.join(each, [key, "_part"]).drop("_part")


def similar_sets(rows: DataFrame, sig: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes."""
    top = sig.where("gram is not null").groupBy("gram").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    grams, counts = top.column("gram").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(grams)
    blocks = materialise(product(incidence(rows, grams[order], counts[order])), "ngram-blocks")

    pairs = blocks.where("kind = 'pair'").groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.sum("k").alias("k"), F.max("ok").alias("ok")).where("ok")
    lengthy = blocks.where("kind = 'long'").select("gram", "a", "x", "y").distinct()
    n_long = lengthy.groupBy("a").agg(F.count("*").alias("n"))
    n_short = blocks.where("kind = 'node'").groupBy("a").agg(F.sum("k").alias("n"))
    n_any = n_long.unionByName(n_short).groupBy("a").agg(F.sum("n").alias("n"))

    def may_share(df: DataFrame, stats: DataFrame, k: Column | int) -> DataFrame:
        """Pairs (a, b, x, y) whose k accumulated columns, with the least that stats grants either, are enough."""
        left = stats.select(F.col("a"), F.col("n").alias("na"))
        right = stats.select(F.col("a").alias("b"), F.col("n").alias("nb"))
        more = F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))
        return df.join(left, "a", "left").join(right, "b", "left").where(_enough(more + k, F.col("x"), F.col("y"))).select("a", "b")

    def sized(x: str, y: str) -> Column:
        return F.least(x, y) * 4 >= F.greatest(x, y) * 3

    keyed = sig.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))

    near = may_share(pairs, n_long, F.col("k"))
    # What is joined to a long column's rows is written first: both sides are plain shuffles, which adaptive execution can split.
    ends = materialise(lengthy.groupBy("gram").agg(F.min(F.struct("a", "x")).alias("lo"), F.max(F.struct("a", "x")).alias("hi")), "ngram-ends")
    stars = lengthy.join(ends, "gram").select("a", "x", F.explode(F.array("lo", "hi")).alias("l")).where(F.col("a") != F.col("l.a"))
    stars = stars.select(F.least("a", "l.a").alias("a"), F.greatest("a", "l.a").alias("b"), "x", F.col("l.x").alias("y")).where(sized("x", "y"))
    stars = may_share(stars.groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y")), n_any, 0)
    first = materialise(near.unionByName(stars).distinct(), "ngram-pairs")

    def linked(some: DataFrame) -> DataFrame:
        """The similar ones of some pairs (a, b)."""
        nodes = some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct()
        return verified(some, materialise(whole_sets(rows, keyed.join(nodes, "node"), 2 * some.count()), "ngram-sets")).select("a", "b")

    labels = components(materialise(linked(first), "ngram-links"))
    if lengthy.isEmpty():
        return labels

    def more(labels: DataFrame, links: DataFrame) -> DataFrame:
        return components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    def open_rows(labels: DataFrame) -> DataFrame:
        """Rows of the long columns that hold several components c, with the largest one (major) and sketches."""
        told = lengthy.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("c", F.coalesce("component", "a")).drop("component")
        groups = told.groupBy("gram", "c").agg(F.count("*").alias("n")).groupBy("gram").agg(F.count("*").alias("groups"), F.max(F.struct("n", "c")).alias("m")).where("groups > 1")
        rows = told.join(materialise(groups.select("gram", F.col("m.c").alias("major")), "ngram-major"), "gram")
        nodes = rows.select(F.col("a").alias("node")).distinct()
        sketches = sig.where("node is not null").join(nodes, "node", "left_semi").select(F.col("node").alias("a"), *_SKETCH).dropDuplicates(["a"])
        return materialise(rows.join(sketches, "a"), "ngram-open")

    def renamed(rows: DataFrame, mark: str, cells: str) -> DataFrame:
        return rows.select("gram", *[F.col(k).alias(k + mark) for k in "axyc"], *[F.col(c).alias(cells + c) for c in _SKETCH])

    # One member of a column's largest component, another in every column, meets the rows outside it ...
    labels = materialise(labels, "ngram-labels")
    open_ = open_rows(labels)
    heads = open_.where("c = major").groupBy("gram").agg(F.max_by("a", F.xxhash64("a", "gram")).alias("a"))
    heads = renamed(open_.join(heads, ["gram", "a"], "left_semi"), "", "")
    few = renamed(open_.where("c <> major"), "1", "l")
    alike = sized("x", "x1") & _alike(F.col("x"), F.col("x1"), "l", "")
    pair = (F.least("a", "a1").alias("a"), F.greatest("a", "a1").alias("b"))
    tried = materialise(few.join(heads, "gram").where(alike).select(*pair).distinct().join(first, ["a", "b"], "left_anti"), "ngram-pairs")
    labels = materialise(more(labels, linked(tried)), "ngram-labels")
    # ... and then the components that are left in a column meet all of it. A similar pair's first shared
    # column stands early in both; in that one column it is enough to meet.
    open_ = open_rows(labels)
    few = renamed(open_.where("c <> major"), "1", "l")
    early = F.least(F.col("x") - F.col("y"), F.col("x1") - F.col("y1")) >= F.floor((3 * (F.col("x") + F.col("x1")) + 6) / 7)
    apart = (F.col("c1") != F.col("c")) & ((F.col("c") == F.col("major")) | (F.col("a1") < F.col("a")))
    few = few.withColumn("size", F.explode(partner_classes(F.col("x1"), F.col("y1"))))
    able = open_.withColumn("size", size_class(F.col("x"))).where(F.size(partner_classes(F.col("x"), F.col("y"))) > 0)
    rest = few.join(able, ["gram", "size"]).where(apart & early & alike).select(*pair).distinct()
    rest = materialise(rest.join(first.unionByName(tried), ["a", "b"], "left_anti"), "ngram-pairs")
    return labels if rest.isEmpty() else more(labels, linked(rest))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows = _rows(docs, id_col, text_col)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        sig = materialise(signatures(rows), "ngram-signatures")
        every = sig.where("gram is null").select("id", "n", "node")
        least = every.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        linked = similar_sets(rows, sig)
        merged = least.join(linked, "node")
        of_component = merged.groupBy("component").agg(F.min("least").alias("whole"))
        whole = merged.join(of_component, "component").select("node", "whole")
        names = materialise(least.join(whole, "node", "left").select("node", F.coalesce("whole", "least").alias("component_id"), "copies"), "ngram-names")
    found = with_each(every.where("node is not null"), "node", names, every.count(), "copies")
    out = found.unionByName(every.where("node is null").withColumn("component_id", F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], chr(31))) AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
e AS MATERIALIZED (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS component FROM documents UNION SELECT e.u, r.component FROM r JOIN e ON e.v = r.node AND r.component < e.u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id FROM (SELECT node AS doc_id, min(component) AS component FROM r GROUP BY node) LEFT JOIN n USING (doc_id)
"""
