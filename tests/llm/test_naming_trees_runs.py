"""Exact dedup by naming, Merkle manifests and periodic runs against plain versions, on odd rows too."""

import collections
import hashlib
import random
import zlib

import pytest

from mosaicq.llm import exact_dedup, merkle_manifest, periodic_runs

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def documents(spark, rows, **more):
    """rows (doc_id, source, text), with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, s, "en", len(t or ""), t, 1, "x") for i, s, t in rows], KIND + ", n long, name string")
    return df.repartition(4)


# ---------------------------------------------------------------- exact dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for i, _, text in rows:
        groups[lowered(text)].append(i)
    out = []
    for text, ids in groups.items():
        best, digest = max((i for i in ids if i is not None), default=None), hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, best, len(ids), i == best and first, digest))
            first = first and i != best
    return sorted(map(repr, out))


def odd_texts():
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "Beta", "gämma", "δ", "𝛼"]) for _ in range(3000))
    texts = ["", None, "One", "one", "ONE", "Éa", "éa", "a" * 64, "a" * 65, "A" * 64, long, long.upper(), long[:-1], "b" + long[1:], long[:700] + "#" + long[701:], "x" * 5000, "x" * 4999]
    rows = [(k, "s", t) for k, t in enumerate(texts * 2)]
    rows += [(500 + k, "s", "same text of many rows") for k in range(150)] + [(None, "s", "One"), (None, "s", "nobody's"), (None, "s", "nobody's")]
    rows += [(900, "s", "twice"), (900, "s", "Twice"), (900, "s", "not twice"), (901, "s", long)]
    rows += [(700, "s", "x" * 5000)] * 3
    return rows


@pytest.mark.parametrize("block_bytes", [16, 64, 1024])
def test_groups_of_equal_texts(spark, block_bytes):
    rows = odd_texts()
    got = exact_dedup.exact_groups(documents(spark, rows), block_bytes=block_bytes).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_groups(rows)


def test_names_stand_for_contents(spark):
    """Equal names, equal texts; names don't depend on partitions."""
    rows = odd_texts()
    docs = documents(spark, rows)
    seen = {}
    for df in (docs, docs.repartition(7), docs.coalesce(1)):
        got = {(r.id, bytes(r.digest)): (r.level, r.name, r.copies) for r in exact_dedup.identities(df, block_bytes=32).collect()}
        seen = seen or got
        assert got == seen
    assert len({v[:2] for v in seen.values()}) == len({d for _, d in seen}) == len({lowered(t) for *_, t in rows})
    assert sum(c for *_, c in seen.values()) == len(rows)


def test_rows_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_REPEATS", 4)
    rows = [(7, "s", "again")] * 23 + [(8, "s", "once"), (7, "s", "x" * 100)]
    got = exact_dedup.exact_groups(documents(spark, rows), block_bytes=16).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_groups(rows)


def test_no_rows_and_what_stays(spark):
    docs = documents(spark, odd_texts())
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    plain = documents(spark, [(k, "s", t) for k, t in enumerate(["a", "A", "b", None, "", "b"])])
    left = exact_dedup.without_copies(plain)
    assert left.columns == plain.columns and sorted(r.doc_id for r in left.collect()) == [1, 4, 5]


# ---------------------------------------------------------------- Merkle manifests


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i - i % 3
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    leaf = lambda *v: H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    groups = collections.defaultdict(list)
    for i, s, t in rows:
        values = (i, s, "en", len(t or ""))
        hit = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and t is not None
        groups["" if s is None else "+" + s].append((i, leaf(*values, t), leaf(*values, t.replace("\n", "")) if hit else leaf(*values, t)))
    names = sorted(groups, key=str.encode)
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: plain_levels([x[1] for x in groups[g]]) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for j, (i, node, bad) in enumerate(groups[g]):
            path = plain_path(trees[g], j) + plain_path(top, k)
            for a, b in path:
                bad = H(a + bad + b)
            out.append(repr((i, node, trees[g][-1][0], top[-1][0], H("".join(a + b for a, b in path)), bad, bad == top[-1][0])))
    return sorted(out)


def manifest_of(docs, tall=merkle_manifest.BLOCK_HEIGHT):
    from pyspark.sql import functions as F

    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest.manifest(merkle_manifest.leaves_of(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", even), tall)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_whole_trees(spark, height):
    """Small blocks make many layers; sizes around powers of three; null, empty and repeated rows."""
    rows, i = [], 0
    for s, n in (("a", 1), ("b", 3), ("é", 4), ("z", 27), (None, 28), ("+", 9), ("", 2), ("hot", 83)):
        for _ in range(n):
            rows.append((i, s, ["line\none\n", None, "", "flat", "é\n𝛼"][i % 5]))
            i += 1
    rows += [(5, "hot", "again\n")] * 40 + [(None, "hot", "no id\n"), (None, None, None), (3, "hot", "other"), (3, "hot", "text")]
    assert sorted(repr(tuple(r)) for r in manifest_of(documents(spark, rows), height).collect()) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert manifest_of(documents(spark, [(1, "s", "x")]).limit(0)).count() == 0
    rows = [(1, "s", "one\nonly")]
    assert sorted(repr(tuple(r)) for r in manifest_of(documents(spark, rows)).collect()) == plain_manifest(rows)


@pytest.mark.parametrize("tall", [1, 2, 3])
def test_traversal_gives_every_path_with_few_nodes(tall):
    for n in [*range(1, 30), 80, 81, 82, 243]:
        leaves = [H(str(k)) for k in range(n)]
        levels = plain_levels(leaves)
        height = merkle_manifest.height_of(n)
        assert height == len(levels) - 1 and merkle_manifest.block_root(leaves, height) == levels[-1][0]
        assert [list(p) for p in merkle_manifest.traversed(leaves, height, tall)] == [plain_path(levels, k) for k in range(n)]
        for k, path in enumerate(merkle_manifest.traversed(leaves, height, tall)):
            assert merkle_manifest.folded(leaves[k], path) == levels[-1][0]
    tree = merkle_manifest.Subtree(2, 2, 4, 243)
    for k in range(162, 243):
        tree.push(k, str(k))
    assert [len(x) for x in tree.nodes] == [9, 3] and not any(tree.runs)


def test_block_of_a_higher_tree_hashes_lone_nodes(spark):
    """The last block of a tree is as high as the others, though its last leaves stand alone."""
    levels = plain_levels([H(str(k)) for k in range(10)])
    assert merkle_manifest.block_root(levels[0][9:], 2) == levels[2][1]


# ---------------------------------------------------------------- periodic runs


def plain_runs(words):
    """Every period: stretches of words that equal those a period on, unless a smaller period explains them."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = text.encode().split() if text else []
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts_with_runs(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        words = []
        while len(words) < rng.choice((5, 30, 90)):
            root = [rng.choice("abc") * rng.choice((1, 2)) for _ in range(rng.randint(1, 7))]
            words += root * rng.choice((1, 1, 2, 4, 5, 9)) + root[: rng.randrange(len(root) + 1)]
        yield " ".join(words)


def test_runs_equal_plain_search():
    for text in texts_with_runs(400, 1):
        words = text.encode().split()
        assert periodic_runs.word_runs(words) == plain_runs(words)
    for letters in ("ab", "a", "abcd"):  # every short text of few words has many overlapping runs
        rng = random.Random(7)
        for _ in range(150):
            words = [rng.choice(letters).encode() for _ in range(rng.randint(0, 40))]
            assert periodic_runs.word_runs(words) == plain_runs(words)


def test_all_runs_without_cutting():
    """The scan itself finds every run of two periods, as the theorem on Lyndon roots has it."""
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(rng.choice((2, 3))) for _ in range(rng.randint(2, 40))]
        want = []
        for q in range(1, len(ids) // 2 + 1):
            i = 0
            while i + q < len(ids):
                j = i
                while j + q < len(ids) and ids[j] == ids[j + q]:
                    j += 1
                length = j + q - i
                if length >= 2 * q and j > i and not any(all(ids[k] == ids[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                    want.append((i, length, q))
                i = j + 1
        assert periodic_runs.runs_of(ids, 2, 2) == sorted(want, key=lambda r: (r[0], r[2]))


def test_colliding_hashes_do_no_harm(monkeypatch):
    """With a rolling hash that hardly tells words apart, the verification still gives exact runs."""
    monkeypatch.setattr(periodic_runs, "_PRIME", 3)
    monkeypatch.setattr(periodic_runs, "_PLAIN", 1)
    for text in texts_with_runs(60, 5):
        words = text.encode().split()
        assert periodic_runs.word_runs(words) == plain_runs(words)


def test_runs_of_odd_documents(spark):
    rows = [(k, "s", t) for k, t in enumerate(texts_with_runs(60, 2))]
    rows += [(100, "s", None), (101, "s", ""), (102, "s", " \n\t"), (None, "s", "a " * 9), (103, "s", "a\x0bb\x0ca\rb a b a b"), (103, "s", "é " * 6), (104, "s", "x y " * 7), (105, "s", "one two"), (105, "s", "one two")]
    rows += [(106, "s", "a " * 30_000), (107, "s", " ".join(str(k % 997) for k in range(20_000)))]
    got = {(r.doc_id, r.collapsed_sha256): tuple(r) for r in periodic_runs.periodic_runs(documents(spark, rows), alter=True).collect()}
    for i, _, text in rows:
        if i not in (106, 107):
            want = plain_row(i, text)
            assert got[i, want[-1]] == want
    assert [v[1:6] for k, v in got.items() if k[0] == 106 and zlib.crc32(b"106") % 10] in ([], [(1, 0, 30_000, 1, 30_000_000)])
    assert [v[1:6] for k, v in got.items() if k[0] == 107 and zlib.crc32(b"107") % 10] in ([], [(1, 0, 20_000, 997, 20060)])
    assert periodic_runs.periodic_runs(documents(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(documents(spark, rows), periods=2)


def test_query_of_runs_equals_plain_rows(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in periodic_runs.op13_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        if len((text or "").split()) <= 500:
            assert got[i] == plain_row(i, text)
    assert sum(r[1] > 0 for r in got.values()) > 5
