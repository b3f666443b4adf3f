import itertools
import random

from pyspark.sql import functions as F

from mosaicq.llm import components, ngram_join


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[top(j)] = top(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(k, least.get(top(i), k))
    return sorted((k, len(sets[i]), least[top(i)]) for i, (k, _) in enumerate(rows))


def run(spark, rows):
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def test_groups_passages_and_chains(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, base, passage = [], text(120), text(60)
    rows += [" ".join(edited(rng, base, 0.02)) for _ in range(70)]  # many pairs on either side of the limit
    rows += [" ".join(base)] * 30
    rows += [" ".join([*text(30), *passage, *text(10)]) for _ in range(60)]  # a shared passage is no copy
    rows += [" ".join([*text(rng.randrange(4, 14)), *passage]) for _ in range(40)]
    chain = text(100)
    for _ in range(25):  # each like the next, ends unlike
        chain = [*chain[6:], *text(6)]
        rows.append(" ".join(chain))
    rows += [" ".join(text(rng.randrange(1, 9))) for _ in range(30)]
    rows += ["A b\tc", "a B c", "a b c d", "", None, " \n", "x", "X"]
    docs = [(i * 7 + 3, t) for i, t in enumerate(rows)]
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "ONE two three four five six"), (4, None)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.component_id, r.n_shingles) for r in got) == [(1, 2), (1, 2), (1, 2), (4, 0)]
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 300), (300, 200)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    found = {r.node: r.component for r in got.collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[k] == 100 for k in range(100, 150)) and found[300] == 200
    assert got.select(F.count_distinct("node") == F.count("*")).first()[0]


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x")], "doc_id long, text string, node long, gram string")
    assert [tuple(r) for r in ngram_join.near_duplicates(docs).collect()] == [(1, 2, 1)]


def test_a_passage_of_unlike_texts_forms_no_pairs(spark):
    """Own words before a passage: too little is shared from the passage's first column on, whatever the size."""
    for own in (10, 12, 15):
        n = 56 + own
        assert spark.range(1).select(ngram_join.partner_classes(F.lit(n), F.lit(own)).alias("c")).where(F.array_contains("c", ngram_join.size_class(F.lit(n)))).isEmpty() == (own > 9)
    got = spark.range(1).select(*[ngram_join.partner_classes(F.lit(x), F.lit(y)).alias(f"c{x}_{y}") for x in (1, 2, 7, 40, 1000) for y in (0, 1, 3, 200)], *[ngram_join.size_class(F.lit(m)).alias(f"s{m}") for m in range(1, 1400)]).first()
    for x in (1, 2, 7, 40, 1000):
        for y in (0, 1, 3, 200):
            able = {m for m in range(1, 1400) if 4 * min(m, x) >= 3 * max(m, x) and x - y >= ngram_join.need(x, m)}
            assert all(got[f"s{m}"] in got[f"c{x}_{y}"] for m in able)


def test_passages_in_texts_of_many_sizes(spark):
    rng = random.Random(21)
    words = lambda n, of="w": [f"{of}{rng.randrange(9000)}" for _ in range(n)]
    passage = words(60, "p")
    rows = [" ".join([*words(rng.randrange(0, 26)), *passage[rng.randrange(6) :], *words(rng.randrange(0, 5))]) for _ in range(260)]
    docs = [(i, t) for i, t in enumerate(rows)]
    assert run(spark, docs) == brute(docs)


def test_heavy_keys_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(components, "HEAVY_ROWS", 4)  # of the copies of a set
    rng = random.Random(22)
    base = [f"w{rng.randrange(9000)}" for _ in range(40_000)]
    rows = ["same text of a few words here"] * 30 + ["other text"] * 3 + [" ".join(base), " ".join(edited(rng, base, 0.01)), " ".join(edited(rng, base, 0.2))]
    docs = [(i + 5, t) for i, t in enumerate(rows)] + [(1, None)]
    assert run(spark, docs) == brute(docs)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(20)] + [(30, 110)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 81 and {r.component for r in got} == {0}
