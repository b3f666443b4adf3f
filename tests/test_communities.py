"""Communities against a plain sequential method, the gain of a move against modularity itself, and weights of neighbours."""

import math
import random
from collections import defaultdict

import numpy as np

from mosaicq.operators import communities as C


def plain_modularity(edges, label, resolution=1.0):
    m2, inside, k = 0.0, 0.0, defaultdict(float)
    for a, b, w in edges:
        m2 += 2 * w
        inside += 2 * w * (label[a] == label[b])
        k[label[a]] += w
        k[label[b]] += w
    return inside / m2 - resolution * sum(x * x for x in k.values()) / m2**2


def plain_leiden(edges, seed=0):
    """One machine: queues of single moves, greedy refinement, contraction."""
    rng = random.Random(seed)
    near, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
        k[a] += w
        k[b] += w
    m2 = sum(k.values())
    label, member = {v: v for v in k}, {v: v for v in k}
    while True:
        total = defaultdict(float)
        for v in k:
            total[label[v]] += k[v]
        todo = list(k)
        rng.shuffle(todo)
        while todo:
            v = todo.pop()
            total[label[v]] -= k[v]
            w = defaultdict(float)
            for u, x in near[v].items():
                w[label[u]] += x
            best = max([label[v], *sorted(w)], key=lambda c: w[c] - k[v] * total[c] / m2)
            if w[best] - k[v] * total[best] / m2 > w[label[v]] - k[v] * total[label[v]] / m2 + 1e-12:
                label[v] = best
                todo = [u for u in near[v] if label[u] != best] + todo
            total[label[v]] += k[v]
        part, strength, alone = {v: v for v in k}, dict(k), set(k)
        for v in sorted(k):
            if v not in alone:
                continue
            w = defaultdict(float)
            for u, x in near[v].items():
                if label[u] == label[v]:
                    w[part[u]] += x
            gains = {p: x - k[v] * strength[p] / m2 for p, x in w.items() if p != v}
            if gains and max(gains.values()) > 1e-12:
                p = max(sorted(gains), key=gains.get)
                part[v] = p
                strength[p] += k[v]
                alone -= {v, p}
        if len(set(part.values())) == len(k):
            return {v: label[u] for v, u in member.items()}
        member = {v: part[u] for v, u in member.items()}
        label = {part[v]: label[v] for v in k}
        smaller = defaultdict(lambda: defaultdict(float))
        for a in near:
            for b, w in near[a].items():
                if part[a] != part[b]:
                    smaller[part[a]][part[b]] += w
        k2 = defaultdict(float)
        for v in k:
            k2[part[v]] += k[v]
        near, k = smaller, k2


def block_graph(sizes, inside, between, seed):
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return [(i, j, float(rng.integers(1, 4))) for i in range(len(of)) for j in range(i + 1, len(of)) if rng.random() < (inside if of[i] == of[j] else between)]


def test_modularity_and_connectedness(spark):
    edges = block_graph([90, 50, 30, 20, 10], 0.3, 0.03, 5)
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {r.node: r.community for r in C.leiden(df).collect()}
    assert set(got) == {v for e in edges for v in e[:2]}
    ours, plain = plain_modularity(edges, got), max(plain_modularity(edges, plain_leiden(edges, s)) for s in range(3))
    assert ours >= 0.99 * plain
    told = C.modularity(df, spark.createDataFrame(list(got.items()), "node long, community long")).first()[0]
    assert abs(told - ours) < 1e-9
    for c in set(got.values()):
        inner = {v for v in got if got[v] == c}
        seen, todo = {min(inner)}, [min(inner)]
        assert min(inner) == c
        while todo:
            v = todo.pop()
            for a, b, _ in edges:
                u = b if a == v else a if b == v else None
                if u in inner and u not in seen:
                    seen.add(u)
                    todo.append(u)
        assert seen == inner


def test_gain_is_the_change_of_modularity(spark):
    edges = block_graph([6, 5, 4], 0.8, 0.2, 9)
    label = {v: v % 4 for e in edges for v in e[:2]}
    m2 = 2 * sum(w for *_, w in edges)
    k = defaultdict(float)
    for a, b, w in edges:
        k[a] += w
        k[b] += w
    rows, want = [], {}
    for v in label:
        rest = {u: c for u, c in label.items() if u != v}
        for c in set(rest.values()):
            to = sum(w for a, b, w in edges if v in (a, b) and rest.get(b if a == v else a) == c)
            rows.append((v, c, float(to), k[v], float(sum(k[u] for u in rest if rest[u] == c))))
            want[v, c] = (plain_modularity(edges, {**label, v: c}) - plain_modularity(edges, {**label, v: -1})) * m2 / 2
    df = spark.createDataFrame(rows, "v long, c long, w double, k double, kc double")
    for r in df.select("v", "c", C.move_gain(df["w"], df["k"], df["kc"], 1.0, float(m2)).alias("g")).collect():
        assert abs(r.g - want[r.v, r.c]) < 1e-9


def test_edges_given_twice_loops_and_none(spark):
    kind = "src long, dst long, weight double"
    assert C.leiden(spark.createDataFrame([], kind)).collect() == []
    edges = [(1, 2, 1.0), (2, 1, 1.0), (3, 3, 5.0), (4, 5, 2.0)]
    assert {r.node: r.community for r in C.leiden(spark.createDataFrame(edges, kind)).collect()} == {1: 1, 2: 1, 4: 4, 5: 4}


def test_fuzzy_weights(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(30, 3))
    rows = []
    for i in range(30):
        d2 = ((points - points[i]) ** 2).sum(1)
        rows += [(i, int(j), float(d2[j])) for j in np.argsort(d2)[1:7]]
    rows += [(100, 101, 0.0), (100, 102, 0.0)]
    one = {}
    for i in {r[0] for r in rows}:
        near = [(j, math.sqrt(d)) for s, j, d in rows if s == i]
        rho = min((d for _, d in near if d > 0), default=0.0)
        mean, lo, hi = sum(d for _, d in near) / len(near), 0.0, 1000 * (max(d for _, d in near) + 1e-9)
        weight = lambda d, s: math.exp(-(d - rho) / s) if d > rho else 1.0
        for _ in range(64):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(weight(d, mid) for _, d in near) > math.log2(len(near)) else (mid, hi)
        for j, d in near:
            one[i, j] = weight(d, max((lo + hi) / 2, 1e-3 * mean, 1e-300))
    got = {(r.src, r.dst): r.weight for r in C.fuzzy_weights(spark.createDataFrame(rows, "src long, dst long, d2 double")).collect()}
    assert set(got) == set(one) | {(b, a) for a, b in one}
    for (a, b), w in got.items():
        x, y = one.get((a, b), 0.0), one.get((b, a), 0.0)
        assert abs(w - (x + y - x * y)) < 1e-9
