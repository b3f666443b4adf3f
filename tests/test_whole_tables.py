"""Queries that must read every row and use their operators' defaults, against DuckDB over whole tables and plain Python."""

import duckdb
import numpy as np
import pytest

from mosaicq.operators import spatial
from mosaicq.plans import catalog

P_VALUES = """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS label, l_quantity AS q, l_extendedprice / 1000 AS e FROM lineitem),
m AS (SELECT label AS component, avg(q) AS mq, avg(e) AS me, covar_samp(q, q) AS qq, covar_samp(q, e) AS qe, covar_samp(e, e) AS ee FROM f GROUP BY 1),
p AS (SELECT k, n, label, component, exp(-(((q - mq) * (q - mq) * ee - 2 * (q - mq) * (e - me) * qe + (e - me) * (e - me) * qq) / (qq * ee - qe * qe)) / 2) AS p FROM f, m)
"""


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("lineitem", "embeddings", "part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_p_values_of_all_spots(spark, sf_dir, duck):
    key = ("k", "n", "label", "component")
    got = sorted(tuple(r[c] for c in (*key, "p")) for r in catalog.QUERIES["mahalanobis_pvalue"](spark, sf_dir).collect())
    want = sorted(duck.sql(P_VALUES + "SELECT k, n, label, component, p FROM p").fetchall())
    assert [r[:4] for r in got] == [r[:4] for r in want] and all(abs(a[4] - b[4]) < 2e-5 for a, b in zip(got, want))
    got = sorted((r.label, r.component, r.frac) for r in catalog.QUERIES["overlap_matrix"](spark, sf_dir).collect())
    want = sorted(duck.sql(P_VALUES + "SELECT label, component, avg(CAST(p > 0.45 AS DOUBLE)) FROM p GROUP BY 1, 2").fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, want))
    got = sorted((r.k, r.n, r.label) for r in catalog.QUERIES["confident_spots"](spark, sf_dir).collect())
    assert got == sorted(duck.sql(P_VALUES + "SELECT k, n, label FROM p WHERE label = component AND p > 0.3").fetchall())


def test_accuracy_curve_of_all_spots(spark, sf_dir, duck):
    got = sorted((r.threshold, r.accuracy) for r in catalog.QUERIES["accuracy_curve"](spark, sf_dir).collect())
    want = duck.sql(P_VALUES + """, t AS (SELECT label, component, range / 50.0 AS threshold, p FROM p, range(50)),
o AS (SELECT threshold, label, component, avg(CAST(p > threshold AS DOUBLE)) AS frac FROM t GROUP BY 1, 2, 3),
s AS (SELECT threshold, label, sum(frac) FILTER (WHERE label = component) AS d, sum(frac) AS s FROM o GROUP BY 1, 2)
SELECT threshold, avg(CASE WHEN s > 0 THEN d / s END) FROM s GROUP BY 1 ORDER BY 1""").fetchall()
    assert len(got) == len(want) == 50
    assert all(abs(a[0] - b[0]) < 1e-6 and abs(a[1] - b[1]) < 2e-5 for a, b in zip(got, want))


def test_components_of_all_edges(spark, sf_dir, duck):
    edges = duck.sql("SELECT vec_id, (vec_id * 7 + 3) % 500 FROM embeddings").fetchall()
    least = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            c = min(least[a], least[b])
            changed |= least[a] != c or least[b] != c
            least[a] = least[b] = c
    got = catalog.QUERIES["seam_components"](spark, sf_dir).collect()
    assert len(got) == len(least) and {r.node: r.component for r in got} == least


def test_boxes_of_all_parts(spark, sf_dir, duck):
    want = duck.sql("""WITH b AS (SELECT p_partkey AS box, p_partkey * 7 % 1400 AS y0, p_partkey * 13 % 9000 AS x0 FROM part)
SELECT box, o_orderkey FROM orders JOIN b ON o_custkey >= y0 AND o_custkey < y0 + 20 AND o_orderkey % 9000 >= x0 AND o_orderkey % 9000 < x0 + 50""").fetchall()
    got = sorted((r.box, r.o_orderkey) for r in catalog.QUERIES["point_in_box"](spark, sf_dir).collect())
    assert got == sorted(want)
    large = {r[0] for r in duck.sql("SELECT p_partkey FROM part WHERE p_size > 10").fetchall()}
    assert any(box in large for box, _ in got)


def plain_labels(x, first, tolerance=1e-3, rounds=100):
    """Expectation and maximisation in full arrays, to the tolerance; the labels start at 0."""

    def logs():
        return np.log(w) - ((x[:, None] - m) ** 2 / (2 * v) + np.log(2 * np.pi * v) / 2).sum(-1)

    m, w, last = np.array(first), np.full(len(first), 1 / len(first)), None
    v = np.tile(np.maximum(x.var(0), 1e-6), (len(first), 1))
    for _ in range(rounds):
        l = logs()
        total = np.logaddexp.reduce(l, 1)
        r = np.exp(l - total[:, None])
        n = r.sum(0)[:, None]
        w, m = r.mean(0), r.T @ x / n
        v = np.maximum(r.T @ x**2 / n - m**2, 0) + 1e-6
        if last is not None and abs(total.mean() - last) < tolerance:
            break
        last = total.mean()
    return logs().argmax(1)


def test_mixture_runs_to_its_tolerance(spark, sf_dir, duck):
    rows = duck.sql("SELECT l_orderkey, l_linenumber, l_quantity / 50, l_extendedprice / 100000, l_linenumber % 2 FROM lineitem").fetchall()
    want = []
    for layer in (0, 1):
        part = [r for r in rows if r[4] == layer]
        labels = plain_labels(np.array([[float(r[2]), float(r[3])] for r in part]), [[0.2, 0.2], [0.8, 0.6]])
        want += [(r[0], r[1], int(k) + 2 * layer + 1) for r, k in zip(part, labels)]
    assert sorted(tuple(r) for r in catalog.QUERIES["gmm_labels"](spark, sf_dir).collect()) == sorted(want)


def test_enrichment_uses_the_default_permutations(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(spatial, "enrichment", lambda *a, **options: seen.append((len(a), options)))
    catalog.QUERIES["neighbourhood_enrichment"](spark, sf_dir)
    assert seen == [(2, {})]
