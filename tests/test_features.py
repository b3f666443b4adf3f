import math

import pytest
from pyspark.sql import functions as F

from mosaicq.functions import features as fx
from mosaicq.operators import cells, decode, stats, tables


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("v")).first().v


def test_ratio_follows_ieee(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 4.0), (None, 1.0)], "x double, t double")
    a, b, c, d, e = (r.v for r in df.select(fx.ratio(F.col("x"), F.col("t")).alias("v")).collect())
    assert math.isnan(a) and b == math.inf and c == -math.inf and d == 0.25 and e is None


def test_clamp_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (7.0,), (float("inf"),), (2.0,), (None,)], "x double")
    got = [r.v for r in df.select(fx.clamp_above(F.col("x"), 5.0).alias("v")).collect()]
    assert math.isnan(got[0]) and got[1:] == [5.0, 5.0, 2.0, None]


def test_golden_base_calls(spark):
    cases = {(300, 500): "A", (300, 499): "T", (299, 500): "C", (299, 499): "G", (0, 0): "G", (5000, 9000): "A"}
    df = spark.createDataFrame(list(cases), "p int, q int")
    assert {(r.p, r.q): r.v for r in df.select("p", "q", fx.base_call(F.col("p"), F.col("q")).alias("v")).collect()} == cases


def test_codes(spark):
    assert one(spark, fx.hamming(F.col("a"), F.col("b")), a="ACGT", b="AGG") == 1
    assert one(spark, fx.overlapped(F.col("a"), F.col("b")), a="ACGT", b="ACTC") == "ACTA"
    assert one(spark, fx.char_count(F.col("a"), "A"), a="ABACA") == 3
    assert one(spark, fx.half_even(F.col("x")), x=2.5) == 2.0
    assert one(spark, fx.packed_key(F.col("y"), F.col("x")), y=12, x=34) == 120000034
    assert one(spark, fx.reordered(F.col("k"), [3, 1, 2]), k=1) == 3 and one(spark, fx.reordered(F.col("k"), [3, 1, 2]), k=9) is None
    assert one(spark, fx.mapped(F.col("k"), {"a": "x"}, "none"), k="b") == "none"


def test_chi_square_tails(spark):
    # Reference values: closed forms of the chi-square distribution.
    assert one(spark, fx.chi2_survival(F.lit(4.0), 2)) == pytest.approx(math.exp(-2))
    assert one(spark, fx.chi2_survival(F.lit(4.0), 4)) == pytest.approx(math.exp(-2) * 3)
    assert one(spark, fx.chi2_survival(F.lit(2.0), 3)) == pytest.approx(math.erfc(1.0) + math.sqrt(4 / math.pi) * math.exp(-1), abs=1e-6)
    for x in (0.0, 0.3, 1.0, 2.1, 2.3, 4.0, 9.0, 20.0):
        assert one(spark, fx.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=1e-11)
    assert one(spark, fx.erf(F.lit(-0.7))) == pytest.approx(math.erf(-0.7), abs=1e-14) and one(spark, fx.erfc(F.lit(-3.0))) == pytest.approx(math.erfc(-3.0), rel=1e-13)
    assert one(spark, fx.chi2_survival(F.lit(80.0), 3)) == pytest.approx(math.erfc(math.sqrt(40)) + math.sqrt(160 / math.pi) * math.exp(-40), rel=1e-10)
    draws = spark.range(4000).select(fx.jittered(F.lit(0.0), ["id"], 0.5).alias("v"))
    m, sd = draws.agg(F.avg("v"), F.stddev("v")).first()
    assert abs(m) < 0.03 and abs(sd - 0.5) < 0.03 and draws.exceptAll(spark.range(4000).repartition(7).select(fx.jittered(F.lit(0.0), ["id"], 0.5))).isEmpty()


def test_panels_and_jitter(spark):
    df = spark.createDataFrame([(900.0, 0.0, 0.0), (10.0, 4.0, 2000.0), (900.0, float("nan"), 0.0), (10.0, 0.0, 0.0)], "sum double, g_a double, scaled_g double")
    assert fx.panel_filter(df, strict=False).count() == 3 and fx.panel_filter(df, strict=True).count() == 1
    z = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "x double").select(fx.jittered(F.col("x"), ["x"], 0.01, 3).alias("v")).collect()
    assert z[0].v != 0 and abs(z[0].v) < 0.1 and abs(z[1].v - 1) < 0.1 and z[2].v == 0.5


def test_barcodes(spark):
    book = spark.createDataFrame([("AAAA", "g1"), ("AATT", "g2"), ("CCCC", "g3")], "barcode string, gene string")
    reads = spark.createDataFrame([("AAAA",), ("AAAT",), ("CCCA",), ("GGGG",), (None,)], "sequence string")
    got = {r.sequence: r.match for r in decode.match_barcodes(reads, book).collect()}
    assert got == {"AAAA": "g1", "AAAT": "Ambiguous", "CCCA": "g3", "GGGG": None, None: None}
    assert sorted(r.sequence for r in decode.near_reference(reads, book).collect()) == ["AAAA", "AAAT", "CCCA"]


def test_mixture_finds_clouds(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(float(x), float(y)) for x, y in np.concatenate([rng.normal((0, 0), 0.1, (200, 2)), rng.normal((3, 1), 0.2, (100, 2))])]
    df = spark.createDataFrame(rows, "x double, y double")
    model = decode.fit_mixture(df, ["x", "y"], [[0.5, 0.5], [2.0, 1.0]])
    assert np.allclose(model["means"], [[0, 0], [3, 1]], atol=0.1) and model["weights"][0] == pytest.approx(2 / 3, abs=0.02)
    labels = decode.mixture_labels(df, ["x", "y"], model, layer=2).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in labels} == {5: 200, 6: 100}


def test_centroids_add_up(spark):
    got = decode.initial_centroids(spark, 5, {"ye": [0, 0.2, 0.5, 0.7, 1], "b": [0, 1], "r": [0, 0.25, 0.5, 0.75, 1]}).collect()
    assert len(got) == 15 and got[0].k == 0 and {r.b for r in got} == {0.0, 0.25, 0.5, 0.75, 1.0}


def test_matrix_round_trip(spark):
    expr = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", 2), (3, "c", 5)], "cell_id int, gene string, cnt long")
    wide = cells.expression_matrix(expr, ["a", "b", "c"])
    assert sorted(tuple(r) for r in cells.to_long(wide).select("cell_id", "gene", "cnt").collect()) == sorted(tuple(r) for r in expr.collect())
    dense, sparse = (cells.normalised(expr, dense=d).where("x > 0").select("cell_id", "gene", F.round("z", 9)).collect() for d in (True, False))
    assert sorted(map(tuple, dense)) == sorted(map(tuple, sparse))
    obs = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "cell_id int, leiden int")
    assert [r.cell_id for r in cells.threshold_in_cluster(expr, obs, 7, "a", 1, {"b": 0}).collect()] == [2]


def test_curves(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 3, 4, 1, 2, 2, 0, 6])], "i int, v double")
    assert [r.i for r in stats.local_extrema(df, "i", "v").orderBy("i").collect()] == [1, 3, 6]
    assert [r.i for r in stats.local_extrema(df, "i", "v", order=2).orderBy("i").collect()] == [3, 6]
    assert [r.i for r in stats.local_extrema(df, "i", "v", order=9).collect()] == [6]
    assert [r.i for r in stats.local_extrema(df, "i", "v", maxima=True).collect()] == [2]
    assert stats.first_crossing(df, "i", "v", 2.5).first().i == 2
    assert stats.histogram(df, "v", 3).orderBy("bin").collect()[-1].bin == 2


def test_tables(spark):
    df = spark.createDataFrame([("k", "1", 0), ("j", "a", 1), ("k", "2", 2), ("j", "b", 3)], "key string, value string, o int")
    assert sorted((r.record, r.k, r.j) for r in tables.records_to_wide(df, "key", "value", "o", ["k", "j"]).collect()) == [(0, "1", "a"), (1, "2", "b")]
    grid = tables.combing_grid(spark.createDataFrame([(i,) for i in range(1, 7)], "tile int"), 3).orderBy("tile").collect()
    assert [(r.grid_r, r.grid_c) for r in grid] == [(0, 2), (0, 1), (0, 0), (1, 0), (1, 1), (1, 2)]
    left = spark.createDataFrame([("l0", "12-0", 1)], "layer string, id string, a int")
    right = spark.createDataFrame([("l0", "12-1", 9), ("l1", "12-1", 8)], "layer string, id string, b int")
    assert tables.realigned(left, right, "layer", "id").first().b == 9
    some = spark.range(1000)
    assert tables.sample_rows(some, 10, ["id"]).count() == 10 and tables.sample_rows(some.repartition(5), 10, ["id"]).exceptAll(tables.sample_rows(some, 10, ["id"])).count() == 0
    a, b = tables.split_train(some, ["id"])
    assert a.count() + b.count() == 1000 and 60 < b.count() < 140
    px = spark.createDataFrame([(0, 0, 1, 0, 1.0), (0, 0, 3, 1, 3.0)], "y int, x int, value int, order int, weight double")
    assert [tables.mosaic(px, m).first().value for m in ("overlay", "average", "blend")] == [3, 2.0, 2.5]
    hit, rest = tables.split_by(spark.createDataFrame([(1,), (None,), (5,)], "v int"), F.col("v") > 3)
    assert hit.count() == 1 and rest.count() == 2


def test_exact_quantiles_of_many_rows(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=40_000), np.round(rng.normal(size=30_000), 1), np.full(20_000, 0.25)])
    g = rng.integers(0, 4, len(x)) // 2
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)] + [(0, None), (None, 1.0), (None, 4.0), (7, None)], "g int, x double")
    for q in (0.0, 0.003, 0.5, 0.731, 0.98, 1.0):
        whole = np.append(x, [1.0, 4.0])
        assert abs(stats.exact_quantile(df, "x", q).first().value - np.quantile(whole, q)) < 1e-12
        got = {r.g: r.value for r in stats.exact_quantile(df, "x", q, ["g"]).collect()}
        assert set(got) == {0, 1, None} and all(abs(got[k] - np.quantile(x[g == k], q)) < 1e-12 for k in (0, 1)) and got[None] == 1 + 3 * q
    assert stats.exact_quantile(df.limit(0), "x", 0.5).count() in (0, 1)


def test_correlations_of_many_rows_and_columns(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) + 50
    x[:, 3] = 7  # a constant column has no correlation
    df = spark.createDataFrame([(f"c{i}", f"g{k}", float(v)) for i, r in enumerate(x) for k, v in enumerate(r)], "cell string, gene string, v double").repartition(5)
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(x.T)
    for most in (2048, 5):
        monkeypatch.setattr(stats, "MOST_COLUMNS", most)
        got = {(int(r.a[1:]), int(r.b[1:])): r.r for r in stats.correlation_matrix(df, "cell", "gene", "v").collect()}
        assert len(got) == 144 and all(got[k, k] is None for k in range(12))
        assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(12) for j in range(12) if i != j and 3 not in (i, j))
        assert all(got[3, k] is None or np.isnan(got[3, k]) for k in range(12))


def test_absent_cells_are_zeros_at_any_width(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(11)
    x = rng.poisson(1.2, (150, 9)).astype(float)
    x[:, 4] = 0
    rows = [(i, k, float(v)) for i, r in enumerate(x) for k, v in enumerate(r) if v or rng.random() < 0.3]
    rows += [(i, 4, None) for i in range(150)]  # a column of nulls, and every row there
    df = spark.createDataFrame(rows, "cell int, gene int, v double").repartition(3)

    def ranks(c):
        order = np.sort(c)
        return (np.searchsorted(order, c, "left") + np.searchsorted(order, c, "right") + 1) / 2

    with np.errstate(invalid="ignore"):
        want = {"p": np.corrcoef(x.T), "s": np.corrcoef(np.apply_along_axis(ranks, 0, x).T)}
    for most in (2048, 4):
        monkeypatch.setattr(stats, "MOST_COLUMNS", most)
        for key, f in (("p", stats.correlation_matrix), ("s", stats.spearman_matrix)):
            got = {(r.a, r.b): r.r for r in f(df, "cell", "gene", "v").collect()}
            assert len(got) >= 64
            for (i, j), r in got.items():
                assert (r is None) == (i == j or 4 in (i, j)) and (r is None or abs(r - want[key][i, j]) < 1e-9)


def test_principal_components(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) @ rng.normal(size=(6, 6)) + 10
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(999, None)], "id int, v array<double>").repartition(4)
    got = {r.id: r.pcs for r in cells.principal_components(df, 3).collect()}
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    vt *= np.sign(vt[np.arange(6), np.abs(vt).argmax(1)])[:, None]
    assert got[999] is None and np.allclose([got[i] for i in range(200)], (x - x.mean(0)) @ vt[:3].T, atol=1e-8)
