"""What larger tables bring about: sums beyond 16 bits, crowds of equal rows, more blocks."""

import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from mosaicq.operators import communities, images, layout, spatial
from mosaicq.plans import catalog, readout


def test_images_of_large_sums_keep_their_differences(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_quantity", F.col("l_quantity") + 100_000)
    lines.write.parquet(f"file://{tmp_path}/lineitem.parquet")
    found = readout.cycle_offsets(spark, f"file://{tmp_path}").collect()
    assert len(found) == 3 and all((r.dy, r.dx) == (-3, 5) for r in found)
    for drawn in (readout._light_tiles, readout._stacks):
        for r in drawn(spark, f"file://{tmp_path}").collect():
            assert len(set(r.pixels[k : k + 2] for k in range(0, len(r.pixels), 2))) > 3


def test_neighbours_among_crowds_of_equal_rows():
    """Ties of a whole crowd, a common offset, values beyond single precision: the nearest are exact, ties in order."""
    rng = np.random.default_rng(0)
    crowd = rng.normal(size=(3000, 6))
    crowd[100:1500] = crowd[99]
    for q in (crowd, crowd + 1e6, crowd * 1e30):
        order, same = rng.permutation(len(q)), np.r_[np.arange(150), np.full(150, -1)]
        p = np.r_[q[:150], rng.normal(size=(150, 6)) * np.abs(q[0, 0]) + q[1]]
        d2 = ((p[:, None] - q[None]) ** 2).sum(2)
        d2[np.arange(150), np.arange(150)] = np.inf
        want = np.lexsort((np.broadcast_to(order, d2.shape), d2), axis=1)[:, :5]
        i, j, found = spatial._nearest_in_block(p, q, order, same, 5)
        assert (i == np.repeat(np.arange(300), 5)).all() and (j.reshape(300, 5) == want).all() and (found.reshape(300, 5) == np.take_along_axis(d2, want, 1)).all()


def test_neighbours_hold_a_bounded_number_of_places():
    """A block's task holds some MB besides the block, also when very many rows are equal (before: 65 times as many)."""
    rng = np.random.default_rng(0)
    q = rng.normal(size=(4096, 64))
    q[:2048] = q[0]
    tracemalloc.start()
    spatial._nearest_in_block(q[:64], q, np.arange(4096), np.full(64, -1), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_radius_joins_hold_no_whole_side(spark, sf_dir):
    """Rows repeated for the cells around are merged, not sent whole to every task; no pair is lost or doubled."""
    for name in ("nearest_neighbor_radius", "expression_matrix", "radius_pairs"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        at = plan.index("Generate explode")  # the repeated rows
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan[max(0, at - 300) : at], name
    rng = np.random.default_rng(0)
    at = np.r_[np.indices((9, 9, 4)).reshape(3, -1).T - 4.0, rng.normal(size=(60, 3)) * 3]
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "id long, z double, y double, x double")
    for dims in (("z", "y", "x"), ("y", "x"), ("x",)):
        p = at[:, ["zyx".index(d) for d in dims]]
        for radius in (1, 1.5):
            i, j = np.nonzero(((p[:, None] - p[None]) ** 2).sum(2) <= radius * radius)
            got = [tuple(r) for r in spatial.within(rows, rows, list(dims), radius).select("l.id", "r.id").collect()]
            assert sorted(got) == list(zip(i.tolist(), j.tolist()))


def test_equal_centres_are_cut_once(spark):
    """Python packs an image's crop once for all its rows (before: once a row)."""
    image = np.arange(80, dtype="<u2").reshape(8, 10)
    df = spark.createDataFrame([(1, 8, 10, image.tobytes())], "tile int, height int, width int, pixels binary")
    centres = spark.createDataFrame([(1, 3, 4)] * 5 + [(1, 0, 9)] * 2, "tile int, y int, x int")
    every = [tuple(r) for r in images.crops(df, centres, 2, ["tile"], 4).select("y", "x", "pixels").collect()]
    assert len(every) == 7 and len(set(every)) == 2
    once = {(r.y, r.x): (r.times, bytes(r.pixels)) for r in images.crops(df, centres, 2, ["tile"], 4, once=True).collect()}
    assert once == {(y, x): (5 if y else 2, bytes(pixels)) for y, x, pixels in every} and once[3, 4][1] == image[1:6, 2:7].tobytes()


def test_suppression_writes_no_pairs_that_are_decided(spark, monkeypatch):
    """A crowd at few places: no row is written for a pair within a block (before: twice, some 200 a point)."""
    rows = [(i, float(i % 7), float(i % 5), float(i * 37 % 11) if i % 50 else None, "ab"[i % 2] if i % 60 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, y double, x double, sum double, kind string")
    written = []
    plain = spatial.materialise
    monkeypatch.setattr(spatial, "materialise", lambda df, label: (written.append(plain(df, label)), written[-1])[1])
    for radius, group in ((1, []), (2.5, ["kind"])):
        for most in (100_000, 10):
            monkeypatch.setattr(spatial, "_MOST_POINTS", most)
            written.clear()
            got = sorted(r.id for r in spatial.suppress_within(df, radius, group=group).collect())
            kept, loose = [], []
            for r in sorted((r for r in rows if r[3] is not None), key=lambda r: (-r[3], r[0])):
                if group and r[4] is None:
                    loose.append(r)
                elif all((r[1] - k[1]) ** 2 + (r[2] - k[2]) ** 2 > radius * radius or group and r[4] != k[4] for k in kept):
                    kept.append(r)
            assert got == sorted([r[0] for r in kept + loose] + [r[0] for r in rows if r[3] is None])
            assert most == 10 or sum(w.count() for w in written) < len(rows)


def test_rounds_of_communities_deal_edges_once(spark):
    """Kept edges meet the labels where they lie; what a round groups by node is dealt once at most (before: four times)."""
    both = spark.createDataFrame([(a, b, 1.0, 2.0) for a in range(6) for b in range(6)], "src long, dst long, w double, k double")
    labels = spark.createDataFrame([(a, a // 3) for a in range(6)], "node long, to long")
    for few in (True, False):
        kept = communities._kept(both, few)
        near = communities._links(kept, few, labels.hint("merge") if not few else labels).groupBy("node").agg(F.sum("w").alias("w"))
        plan = near._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange" in line and "ENSURE_REQUIREMENTS" in line]
        assert len(dealt) == (0 if few else 1), plan  # the labels; what is found is dealt by the query itself
        assert {r.node: r.w for r in near.collect()} == {a: 6.0 for a in range(6)}
        kept.unpersist()


def test_neighbours_are_sought_in_few_large_blocks(spark):
    """300,000 rows of 64 are dealt into 5 blocks, or as many as the cores need, not 37; a row is copied once for each."""
    rows = spark.range(300_000).select("id", F.array_repeat(F.col("id").cast("float"), 64).alias("v"))
    blocks = max(5, int((3 * spark.sparkContext.defaultParallelism - 1) ** 0.5) + 1)
    plan = spatial.knn(rows, 3)._jdf.queryExecution().analyzed().toString()
    assert {int(last) + 1 for last in re.findall(r"sequence\(0, (\d+)", plan)} == {blocks}


def test_neighbours_are_the_nearest_of_all_steps():
    """More rows than a step and a part hold: neighbours equal those of all distances, the row itself left out."""
    rng = np.random.default_rng(2)
    q = rng.normal(size=(5000, 8)).astype(np.float32)
    order, same = rng.permutation(5000), np.arange(4400, 5000)
    d2 = ((q[4400:, None].astype(float) - q[None]) ** 2).sum(2)
    d2[np.arange(600), same] = np.inf
    want = np.lexsort((np.broadcast_to(order, d2.shape), d2), axis=1)[:, :15]
    i, j, _ = spatial._nearest_in_block(q[4400:], q, order, same, 15)
    assert (i == np.repeat(np.arange(600), 15)).all() and (j.reshape(600, 15) == want).all()


def test_weights_do_not_depend_on_the_order_of_neighbours():
    rng = np.random.default_rng(1)
    lists = [rng.random(n) for n in (1, 15, 4, 9)]
    shuffled = [rng.permutation(len(x)) for x in lists]
    sizes = np.array([len(x) for x in lists])
    once = np.split(communities._weights(np.concatenate(lists), sizes, 64), np.cumsum(sizes)[:-1])
    again = np.split(communities._weights(np.concatenate([x[p] for x, p in zip(lists, shuffled)]), sizes, 64), np.cumsum(sizes)[:-1])
    assert all((a[p] == b).all() for a, p, b in zip(once, shuffled, again))


def test_layout_joins_no_edges_in_its_rounds(spark, monkeypatch):
    """A round sends places from block to block as arrays (before: every edge was joined with places and dealt anew)."""
    rng = np.random.default_rng(3)
    edges = [(f"n{i}", f"n{j}", float(w)) for i, j, w in zip(*rng.integers(0, 120, (2, 900)), rng.random(900))]
    df = spark.createDataFrame(edges, "src string, dst string, weight double").dropDuplicates(["src", "dst"])
    start = spark.createDataFrame([(f"n{i}", float(rng.normal()), float(rng.normal())) for i in range(130)], "id string, y double, x double")
    plans, kept = [], layout.materialise
    monkeypatch.setattr(layout, "materialise", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or kept(df, label))
    got = layout.layout(df, start, rounds=2, block_nodes=40).collect()
    rounds = [plan for label, plan in plans if label == "layout"]
    assert len(rounds) >= 2 and not any("Join" in plan for plan in rounds[1:])
    assert sorted(r.id for r in got) == sorted(f"n{i}" for i in range(130)) and np.isfinite([(r.y, r.x) for r in got]).all()
