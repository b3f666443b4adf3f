"""More queries over the driver tables: geometry, codes, tiles, images, sources and sinks, with equivalent DuckDB SQL.

Sources and sinks are queried by a round trip: a table is written by the sink, read by the source, and must
come back. Images are drawn from tables: order lines counted on a grid are a tile's pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from mosaicq.functions import features as fx
from mosaicq.operators import cells, decode, graph, images, registration, segmentation, spatial, stats, tables
from mosaicq.plans.catalog import SCALED, _line_counts, _points, _scaled, query, r6, table
from mosaicq.sources import images as codec
from mosaicq.sources import readers, sinks
from mosaicq.streaming import watch, windows
from mosaicq.workspace import fresh_path

# ---------------------------------------------------------------- projections and keys


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey * 10000000 + l_suppkey AS BIGINT) AS id, round_even(l_extendedprice / 100, 0) AS rounded, CAST(floor(l_partkey / 7) AS BIGINT) AS small, CAST(l_linenumber AS DOUBLE) * CAST(3.36 AS DOUBLE) AS z FROM lineitem")
def integer_keys(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", fx.packed_key(F.col("l_partkey"), F.col("l_suppkey")).alias("id"), fx.half_even(F.col("l_extendedprice") / 100).alias("rounded"), fx.downsampled(F.col("l_partkey"), 7).alias("small"), fx.scaled_depth(F.col("l_linenumber")).alias("z"))


@query(SCALED + """, m AS (SELECT k, n, sye + sr AS red, 0.9 * sye + 0.2 * sg AS green, sb AS blue FROM t), h AS (SELECT *, greatest(red, green, blue) AS top FROM m)
SELECT k, n, round(greatest(0, least(1, CASE WHEN top = 0 THEN 0 ELSE red / top END)), 6) AS red, round(greatest(0, least(1, CASE WHEN top = 0 THEN 0 ELSE green / top END)), 6) AS green, round(greatest(0, least(1, CASE WHEN top = 0 THEN 0 ELSE blue / top END)), 6) AS blue FROM h""")
def mixed_colours(spark, sf):
    t = _scaled(spark, sf)
    rgb = fx.mixed_rgb(F.col("sye"), F.col("sb"), F.col("sr"), F.col("sg"))
    return t.select("k", "n", *[r6(c).alias(name) for c, name in zip(rgb, ("red", "green", "blue"))])


@query("SELECT l_orderkey, l_linenumber, [3, 1, 7, 5, 2, 6][l_linenumber] AS code, CASE l_shipmode_like WHEN 'N' THEN 10 WHEN 'R' THEN 20 ELSE -1 END AS known FROM (SELECT *, l_returnflag AS l_shipmode_like FROM lineitem)")
def reordered_codes(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", fx.reordered(F.col("l_linenumber"), [3, 1, 7, 5, 2, 6]).alias("code"), fx.mapped(F.col("l_returnflag"), {"N": 10, "R": 20}, -1).alias("known"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders")
def dense_row_ids(spark, sf):
    return tables.with_row_ids(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query("SELECT e.event_id AS id, e.user_id - n.n_nationkey * 3 AS y, round(e.value * 4 - n.n_regionkey * 5, 6) AS x FROM events e JOIN nation n ON e.user_id % 25 = n.n_nationkey")
def relative_coordinates(spark, sf):
    origins = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("crop"), (F.col("n_nationkey") * 3).alias("y0"), (F.col("n_regionkey") * 5).alias("x0"))
    points = _points(spark, sf).select("id", "y", "x", (F.col("y") % 25).alias("crop"))
    return spatial.relative_to(points, origins, "crop").select("id", "y", r6("x").alias("x"))


@query("SELECT e.event_id AS id, e.user_id + n.n_nationkey * 100 AS y, round(e.value * 4 + n.n_regionkey * 50, 6) AS x FROM events e JOIN nation n ON e.user_id % 25 = n.n_nationkey")
def tile_to_mosaic(spark, sf):
    positions = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tile"), (F.col("n_nationkey") * 100).alias("y0"), (F.col("n_regionkey") * 50).alias("x0"))
    points = _points(spark, sf).select("id", "y", "x", (F.col("y") % 25).alias("tile"))
    return spatial.shifted_by_tile(points, positions).select("id", "y", r6("x").alias("x"))


@query("""SELECT e.event_id AS id, e.event_id % 6 + 1 AS cycle, e.user_id + CASE WHEN e.event_id % 6 = 0 THEN 0 ELSE coalesce(n.n_nationkey - 12, 0) END AS y,
round(e.value * 4 + CASE WHEN e.event_id % 6 = 0 THEN 0 ELSE coalesce(n.n_nationkey % 7 - 3, 0) END, 6) AS x FROM events e LEFT JOIN nation n ON n.n_regionkey + 1 = e.event_id % 6 + 1 AND n.n_nationkey = e.user_id % 25""")
def registered_points(spark, sf):
    offsets = table(spark, sf, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("cycle"), F.col("n_nationkey").cast("long").alias("tile"), (F.col("n_nationkey") - 12).alias("dy"), (F.col("n_nationkey") % 7 - 3).alias("dx"))
    points = _points(spark, sf).select("id", "y", "x", (F.col("id") % 6 + 1).alias("cycle"), (F.col("y") % 25).alias("tile"))
    return spatial.shifted_by_cycle(points, offsets).select("id", "cycle", "y", r6("x").alias("x"))


# ---------------------------------------------------------------- filters


@query("SELECT event_id, CASE WHEN v > 3 THEN 'hit' ELSE 'rest' END AS part FROM (SELECT event_id, nullif(user_id % 7, 0) AS v FROM events)")
def split_and_back(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.nullif(F.col("user_id") % 7, F.lit(0)).alias("v"))
    hit, rest = tables.split_by(e, F.col("v") > 3)
    return tables.stacked([hit.select("event_id", F.lit("hit").alias("part")), rest.select("event_id", F.lit("rest").alias("part"))])


@query("""SELECT event_id AS id, CASE WHEN NOT (user_id >= 20 AND user_id < 60) AND NOT (value * 4 >= 50 AND value * 4 < 150) THEN 'off' WHEN user_id >= 20 AND user_id < 60 AND value * 4 >= 50 AND value * 4 < 150 THEN 'in' ELSE 'one' END AS place,
user_id < 100 AND value * 4 >= 0 AND value * 4 < 200 AND event_id >= 0 AND event_id < 5000 AS bounded FROM events""")
def crop_and_bounds(spark, sf):
    y, x = F.col("y"), F.col("x")
    place = F.when(spatial.off_both_axes(y, x, 20, 50, 40, 100), "off").when(spatial.in_box(y, x, 20, 50, 40, 100), "in").otherwise("one")
    return _points(spark, sf).select("id", place.alias("place"), spatial.in_bounds({"y": 100, "x": 200, "id": 5000}).alias("bounded"))


@query("""WITH c AS (SELECT lpad(bin(n_nationkey * 37 % 1024), 10, '0') AS code FROM nation), r AS (SELECT s_suppkey AS id, lpad(bin(s_suppkey * 53 % 1024), 10, '0') AS sequence FROM supplier)
SELECT id, sequence FROM r WHERE EXISTS (SELECT 1 FROM c WHERE hamming(c.code, r.sequence) <= 1)""")
def near_codebook(spark, sf):
    code = lambda c, k: F.lpad(F.bin((F.col(c) * k % 1024).cast("long")), 10, "0")
    c = table(spark, sf, "nation").select(code("n_nationkey", 37).alias("barcode"))
    return decode.near_reference(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), code("s_suppkey", 53).alias("sequence")), c).select("id", "sequence")


@query("""WITH m AS (SELECT r.range AS row, c.range AS col, max(1 + (r.range * c.range + k.range) % 3) AS roi FROM range(3) r, range(5) c, range(2) k WHERE (r.range + c.range) % 4 <> 0 GROUP BY 1, 2),
p AS (SELECT event_id AS id, 3 - greatest(1, CAST(floor(user_id / 100) AS INTEGER)) AS row, CAST(floor(greatest(0, value * 4 - 20) / 100) AS INTEGER) AS col FROM events)
SELECT id, m.roi FROM p LEFT JOIN m ON m.row = p.row AND m.col = p.col""")
def region_of_points(spark, sf):
    grid = spark.range(3).select(F.col("id").cast("int").alias("row")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("col"))).crossJoin(spark.range(2).withColumnRenamed("id", "k"))
    mask = grid.where("(row + col) % 4 <> 0").withColumn("roi", (1 + (F.col("row") * F.col("col") + F.col("k")) % 3).cast("long"))
    mask = mask.withColumn("order", F.col("roi"))
    points = _points(spark, sf).select("id", "y", (F.col("x") - 20).alias("x"))
    return spatial.roi_of_points(points, mask, 3).select("id", "roi")


LINES = "WITH e AS (SELECT o_custkey AS cell_id, l_suppkey % 40 AS gene, count(*) AS cnt FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


@query(LINES + " SELECT cell_id, gene, cnt FROM e WHERE cell_id IN (SELECT cell_id FROM e WHERE gene < 12 GROUP BY 1 HAVING sum(cnt) >= 5)")
def rich_cells(spark, sf):
    return cells.rich_cells(_line_counts(spark, sf), list(range(12)), 5).select("cell_id", "gene", "cnt")


@query("SELECT e.event_id AS id, CASE WHEN p.v > 0 THEN p.v END AS v FROM events e LEFT JOIN (SELECT event_id, value - 20 AS v FROM events WHERE value - 20 > 0) p USING (event_id)")
def positive_only(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") - 20).alias("v"))
    return tables.side_by_side([e.select("id"), e.where(F.col("v") > 0)], "id", None).select("id", "v")


# ---------------------------------------------------------------- joins


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def indexed_lookup(spark, sf):
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return tables.looked_up(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), right, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("""WITH a AS (SELECT 'l' || (c_nationkey % 3) AS layer, c_custkey || '-0' AS id, c_nationkey AS a FROM customer), b AS (SELECT 'l' || (c_nationkey % 4) AS layer, c_custkey || '-1' AS id, c_acctbal AS b FROM customer)
SELECT a.layer, a.id, a.a, b.b FROM a JOIN b ON a.layer = b.layer AND string_split(a.id, '-')[1] = string_split(b.id, '-')[1]""")
def layer_realigned(spark, sf):
    c = table(spark, sf, "customer")
    a = c.select(F.concat(F.lit("l"), F.col("c_nationkey") % 3).alias("layer"), F.concat("c_custkey", F.lit("-0")).alias("id"), F.col("c_nationkey").alias("a"))
    b = c.select(F.concat(F.lit("l"), F.col("c_nationkey") % 4).alias("layer"), F.concat("c_custkey", F.lit("-1")).alias("id"), F.col("c_acctbal").alias("b"))
    return tables.realigned(a, b, "layer", "id").select("layer", "id", "a", "b")


PIXELS = "WITH px AS (SELECT l_returnflag AS channel, l_partkey % 60 AS y, l_suppkey % 50 AS x, CAST(count(*) AS INTEGER) AS value FROM lineitem GROUP BY 1, 2, 3)"


def _pixels(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("channel"), (F.col("l_partkey") % 60).alias("y"), (F.col("l_suppkey") % 50).alias("x"))
    return t.agg(F.count("*").cast("int").alias("value"))


@query(PIXELS + """, e AS (SELECT event_id AS id, user_id % 60 AS y, event_id % 50 AS x FROM events)
SELECT id, y, x, max(value) FILTER (WHERE channel = 'A') AS A, max(value) FILTER (WHERE channel = 'N') AS N, max(value) FILTER (WHERE channel = 'R') AS R FROM e LEFT JOIN px USING (y, x) GROUP BY 1, 2, 3""")
def pixel_lookup(spark, sf):
    points = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 60).alias("y"), (F.col("event_id") % 50).alias("x"))
    return tables.sampled_pixels(points, _pixels(spark, sf), ["A", "N", "R"])


@query(PIXELS + """, e AS (SELECT event_id AS id, user_id % 60 AS y, event_id % 50 AS x FROM events), s AS (SELECT id, y + range AS y, x + range AS x, CAST(range AS INTEGER) AS step FROM e, range(-3, 4))
SELECT id, step, value FROM s LEFT JOIN (SELECT * FROM px WHERE channel = 'N') p ON p.y = s.y AND p.x = s.x""")
def diagonal_profiles(spark, sf):
    points = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 60).alias("y"), (F.col("event_id") % 50).alias("x"))
    return spatial.diagonal_profiles(points, _pixels(spark, sf).where("channel = 'N'").drop("channel"), 3)


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM a FULL JOIN b USING (k)""")
def side_by_side(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return tables.side_by_side([a, b], "k")


# ---------------------------------------------------------------- aggregates and order


@query("SELECT s_nationkey AS tile, array_to_string(list_sort(list(s_name)), ',') AS names FROM supplier GROUP BY 1")
def stack_names(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("tile"), F.col("s_name").alias("name"))
    return tables.group_lists(s, "tile", "name").select("tile", F.array_join("names", ",").alias("names"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS record, n_name AS file, CAST(n_regionkey AS VARCHAR) AS grid FROM nation")
def records_to_rows(spark, sf):
    n = table(spark, sf, "nation")
    lines = n.select(F.lit("file").alias("key"), F.col("n_name").alias("value"), "n_nationkey").unionByName(n.select(F.lit("grid").alias("key"), F.col("n_regionkey").cast("string").alias("value"), "n_nationkey"))
    return tables.records_to_wide(lines, "key", "value", "n_nationkey", ["file", "grid"]).select("record", "file", "grid")


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def means_of_labels(spark, sf):
    out = stats.label_means(table(spark, sf, "lineitem"), "l_suppkey", ["l_quantity", "l_tax"])
    return out.select("l_suppkey", r6("l_quantity").alias("l_quantity"), r6("l_tax").alias("l_tax"))


@query("WITH f AS (SELECT l_suppkey % 4 AS cycle, l_partkey % 9 AS tile, l_returnflag AS channel, max(l_linenumber) + 1 AS depth FROM lineitem GROUP BY 1, 2, 3) SELECT *, max(depth) OVER () AS max_depth FROM f")
def stack_depths(spark, sf):
    f = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("cycle"), (F.col("l_partkey") % 9).alias("tile"), F.col("l_returnflag").alias("channel"), F.col("l_linenumber").alias("z"))
    return tables.depth_of_stacks(f)


@query("""WITH f AS (SELECT DISTINCT s_nationkey % 3 AS cycle, s_suppkey % 11 AS tile, 'c' AS channel, CAST(z.range AS INTEGER) AS z FROM supplier, range(6) z WHERE z.range <= s_suppkey % 11 % 6),
d AS (SELECT cycle, tile, channel, (SELECT max(z) + 1 FROM f) - max(z) - 1 AS pad FROM f GROUP BY 1, 2, 3)
SELECT f.cycle, f.tile, f.channel, CAST(z + pad AS INTEGER) AS z, z AS own FROM f JOIN d USING (cycle, tile, channel) UNION ALL SELECT cycle, tile, channel, CAST(p.range AS INTEGER), NULL FROM d, range(6) p WHERE p.range < pad""")
def padded_stacks(spark, sf):
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") % 3).alias("cycle"), (F.col("s_suppkey") % 11).alias("tile"), F.lit("c").alias("channel"))
    f = s.withColumn("z", F.explode(F.sequence(F.lit(0), (F.col("tile") % 6).cast("int")))).distinct()
    return tables.padded_stacks(f.withColumn("own", F.col("z"))).select("cycle", "tile", "channel", "z", "own")


@query("""WITH h AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM h""")
def box_quartiles(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    parts = [stats.exact_quantile(e, "value", q, ["event_type"]).withColumn("value", r6("value")).withColumnRenamed("value", f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75), 1)]
    return parts[0].join(parts[1], "event_type").join(parts[2], "event_type")


@query("SELECT event_id AS id, count(*) OVER (PARTITION BY floor(user_id / 10), floor(value * 4 / 10)) AS density, row_number() OVER (ORDER BY cnt, event_id) - 1 AS turn FROM (SELECT *, count(*) OVER (PARTITION BY floor(user_id / 10), floor(value * 4 / 10)) AS cnt FROM events)")
def drawn_by_density(spark, sf):
    dense = stats.block_density(_points(spark, sf), "y", "x", 10)
    return tables.with_row_ids(dense.select("id", "density"), ["density", "id"], "turn")


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CAST(least(floor((l_extendedprice - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin FROM lineitem, e),
c AS (SELECT r.range AS bin, count(b.bin) AS n FROM range(30) r LEFT JOIN b ON b.bin = r.range GROUP BY 1), v AS (SELECT bin FROM (SELECT bin, n, lag(n) OVER (ORDER BY bin) AS p, lead(n) OVER (ORDER BY bin) AS q FROM c) WHERE n < p AND n < q)
SELECT l_orderkey, l_linenumber, CAST((SELECT count(*) FROM v WHERE v.bin <= b.bin) AS INTEGER) AS layer FROM b""")
def layers_by_valleys(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.layers_by_valleys(t, "l_extendedprice", 30).select("l_orderkey", "l_linenumber", "layer")


@query("""WITH m AS (SELECT l_returnflag AS cluster, l_suppkey AS gene, avg(l_quantity) AS mean FROM lineitem GROUP BY 1, 2), r AS (SELECT l_linestatus AS cluster, l_suppkey AS gene, avg(l_tax) AS mean FROM lineitem GROUP BY 1, 2)
SELECT m.cluster AS a, r.cluster AS b, round(corr(m.mean, r.mean), 6) AS r FROM m JOIN r USING (gene) GROUP BY 1, 2""")
def cluster_correlation(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("gene", F.col("l_suppkey"))
    a = t.groupBy(F.col("l_returnflag").alias("cluster"), "gene").agg(F.avg("l_quantity").alias("mean"))
    b = t.groupBy(F.col("l_linestatus").alias("cluster"), "gene").agg(F.avg("l_tax").alias("mean"))
    return stats.cluster_correlation(a, b).withColumn("r", r6("r"))


@query(LINES + """, w AS (SELECT c_custkey AS cell_id, coalesce(max(cnt) FILTER (WHERE gene = 3), 0) AS m, coalesce(max(cnt) FILTER (WHERE gene = 5), 0) AS a FROM customer LEFT JOIN e ON e.cell_id = c_custkey WHERE c_nationkey = 7 GROUP BY 1)
SELECT cell_id FROM w WHERE m > 0 AND a <= 1""")
def threshold_in_cluster(spark, sf):
    obs = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("leiden"))
    return cells.threshold_in_cluster(_line_counts(spark, sf), obs, 7, 3, 0, {5: 1})


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem), m AS (SELECT * FROM (VALUES (1, 0.2, 0.1, 0.04, 0.02), (2, 0.7, 0.5, 0.03, 0.05)) v(component, mx, my, vx, vy))
SELECT k, n, component, round(exp(-((x - mx) * (x - mx) / vx + (y - my) * (y - my) / vy) / 2), 6) AS p FROM f, m""")
def mixture_p_values(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))
    model = {"means": [[0.2, 0.1], [0.7, 0.5]], "variances": [[0.04, 0.02], [0.03, 0.05]]}
    return decode.mixture_p_values(f, ["x", "y"], model).select("k", "n", "component", r6("p").alias("p"))


@query("""WITH b AS (SELECT DISTINCT 'b' || (s_suppkey % 5) AS block, s_nationkey AS y, s_suppkey % 6 AS x, s_suppkey % 4 AS label FROM supplier), n AS (SELECT y, x, block || ':' || label AS node FROM b),
e AS (SELECT DISTINCT p.node AS a, q.node AS b FROM n p JOIN n q USING (y, x)), r AS (SELECT a AS node, min(b) AS c FROM (WITH RECURSIVE w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT * FROM w) GROUP BY 1)
SELECT DISTINCT y, x, c AS label FROM n JOIN r USING (node)""")
def seam_merge(spark, sf):
    s = table(spark, sf, "supplier")
    px = s.select(F.concat(F.lit("b"), F.col("s_suppkey") % 5).alias("block"), F.col("s_nationkey").alias("y"), (F.col("s_suppkey") % 6).alias("x"), (F.col("s_suppkey") % 4).alias("label")).distinct()
    return graph.merged_labels(px)


# ---------------------------------------------------------------- strings and codes


@query("""WITH s AS (SELECT s_suppkey AS id, [CASE substr(lpad(bin(s_suppkey * 53 % 65536), 16, '0'), 2 * k - 1, 2) WHEN '00' THEN 'A' WHEN '01' THEN 'C' WHEN '10' THEN 'G' ELSE 'T' END FOR k IN range(1, 9)] AS p,
[CASE substr(lpad(bin(s_suppkey * 771 % 65536), 16, '0'), 2 * k - 1, 2) WHEN '00' THEN 'A' WHEN '01' THEN 'C' WHEN '10' THEN 'G' ELSE 'T' END FOR k IN range(1, 9)] AS q FROM supplier)
SELECT id, array_to_string([CASE WHEN p[k] = q[k] THEN p[k] WHEN p[k] <> 'G' AND q[k] <> 'G' THEN 'A' WHEN p[k] = 'C' OR q[k] = 'C' THEN 'C' WHEN p[k] = 'T' OR q[k] = 'T' THEN 'T' ELSE 'A' END FOR k IN range(1, 9)], '') AS code FROM s""")
def overlap_codes(spark, sf):
    def bases(k: int):
        bits = F.lpad(F.bin((F.col("s_suppkey") * k % 65536).cast("long")), 16, "0")
        pair = lambda i: F.substring(bits, 2 * i + 1, 2)
        return F.concat(*[F.when(pair(i) == "00", "A").when(pair(i) == "01", "C").when(pair(i) == "10", "G").otherwise("T") for i in range(8)])

    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), fx.overlapped(bases(53), bases(771)).alias("code"))


@query("SELECT p_partkey, upper(p_name) AS name, contains(p_name, 'an') AS has, regexp_extract(p_brand, '#([0-9]+)', 1) AS number, length(p_type) - length(replace(p_type, 'E', '')) AS es FROM part")
def string_rules(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("name"), F.contains("p_name", F.lit("an")).alias("has"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("number"), fx.char_count(F.col("p_type"), "E").cast("long").alias("es"))


NAMES = "WITH f AS (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS cycle, CAST(l_suppkey % 40 AS INTEGER) AS tile, l_returnflag AS channel, CAST(l_quantity AS INTEGER) % 5 AS z FROM lineitem)"


def _names(spark, sf):
    t = table(spark, sf, "lineitem")
    f = t.select(F.col("l_linenumber").cast("int").alias("cycle"), (F.col("l_suppkey") % 40).cast("int").alias("tile"), F.col("l_returnflag").alias("channel"), (F.col("l_quantity").cast("int") % 5).alias("z")).distinct()
    return f.select(F.format_string("C%03d-T%04d-%s-Z%03d.tif", "cycle", "tile", "channel", "z").alias("name"))


@query(NAMES + " SELECT cycle, tile, channel, z FROM f")
def file_names(spark, sf):
    names = _names(spark, sf).unionByName(spark.createDataFrame([("notes.txt",), ("C1-T2.tif",)], "name string"))
    return readers.parsed_names(names).select("cycle", "tile", "channel", "z")


@query("SELECT 'T' || n_nationkey || '.tif' AS file, round(n_regionkey / 4.0, 10) AS corr, CAST(n_nationkey * 7 - 50 AS INTEGER) AS x, CAST(n_regionkey * 3 - 4 AS INTEGER) AS y, CAST(n_nationkey % 5 AS INTEGER) AS grid_c, CAST(n_nationkey // 5 AS INTEGER) AS grid_r FROM nation")
def position_records(spark, sf):
    """Positions written as text records and read again."""
    n = table(spark, sf, "nation")
    rows = n.select(F.format_string("T%d.tif", "n_nationkey").alias("file"), (F.col("n_regionkey") / 4.0).alias("corr"), (F.col("n_nationkey") * 7 - 50).alias("x"), (F.col("n_regionkey") * 3 - 4).alias("y"), (F.col("n_nationkey") % 5).alias("grid_c"), F.expr("n_nationkey div 5").cast("int").alias("grid_r"))
    path = fresh_path(spark, "positions")
    sinks.write_positions(rows, path)
    return readers.read_positions(spark, path).withColumn("corr", F.round("corr", 10))


# ---------------------------------------------------------------- sources and sinks, by round trips


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def csv_round_trip(spark, sf):
    path = fresh_path(spark, "csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    hit, rest = tables.split_by(orders, F.col("o_orderstatus") == "F")
    sinks.write_csv(hit, path)
    sinks.append_csv(rest, path)
    return readers.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string")


@query("SELECT CAST(l_partkey AS INTEGER) AS y, CAST(l_suppkey AS INTEGER) AS x, CAST(round_even(l_quantity * 0.5, 0) AS INTEGER) AS v FROM lineitem")
def integer_text_round_trip(spark, sf):
    path = fresh_path(spark, "ints")
    sinks.write_ints(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"), (F.col("l_quantity") * 0.5).alias("v")), path)
    return readers.read_int_blocks(spark, path, ["y", "x", "v"])


@query("SELECT CAST(round_even(value, 0) AS INTEGER) - 1 AS x, CAST(user_id AS INTEGER) - 1 AS y, CAST(event_id % 30 AS INTEGER) - 1 AS z, value AS \"integratedIntensity\" FROM events")
def localisations_round_trip(spark, sf):
    path = fresh_path(spark, "loc")
    e = table(spark, sf, "events").select(F.col("value").alias("x_in_pix"), F.col("user_id").alias("y_in_pix"), (F.col("event_id") % 30).alias("z_in_pix"), F.col("value").alias("integratedIntensity"))
    e.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_localisations(spark, path)


@query("SELECT c_custkey AS cell_id, c_mktsegment AS type FROM customer")
def partitioned_round_trip(spark, sf):
    path = fresh_path(spark, "cells")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("type"))
    sinks.write_table(c, path, ["type"])
    sinks.write_table(c.where("type = 'BUILDING'"), path, ["type"])  # replaces that partition alone
    return spark.read.parquet(path).select("cell_id", "type")


@query("SELECT CAST(n_regionkey AS INTEGER) AS cycle, 't' || n_nationkey || '.tif' AS file, CAST(n_nationkey - 9 AS INTEGER) AS dy, CAST(n_nationkey % 4 AS INTEGER) AS dx FROM nation")
def offsets_wide_and_long(spark, sf):
    n = table(spark, sf, "nation")
    long = n.select(F.col("n_regionkey").cast("int").alias("cycle"), F.format_string("t%d.tif", "n_nationkey").alias("file"), (F.col("n_nationkey") - 9).alias("dy"), (F.col("n_nationkey") % 4).alias("dx"))
    return readers.offsets_long(readers.offsets_wide(long, [f"t{k}.tif" for k in range(25)]))


def _grey(px, by):
    """px (by, value), the values of an image or stack (by) scaled down to 16 bits where its greatest passes them.

    Sums on a grid grow with the table; values cut at the top would leave nothing to tell pixels apart.
    """
    top = F.max("value").over(Window.partitionBy(*by))
    return px.withColumn("value", F.when(top > 65535, F.rint(F.col("value") * 65535 / top)).otherwise(F.col("value")).cast("int"))


def _images(spark, sf):
    """One 60 x 50 image of 16 bits a return flag; missing pixels are 0."""

    def draw(frame):
        import pandas as pd

        a = np.zeros((60, 50), "<u2")
        a[frame["y"], frame["x"]] = frame["value"]
        return pd.DataFrame([{"channel": frame["channel"].iloc[0], "height": 60, "width": 50, "pixels": a.tobytes()}])

    return _pixels(spark, sf).groupBy("channel").applyInPandas(draw, "channel string, height int, width int, pixels binary")


@query(PIXELS + " SELECT channel || '.' || ext AS name, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, value FROM px, (VALUES ('tif'), ('png')) v(ext)")
def image_files_round_trip(spark, sf):
    """Images written as TIFF and PNG files by the tasks, listed and decoded again, as pixels."""
    path = fresh_path(spark, "images")
    both = F.explode(F.array(F.lit("tif"), F.lit("png")))
    sinks.write_images(_images(spark, sf).withColumn("ext", both).withColumn("name", F.concat_ws(".", "channel", "ext")), path).collect()
    px = codec.to_pixels(codec.read_tiles(spark, path, "*.*").withColumn("name", F.element_at(F.split("path", "/"), -1)), ["name"])
    return px.where("value > 0").select("name", "y", "x", "value")


# ---------------------------------------------------------------- tiles and images


@query("SELECT s_suppkey + 1 AS tile, CAST(s_suppkey // 7 AS INTEGER) AS grid_r, CAST(CASE WHEN s_suppkey // 7 % 2 = 0 THEN 6 - s_suppkey % 7 ELSE s_suppkey % 7 END AS INTEGER) AS grid_c FROM supplier")
def combing_grid(spark, sf):
    return tables.combing_grid(table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("tile")), 7).select("tile", "grid_r", "grid_c")


OVERLAID = "WITH t AS (SELECT l_suppkey % 5 AS tile, l_partkey % 30 AS y, l_orderkey % 40 AS x, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)"


def _tile_pixels(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.groupBy((F.col("l_suppkey") % 5).alias("tile"), (F.col("l_partkey") % 30).alias("y"), (F.col("l_orderkey") % 40).alias("x")).agg(F.max("l_quantity").alias("value"))


@query(OVERLAID + ", w AS (SELECT *, power(least(y + 1, 30 - y) * least(x + 1, 40 - x), 1.5) AS weight FROM t) SELECT y, x, arg_max(value, tile) AS top, round(avg(value), 6) AS mean, round(sum(value * weight) / sum(weight), 6) AS blend FROM w GROUP BY 1, 2")
def mosaics(spark, sf):
    px = _tile_pixels(spark, sf).withColumn("order", F.col("tile")).withColumn("weight", tables.blend_weight(F.col("y"), F.col("x"), 30, 40))
    parts = [tables.mosaic(px, mode).withColumnRenamed("value", name) for mode, name in (("overlay", "top"), ("average", "mean"), ("blend", "blend"))]
    out = parts[0].join(parts[1], ["y", "x"]).join(parts[2], ["y", "x"])
    return out.select("y", "x", "top", r6("mean").alias("mean"), r6("blend").alias("blend"))


@query(OVERLAID + """, l AS (SELECT tile, tile // 2 AS r, tile % 2 AS c, y, x, value FROM t),
k AS (SELECT * FROM l WHERE y >= CASE WHEN r > 0 THEN 4 ELSE 0 END AND y < CASE WHEN r < 2 THEN 26 ELSE 30 END AND x >= CASE WHEN c > 0 THEN 4 ELSE 0 END AND x < CASE WHEN c < 1 THEN 36 ELSE 40 END)
SELECT y + r * 20 AS y, x + c * 30 - 2 AS x, arg_max(value, r * 10 + c) AS value FROM k WHERE y + r * 20 < 66 AND x + c * 30 - 2 >= 0 AND x + c * 30 - 2 < 65 GROUP BY 1, 2""")
def pasted_tiles(spark, sf):
    tile = F.col("id")
    positions = spark.range(5).select(tile.alias("tile"), F.floor(tile / 2).alias("grid_r"), (tile % 2).alias("grid_c")).select("*", (F.col("grid_r") * 20).alias("y0"), (F.col("grid_c") * 30 - 2).alias("x0"))
    return tables.pasted(_tile_pixels(spark, sf), positions, 66, 65, 30, 40, bleed=4)


@query("""WITH e AS (SELECT 1000 + 10 * count(*) AS h, 1500 + 7 * count(*) AS w FROM supplier), n AS (SELECT *, CAST(greatest(1, ceil((h - 100) / 524.0)) AS BIGINT) AS ny, CAST(greatest(1, ceil((w - 100) / 524.0)) AS BIGINT) AS nx FROM e)
SELECT CAST(y.y AS INTEGER) AS tile_y, CAST(x.x AS INTEGER) AS tile_x, y.y * (h // ny) AS pad_y, x.x * (w // nx) AS pad_x, h // ny + 100 AS cut_y, w // nx + 100 AS cut_x FROM n, (SELECT unnest(range(ny)) AS y FROM n) y, (SELECT unnest(range(nx)) AS x FROM n) x""")
def tile_plan(spark, sf):
    """Tiles of an image whose sides grow with the suppliers."""
    n = table(spark, sf, "supplier").count()
    t = spatial.tile_table(spark, 1000 + 10 * n, 1500 + 7 * n, 624 * 624, 100)
    return t.select("tile_y", "tile_x", *[F.col(c).cast("long").alias(c) for c in ("pad_y", "pad_x", "cut_y", "cut_x")])


#: Peaks of a 60 x 50 image: the largest of their 5 x 5 pixels, above a limit, not within 2 pixels of the edge.
PEAKS = PIXELS + """, g AS (SELECT c.channel, y.range AS y, x.range AS x FROM (SELECT DISTINCT channel FROM px) c, range(60) y, range(50) x), a AS (SELECT g.*, coalesce(value, 0) AS v FROM g LEFT JOIN px ON px.channel = g.channel AND px.y = g.y AND px.x = g.x)
SELECT p.channel, CAST(p.y AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, CAST(p.v AS DOUBLE) AS value FROM a p JOIN a q ON q.channel = p.channel AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 WHERE p.y BETWEEN 2 AND 57 AND p.x BETWEEN 2 AND 47 GROUP BY p.channel, p.y, p.x, p.v HAVING p.v = max(q.v) AND p.v > 8"""


@query(PEAKS)
def image_peaks(spark, sf):
    """Peaks of images that were cut into blocks of 16 pixels and a halo: each block reports those of its core."""
    from mosaicq.functions import kernels

    def run(batches):
        import pandas as pd

        for frame in batches:
            for r in frame.itertuples(index=False):
                a = codec.to_array(r.pixels, r.height, r.width).astype(float)
                at = kernels.local_peaks(a, 8, 2)
                at = at[(at[:, 0] + r.top) // 16 == r.tile_y]
                at = at[(at[:, 1] + r.left) // 16 == r.tile_x]
                yield pd.DataFrame({"channel": np.full(len(at), r.channel, object), "y": (at[:, 0] + r.top).astype(np.int32), "x": (at[:, 1] + r.left).astype(np.int32), "value": a[tuple(at.T)]})

    strips = _images(spark, sf).withColumn("row0", F.lit(0))
    return images.blocks(strips, ["channel"], 60, 50, 16, 4).mapInPandas(run, "channel string, y int, x int, value double")


@query()
def tiled_signals(spark, sf):
    """Spots of every channel's image, cut into blocks, with the signals of all channels, one a place."""
    strips = _images(spark, sf).withColumn("row0", F.lit(0))
    spots = images.tiled_spots(strips, ["channel"], 60, 50, side=32, times_mean=2.0)
    return images.signal_table(spots, ["A", "N", "R"])


@query()
def localised_spots(spark, sf):
    return images.localised(_images(spark, sf), ["channel"], sigma=1.0, level=0.5, units="legacySD", method="2DGaussianMask", background="localMedian")


CELLS = {"block": 15, "offset": 2.0, "min_region": 6, "dilate": 1, "erode": 1, "min_distance": 2, "min_area": 6}


@query()
def segmented_tiles(spark, sf):
    """Cells of the images, in strips of 16 rows."""
    return segmentation.watershed_cells(_images(spark, sf).withColumn("row0", F.lit(0)), ["channel"], 60, 50, rows=16, **CELLS)


#: All pixels of the images, empty ones 0.
FULL = PIXELS + ", g AS (SELECT c.channel, y.range AS y, x.range AS x FROM (SELECT DISTINCT channel FROM px) c, range(60) y, range(50) x), a AS (SELECT g.*, coalesce(value, 0) AS v FROM g LEFT JOIN px ON px.channel = g.channel AND px.y = g.y AND px.x = g.x)"


def _as_pixels(spark, f):
    """(channel, y, x, value) of f(array) for every image."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            for r in frame.itertuples(index=False):
                a = f(codec.to_array(r.pixels, r.height, r.width).astype(float))
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"channel": np.full(a.size, r.channel, object), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "value": a.ravel()})

    return lambda df: df.mapInPandas(run, "channel string, y int, x int, value double")


@query(FULL + """, o AS (SELECT dy.range AS dy, dx.range AS dx FROM range(-3, 4) dy, range(-3, 4) dx WHERE dy.range * dy.range + dx.range * dx.range <= 12.25),
e AS (SELECT p.channel, p.y, p.x, min(q.v) AS v FROM a p, o JOIN a q ON q.channel = p.channel AND q.y = greatest(0, least(59, p.y + dy)) AND q.x = greatest(0, least(49, p.x + dx)) GROUP BY 1, 2, 3),
d AS (SELECT p.channel, p.y, p.x, max(q.v) AS v FROM a p, o JOIN e q ON q.channel = p.channel AND q.y = greatest(0, least(59, p.y + dy)) AND q.x = greatest(0, least(49, p.x + dx)) GROUP BY 1, 2, 3)
SELECT a.channel, CAST(a.y AS INTEGER) AS y, CAST(a.x AS INTEGER) AS x, CAST(a.v - least(d.v, a.v) AS DOUBLE) AS value FROM a JOIN d USING (channel, y, x)""")
def white_top_hat(spark, sf):
    from mosaicq.functions import kernels

    return _images(spark, sf).transform(_as_pixels(spark, lambda a: kernels.top_hat(a, (7, 7))))


@query(FULL + """, o AS (SELECT dy.range AS dy, dx.range AS dx FROM range(-5, 5) dy, range(-5, 5) dx),
e AS (SELECT p.channel, p.y, p.x, p.v, min(q.v) AS low FROM a p, o JOIN a q ON q.channel = p.channel AND q.y = greatest(0, least(59, p.y + dy)) AND q.x = greatest(0, least(49, p.x + dx)) GROUP BY 1, 2, 3, 4)
SELECT channel, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN low > 0 THEN round(v / low, 6) ELSE -1.0 END AS value FROM e""")
def signal_to_noise(spark, sf):
    from mosaicq.functions import kernels

    snr = lambda a: np.nan_to_num(np.round(kernels.signal_to_noise(a), 6), posinf=-1.0)
    return _images(spark, sf).transform(_as_pixels(spark, snr))


@query("WITH p AS (" + PEAKS + ") SELECT p.channel, CAST(p.y + dy.range AS INTEGER) AS y, CAST(p.x + dx.range AS INTEGER) AS x, max(p.value) AS value FROM p, range(-2, 3) dy, range(-2, 3) dx GROUP BY p.channel, p.y + dy.range, p.x + dx.range")
def spread_maxima(spark, sf):
    from mosaicq.functions import kernels

    return _images(spark, sf).transform(_as_pixels(spark, lambda a: kernels.spread_maxima(a, kernels.local_peaks(a, 8, 2)))).where("value > 0")


@query(FULL + " SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(max(v) AS INTEGER) AS value FROM a GROUP BY 1, 2")
def max_projection(spark, sf):
    planes = _images(spark, sf).select(F.lit(1).alias("cycle"), F.lit(1).alias("tile"), F.lit("all").alias("channel"), F.ascii("channel").alias("z"), "height", "width", "pixels")
    return codec.to_pixels(images.focus_stacked(planes, mode="max"), ["channel"]).select("y", "x", "value")


PLACED = "WITH t AS (SELECT CAST(s_suppkey AS INTEGER) AS tile, CAST(s_suppkey // 5 * 90 + s_nationkey % 7 AS INTEGER) AS y, CAST(s_suppkey % 5 * 100 + CAST(floor(abs(s_acctbal)) AS BIGINT) % 9 AS INTEGER) AS x FROM supplier)"


@query(PLACED + " SELECT tile, y - (SELECT min(y) FROM t) AS y0, x - (SELECT min(x) FROM t) AS x0 FROM t")
def stitched_positions(spark, sf):
    """Suppliers as tiles of a grid five wide; what neighbours say of each other, weakly and wrongly beside each other below the first row, gives back where they lie."""
    k = F.col("s_suppkey")
    y, x = F.floor(k / 5) * 90 + F.col("s_nationkey") % 7, k % 5 * 100 + F.floor(F.abs("s_acctbal")) % 9
    t = table(spark, sf, "supplier").select(k.cast("int").alias("tile"), y.cast("int").alias("y"), x.cast("int").alias("x"))
    a, b = t.select(*[F.col(c).alias(f"{c}1") for c in t.columns]), t.select(*[F.col(c).alias(f"{c}2") for c in t.columns])
    sides = a.withColumn("tile2", F.explode(F.array(F.when(F.col("tile1") % 5 < 4, F.col("tile1") + 1), F.col("tile1") + 5))).join(b, "tile2")
    weak = (F.col("tile2") - F.col("tile1") == 1) & (F.col("tile1") >= 5)
    corr = F.when(weak, 0.1).otherwise(0.5 + F.col("tile1") % 7 / 20)
    edges = sides.select(F.col("tile1").alias("i"), F.col("tile2").alias("j"), (F.col("y2") - F.col("y1") + F.when(weak, 37).otherwise(0)).alias("dy"), (F.col("x2") - F.col("x1")).alias("dx"), corr.alias("corr"))
    return images.tile_positions(edges)


def _stacks(spark, sf):
    """Stacks of seven planes of 24 x 20 pixels: order lines summed on a grid, a plane a line number, a stack a return flag."""

    def draw(frame):
        import pandas as pd

        a = np.zeros((24, 20), "<u2")
        a[frame["y"], frame["x"]] = frame["value"]
        return pd.DataFrame([{"cycle": 1, "tile": 1, "channel": frame["channel"].iloc[0], "z": frame["z"].iloc[0], "height": 24, "width": 20, "pixels": a.tobytes()}])

    t = table(spark, sf, "lineitem")
    px = t.groupBy(F.col("l_returnflag").alias("channel"), F.col("l_linenumber").cast("int").alias("z"), (F.col("l_partkey") % 24).alias("y"), (F.col("l_suppkey") % 20).alias("x")).agg(F.sum(F.col("l_quantity") * 20).alias("value"))
    return _grey(px, ["channel"]).groupBy("channel", "z").applyInPandas(draw, "cycle int, tile int, channel string, z int, height int, width int, pixels binary")


@query()
def focused_stacks(spark, sf):
    """All-in-focus pixels of every stack, by selective and by pairwise fusion."""
    both = [codec.to_pixels(images.focus_stacked(_stacks(spark, sf), mode=m), ["channel"]).withColumn("mode", F.lit(m)) for m in ("fused", "pairwise")]
    return tables.stacked(both).select("mode", "channel", "y", "x", "value")


@query(FULL + """, q AS (SELECT channel, quantile_cont(CAST(v AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.998) AS hi FROM a GROUP BY 1)
SELECT a.channel, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round((v - lo) / greatest(hi - lo, 1e-12), 6) AS value FROM a JOIN q ON q.channel = a.channel""")
def stretched_images(spark, sf):
    """Images between their 1st and 99.8th percentile."""
    from mosaicq.functions import kernels

    return _images(spark, sf).transform(_as_pixels(spark, lambda a: np.round(kernels.stretched(a, 1, 99.8), 6)))


LIGHT_ROUNDS = 40


def _light_tiles(spark, sf):
    """Tiles of 12 x 10 pixels: order lines summed on a grid by return flag and by a day of the month; 0 where there are none."""

    def draw(frame):
        import pandas as pd

        a = np.zeros((12, 10), "<u2")
        a[frame["y"], frame["x"]] = frame["value"]
        return pd.DataFrame([{"cycle": 1, "channel": frame["channel"].iloc[0], "tile": frame["tile"].iloc[0], "height": 12, "width": 10, "pixels": a.tobytes()}])

    t = table(spark, sf, "lineitem")
    px = t.groupBy(F.col("l_returnflag").alias("channel"), F.dayofmonth("l_shipdate").alias("tile"), (F.col("l_partkey") % 12).alias("y"), (F.col("l_suppkey") % 10).alias("x")).agg(F.sum("l_quantity").alias("value"))
    return _grey(px, ["channel"]).groupBy("channel", "tile").applyInPandas(draw, "cycle int, channel string, tile int, height int, width int, pixels binary")


@query()
def illumination_surfaces(spark, sf):
    """Gain and zero light of every pixel, fitted over all tiles of a channel."""

    def pixels(batches):
        import pandas as pd

        for frame in batches:
            for r in frame.itertuples(index=False):
                gain, offset = (np.frombuffer(v, "<f4").reshape(r.m_height, -1) for v in (r.gain, r.offset))
                y, x = np.indices(gain.shape)
                yield pd.DataFrame({"channel": np.full(gain.size, r.channel, object), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "gain": gain.ravel().astype(float), "offset": offset.ravel().astype(float)})

    models = images.illumination_models(_light_tiles(spark, sf), rounds=LIGHT_ROUNDS)
    return models.select("channel", "m_height", "gain", "offset").mapInPandas(pixels, "channel string, y int, x int, gain double, offset double")


@query(FULL + """, c AS (SELECT s_suppkey % 60 AS cy, s_suppkey * 7 % 50 AS cx FROM supplier)
SELECT a.channel, CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx, CAST(a.y - cy + 4 AS INTEGER) AS y, CAST(a.x - cx + 4 AS INTEGER) AS x, CAST(v AS INTEGER) AS value FROM c JOIN a ON a.y BETWEEN cy - 4 AND cy + 4 AND a.x BETWEEN cx - 4 AND cx + 4 WHERE v > 0""")
def crops_of_cells(spark, sf):
    centres = table(spark, sf, "supplier").select(F.explode(F.array(*[F.lit(c) for c in "ANR"])).alias("channel"), (F.col("s_suppkey") % 60).cast("int").alias("y"), (F.col("s_suppkey") * 7 % 50).cast("int").alias("x"))
    cut = images.crops(_images(spark, sf), centres, 4, ["channel"], side=20, once=True).withColumnsRenamed({"y": "cy", "x": "cx"})
    pixels = codec.to_pixels(cut, ["channel", "cy", "cx", "times"]).where("value > 0")
    dealt = pixels.repartition(spark.sparkContext.defaultParallelism, "channel", "cy", "cx", "y", "x")  # few rows, each many times
    return dealt.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


@query("""WITH m AS (SELECT row_number() OVER (ORDER BY v) - 1 AS l, v FROM (SELECT round(count(*) / (SELECT count(*) FROM orders), 6) AS v FROM orders GROUP BY o_orderpriority))
SELECT a.range AS i, b.range AS j, l, a.range / 4.0 AS ye, b.range / 4.0 AS b, v AS r FROM range(5) a, range(5) b, m WHERE a.range + b.range + l = 4""")
def initial_centroids(spark, sf):
    """Corners of the grid: two axes without enough maxima fall back to equal steps, the third has the priorities' shares."""
    o = table(spark, sf, "orders")
    total = o.count()
    shares = [r["v"] for r in o.groupBy("o_orderpriority").agg(F.round(F.count("*") / total, 6).alias("v")).collect()]  # five priorities
    got = decode.initial_centroids(spark, 5, {"ye": [0.1, 0.9], "b": [], "r": shares})
    l_ = F.lit(4) - F.round(F.col("ye") * 4) - F.round(F.col("b") * 4)
    return got.select((F.col("ye") * 4).cast("long").alias("i"), (F.col("b") * 4).cast("long").alias("j"), l_.cast("long").alias("l"), "ye", "b", "r")


@query("""WITH q AS (SELECT DISTINCT p_size % 4 AS label, p_partkey * 7 % 40 AS y, p_partkey * 13 % 30 AS x, p_size FROM part), p AS (SELECT DISTINCT label, y, x FROM q WHERE (y - 20) * (y - 20) + (x - 15) * (x - 15) <= 60 + 2 * p_size),
e AS (SELECT a.label, a.y AS ay, a.x AS ax, b.y AS cy, b.x AS cx FROM p a JOIN p b ON a.label = b.label AND (a.y <> b.y OR a.x <> b.x)),
h AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.label = e.label AND (cy - ay) * (p.x - ax) - (cx - ax) * (p.y - ay) < 0)),
g AS (SELECT l.label, y.range AS y, x.range AS x FROM (SELECT DISTINCT label FROM p) l, range(40) y, range(30) x)
SELECT CAST(label AS INTEGER) AS label, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.label = g.label AND (cy - ay) * (g.x - ax) - (cx - ax) * (g.y - ay) < 0)""")
def filled_hulls(spark, sf):
    """Parts as pixels of four labels, their hulls filled."""
    p = table(spark, sf, "part").select((F.col("p_size") % 4).cast("int").alias("label"), (F.col("p_partkey") * 7 % 40).cast("int").alias("y"), (F.col("p_partkey") * 13 % 30).cast("int").alias("x"), "p_size")
    near = (F.col("y") - 20) * (F.col("y") - 20) + (F.col("x") - 15) * (F.col("x") - 15) <= 60 + 2 * F.col("p_size")
    return images.hull_filled(p.where(near).select("label", "y", "x").distinct(), ("y", "x"))


@query("SELECT DISTINCT 2 AS cycle, CAST(ascii(l_returnflag) AS INTEGER) AS tile, -3 AS dy, 5 AS dx FROM lineitem")
def cycle_offsets(spark, sf):
    """The offsets of a second cycle in which every tile's pixels have moved by (3, -5), from the images alone."""

    def draw(frame):
        import pandas as pd

        a = np.zeros((48, 40), "<u2")
        a[frame["y"], frame["x"]] = frame["value"]
        one = frame[["cycle", "tile", "channel"]].iloc[:1].reset_index(drop=True)
        return pd.concat([one, pd.DataFrame([{"height": 48, "width": 40, "pixels": a.tobytes()}])], axis=1)

    t = table(spark, sf, "lineitem").select(F.ascii("l_returnflag").alias("tile"), F.explode(F.array(F.lit(1), F.lit(2))).alias("cycle"), "l_partkey", "l_orderkey", "l_quantity")
    moved = F.when(F.col("cycle") == 2, 1).otherwise(0)
    px = t.groupBy("cycle", "tile", F.lit("DAPI").alias("channel"), ((F.col("l_partkey") + 3 * moved) % 48).alias("y"), ((F.col("l_orderkey") + 35 * moved) % 40).alias("x")).agg(F.sum("l_quantity").alias("value"))
    drawn = _grey(px, ["cycle", "tile", "channel"]).groupBy("cycle", "tile", "channel").applyInPandas(draw, "cycle int, tile int, channel string, height int, width int, pixels binary")
    return images.registered(drawn, 1, "DAPI")[0]


@query("SELECT DISTINCT CAST(ascii(l_returnflag) AS INTEGER) AS tile, 1 AS dz, 2 AS dy, -1 AS dx, 0 AS turned FROM lineitem")
def volume_shifts(spark, sf):
    """Volumes drawn from order lines against themselves moved by (1, 2, -1): the shift comes back, and no turn."""
    from mosaicq.functions import kernels

    def draw(moved: bool):
        def run(frame):
            import pandas as pd

            a = np.zeros((12, 24, 22))
            np.add.at(a, (frame["z"], frame["y"], frame["x"]), frame["value"])
            a = kernels.gaussian(a, 2.0)
            a = np.rint(a / a.max() * 20000).astype("<u2")
            a = np.roll(a, (1, 2, -1), (0, 1, 2)) if moved else a
            return pd.DataFrame([(frame["tile"].iloc[0], z, 24, 22, p.tobytes()) for z, p in enumerate(a)], columns=["tile", "z", "height", "width", "pixels"])

        t = table(spark, sf, "lineitem")
        px = t.groupBy(F.ascii("l_returnflag").alias("tile"), (F.col("l_orderkey") % 12).alias("z"), (F.col("l_partkey") % 24).alias("y"), (F.expr("l_orderkey div 12 + l_linenumber") % 22).alias("x")).agg(F.sum("l_quantity").alias("value"))
        return px.groupBy("tile").applyInPandas(run, "tile int, z int, height int, width int, pixels binary")

    found = registration.rigid_transforms(draw(False), draw(True), ["tile"], first_step=1.0, least_step=0.05, rounds=30, side=24)
    rows = [(*key, *(int(round(v)) for v in t.shift), int(np.abs(np.degrees(t.angles)).max() > 1.5)) for key, t in found.items()]
    return spark.createDataFrame(rows, "tile int, dz int, dy int, dx int, turned int")


@query("SELECT n_nationkey AS cycle FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey = 0")
def cycle_discovery(spark, sf):
    return tables.odd_cycles(table(spark, sf, "nation").select(F.col("n_nationkey").alias("cycle")), with_zero=True)


@query("SELECT c_custkey AS cell_id, c_mktsegment AS type, o_orderstatus AS gene, count(*) AS cnt FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def cells_round_trip(spark, sf):
    path = fresh_path(spark, "cells")
    obs = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("type"))
    expr = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.col("o_orderstatus").alias("gene")).agg(F.count("*").alias("cnt"))
    sinks.write_cells(obs, expr.select("gene").distinct(), expr, path)
    obs, var, expr = sinks.read_cells(spark, path)
    return expr.join(var, "gene", "left_semi").join(obs, "cell_id").select("cell_id", "type", "gene", "cnt")


@query("SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'west' ELSE 'north' END || '-file: t' || n_nationkey || '.tif; corr: ' || printf('%.10f', CASE WHEN n_nationkey % 6 = 0 THEN -1.0 ELSE n_nationkey / 32.0 END) || '; position: (' || (n_nationkey - 7) || ', ' || n_regionkey || '); grid: (' || (n_nationkey % 5) || ', ' || (n_nationkey // 5) || ');' AS line FROM nation")
def translation_records(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    corr = F.when(k % 6 == 0, F.when(k % 12 == 0, F.lit(None)).otherwise(F.lit(float("nan")))).otherwise(k / 32.0)
    rows = n.select(F.when(F.col("n_regionkey") % 2 == 0, "west").otherwise("north").alias("side"), F.format_string("t%d.tif", k).alias("file"), corr.cast("double").alias("corr"), (k - 7).alias("dx"), F.col("n_regionkey").alias("dy"), (k % 5).alias("grid_c"), F.expr("n_nationkey div 5").cast("int").alias("grid_r"))
    path = fresh_path(spark, "translations")
    sinks.write_translations(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT 'run-' || r_regionkey AS run_id, r_name AS stage, '{\"grade\": ' || r_regionkey || '}' AS settings FROM region")
def run_metadata(spark, sf):
    path = fresh_path(spark, "runs")
    r = table(spark, sf, "region")
    sinks.write_runs(r.select(F.format_string("run-%d", "r_regionkey").alias("run_id"), F.col("r_name").alias("stage"), F.format_string('{"grade": %d}', "r_regionkey").alias("settings")), path)
    return spark.read.parquet(path).where(F.col("at") <= F.current_timestamp()).select("run_id", "stage", "settings")


@query("SELECT CAST(n_nationkey AS INTEGER) AS cycle FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey > 0 AND n_nationkey <> 8")
def watched_cycles(spark, sf):
    """Folders whose marker has appeared are taken up once, but for a cycle that is done already."""
    from pyarrow import fs

    folder, checkpoint, seen = fresh_path(spark, "cycles"), fresh_path(spark, "cycles-checkpoint"), fresh_path(spark, "cycles-seen")

    def mark(frames):
        store, base = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for key in frame["n_nationkey"]:
                name = f"{base}/cyc_{key}"
                store.create_dir(name, recursive=True)
                with store.open_output_stream(f"{name}/{watch.MARKER if key % 2 == 0 else 'started.txt'}") as f:
                    f.write(b"x")
            yield frame[["n_nationkey"]]

    table(spark, sf, "nation").select("n_nationkey").mapInPandas(mark, "n_nationkey long").write.format("noop").mode("overwrite").save()

    def take(session, cycle, path):
        session.range(1).select(F.lit(cycle).alias("cycle")).write.mode("append").parquet(seen)

    for _ in range(2):  # the second time nothing is new
        watch.run_available(watch.finished_cycles(spark, folder), take, lambda cycle: cycle == 8, checkpoint)
    return spark.read.schema("cycle int").parquet(seen)


@query("SELECT 'img-' || n_nationkey || '.tif' AS name FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0")
def paired_files(spark, sf):
    images_at, masks_at = fresh_path(spark, "pair-images"), fresh_path(spark, "pair-masks")
    one = F.lit(np.ones((2, 3), "<u2").tobytes())
    n = table(spark, sf, "nation").select("n_nationkey", F.format_string("img-%d.tif", "n_nationkey").alias("name"), F.lit(2).alias("height"), F.lit(3).alias("width"), one.alias("pixels"))
    for part, path in ((n.where("n_nationkey % 3 = 0"), images_at), (n.where("n_nationkey % 2 = 0"), masks_at)):
        sinks.write_images(part, path).collect()
    return readers.paired_files(spark, images_at, masks_at).select("name")


# ---------------------------------------------------------------- sampling and streams


def _drawn(seed: int, key: str) -> str:
    """SQL of the draw of a key."""
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 15) AS BIGINT)"


@query(f"SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_drawn(0, 'event_id')}, event_id) <= 20")
def sampled_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return tables.sample_each(e, "event_type", 20, ["event_id"])


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY {_drawn(7, "l_orderkey || '|' || l_linenumber || '|' || l_quantity")}, 1, 2, 3 LIMIT 500")
def subsampled_rows(spark, sf):
    """A sample of a fixed number of rows; the number is the feature. Order and line repeat, all three columns tell rows apart."""
    return tables.sample_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 500, ["l_orderkey", "l_linenumber", "l_quantity"], seed=7)


@query(f"""WITH e AS (SELECT list_transform(range(0, 20), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-0.5) * pow(0.5, j) / factorial(CAST(j AS INTEGER))))) AS ends),
d AS (SELECT o_orderkey, len(list_filter(ends, lambda x: x <= {_drawn(1, 'o_orderkey')} / 1152921504606846976.0)) AS copies FROM orders, e)
SELECT o_orderkey, copies FROM d, range(0, 20) r WHERE r.range < copies""")
def drawn_with_replacement(spark, sf):
    """Orders drawn with replacement at half their number: each as often as a Poisson draw says, with that number."""
    drawn = tables.bootstrap(table(spark, sf, "orders").select("o_orderkey"), 0.5, ["o_orderkey"])
    times = drawn.groupBy("o_orderkey").agg(F.count("*").alias("copies"))
    return drawn.join(times, "o_orderkey")


@query(f"SELECT event_id, CASE WHEN {_drawn(42, 'event_id')} / 1152921504606846976.0 < 0.1 THEN 'held' ELSE 'train' END AS part FROM events")
def train_split(spark, sf):
    train, held = tables.split_train(table(spark, sf, "events").select("event_id"), ["event_id"])
    return tables.stacked([train.withColumn("part", F.lit("train")), held.withColumn("part", F.lit("held"))])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_counts(spark, sf):
    """The tumbling counts of a stream that ends when all that is there has been read."""
    out, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    counts = windows.tumbling(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
