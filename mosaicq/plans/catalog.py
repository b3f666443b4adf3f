"""The engine's own queries over the driver tables, with equivalent DuckDB SQL.

Role of the tables: lineitem rows are four-channel spots, events are points with a priority,
embeddings are cells' feature vectors, customers and order lines are cell by gene counts, and a
part's name is a list of genes of one barcode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaicq.functions import features as fx
from mosaicq.operators import cells, communities, decode, graph, harmony, layout, spatial, stats, tables
from mosaicq.streaming import windows
from mosaicq.workspace import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- spots


def spots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"),
        F.col("l_quantity").alias("r"), (F.col("l_extendedprice") / 1000).alias("ye"), (F.col("l_discount") * 100).alias("g"), (F.col("l_tax") * 100).alias("b"),
    )


SPOTS = "WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS y, l_suppkey AS x, l_quantity AS r, l_extendedprice / 1000 AS ye, l_discount * 100 AS g, l_tax * 100 AS b FROM lineitem)"
SCALED = SPOTS + """,
a AS (SELECT k, n, y, x, r, ye, g, greatest(b - g * 0.25, 0) AS b FROM s),
t AS (SELECT k, n, y, x, r AS sr, ye AS sye, g * 2.5 AS sg, b * 0.75 AS sb, r + ye + b * 0.75 AS total FROM a)"""


def _scaled(spark, sf):
    out = spots(spark, sf).withColumn("b", fx.without_crosstalk(F.col("b"), F.col("g")))
    c = fx.scaled({k: F.col(k) for k in ("r", "ye", "g", "b")}, {"g": 2.5, "b": 0.75})
    out = out.select("k", "n", "y", "x", *[v.alias(f"s{k}") for k, v in c.items()])
    return out.withColumn("total", F.col("sr") + F.col("sye") + F.col("sb"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) * sum(count(*)) OVER () / (sum(count(*)) OVER (PARTITION BY l_returnflag) * sum(count(*)) OVER (PARTITION BY l_linestatus)), 6) AS roe FROM lineitem GROUP BY 1, 2")
def roe_flag_status(spark, sf):
    return stats.observed_over_expected(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").withColumn("roe", r6("roe"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS n_{s}" for s in SEGMENTS) + " FROM customer GROUP BY 1")
def expr_matrix_nation_segment(spark, sf):
    return tables.pivot_counts(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment", SEGMENTS, "n_")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS pct FROM orders GROUP BY 1, 2")
def composition_pct(spark, sf):
    return stats.composition(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("pct", r6("pct"))


@query(SCALED + " SELECT k, n, round(sr, 6) AS sr, round(sye, 6) AS sye, round(sg, 6) AS sg, round(sb, 6) AS sb, round(total, 6) AS total, round(least(sg / total, 5), 6) AS g_a FROM t")
def crosstalk_scale_sum(spark, sf):
    out = _scaled(spark, sf)
    g_a = fx.clamp_above(fx.ratio(F.col("sg"), F.col("total")), 5.0)
    return out.select("k", "n", *[r6(c).alias(c) for c in ("sr", "sye", "sg", "sb", "total")], r6(g_a).alias("g_a"))


@query(SCALED + ", q AS (SELECT *, sg / total AS g_a FROM t) SELECT k, n, round(total, 6) AS total FROM q WHERE (total >= 60 OR (g_a >= 0.3 AND sg > 15)) AND total > 20 AND total < 120")
def panel_filter(spark, sf):
    out = _scaled(spark, sf).withColumns({"sum": F.col("total"), "scaled_g": F.col("sg"), "g_a": fx.ratio(F.col("sg"), F.col("total"))})
    out = fx.panel_filter(out, strict=False, limit=60, g_ratio=0.3, g_limit=15)
    return out.where((F.col("sum") > 20) & (F.col("sum") < 120)).select("k", "n", r6("total").alias("total"))


@query(SCALED + """,
q AS (SELECT k, n, sr / total AS ra, sye / total AS ya, sb / total AS ba, least(sg / total, 5) AS ga FROM t),
f AS (SELECT k, n, ra, ya, ga * exp(0.6 * ya) AS ga, ba FROM q),
h AS (SELECT k, n, ra, ya, ln(1 + log10(1 + ga)) AS ga, ba * exp(0.1 * ga) AS ba FROM f),
u AS (SELECT k, n, ga, ra / (ra + ya + ba) AS ra, ya / (ra + ya + ba) AS ya, ba / (ra + ya + ba) AS ba FROM h)
SELECT k, n, round(ga, 6) AS g_a, round(ra, 6) AS r_a, round(ya, 6) AS ye_a, round(ba, 6) AS b_a, round((ba - ya) * sqrt(2) / 2, 6) AS cd_1, round(ra * sqrt(2) / 2 - (ya + ba) / 2, 6) AS cd_2, round(2 * ra - 1, 6) AS cx, round(ba - ya, 6) AS cy FROM u""")
def ratio_simplex_project(spark, sf):
    out = fx.readout_features(spots(spark, sf))
    cx, cy = fx.colour_xy(F.col("r_a"), F.col("b_a"), F.col("ye_a"))
    return out.select("k", "n", *[r6(c).alias(c) for c in ("g_a", "r_a", "ye_a", "b_a", "cd_1", "cd_2")], r6(cx).alias("cx"), r6(cy).alias("cy"))


@query("SELECT p_partkey, CASE WHEN p_retailprice >= 900 AND p_retailprice < 1200 THEN 0 WHEN p_retailprice >= 1200 AND p_retailprice < 1500 THEN 1 WHEN p_retailprice >= 1500 AND p_retailprice < 1800 THEN 2 END AS layer FROM part")
def layer_cut(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fx.cut(F.col("p_retailprice"), [900, 1200, 1500, 1800]).alias("layer"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 3 WHEN c_acctbal >= 5000 THEN 2 WHEN c_acctbal >= 2000 THEN 1 WHEN c_acctbal >= 0 THEN 0 ELSE -2 END AS grade FROM customer")
def grade_binning(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fx.graded(F.col("c_acctbal"), {0: 0, 1: 2000, 2: 5000, 3: 8000}).alias("grade"))


@query("SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value, 0.98) FROM events)")
def quantile_filter(spark, sf):
    return stats.above_quantile(table(spark, sf, "events").select("event_id", "value"), "value", 0.98)


@query("SELECT event_id, event_type, value FROM events JOIN (SELECT event_type AS g, quantile_cont(value, 0.9) AS q FROM events GROUP BY 1) ON event_type = g WHERE value > q")
def group_quantile_threshold(spark, sf):
    return stats.above_group_quantile(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "value", 0.9)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 10)")
def group_size_filter(spark, sf):
    return stats.in_large_groups(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 10)


@query("SELECT r.range AS label, coalesce(c.n, 0) AS n FROM range(-2, 13) r LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) c ON c.label = r.range")
def label_hist_complete(spark, sf):
    return stats.complete_histogram(table(spark, sf, "embeddings"), "label", -2, 12)


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) * 40 / (hi - lo)), 39) AS BIGINT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def hist1d(spark, sf):
    return stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 40)


@query("SELECT CAST(least(floor(l_quantity * 25 / 50), 24) AS BIGINT) AS bx, CAST(least(floor(l_discount * 25 / 0.1), 24) AS BIGINT) AS by, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2")
def hist2d(spark, sf):
    return stats.histogram2d(table(spark, sf, "lineitem"), "l_quantity", "l_discount", (0, 50), (0, 0.1), 25)


@query("""WITH h AS (SELECT CAST(least(floor(l_quantity * 25 / 50), 24) AS BIGINT) AS bx, CAST(least(floor(l_discount * 25 / 0.1), 24) AS BIGINT) AS byy, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2),
d AS (SELECT coalesce(n, 0) AS n FROM (SELECT x.range AS bx, y.range AS byy FROM range(25) x, range(25) y) LEFT JOIN h USING (bx, byy)) SELECT round(quantile_cont(CAST(n AS DOUBLE), 0.998), 6) AS value FROM d""")
def hist2d_percentile(spark, sf):
    return stats.dense_percentile(hist2d(spark, sf), 0.998, 625).select(r6("value").alias("value"))


@query("SELECT CAST(floor(l_partkey / 100) AS BIGINT) AS by, CAST(floor(l_suppkey / 100) AS BIGINT) AS bx, count(DISTINCT (l_partkey, l_suppkey)) AS n_pixels FROM lineitem GROUP BY 1, 2")
def density_blocks(spark, sf):
    return stats.block_occupancy(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", 100)


@query("SELECT CAST(floor(l_partkey / 64) AS BIGINT) AS by, CAST(floor(l_suppkey / 64) AS BIGINT) AS bx, count(*) AS n FROM lineitem GROUP BY 1, 2")
def density_counts(spark, sf):
    return stats.block_counts(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", 64)


@query("SELECT label, d, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS d, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2")
def centroid_by_label(spark, sf):
    out = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    return out.groupBy("label", F.col("p").cast("long").alias("d")).agg(r6(F.avg(F.col("v").cast("double"))).alias("mean"))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_q, round(avg(l_discount), 6) AS mean_d, round(covar_samp(l_quantity, l_quantity), 6) AS cov_q_q, round(covar_samp(l_quantity, l_discount), 6) AS cov_q_d, round(covar_samp(l_discount, l_discount), 6) AS cov_d_d FROM lineitem GROUP BY 1")
def label_cov(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    out = stats.label_covariance(df, "l_returnflag", ["q", "d"])
    return out.select("l_returnflag", *[r6(c).alias(c) for c in out.columns[1:]])


P_VALUES = """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS label, l_quantity AS q, l_extendedprice / 1000 AS e FROM lineitem),
m AS (SELECT label AS component, avg(q) AS mq, avg(e) AS me, covar_samp(q, q) AS qq, covar_samp(q, e) AS qe, covar_samp(e, e) AS ee FROM f GROUP BY 1),
p AS (SELECT k, n, label, component, exp(-(((q - mq) * (q - mq) * ee - 2 * (q - mq) * (e - me) * qe + (e - me) * (e - me) * qq) / (qq * ee - qe * qe)) / 2) AS p FROM f, m)
"""


def _p_values(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("e"))
    return decode.label_p_values(df, "label", ["q", "e"])


ORACLE_ROUNDED_P = P_VALUES + "SELECT k, n, label, component, round(p, 5) AS p FROM p"


@query(ORACLE_ROUNDED_P)
def mahalanobis_pvalue(spark, sf):
    return _p_values(spark, sf).select("k", "n", "label", "component", F.round("p", 5).alias("p"))


@query(P_VALUES + "SELECT label, component, round(avg(CAST(p > 0.45 AS DOUBLE)), 6) AS frac FROM p GROUP BY 1, 2")
def overlap_matrix(spark, sf):
    return stats.overlap(_p_values(spark, sf), 0.45).withColumn("frac", r6("frac"))


@query(P_VALUES + "SELECT k, n, label FROM p WHERE label = component AND p > 0.3")
def confident_spots(spark, sf):
    return decode.confident(_p_values(spark, sf), "label", 0.3).select("k", "n", "label")


@query(P_VALUES + """, t AS (SELECT label, component, range / 50.0 AS threshold, p FROM p, range(50)),
o AS (SELECT threshold, label, component, avg(CAST(p > threshold AS DOUBLE)) AS frac FROM t GROUP BY 1, 2, 3),
s AS (SELECT threshold, label, sum(frac) FILTER (WHERE label = component) AS d, sum(frac) AS s FROM o GROUP BY 1, 2)
SELECT round(threshold, 6) AS threshold, round(avg(CASE WHEN s > 0 THEN d / s END), 5) AS accuracy FROM s GROUP BY 1""")
def accuracy_curve(spark, sf):
    return stats.accuracy_curve(_p_values(spark, sf)).select(r6("threshold").alias("threshold"), F.round("accuracy", 5).alias("accuracy"))


COUNTS = "WITH c AS (SELECT c_nationkey AS cell_id, c_mktsegment AS gene, count(*) AS cnt FROM customer GROUP BY 1, 2)"


def _counts(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cell_id"), F.col("c_mktsegment").alias("gene")).agg(F.count("*").alias("cnt"))


DENSE = COUNTS + ", d AS (SELECT a.cell_id, b.gene, coalesce(c.cnt, 0) AS cnt FROM (SELECT DISTINCT cell_id FROM c) a CROSS JOIN (SELECT DISTINCT gene FROM c) b LEFT JOIN c ON c.cell_id = a.cell_id AND c.gene = b.gene)"


@query(DENSE + ", s AS (SELECT cell_id, gene, cnt / sum(cnt) OVER (PARTITION BY gene) AS x FROM d) SELECT p.gene AS a, q.gene AS b, CASE WHEN p.gene <> q.gene THEN round(corr(p.x, q.x), 6) END AS r FROM s p JOIN s q USING (cell_id) GROUP BY 1, 2")
def gene_corr_matrix(spark, sf):
    share = cells.column_share(_counts(spark, sf))
    return stats.correlation_matrix(share, "cell_id", "gene", "share").withColumn("r", r6("r"))


@query(DENSE + """, k AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY cnt) + (count(*) OVER (PARTITION BY gene, cnt) - 1) / 2.0 AS x FROM d)
SELECT p.gene AS a, q.gene AS b, CASE WHEN p.gene <> q.gene THEN round(corr(p.x, q.x), 6) END AS r FROM k p JOIN k q USING (cell_id) GROUP BY 1, 2""")
def gene_rank_corr(spark, sf):
    return stats.spearman_matrix(_counts(spark, sf), "cell_id", "gene", "cnt").withColumn("r", r6("r"))


@query("WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_tax) AS mean, avg(CAST(l_tax > 0 AS DOUBLE)) AS frac_positive FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, round(mean, 6) AS mean, round(frac_positive, 6) AS frac_positive, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY l_linestatus)), 6) AS l2 FROM m")
def mean_expr_l2(spark, sf):
    out = stats.mean_expression(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_tax")
    return out.select("l_returnflag", "l_linestatus", *[r6(c).alias(c) for c in ("mean", "frac_positive", "l2")])


@query("SELECT CAST(g AS DOUBLE) AS g, round((SELECT count(*) FROM events WHERE value < g) / (SELECT count(*) FROM events), 6) AS ecdf FROM (SELECT unnest(range(0, 200, 10)) AS g)")
def ecdf_lookup(spark, sf):
    grid = spark.range(0, 200, 10).select(F.col("id").cast("double").alias("g"))
    return stats.ecdf(table(spark, sf, "events"), "value", grid).withColumn("ecdf", r6("ecdf"))


LINES = "WITH e AS (SELECT o_custkey AS cell_id, l_suppkey % 40 AS gene, count(*) AS cnt FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def _line_counts(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 40).alias("gene"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("cell_id", "gene").agg(F.count("*").alias("cnt"))


@query(LINES + """, ok AS (SELECT cell_id FROM e GROUP BY 1 HAVING count(*) >= 10 AND sum(cnt) >= 30 AND sum(cnt) <= 70),
l AS (SELECT * FROM e WHERE cell_id IN (SELECT cell_id FROM ok)), g AS (SELECT gene FROM l GROUP BY 1 HAVING count(DISTINCT cell_id) >= 20)
SELECT cell_id, gene, cnt FROM l WHERE gene IN (SELECT gene FROM g)""")
def qc_metrics_filter(spark, sf):
    return cells.qc_filter(_line_counts(spark, sf), 10, 30, 70, 20).select("cell_id", "gene", "cnt")


@query(DENSE + """, t AS (SELECT cell_id, sum(cnt) AS t FROM c GROUP BY 1), x AS (SELECT d.cell_id, gene, cnt * (SELECT median(t) FROM t) / t AS x FROM d JOIN t USING (cell_id))
SELECT cell_id, gene, round(x, 6) AS x, round(coalesce((x - avg(x) OVER (PARTITION BY gene)) / nullif(stddev_samp(x) OVER (PARTITION BY gene), 0), 0), 6) AS z FROM x""")
def zscore_normalise_total(spark, sf):
    return cells.normalised(_counts(spark, sf), dense=True).select("cell_id", "gene", r6("x").alias("x"), r6("z").alias("z"))


# ---------------------------------------------------------------- space


def _points(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("y"), (F.col("value") * 4).alias("x"), F.col("value").alias("sum"), "event_type")


@query("""WITH p AS (SELECT event_id AS id, user_id AS y, value * 4 AS x FROM events), c AS (SELECT c_custkey AS cell_id, c_custkey % 150 AS y, abs(c_acctbal) % 400 AS x FROM customer),
d AS (SELECT p.id, c.cell_id, (p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x) AS d2 FROM p, c WHERE abs(p.y - c.y) < 3 AND abs(p.x - c.x) < 3)
SELECT id, cell_id, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cell_id) AS r FROM d WHERE d2 < 9) WHERE r = 1""")
def nearest_neighbor_radius(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), (F.col("c_custkey") % 150).alias("y"), (F.abs("c_acctbal") % 400).alias("x"))
    return spatial.nearest_within(_points(spark, sf), c, 3).withColumn("distance", r6("distance"))


@query("""WITH p AS (SELECT event_id AS id, user_id AS y, value * 4 AS x FROM events)
SELECT a.id AS a, b.id AS b, round(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), 6) AS distance FROM p a JOIN p b ON a.id < b.id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2
WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4""")
def radius_pairs(spark, sf):
    return spatial.radius_pairs(_points(spark, sf), 2).withColumn("distance", r6("distance"))


def _nms_sql(radius: int, also: str, columns: str) -> str:
    """Greedy suppression as turns: a point is gone with a kept better neighbour, kept once no better one is open."""
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT event_id AS id, user_id AS y, value * 4 AS x, value AS sum, event_type FROM events),
n AS MATERIALIZED (SELECT a.id AS lo, b.id AS hi FROM p a JOIN p b ON a.id <> b.id AND abs(a.y - b.y) <= {radius} AND abs(a.x - b.x) <= {radius}
  WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {radius * radius}{also} AND (b.sum > a.sum OR (b.sum = a.sum AND b.id < a.id))),
s AS (SELECT id, 0 AS turn, 'open' AS state FROM p
  UNION ALL SELECT s.id, s.turn + 1, CASE WHEN s.state <> 'open' THEN s.state WHEN kept THEN 'gone' WHEN undecided THEN 'open' ELSE 'kept' END
  FROM s LEFT JOIN (SELECT n.lo, bool_or(b.state = 'kept') AS kept, bool_or(b.state = 'open') AS undecided FROM n JOIN s b ON b.id = n.hi GROUP BY n.lo) m ON m.lo = s.id
  WHERE EXISTS (SELECT 1 FROM s WHERE state = 'open'))
SELECT {columns} FROM p JOIN s USING (id) WHERE turn = (SELECT max(turn) FROM s) AND state = 'kept'"""


@query(_nms_sql(2, "", "id, y, x, sum"))
def radius_nms(spark, sf):
    return spatial.suppress_within(_points(spark, sf), 2).select("id", "y", "x", "sum")


@query(_nms_sql(4, " AND a.event_type = b.event_type", "id, event_type, sum"))
def per_group_nms(spark, sf):
    return spatial.suppress_within(_points(spark, sf), 4, group=["event_type"]).select("id", "event_type", "sum")


KNN = """WITH d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS d2 FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
e AS (SELECT src, dst, d2, r FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS r FROM d) WHERE r <= 5)
"""


def _knn(spark, sf):
    return spatial.knn(table(spark, sf, "embeddings"), 5, "vec_id", "embedding")


@query(KNN + "SELECT src, dst, round(d2, 5) AS d2, CAST(r AS INTEGER) AS rank FROM e")
def knn_k(spark, sf):
    return _knn(spark, sf).withColumn("d2", F.round("d2", 5))


@query()
def cell_layout(spark, sf):
    """Places of the cells in the plane, from their neighbour graph and their first two directions."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    edges = materialise(communities.fuzzy_weights(spatial.knn(e, 15, "vec_id", "v")), "cell-graph")
    start = cells.principal_components(e, 2).select(F.col("vec_id").alias("id"), F.col("pcs")[0].alias("y"), F.col("pcs")[1].alias("x"))
    return layout.layout(edges, start, rounds=20).withColumnRenamed("id", "vec_id")


INTEGRATION = harmony.Settings(clusters=8, corrections=2, rounds=2, blocks=2)


def _batches(spark, sf):
    """Scores of the cells on eight directions, dealt into three batches."""
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("b"), F.col("vec_id") % 3).alias("batch"), F.col("embedding").alias("v"))
    return cells.principal_components(e, 8).select("vec_id", "batch", "pcs")


@query()
def integrated_cells(spark, sf):
    """The cells' scores without what tells their batches apart."""
    out = harmony.integrated(_batches(spark, sf), "vec_id", "batch", "pcs", INTEGRATION)
    return out.select("vec_id", "batch", F.transform("integrated", lambda x: F.round(x, 6)).alias("integrated"))


@query()
def cell_communities(spark, sf):
    """Communities of the cells' neighbour graph, its distances turned to weights."""
    edges = communities.fuzzy_weights(spatial.knn(table(spark, sf, "embeddings"), 15, "vec_id", "embedding"))
    return communities.leiden(materialise(edges, "cell-graph"), iterations=1).withColumnRenamed("node", "vec_id")


@query(KNN + "SELECT a.label AS src_label, b.label AS dst_label, count(*) AS n_edges FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst GROUP BY 1, 2")
def interaction_matrix(spark, sf):
    return spatial.interactions(_knn(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"))


@query(KNN + ", v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) - (SELECT avg(CAST(embedding[1] AS DOUBLE)) FROM embeddings) AS z FROM embeddings) SELECT round((SELECT count(*) FROM v) / sum(1.0) * sum(a.z * b.z) / (SELECT sum(z * z) FROM v), 6) AS morans_i FROM e JOIN v a ON a.vec_id = src JOIN v b ON b.vec_id = dst")
def morans_i(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("value"))
    return spatial.morans_i(_knn(spark, sf).withColumn("weight", F.lit(1.0)), v).select(r6("morans_i").alias("morans_i"))


@query()
def neighbourhood_enrichment(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return spatial.enrichment(_knn(spark, sf), labels)


CO = """WITH p AS (SELECT event_id AS id, user_id AS y, value * 4 AS x, event_type AS label FROM events),
q AS (SELECT CAST(least(floor(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) * 3 / 4.0), 2) AS BIGINT) AS ring, a.label AS given, b.label AS label FROM p a JOIN p b ON a.id <> b.id AND abs(a.y - b.y) <= 4 AND abs(a.x - b.x) <= 4 WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 16),
n AS (SELECT ring, given, label, count(*) AS n FROM q GROUP BY 1, 2, 3)
SELECT ring, given, label, n, round((n / sum(n) OVER (PARTITION BY ring, given)) / (sum(n) OVER (PARTITION BY ring, label) / sum(n) OVER (PARTITION BY ring)), 6) AS ratio FROM n"""


@query(CO)
def co_occurrence(spark, sf):
    return spatial.co_occurrence(_points(spark, sf).withColumnRenamed("event_type", "label"), 4, 3).withColumn("ratio", r6("ratio"))


@query("""WITH b AS (SELECT p_partkey AS box, p_partkey * 7 % 1400 AS y0, p_partkey * 13 % 9000 AS x0, 20 AS h, 50 AS w FROM part)
SELECT box, o_orderkey FROM orders JOIN b ON o_custkey >= y0 AND o_custkey < y0 + h AND o_orderkey % 9000 >= x0 AND o_orderkey % 9000 < x0 + w""")
def point_in_box(spark, sf):
    p = table(spark, sf, "part")
    b = p.select(F.col("p_partkey").alias("box"), (F.col("p_partkey") * 7 % 1400).alias("y0"), (F.col("p_partkey") * 13 % 9000).alias("x0"), F.lit(20).alias("h"), F.lit(50).alias("w"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("y"), (F.col("o_orderkey") % 9000).alias("x"))
    return spatial.points_in_boxes(o, b, 50).select("box", "o_orderkey")


@query("""WITH t AS (SELECT a.range AS ty, b.range AS tx FROM range(4) a, range(3) b), p AS (SELECT l_orderkey AS k, l_linenumber AS n, l_orderkey % 4 AS ty, l_orderkey % 3 AS tx, l_partkey % 600 AS y, l_suppkey % 500 AS x FROM lineitem)
SELECT k, n, ty AS tile_y, tx AS tile_x, y, x FROM p WHERE y BETWEEN ty * 150 + CASE WHEN ty = 0 THEN 0 ELSE 10 END AND ty * 150 + 190 - CASE WHEN ty = 3 THEN 0 ELSE 10 END AND x BETWEEN tx * 160 + CASE WHEN tx = 0 THEN 0 ELSE 10 END AND tx * 160 + 200 - CASE WHEN tx = 2 THEN 0 ELSE 10 END""")
def tile_halo_ownership(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") % 4).cast("int").alias("tile_y"), (F.col("l_orderkey") % 3).cast("int").alias("tile_x"), (F.col("l_partkey") % 600).alias("y"), (F.col("l_suppkey") % 500).alias("x"))
    t = spatial.tile_table(spark, 600, 480, 48400, 40).withColumns({"pad_y": F.col("tile_y") * 150, "pad_x": F.col("tile_x") * 160, "cut_y": F.lit(190), "cut_x": F.lit(200), "n_y": F.lit(4), "n_x": F.lit(3)})
    return spatial.owned_by_tile(p, t, trim=10).select("k", "n", F.col("tile_y").cast("long"), F.col("tile_x").cast("long"), "y", "x")


@query("SELECT l_orderkey, l_linenumber, round(l_partkey * cos(atan(0.5)) + l_suppkey * sin(atan(0.5)), 6) AS d FROM lineitem")
def direction_projection(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(fx.direction(F.col("l_partkey"), F.col("l_suppkey"))).alias("d"))


@query("""WITH m AS (SELECT r.range AS row, c.range AS col, 1 + (r.range + c.range) % 3 AS label FROM range(20) r, range(20) c WHERE (r.range * 7 + c.range * 3) % 4 <> 0),
p AS (SELECT event_id AS id, user_id % 5 AS label, (user_id % 100) / 100.0 * 1.6 - 0.8 AS cd_1, (event_id % 140) / 100.0 - 0.6 + 0.005 AS cd_2, user_id % 2 = 0 AS layer FROM events),
q AS (SELECT *, CAST(trunc((0.8 - cd_2) * 20 / 1.4) AS INTEGER) AS row, CAST(trunc((cd_1 + 0.8) * 20 / 1.6 + 1e-9) AS INTEGER) AS col FROM p)
SELECT id, CASE WHEN layer AND m.label IS NOT NULL THEN m.label ELSE q.label END AS label FROM q LEFT JOIN m ON m.row = q.row AND m.col = q.col""")
def mask_relabel(spark, sf):
    rows, cols = spark.range(20).withColumnRenamed("id", "row"), spark.range(20).withColumnRenamed("id", "col")
    m = rows.crossJoin(cols).where("(row * 7 + col * 3) % 4 <> 0").select((1 + (F.col("row") + F.col("col")) % 3).alias("label"), F.col("row").cast("int"), F.col("col").cast("int"))
    p = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("label"), ((F.col("user_id") % 100) / 100.0 * 1.6 - 0.8 + 1e-10).alias("cd_1"), ((F.col("event_id") % 140) / 100.0 - 0.6 + 0.005).alias("cd_2"), (F.col("user_id") % 2 == 0).alias("layer"))
    return spatial.mask_relabelled(p, m, "replace", F.col("layer"), 20, 20).select("id", "label")


# ---------------------------------------------------------------- codes


@query("""WITH c AS (SELECT n_nationkey AS code, lpad(bin(n_nationkey * 37 % 1024), 10, '0') AS bits FROM nation), r AS (SELECT s_suppkey AS id, lpad(bin(s_suppkey * 53 % 1024), 10, '0') AS bits FROM supplier)
SELECT id, code, CAST(hamming(r.bits, c.bits) AS BIGINT) AS d FROM r, c WHERE hamming(r.bits, c.bits) <= 3""")
def hamming_codebook(spark, sf):
    c = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.lpad(F.bin((F.col("n_nationkey") * 37 % 1024).cast("long")), 10, "0").alias("cb"))
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lpad(F.bin(F.col("s_suppkey") * 53 % 1024), 10, "0").alias("rb"))
    return decode.within_substitutions(r, c, "rb", "cb", 3).select("id", "code", F.col("d").cast("long").alias("d"))


@query("""WITH c AS (SELECT 'g' || n_nationkey AS gene, lpad(bin(n_nationkey * 37 % 1024), 10, '0') AS code FROM nation), r AS (SELECT s_suppkey AS id, lpad(bin(s_suppkey * 53 % 1024), 10, '0') AS code FROM supplier),
h AS (SELECT id, max(CASE WHEN r.code = c.code THEN gene END) AS exact, count(DISTINCT c.code) AS n, max(gene) AS one FROM r JOIN c ON hamming(r.code, c.code) <= 1 GROUP BY 1)
SELECT r.id, CASE WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN one WHEN n > 1 THEN 'Ambiguous' END AS gene FROM r LEFT JOIN h ON h.id = r.id""")
def barcode_match(spark, sf):
    c = table(spark, sf, "nation").select(F.concat(F.lit("g"), F.col("n_nationkey")).alias("gene"), F.lpad(F.bin((F.col("n_nationkey") * 37 % 1024).cast("long")), 10, "0").alias("barcode"))
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lpad(F.bin(F.col("s_suppkey") * 53 % 1024), 10, "0").alias("sequence"))
    return decode.match_barcodes(r, c).select("id", F.col("match").alias("gene"))


CALLS = [("l_quantity", 25, "l_discount", 0.05), ("l_tax", 0.04, "l_quantity", 30), ("l_extendedprice", 30000, "l_tax", 0.03)]
CALL_SQL = " || ".join(f"CASE WHEN {a} >= {x} AND {b} >= {y} THEN 'A' WHEN {a} >= {x} THEN 'T' WHEN {b} >= {y} THEN 'C' ELSE 'G' END" for a, x, b, y in CALLS)


def _calls(spark, sf):
    seq = fx.sequence_of([fx.base_call(F.col(a), F.col(b), x, y) for a, x, b, y in CALLS])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", seq.alias("seq"))


@query(f"SELECT l_orderkey, l_linenumber, {CALL_SQL} AS seq FROM lineitem")
def base_call(spark, sf):
    return _calls(spark, sf)


@query(f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {CALL_SQL} AS seq FROM lineitem) WHERE length(seq) - length(replace(seq, 'A', '')) <= 1 AND length(seq) - length(replace(seq, 'G', '')) <= 1")
def seq_composition(spark, sf):
    return _calls(spark, sf).where(decode.balanced(F.col("seq"), {"A": 1, "G": 1}))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS gene FROM part")
def explode_plex(spark, sf):
    return tables.exploded_members(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("gene")), "gene", " ")


@query("SELECT k, n, channel, value FROM (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS r, l_discount AS g, l_tax AS b FROM lineitem) UNPIVOT (value FOR channel IN (r, g, b))")
def unpivot_channels(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("r"), F.col("l_discount").alias("g"), F.col("l_tax").alias("b"))
    return tables.unpivoted(s, ["k", "n"], ["r", "g", "b"], "channel", "value")


@query("SELECT n_nationkey, n_regionkey, coalesce(r_name, 'default_value') AS gene_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey")
def codebook_map_default(spark, sf):
    names = table(spark, sf, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("gene_name"))
    return tables.with_names(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", names, "gene_name", "default_value")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dictionary_replace(spark, sf):
    return tables.replaced(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "filled", "O": "open"})


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def dedup_keep_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return tables.keep_first(e, ["user_id", "event_type"], [F.desc("value"), "event_id"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_intensity(spark, sf):
    return tables.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("""SELECT 'both' AS part, k FROM (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'less', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'any', k FROM (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def set_ops(spark, sf):
    s, c, n = table(spark, sf, "supplier"), table(spark, sf, "customer"), table(spark, sf, "nation")
    both = tables.common_members([s.where("s_acctbal > 0").select(F.col("s_nationkey").alias("k")), c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))], "k")
    less = n.select(F.col("n_nationkey").alias("k")).exceptAll(s.where("s_acctbal > 5000").select("s_nationkey").distinct())
    either = tables.stacked_distinct([s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))])
    return tables.stacked([both.select(F.lit("both").alias("part"), "k"), less.select(F.lit("less").alias("part"), "k"), either.select(F.lit("any").alias("part"), "k")])


@query("SELECT CAST(r.range AS BIGINT) AS tile FROM range(1, 301) r WHERE r.range NOT IN (SELECT user_id FROM events WHERE value > 100)")
def missing_tiles(spark, sf):
    return tables.missing_members(spark, table(spark, sf, "events").where("value > 100").select(F.col("user_id").alias("tile")), "tile", 1, 300)


@query("WITH n AS (SELECT count(*) AS n FROM region) SELECT a.range AS k0, b.range AS k1, c.range AS k2 FROM n, range((SELECT n + 1 FROM n)) a, range((SELECT n + 1 FROM n)) b, range((SELECT n + 1 FROM n)) c WHERE a.range + b.range + c.range = n")
def combinations_sum(spark, sf):
    """Ways to deal the regions among three."""
    n = table(spark, sf, "region").count()
    out = tables.combinations(spark, n + 1, 3, n)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("""WITH h AS (SELECT l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT flag, bin, sum(n) OVER w AS n, sum(n * bin) OVER w AS s FROM h WINDOW w AS (PARTITION BY flag ORDER BY bin)), t AS (SELECT flag, max(n) AS n, max(s) AS s FROM c GROUP BY 1),
p AS (SELECT a.flag, a.bin AS t1, b.bin AS t2, a.s * a.s / a.n + (b.s - a.s) * (b.s - a.s) / (b.n - a.n) + (t.s - b.s) * (t.s - b.s) / (t.n - b.n) AS v FROM c a JOIN c b ON b.flag = a.flag AND b.bin > a.bin JOIN t ON t.flag = a.flag WHERE b.n < t.n)
SELECT flag AS l_returnflag, arg_max(t1, v) AS t1, arg_max(t2, v) AS t2 FROM p GROUP BY 1""")
def otsu_classes(spark, sf):
    """Two borders that part each flag's quantities best into three classes."""
    t = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    out = stats.otsu_thresholds(t, 3, ["l_returnflag"])
    return out.select("l_returnflag", F.col("thresholds")[0].alias("t1"), F.col("thresholds")[1].alias("t2"))


DAILY = "WITH d AS (SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS v FROM events GROUP BY 1)"


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))


@query(DAILY + " SELECT day, v FROM (SELECT day, v, lag(v) OVER (ORDER BY day) AS p, lead(v) OVER (ORDER BY day) AS q FROM d) WHERE v < p AND v < q")
def local_extrema(spark, sf):
    return stats.local_extrema(_daily(spark, sf), "day", "v")


@query(DAILY + """, n AS (SELECT day, v, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM d),
k AS (SELECT a.day, a.v, bool_and(a.v < b.v) AS ok FROM n a JOIN range(-5, 6) s ON s.range <> 0 JOIN n b ON b.i = greatest(1, least(a.n, a.i + s.range)) GROUP BY 1, 2)
SELECT day, v FROM k WHERE ok""")
def local_extrema_order5(spark, sf):
    return stats.local_extrema(_daily(spark, sf), "day", "v", order=5)


@query(DAILY + ", m AS (SELECT day FROM (SELECT day, v, lag(v) OVER (ORDER BY day) AS p, lead(v) OVER (ORDER BY day) AS q FROM d) WHERE v < p AND v < q) SELECT lo, hi FROM (SELECT lag(day) OVER (ORDER BY day) AS lo, day AS hi FROM m) WHERE lo IS NOT NULL")
def extrema_ranges(spark, sf):
    return stats.between_extrema(local_extrema(spark, sf), "day")


@query(DAILY + ", c AS (SELECT day, sum(v) OVER (ORDER BY day) / sum(v) OVER () AS y FROM d) SELECT day, round(y, 6) AS y FROM (SELECT *, lead(sign(y - 0.5)) OVER (ORDER BY day) AS nx FROM c) WHERE sign(y - 0.5) <> nx ORDER BY day LIMIT 1")
def first_crossing(spark, sf):
    d = _daily(spark, sf)
    c = d.select("day", (F.sum("v").over(Window.orderBy("day")) / F.sum("v").over(Window.partitionBy(F.lit(0)))).alias("y"))
    return stats.first_crossing(c, "day", "y", 0.5).withColumn("y", r6("y"))


@query("""WITH s AS (SELECT l_returnflag, covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_discount, l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz FROM lineitem GROUP BY 1),
t AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS c FROM s)
SELECT l_returnflag, round(mz - b * mx - c * my, 3) AS a, round(b, 3) AS b, round(c, 3) AS c FROM t""")
def plane_fit(spark, sf):
    out = stats.plane_fit(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, 3).alias(c) for c in "abc"])


@query("WITH m AS (SELECT median(v) AS m FROM (SELECT DISTINCT l_quantity AS v FROM lineitem WHERE l_quantity > 0)) SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity / m * 5000) AS INTEGER) AS l_quantity FROM lineitem, m")
def median_scaling(spark, sf):
    return stats.median_of_distinct_scaled(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("WITH x AS (SELECT event_id, ln(1 + ln(1 + value)) AS x FROM events) SELECT event_id, round(x / (SELECT quantile_cont(x, 0.95) FROM x), 6) AS x FROM x")
def percentile_normalise(spark, sf):
    return stats.by_percentile(table(spark, sf, "events").select("event_id", F.col("value").alias("x")), "x").withColumn("x", r6("x"))


@query("""WITH s AS (SELECT count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem), g AS (SELECT CAST(range AS DOUBLE) AS g FROM range(0, 51, 5))
SELECT g AS l_quantity, round(sum(exp(-((l_quantity - g) / h) * ((l_quantity - g) / h) / 2) / (h * 2.5066282746310002)) / max(n), 8) AS density FROM lineitem, g, s GROUP BY 1""")
def kde_grid(spark, sf):
    grid = spark.range(0, 51, 5).select(F.col("id").cast("double").alias("l_quantity"))
    return stats.kde(table(spark, sf, "lineitem"), ["l_quantity"], grid).withColumn("density", F.round("density", 8))


@query(SCALED + ", q AS (SELECT k, n, sr / total AS ra, sye / total AS ya FROM t) SELECT k, n, CASE WHEN ra BETWEEN 0.5 AND 1 AND ya BETWEEN 0 AND 0.4 THEN 'c' WHEN ya BETWEEN 0.3 AND 1 THEN 'b' WHEN ra BETWEEN 0.2 AND 0.5 THEN 'a' ELSE 'Other' END AS gene FROM q")
def rule_calling(spark, sf):
    q = _scaled(spark, sf).select("k", "n", (F.col("sr") / F.col("total")).alias("ra"), (F.col("sye") / F.col("total")).alias("ya"))
    rules = [("a", {"ra": (0.2, 0.5)}), ("b", {"ya": (0.3, 1)}), ("c", {"ra": (0.5, 1), "ya": (0, 0.4)})]
    return q.select("k", "n", fx.boxes(rules).alias("gene"))


@query("""WITH f AS (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem), v AS (SELECT var_pop(x) AS vx, var_pop(y) AS vy FROM f),
l AS (SELECT x, y, exp(-(x - 0.2) * (x - 0.2) / (2 * vx) - (y - 0.2) * (y - 0.2) / (2 * vy)) AS a, exp(-(x - 0.8) * (x - 0.8) / (2 * vx) - (y - 0.6) * (y - 0.6) / (2 * vy)) AS b FROM f, v),
r AS (SELECT x, y, a / (a + b) AS r0, b / (a + b) AS r1 FROM l)
SELECT 0 AS component, round(avg(r0), 6) AS weight, round(sum(r0 * x) / sum(r0), 6) AS mx, round(sum(r0 * y) / sum(r0), 6) AS my, round(sum(r0 * x * x) / sum(r0) - pow(sum(r0 * x) / sum(r0), 2) + 1e-6, 6) AS vx FROM r
UNION ALL SELECT 1, round(avg(r1), 6), round(sum(r1 * x) / sum(r1), 6), round(sum(r1 * y) / sum(r1), 6), round(sum(r1 * x * x) / sum(r1) - pow(sum(r1 * x) / sum(r1), 2) + 1e-6, 6) FROM r""")
def gmm_em_step(spark, sf):
    f = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))
    m = decode.fit_mixture(f, ["x", "y"], [[0.2, 0.2], [0.8, 0.6]], rounds=1)
    rows = [(k, round(m["weights"][k], 6), round(m["means"][k][0], 6), round(m["means"][k][1], 6), round(m["variances"][k][0], 6)) for k in (0, 1)]
    return spark.createDataFrame(rows, "component int, weight double, mx double, my double, vx double")


_LOGS = ", ".join(f"ln(w{k}) - 0.5 * (ln(2 * pi() * v{k}x) + ln(2 * pi() * v{k}y)) - (x - m{k}x) * (x - m{k}x) / (2 * v{k}x) - (y - m{k}y) * (y - m{k}y) / (2 * v{k}y) AS l{k}" for k in (0, 1))
_STEP = ", ".join(
    [f"sum(r{k}) / count(*) AS w{k}" for k in (0, 1)]
    + [f"sum(r{k} * {c}) / sum(r{k}) AS m{k}{c}" for k in (0, 1) for c in "xy"]
    + [f"greatest(sum(r{k} * {c} * {c}) / sum(r{k}) - pow(sum(r{k} * {c}) / sum(r{k}), 2), 0) + 1e-6 AS v{k}{c}" for k in (0, 1) for c in "xy"]
)


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x, l_extendedprice / 100000 AS y, l_linenumber % 2 AS layer FROM lineitem),
s AS (SELECT layer, 0 AS turn, CAST(0.5 AS DOUBLE) AS w0, CAST(0.5 AS DOUBLE) AS w1, CAST(0.2 AS DOUBLE) AS m0x, CAST(0.2 AS DOUBLE) AS m0y, CAST(0.8 AS DOUBLE) AS m1x, CAST(0.6 AS DOUBLE) AS m1y,
  greatest(var_pop(x), 1e-6) AS v0x, greatest(var_pop(y), 1e-6) AS v0y, greatest(var_pop(x), 1e-6) AS v1x, greatest(var_pop(y), 1e-6) AS v1y, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS last FROM f GROUP BY layer
  UNION ALL SELECT layer, max(turn) + 1, {_STEP}, avg(top + ln(total)) AS score, max(score) AS last FROM (SELECT *, exp(l0 - top) / total AS r0, exp(l1 - top) / total AS r1 FROM
    (SELECT *, exp(l0 - top) + exp(l1 - top) AS total FROM (SELECT *, greatest(l0, l1) AS top FROM (SELECT f.layer, x, y, turn, score, {_LOGS} FROM f JOIN s ON s.layer = f.layer WHERE turn < 100 AND (last IS NULL OR abs(score - last) >= 1e-3))))) GROUP BY layer),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY layer ORDER BY turn DESC) = 1)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l0 >= l1 THEN 0 ELSE 1 END + layer * 2 + 1 AS INTEGER) AS label FROM (SELECT l_orderkey, l_linenumber, f.layer, {_LOGS} FROM f JOIN b ON b.layer = f.layer)""")
def gmm_labels(spark, sf):
    f = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"), (F.col("l_linenumber") % 2).alias("g_layer"))
    return decode.fit_layers(f, ["x", "y"], {0: [[0.2, 0.2], [0.8, 0.6]], 1: [[0.2, 0.2], [0.8, 0.6]]}).select("l_orderkey", "l_linenumber", "label")


CALLED = SCALED + """,
fq AS (SELECT k, n, total, sr / total AS ra, sye / total AS ya, sb / total AS ba, least(sg / total, 5) AS ga FROM t),
ff AS (SELECT k, n, total, ra, ya, ga * exp(0.6 * ya) AS ga, ba FROM fq),
fh AS (SELECT k, n, total, ra, ya, ln(1 + log10(1 + ga)) AS ga, ba * exp(0.1 * ga) AS ba FROM ff),
fu AS (SELECT k, n, total, ga, ra / (ra + ya + ba) AS ra, ya / (ra + ya + ba) AS ya, ba / (ra + ya + ba) AS ba FROM fh),
f AS MATERIALIZED (SELECT k, n, CAST(ga >= 0.1 AS INTEGER) AS layer, (ba - ya) * sqrt(2) / 2 AS x, ra * sqrt(2) / 2 - (ya + ba) / 2 AS y FROM fu WHERE total > 20 AND total < 120)"""


@query(CALLED.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + f""",
z AS (SELECT layer, 0 AS turn, CAST(0.5 AS DOUBLE) AS w0, CAST(0.5 AS DOUBLE) AS w1, CAST(-0.5 AS DOUBLE) AS m0x, CAST(-0.2 AS DOUBLE) AS m0y, CAST(-0.2 AS DOUBLE) AS m1x, CAST(0.1 AS DOUBLE) AS m1y,
  greatest(var_pop(x), 1e-6) AS v0x, greatest(var_pop(y), 1e-6) AS v0y, greatest(var_pop(x), 1e-6) AS v1x, greatest(var_pop(y), 1e-6) AS v1y, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS last FROM f GROUP BY layer
  UNION ALL SELECT layer, max(turn) + 1, {_STEP}, avg(top + ln(total)) AS score, max(score) AS last FROM (SELECT *, exp(l0 - top) / total AS r0, exp(l1 - top) / total AS r1 FROM
    (SELECT *, exp(l0 - top) + exp(l1 - top) AS total FROM (SELECT *, greatest(l0, l1) AS top FROM (SELECT f.layer, x, y, turn, score, {_LOGS} FROM f JOIN z ON z.layer = f.layer WHERE turn < 100 AND (last IS NULL OR abs(score - last) >= 1e-3))))) GROUP BY layer),
e AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY layer ORDER BY turn DESC) = 1),
c AS (SELECT k, n, x, y, f.layer, CASE WHEN l0 >= l1 THEN 0 ELSE 1 END + f.layer * 2 + 1 AS label FROM (SELECT k, n, x, y, f.layer, {_LOGS} FROM f JOIN e ON e.layer = f.layer) f),
w AS (SELECT k, n, label FROM c WHERE NOT (label = 2 AND (trunc((x + 0.8) * 40 / 1.6) < 8 OR trunc((x + 0.8) * 40 / 1.6) >= 40 OR trunc((0.8 - y) * 35 / 1.4) < 0 OR trunc((0.8 - y) * 35 / 1.4) >= 35)))
SELECT k, n, CASE label WHEN 1 THEN 'Actb' WHEN 2 THEN 'Gad1' WHEN 3 THEN 'Sst' ELSE 'unnamed' END AS gene FROM w""")
def called_genes(spark, sf):
    """Gene calling from spots to names: features, panel range, layers, mixtures, one label kept inside its drawn mask, codebook."""
    out = fx.readout_features(spots(spark, sf)).where((F.col("sum") > 20) & (F.col("sum") < 120))
    out = materialise(out.select("k", "n", "cd_1", "cd_2", (F.col("g_a") >= 0.1).cast("int").alias("g_layer")), "called-features")
    first = [[-0.5, -0.2], [-0.2, 0.1]]
    told = decode.fit_layers(out, ["cd_1", "cd_2"], {0: first, 1: first})
    mask = spark.range(35).select(F.lit(2).alias("label"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(8), F.lit(39))).alias("col"))
    kept = spatial.mask_relabelled(told, mask, "discard", F.lit(True), 35, 40)
    names = spark.createDataFrame([(1, "Actb"), (2, "Gad1"), (3, "Sst")], "label int, gene string")
    return tables.with_names(kept.select("k", "n", "label"), "label", names, "gene", "unnamed").select("k", "n", "gene")


# ---------------------------------------------------------------- cells


@query("""WITH c AS (SELECT c_custkey AS cell_id, c_custkey % 150 AS y, abs(c_acctbal) % 400 AS x FROM customer), p AS (SELECT event_id AS id, user_id AS y, value * 4 AS x, event_type AS gene FROM events WHERE event_type <> 'error'),
d AS (SELECT p.id, p.gene, c.cell_id, (p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x) AS d2 FROM p, c WHERE abs(p.y - c.y) < 3 AND abs(p.x - c.x) < 3),
n AS (SELECT id, gene, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cell_id) AS r FROM d WHERE d2 < 9) WHERE r = 1)
SELECT cell_id, count(*) FILTER (WHERE gene = 'click') AS click, count(*) FILTER (WHERE gene = 'purchase') AS purchase, count(*) FILTER (WHERE gene = 'signup') AS signup, count(*) FILTER (WHERE gene = 'view') AS view FROM n GROUP BY 1""")
def expression_matrix(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), (F.col("c_custkey") % 150).alias("y"), (F.abs("c_acctbal") % 400).alias("x"))
    p = _points(spark, sf).withColumnRenamed("event_type", "gene").drop("sum")
    return cells.expression_matrix(cells.expression(p, c, 3, sentinel="error"), ["click", "purchase", "signup", "view"])


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2, 3) THEN 'neuron' WHEN c_nationkey IN (4, 5) THEN 'glia' ELSE 'other' END AS type FROM customer")
def annotate_clusters(spark, sf):
    return cells.annotated(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), {"neuron": [1, 2, 3], "glia": [4, 5]}, "c_nationkey").select("c_custkey", "type")


@query(LINES + ", r AS (SELECT c_custkey AS cell_id, c_mktsegment AS roi FROM customer) SELECT roi, gene, CAST(sum(cnt) AS BIGINT) AS cnt FROM e JOIN r USING (cell_id) GROUP BY 1, 2")
def genes_by_region(spark, sf):
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("roi"))
    return cells.genes_by_region(_line_counts(spark, sf), r, ["roi"])


@query("SELECT l_suppkey AS label, count(*) AS area, CAST(trunc(avg(l_partkey)) AS INTEGER) AS y, CAST(trunc(avg(l_linenumber)) AS INTEGER) AS x FROM lineitem WHERE l_suppkey > 0 AND l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 60) GROUP BY 1")
def label_centroids(spark, sf):
    px = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_partkey").alias("y"), F.col("l_linenumber").alias("x"))
    return cells.label_centroids(cells.small_labels_dropped(px, 60))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS a, (vec_id * 7 + 3) % 500 AS b FROM embeddings), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1""")
def seam_components(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % 500).alias("dst"))
    return graph.connected_components(e)


# ---------------------------------------------------------------- extensions


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, i""")
def session_counts(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "30 minutes").select("user_id", "start", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    return windows.tumbling(table(spark, sf, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
