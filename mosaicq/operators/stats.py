"""Aggregates and ordered analytics of the engine, in long form."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.operators.tables import with_row_ids
from mosaicq.workspace import broadcast_if_few, materialise


def observed_over_expected(df: DataFrame, i: str, j: str) -> DataFrame:
    """n_ij * N / (n_i * n_j) of two categories."""
    n = df.groupBy(i, j).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.withColumn("roe", F.col("n") * total / (F.sum("n").over(Window.partitionBy(i)) * F.sum("n").over(Window.partitionBy(j))))


def composition(df: DataFrame, region: str, kind: str) -> DataFrame:
    """Counts by region and kind with their share of the region in percent."""
    n = df.groupBy(region, kind).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(region)))


#: approx_percentile's accuracy, the half width of the bracket around a quantile, and the rows up to which all are ordered.
_ACCURACY, _SLACK, _FEW = 10_000, 1e-3, 10_000


def exact_quantile(df: DataFrame, col: str, q: float, by: list[str] = ()) -> DataFrame:
    """(by, value): the exact q-quantile of a column, linear between the two ranks around it; nulls don't count.

    A sketch brackets the quantile, the values below the bracket are only counted, and the distinct values
    inside it, a share of 2 * _SLACK of the rows, are ordered: no buffer holds the values of a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(col).cast("double").alias("_x")).where("_x is not null")
    ends = F.percentile_approx("_x", [max(0.0, q - _SLACK), min(1.0, q + _SLACK)], _ACCURACY)
    span = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), ends.alias("_e"))
    few = F.col("_n") <= _FEW
    span = span.select(*keys, "_n", F.when(few, F.col("_lo")).otherwise(F.col("_e")[0]).alias("_lo"), F.when(few, F.col("_hi")).otherwise(F.col("_e")[1]).alias("_hi"))

    def same(a: str, b: str) -> Column:
        return reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), keys, F.lit(True))

    told = rows.alias("r").join(span.alias("s") if keys else F.broadcast(span).alias("s"), same("r", "s"))
    place = F.when(F.col("_x") < F.col("_lo"), -1).when(F.col("_x") > F.col("_hi"), 1).otherwise(0)
    counts = told.select(*[F.col(f"r.{k}").alias(k) for k in keys], place.alias("_p"), F.when(place == 0, F.col("_x")).alias("_x"), "_n")
    counts = counts.groupBy(*keys, "_p", "_x").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    last = F.sum("_c").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_p", "_x"))
    at = (F.col("_n") - 1) * q
    steps = counts.withColumns({"_to": last, "_at": at})

    def ranked(rank: Column) -> Column:  # ranks from 0
        return F.max(F.when((F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")) & (F.col("_p") == 0), F.col("_x")))

    got = steps.groupBy(*keys).agg(ranked(F.floor("_at")).alias("_a"), ranked(F.ceil("_at")).alias("_b"), F.max("_at").alias("_at"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    # The sketch's bound on ranks makes this impossible; a wrong value must not pass.
    value = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), value).otherwise(F.raise_error(F.lit("the quantile is outside its bracket")))
    return got.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], value.alias("value"))


def above_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """Rows above the q-quantile (q <= 1) or above the absolute threshold."""
    if q > 1:
        return df.where(F.col(col) > q)
    limit = exact_quantile(df, col, q).withColumnRenamed("value", "_q")
    return df.join(F.broadcast(limit), F.col(col) > F.col("_q")).drop("_q")


def above_group_quantile(df: DataFrame, group: str, col: str, q: float) -> DataFrame:
    limit = exact_quantile(df, col, q, [group]).select(F.col(group).alias("_g"), F.col("value").alias("_q"))
    return df.join(limit, (F.col(group) == F.col("_g")) & (F.col(col) > F.col("_q"))).drop("_g", "_q")


def in_large_groups(df: DataFrame, group: str, more_than: int) -> DataFrame:
    big = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than)
    return df.join(big, group, "left_semi")


def complete_histogram(df: DataFrame, label: str, lo: int, hi: int) -> DataFrame:
    """Counts of the labels lo..hi, absent ones as 0."""
    every = df.sparkSession.range(lo, hi + 1).withColumnRenamed("id", label)
    n = df.groupBy(F.col(label).cast("long").alias(label)).agg(F.count("*").alias("n"))
    return every.join(n, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def bin_of(x: Column, lo: Column | float, hi: Column | float, n: int) -> Column:
    """Equal bins 0..n-1 over [lo, hi], the last one closed; null outside."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) * n / (hi - lo)), F.lit(n - 1)))


def histogram(df: DataFrame, col: str, n: int) -> DataFrame:
    """(bin, n) over the column's own range; empty bins absent."""
    ends = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).groupBy(bin_of(F.col(col), F.col("_lo"), F.col("_hi"), n).alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, xr: tuple[float, float], yr: tuple[float, float], n: int) -> DataFrame:
    out = df.groupBy(bin_of(F.col(x), *xr, n).alias("bx"), bin_of(F.col(y), *yr, n).alias("by")).agg(F.count("*").alias("n"))
    return out.where("bx is not null and by is not null")


def dense_percentile(counts: DataFrame, q: float, cells: int) -> DataFrame:
    """Percentile of 2-D counts including the cells - rows(counts) empty ones, without making them.

    Linear interpolation between order statistics of the padded list.
    """
    stats = counts.agg(F.count("*").alias("m"))
    ranked = counts.withColumn("r", F.row_number().over(Window.orderBy("n")))
    at = q * (cells - 1)
    lo, hi = int(at), min(int(at) + 1, cells - 1)
    shift = F.lit(cells) - F.col("m")
    got = ranked.crossJoin(F.broadcast(stats)).agg(
        F.max(F.when(F.col("r") == lo + 1 - shift, F.col("n"))).alias("a"),
        F.max(F.when(F.col("r") == hi + 1 - shift, F.col("n"))).alias("b"),
    )
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return got.select((a + (b - a) * (at - lo)).cast("double").alias("value"))


def block_occupancy(df: DataFrame, y: str, x: str, side: int) -> DataFrame:
    """Distinct occupied pixels of each block."""
    return df.groupBy(F.floor(F.col(y) / side).alias("by"), F.floor(F.col(x) / side).alias("bx")).agg(F.count_distinct(y, x).alias("n_pixels"))


def block_counts(df: DataFrame, y: str, x: str, side: int) -> DataFrame:
    return df.groupBy(F.floor(F.col(y) / side).alias("by"), F.floor(F.col(x) / side).alias("bx")).agg(F.count("*").alias("n"))


def label_means(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])


def label_covariance(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Mean vector and sample covariances of each label: columns mean_c and cov_c_d (c before d)."""
    aggs = [F.avg(c).alias(f"mean_{c}") for c in cols]
    aggs += [F.covar_samp(c, d).alias(f"cov_{c}_{d}") for k, c in enumerate(cols) for d in cols[k:]]
    return df.groupBy(label).agg(*aggs)


def overlap(p_values: DataFrame, limit: float) -> DataFrame:
    """Share of each label's points with a component's p-value above the limit (label, component, p)."""
    return p_values.groupBy("label", "component").agg(F.avg((F.col("p") > limit).cast("double")).alias("frac"))


def accuracy_curve(p_values: DataFrame, n: int = 50, by_component: bool = False) -> DataFrame:
    """(threshold, accuracy): mean over labels of diagonal over sum of the overlap row (or column)."""
    # p > i / n for the thresholds below p: rows are counted once by how many there are, then summed over the thresholds.
    above = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil(F.col("p") * n))).cast("int")
    above = above - ((above > 0) & ~(F.col("p") > (above - 1) / F.lit(n))).cast("int") + ((above < n) & (F.col("p") > above / F.lit(n))).cast("int")
    counts = p_values.groupBy("label", "component", above.alias("above")).agg(F.count("*").alias("c"))
    grid = p_values.sparkSession.range(n).select(F.col("id").alias("i"), (F.col("id") / n).alias("threshold"))
    hit = F.sum(F.when(F.col("above") > F.col("i"), F.col("c")).otherwise(0))
    frac = counts.crossJoin(F.broadcast(grid)).groupBy("threshold", "label", "component").agg((hit / F.sum("c")).alias("frac"))
    key = "component" if by_component else "label"
    rows = frac.groupBy("threshold", key).agg(F.sum(F.when(F.col("label") == F.col("component"), F.col("frac"))).alias("d"), F.sum("frac").alias("s"))
    return rows.groupBy("threshold").agg(F.avg(F.when(F.col("s") > 0, F.col("d") / F.col("s"))).alias("accuracy"))


def first_crossing(curve: DataFrame, order: str, y: str, line: float) -> DataFrame:
    """The last row before the sign of y - line first changes."""
    s = F.signum(F.col(y) - line)
    w = Window.orderBy(order)
    marked = curve.withColumns({"_s": s, "_next": F.lead(s).over(w)})
    return marked.where(F.col("_s") != F.col("_next")).orderBy(order).limit(1).drop("_s", "_next")


def _correlated(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, r): Pearson correlation of x and y; null where either is constant."""
    sums = pairs.groupBy(*by).agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(*by, F.when(spread > 0, F.col("xy") / spread).alias("r"))


#: Columns of a block: a task holds the products of two blocks' columns. Rows it lays out densely at a time.
MOST_COLUMNS, _DENSE_ROWS = 2048, 1024
#: A column whose variance is below this share of its mean square is constant: the rest is rounding.
_CONSTANT = 1e-12


def gram_blocks(cells: DataFrame, n: int) -> DataFrame:
    """(i, j, xy), i <= j: sums of products of n columns of rows (r, k, x), what is absent being 0.

    A cell goes to each pair of blocks that its column's block is in (one pair up to MOST_COLUMNS columns);
    a task adds up the products of the pairs it was dealt, row by row.
    """
    side, count = MOST_COLUMNS, -(-n // MOST_COLUMNS)
    own = F.floor(F.col("k") / side).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0)))).alias("other")
    wide = cells.select("r", "k", F.col("x").cast("double").alias("x"), own.alias("own"), other)
    wide = wide.select(F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "r", "k", "x")

    def added(total: np.ndarray, table: pa.Table, bi: int, bj: int) -> None:
        r = table.column("r").combine_chunks().dictionary_encode().indices.to_numpy()
        k, x = table.column("k").to_numpy(), table.column("x").to_numpy()
        line = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])])
        for first in range(0, int(line[-1]) + 1, _DENSE_ROWS):
            a, b = np.searchsorted(line, (first, first + _DENSE_ROWS))
            at, col, val = line[a:b] - first, k[a:b], x[a:b]
            left = np.zeros((int(at[-1]) + 1, total.shape[0]))
            mine = col // side == bi
            left[at[mine], col[mine] - bi * side] = val[mine]
            right = left
            if bi != bj:
                right = np.zeros((len(left), total.shape[1]))
                right[at[~mine], col[~mine] - bj * side] = val[~mine]
            total += left.T @ right

    def told(total: np.ndarray, bi: int, bj: int) -> pa.RecordBatch:
        i, j = np.triu_indices(len(total)) if bi == bj else (x.ravel() for x in np.indices(total.shape))
        return pa.RecordBatch.from_arrays([pa.array(i + bi * side), pa.array(j + bj * side), pa.array(total[i, j])], names=["i", "j", "xy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, pair, total = None, None, None
        for batch in _and_end(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not len(table):
                continue
            bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
            r = table.column("r").combine_chunks().dictionary_encode().indices.to_numpy()
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            done = len(table) if batch is None else int(np.flatnonzero(new)[-1])  # the last row may go on
            rest = table.slice(done)
            edges = [0, *(np.flatnonzero((bi[1:done] != bi[: done - 1]) | (bj[1:done] != bj[: done - 1])) + 1), done] if done else []
            for a, b in zip(edges, edges[1:]):
                if pair != (bi[a], bj[a]):
                    if pair is not None:
                        yield told(total, *pair)
                    pair = int(bi[a]), int(bj[a])
                    total = np.zeros(tuple(min(side, n - x * side) for x in pair))
                added(total, table.slice(a, b - a), *pair)
        if pair is not None:
            yield told(total, *pair)

    dealt = wide.repartition("bi", "bj", "r").sortWithinPartitions("bi", "bj", "r")
    return dealt.mapInArrow(run, "i long, j long, xy double").groupBy("i", "j").agg(F.sum("xy").alias("xy"))


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def correlation_matrix(long: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(a, b, r): Pearson correlation of all column pairs of a long matrix over all its rows; the diagonal null.

    A cell that is absent or null counts as 0, whatever the number of columns: over n rows, r comes from the
    columns' sums and the sums of their products. A constant column has no correlation.
    """
    n_rows = long.select(row).distinct().count()
    cells = long.where(F.col(value).isNotNull())
    names = materialise(with_row_ids(long.select(F.col(col).alias("name")).distinct(), ["name"], "k"), "correlation-columns")
    n = names.count()
    numbered = cells.join(broadcast_if_few(names), F.col(col) == F.col("name")).select(F.col(row).alias("r"), "k", F.col(value).cast("double").alias("x"))
    grams = materialise(gram_blocks(numbered, n), "correlation")
    own = grams.where("i = j").select(F.col("i").alias("k"), F.col("xy").alias("xx")).join(numbered.groupBy("k").agg(F.sum("x").alias("s")), "k").join(names, "k")
    own = broadcast_if_few(materialise(own.withColumn("v", F.greatest(F.col("xx") * n_rows - F.col("s") * F.col("s"), F.lit(0.0))), "correlation-columns"))
    both = grams.unionByName(grams.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "xy"))
    out = both.join(own.select(F.col("k").alias("i"), F.col("name").alias("a"), F.col("s").alias("si"), F.col("v").alias("vi"), F.col("xx").alias("xi")), "i")
    out = out.join(own.select(F.col("k").alias("j"), F.col("name").alias("b"), F.col("s").alias("sj"), F.col("v").alias("vj"), F.col("xx").alias("xj")), "j")
    varies = (F.col("vi") > F.col("xi") * n_rows * _CONSTANT) & (F.col("vj") > F.col("xj") * n_rows * _CONSTANT)
    r = (F.col("xy") * n_rows - F.col("si") * F.col("sj")) / (F.sqrt("vi") * F.sqrt("vj"))
    return out.select("a", "b", F.when((F.col("i") != F.col("j")) & varies, r).alias("r"))


def cluster_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, r): Pearson correlation over their common genes of the clusters of two tables (cluster, gene, mean)."""
    left = a.select(F.col("cluster").alias("a"), "gene", F.col("mean").alias("x"))
    right = b.select(F.col("cluster").alias("b"), "gene", F.col("mean").alias("y"))
    return _correlated(left.join(right, "gene"), "a", "b")


def block_density(df: DataFrame, y: str, x: str, side: int) -> DataFrame:
    """df with density: rows in the block of each row, by which a drawing is ordered."""
    keyed = df.withColumns({"_by": F.floor(F.col(y) / side), "_bx": F.floor(F.col(x) / side)})
    n = keyed.groupBy("_by", "_bx").agg(F.count("*").alias("density"))
    return keyed.join(n, ["_by", "_bx"]).drop("_by", "_bx")


def layers_by_valleys(df: DataFrame, col: str, bins: int, order: int = 1) -> DataFrame:
    """df with layer: how many valleys of the column's histogram lie at or below the row's bin.

    The histogram and its valleys are as many rows as bins; the rows only look up their bin.
    """
    ends = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    told = df.crossJoin(F.broadcast(ends)).withColumn("_bin", bin_of(F.col(col), F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")
    counts = told.where("_bin is not null").groupBy(F.col("_bin").alias("bin")).agg(F.count("*").alias("n"))
    curve = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").na.fill(0, ["n"])
    valleys = local_extrema(curve, "bin", "n", order).select("bin", F.lit(1).alias("v"))
    layer = curve.join(valleys, "bin", "left").select(F.col("bin").alias("_b"), F.coalesce(F.sum("v").over(Window.orderBy("bin")), F.lit(0)).cast("int").alias("layer"))
    return told.join(F.broadcast(layer), F.col("_bin") == F.col("_b"), "left").drop("_bin", "_b")


#: Parts into which a column's values are dealt for ranking: one window orders a part or the parts, never a column.
RANK_PARTS = 64


def _below(counts: DataFrame) -> DataFrame:
    """(by, v, n, below): how many values of a column are below each of its values, from their counts (by, v, n)."""
    ends = counts.groupBy("by").agg(F.percentile_approx("v", [i / RANK_PARTS for i in range(1, RANK_PARTS)], 1000).alias("cuts"))
    told = counts.join(ends, "by").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = told.groupBy("by", "part").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.partitionBy("by").orderBy("part")) - F.col("all")
    sums = sums.select(F.col("by").alias("_by"), F.col("part").alias("_part"), before.alias("before"))
    inside = F.sum("n").over(Window.partitionBy("by", "part").orderBy("v")) - F.col("n")
    told = told.withColumn("inside", inside).join(sums, (F.col("by") == F.col("_by")) & (F.col("part") == F.col("_part")))
    return told.select("by", "v", "n", (F.col("before") + F.col("inside")).alias("below"))


def _value_ranks(counts: DataFrame) -> DataFrame:
    """(by, v, rank): average ranks of values from their counts (by, v, n)."""
    return _below(counts).select("by", "v", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def average_ranks(long: DataFrame, by: str, value: str) -> DataFrame:
    """Ranks with ties averaged, as column rank: a column's values are counted, the counts ordered in parts."""
    counts = long.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranks = _value_ranks(counts).select(F.col("by").alias("_by"), F.col("v").alias("_v"), "rank")
    return long.join(ranks, (F.col(by) == F.col("_by")) & (F.col(value) == F.col("_v")), "left").drop("_by", "_v")


def spearman_matrix(long: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(a, b, r): Pearson correlation of the columns' ranks; absent and null cells are ranked as 0.

    Ranks are counted from that of 0, so that what is absent stays absent.
    """
    n_rows = long.select(row).distinct().count()
    cells = long.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    counts = cells.groupBy(F.col(col).alias("by"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    absent = long.select(F.col(col).alias("by")).distinct().join(counts.groupBy("by").agg(F.sum("n").alias("_n")), "by", "left")
    zeros = absent.select("by", F.lit(0.0).alias("v"), (F.lit(n_rows) - F.coalesce("_n", F.lit(0))).alias("n"))
    counts = materialise(counts.unionByName(zeros).groupBy("by", "v").agg(F.sum("n").alias("n")).where("n > 0 or v = 0"), "rank-counts")
    ranks = materialise(_value_ranks(counts), "ranks")
    zero = ranks.where("v = 0").select(F.col("by").alias("_zby"), F.col("rank").alias("_zero"))
    shifted = ranks.join(zero, F.col("by") == F.col("_zby")).select(F.col("by").alias("_by"), F.col("v").alias("_v"), (F.col("rank") - F.col("_zero")).alias("rank"))
    told = cells.join(shifted, (F.col(col) == F.col("_by")) & (F.col(value) == F.col("_v"))).select(row, col, "rank")
    # Columns without a value, and rows, still count.
    rest = long.where(F.col(value).isNull()).select(row, col, F.lit(None).cast("double").alias("rank"))
    return correlation_matrix(told.unionByName(rest), row, col, "rank")


def mean_expression(df: DataFrame, cluster: str, gene: str, value: str, share: str = "cluster") -> DataFrame:
    """Mean and positive share of each (cluster, gene), and the mean divided by its L2 norm over share."""
    out = df.groupBy(cluster, gene).agg(F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("frac_positive"))
    over = Window.partitionBy(gene if share == "cluster" else cluster)
    return out.withColumn("l2", F.col("mean") / F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(over)))


def ecdf(df: DataFrame, value: str, grid: DataFrame) -> DataFrame:
    """Share of values strictly below each value g of a grid of any size; null g and an empty df give null.

    Values are counted first; grid values join the counts with none of their own, and what is below is summed
    in parts of the order.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    points = grid.where("g is not null").select(F.col("g").cast("double").alias("v"), F.lit(0).cast("long").alias("n"))
    counts = values.unionByName(points).groupBy("v").agg(F.sum("n").alias("n")).withColumn("by", F.lit(0))
    below = _below(counts).select(F.col("v").alias("_v"), "below")
    total = df.agg(F.count(value).alias("_total"))
    told = grid.join(below, F.col("g").cast("double") == F.col("_v"), "left").crossJoin(F.broadcast(total))
    return told.select("g", F.when(F.col("_total") > 0, F.col("below") / F.col("_total")).alias("ecdf"))


def otsu_thresholds(counts: DataFrame, classes: int = 3, by: list[str] = ()) -> DataFrame:
    """(by, thresholds): the class borders of histograms (by, bin, n) that part their bins best, exactly.

    Bins up to a border belong below it. The sum over classes of (sum of bins)^2 / rows is largest, which is
    the largest variance between classes; the best of k classes ends where the best of k - 1 classes and one
    interval meet, so all borders come from prefix sums. A histogram is one task's, as its bins are few.
    Histograms with fewer bins than classes have none.
    """
    keys = list(by)
    kinds = ", ".join([*(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys), "thresholds array<long>"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["n"] > 0].sort_values("bin")
        bins, n = frame["bin"].to_numpy(np.int64), frame["n"].to_numpy(float)
        if len(bins) < classes:
            return pd.DataFrame(columns=[*keys, "thresholds"])
        rows, sums = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * bins)]
        with np.errstate(invalid="ignore", divide="ignore"):
            each = (sums[None] - sums[:, None]) ** 2 / (rows[None] - rows[:, None])  # of the interval (i, j]
        each[np.tril_indices(len(rows))] = -np.inf
        best, ends = each[0], []
        for _ in range(classes - 1):
            whole = best[:, None] + each
            ends.append(whole.argmax(0))
            best = whole.max(0)
        at, out = len(bins), []
        for step in reversed(ends):
            at = int(step[at])
            out.append(int(bins[at - 1]))
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, "thresholds": out[::-1]}])

    grouped = counts.withColumn("_all", F.lit(0)).groupBy(*(keys or ["_all"]))
    return grouped.applyInPandas(run, kinds)


def local_extrema(curve: DataFrame, order_col: str, y: str, order: int = 1, maxima: bool = False) -> DataFrame:
    """Rows of a curve strictly below (above) their neighbours up to order places away.

    Neighbours beyond an end are the end row itself, so the ends never count. A curve is ordered as a
    whole, in one task: it is the small result of a histogram or of a density, not a table of spots.
    """
    w = Window.orderBy(order_col)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(y).over(ends), F.last(y).over(ends)
    at, n = F.row_number().over(w), F.count("*").over(ends)
    ok = F.lit(True)
    for k in range(1, order + 1):
        for beside in (F.when(at > k, F.lag(y, k).over(w)).otherwise(first), F.when(at + k <= n, F.lead(y, k).over(w)).otherwise(last)):
            ok = ok & (F.col(y) > beside if maxima else F.col(y) < beside)
    return curve.withColumn("_ok", F.coalesce(ok, F.lit(False))).where("_ok").drop("_ok")


def between_extrema(extrema: DataFrame, order_col: str) -> DataFrame:
    """Ranges (lo, hi) between consecutive extrema."""
    out = extrema.select(F.lag(order_col).over(Window.orderBy(order_col)).alias("lo"), F.col(order_col).alias("hi"))
    return out.where("lo is not null")


def plane_fit(df: DataFrame, x: str, y: str, z: str, by: list[str] = ()) -> DataFrame:
    """Least squares z = a + b x + c y from sums alone (Cramer's rule on centred sums)."""
    cov = {n: F.covar_pop(*p) for n, p in {"xx": (x, x), "yy": (y, y), "xy": (x, y), "xz": (x, z), "yz": (y, z)}.items()}
    s = df.groupBy(*by).agg(*[c.alias(n) for n, c in cov.items()], F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumn("b", (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).withColumn("c", (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
    return s.select(*by, (F.col("mz") - F.col("b") * F.col("mx") - F.col("c") * F.col("my")).alias("a"), "b", "c")


def median_of_distinct_scaled(df: DataFrame, col: str, to: float = 5000) -> DataFrame:
    """Integer column: x / median(distinct positive x) * to."""
    m = exact_quantile(df.where(F.col(col) > 0).select(col).distinct(), col, 0.5).withColumnRenamed("value", "_m")
    return df.crossJoin(F.broadcast(m)).withColumn(col, (F.col(col) / F.col("_m") * to).cast("int")).drop("_m")


def by_percentile(df: DataFrame, col: str, q: float = 0.95) -> DataFrame:
    """log(1 + log(1 + x)) divided by its q-quantile."""
    out = df.withColumn(col, F.log1p(F.log1p(F.col(col))))
    return out.crossJoin(F.broadcast(exact_quantile(out, col, q).withColumnRenamed("value", "_p"))).withColumn(col, F.col(col) / F.col("_p")).drop("_p")


#: Bandwidths beyond which a kernel is left out: there it is below 3e-18 of its top.
REACH = 9


def kde(df: DataFrame, cols: list[str], grid: DataFrame, factor: float | None = None, steps: int | None = None) -> DataFrame:
    """Gaussian density at the grid's different points (same columns), Scott's bandwidth for each axis.

    Equal rows are counted first and meet the points of the cells around their own, whose sides are the kernel's reach.
    With steps, the rows of each step of so many a bandwidth are counted at their mean, so that the number of places
    no longer grows with the rows; a density changes by at most axes / (8 * steps ** 2) of the kernel's top.
    A point that nothing reaches has density 0; in a table of less than two rows densities are null.
    """
    axes = range(len(cols))
    stats = df.agg(F.count("*").alias("_n"), *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    band = F.lit(factor) if factor else F.pow(F.col("_n").cast("double"), F.lit(-1.0 / (len(cols) + 4)))
    stats = F.broadcast(stats.select("_n", *[(F.col(f"_s{i}") * band).alias(f"_w{i}") for i in axes]))

    def cell(value: str, i: int) -> Column:
        return F.floor(F.col(value) / (F.col(f"_w{i}") * REACH))

    rows = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    if steps:
        step = [F.floor(F.col(f"_x{i}") / F.col(f"_w{i}") * steps).alias(f"_b{i}") for i in axes]
        places = rows.crossJoin(stats).groupBy(*step).agg(F.count("*").alias("_c"), *[F.avg(f"_x{i}").alias(f"_x{i}") for i in axes])
        places = places.drop(*[f"_b{i}" for i in axes])
    else:
        places = rows.groupBy(*rows.columns).agg(F.count("*").alias("_c"))
    places = places.crossJoin(stats)
    places = places.withColumns({f"_k{i}": cell(f"_x{i}", i) for i in axes})
    points = grid.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(cols)]).distinct()
    near = points.crossJoin(stats).drop("_n")
    for i in axes:
        near = near.withColumn(f"_k{i}", F.explode(F.sequence(cell(f"_g{i}", i) - 1, cell(f"_g{i}", i) + 1)))
    both = places.join(broadcast_if_few(near.drop(*[f"_w{i}" for i in axes])), [f"_k{i}" for i in axes])
    power, norm = F.lit(0.0), F.lit(1.0)
    for i in axes:
        u = (F.col(f"_x{i}") - F.col(f"_g{i}")) / F.col(f"_w{i}")
        power = power - u * u / 2
        norm = norm * F.col(f"_w{i}") * 2.5066282746310002
    ends = [f"_g{i}" for i in axes]
    found = both.groupBy(*ends).agg((F.sum(F.col("_c") * F.exp(power) / norm) / F.max("_n")).alias("_d"))
    out = points.join(found, ends, "left").crossJoin(stats)
    return out.select(*[F.col(e).alias(c) for e, c in zip(ends, cols)], F.when(F.col("_n") > 1, F.coalesce("_d", F.lit(0.0))).alias("density"))
