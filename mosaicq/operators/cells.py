"""Cells and genes: expression in long form, filters, normalisation, annotation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicq.operators.spatial import nearest_within
from mosaicq.operators.stats import exact_quantile
from mosaicq.workspace import broadcast_if_few


def expression(spots: DataFrame, cells: DataFrame, radius: float = 100, dims=("y", "x"), depth_scale: float | None = None, sentinel: str = "Other") -> DataFrame:
    """(cell_id, gene, cnt): spots counted in the nearest cell nearer than the radius."""
    spots = spots.where(F.col("gene") != sentinel)
    if depth_scale:
        spots, cells = (d.withColumn("z", F.col("z") * depth_scale) for d in (spots, cells))
    near = nearest_within(spots, cells, radius, dims)
    return near.join(spots.select("id", "gene"), "id").groupBy("cell_id", "gene").agg(F.count("*").alias("cnt"))


def expression_matrix(expr: DataFrame, genes: list[str]) -> DataFrame:
    """Wide form with the listed genes, absent counts 0."""
    return expr.groupBy("cell_id").pivot("gene", genes).agg(F.sum("cnt")).na.fill(0)


def to_long(wide: DataFrame, key: str = "cell_id") -> DataFrame:
    genes = [c for c in wide.columns if c != key]
    return wide.unpivot([key], genes, "gene", "cnt").where("cnt > 0")


def qc_metrics(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.sum("cnt").alias("total_counts"), F.count_if(F.col("cnt") > 0).alias("n_genes"))


def qc_filter(expr: DataFrame, min_genes: int = 0, min_counts: int = 0, max_counts: int | None = None, min_cells: int = 0) -> DataFrame:
    """Cells by genes and counts, then genes by the cells that are left."""
    m = qc_metrics(expr)
    ok = m.where((F.col("n_genes") >= min_genes) & (F.col("total_counts") >= min_counts) & (F.col("total_counts") <= max_counts if max_counts is not None else F.lit(True)))
    left = expr.join(ok, "cell_id", "left_semi")
    genes = left.where("cnt > 0").groupBy("gene").agg(F.count_distinct("cell_id").alias("n")).where(F.col("n") >= min_cells)
    return left.join(genes, "gene", "left_semi")


def rich_cells(expr: DataFrame, genes: list, least: int) -> DataFrame:
    """Rows of the cells whose counts of the listed genes add up to at least so many."""
    ok = expr.where(F.col("gene").isin(*genes)).groupBy("cell_id").agg(F.sum("cnt").alias("n")).where(F.col("n") >= least)
    return expr.join(ok, "cell_id", "left_semi")


def complete(expr: DataFrame) -> DataFrame:
    """All (cell, gene) combinations with zeros: the dense matrix in long form."""
    grid = expr.select("cell_id").distinct().crossJoin(broadcast_if_few(expr.select("gene").distinct()))
    return grid.join(expr, ["cell_id", "gene"], "left").na.fill(0, ["cnt"])


def normalised(expr: DataFrame, dense: bool = False) -> DataFrame:
    """Counts scaled to the median total, then z-scores of each gene over all cells, zeros included.

    The zeros enter by number, not by row, unless the dense rows are asked for.
    """
    totals = expr.groupBy("cell_id").agg(F.sum("cnt").alias("t"))
    mid = exact_quantile(totals, "t", 0.5).withColumnRenamed("value", "mid").crossJoin(totals.agg(F.count("*").alias("n_cells")))
    x = expr.join(totals, "cell_id").crossJoin(F.broadcast(mid)).select("cell_id", "gene", (F.col("cnt") * F.col("mid") / F.col("t")).alias("x"), "n_cells")
    g = x.groupBy("gene").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.max("n_cells").alias("n"))
    mean = F.col("s") / F.col("n")
    g = g.select("gene", mean.alias("mean"), F.sqrt(F.greatest((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0))).alias("sd"))
    base = complete(expr).select("cell_id", "gene").join(x.drop("n_cells"), ["cell_id", "gene"], "left").na.fill(0.0, ["x"]) if dense else x.drop("n_cells")
    return base.join(g, "gene").select("cell_id", "gene", "x", F.when(F.col("sd") > 0, (F.col("x") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))


def annotated(obs: DataFrame, groups: dict[str, list], cluster: str = "leiden", column: str = "type", default: str = "other") -> DataFrame:
    """Cluster numbers to names by a dictionary of lists."""
    table = {c: name for name, members in groups.items() for c in members}
    got = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(cluster))
    return obs.withColumn(column, F.coalesce(got, F.lit(default)))


def threshold_in_cluster(expr: DataFrame, obs: DataFrame, cluster, marker: str, valley: float, against: dict[str, float] | None = None) -> DataFrame:
    """Cells of a cluster whose marker is above its valley and no other listed gene above its own."""
    inside = obs.where(F.col("leiden") == cluster).select("cell_id")
    wide = inside.join(expr, "cell_id", "left").groupBy("cell_id").agg(
        F.max(F.when(F.col("gene") == marker, F.col("cnt"))).alias("m"),
        *[F.max(F.when(F.col("gene") == g, F.col("cnt"))).alias(f"a{i}") for i, g in enumerate(against or {})],
    )
    ok = F.coalesce("m", F.lit(0)) > valley
    for i, v in enumerate((against or {}).values()):
        ok = ok & (F.coalesce(f"a{i}", F.lit(0)) <= v)
    return wide.where(ok).select("cell_id")


def principal_components(vectors: DataFrame, k: int, vec_col: str = "v") -> DataFrame:
    """vectors with pcs: scores on the k directions of largest variance of the centred vectors, each direction's largest loading positive.

    A task adds up its vectors and their products; dimensions squared numbers reach the driver, which solves
    for the directions. Rows without a vector get none.
    """
    dims = vectors.where(F.col(vec_col).isNotNull()).agg(F.max(F.size(vec_col))).first()[0]
    if not dims:
        return vectors.withColumn("pcs", F.lit(None).cast("array<double>"))

    def sums(batches):
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.c_[np.ones(len(x)), x]
            total += x.T @ x
        i, j = (a.ravel() for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])

    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"))
    total = np.zeros((dims + 1, dims + 1))
    for i, j, s in rows.mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        total[i, j] = s
    mean = total[0, 1:] / total[0, 0]
    _, directions = np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))
    directions = directions[:, ::-1][:, :k].T
    directions *= np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(1)])[:, None]

    def score(d: np.ndarray) -> Column:
        line = F.array(*[F.lit(float(x)) for x in d])
        dot = F.aggregate(F.zip_with(F.col(vec_col), line, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b)
        return dot - F.lit(float(mean @ d))

    return vectors.withColumn("pcs", F.when(F.col(vec_col).isNotNull(), F.array(*[score(d) for d in directions])))


def small_labels_dropped(pixels: DataFrame, min_area: int) -> DataFrame:
    big = pixels.groupBy("label").agg(F.count("*").alias("area")).where(F.col("area") >= min_area)
    return pixels.join(big, "label", "left_semi")


def label_centroids(pixels: DataFrame, dims=("y", "x")) -> DataFrame:
    """Area and truncated centre of mass of each label."""
    return pixels.where("label > 0").groupBy("label").agg(F.count("*").alias("area"), *[F.avg(d).cast("int").alias(d) for d in dims])


def genes_by_region(expr: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    return expr.join(regions, "cell_id").groupBy(*by, "gene").agg(F.sum("cnt").alias("cnt"))


def column_share(expr: DataFrame, by: str = "gene") -> DataFrame:
    """expr with share: a count's part of its column's total, totals being sums that join back."""
    totals = expr.groupBy(F.col(by).alias("_by")).agg(F.sum("cnt").alias("_total"))
    return expr.join(totals, F.col(by).eqNullSafe(F.col("_by"))).withColumn("share", F.col("cnt") / F.col("_total")).drop("_by", "_total")
