"""Gene calling: mixtures, p-values, rules, barcodes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicq.functions.features import chi2_survival, hamming
from mosaicq.operators.tables import combinations
from mosaicq.workspace import fresh_path


def _log_density(cols: list[str], mean: list[float], var: list[float], weight: float) -> Column:
    out = F.lit(math.log(weight) - 0.5 * sum(math.log(2 * math.pi * v) for v in var))
    for c, m, v in zip(cols, mean, var):
        d = F.col(c) - m
        out = out - d * d / (2 * v)
    return out


def mixture_step(df: DataFrame, cols: list[str], weights, means, variances) -> tuple[list[float], list[list[float]], list[list[float]], float]:
    """One round of expectation and maximisation of a diagonal mixture: a single aggregate of sums."""
    logs = [_log_density(cols, m, v, w) for m, v, w in zip(means, variances, weights)]
    frame = df.select(*cols, *[x.alias(f"_l{k}") for k, x in enumerate(logs)])
    top = F.greatest(*[F.col(f"_l{k}") for k in range(len(logs))]) if len(logs) > 1 else F.col("_l0")
    frame = frame.withColumn("_top", top)
    total = sum((F.exp(F.col(f"_l{k}") - F.col("_top")) for k in range(1, len(logs))), F.exp(F.col("_l0") - F.col("_top")))
    frame = frame.withColumn("_sum", total)
    aggs = [F.count("*").alias("n"), F.sum(F.col("_top") + F.log("_sum")).alias("ll")]
    for k in range(len(logs)):
        r = F.exp(F.col(f"_l{k}") - F.col("_top")) / F.col("_sum")
        aggs.append(F.sum(r).alias(f"r{k}"))
        aggs += [F.sum(r * F.col(c)).alias(f"s{k}_{i}") for i, c in enumerate(cols)]
        aggs += [F.sum(r * F.col(c) * F.col(c)).alias(f"q{k}_{i}") for i, c in enumerate(cols)]
    row = frame.agg(*aggs).first()
    new_w, new_m, new_v = [], [], []
    for k in range(len(logs)):
        r = max(row[f"r{k}"] or 0.0, 1e-12)
        mean = [row[f"s{k}_{i}"] / r for i in range(len(cols))]
        new_w.append(r / row["n"])
        new_m.append(mean)
        new_v.append([max(row[f"q{k}_{i}"] / r - mean[i] ** 2, 0.0) + 1e-6 for i in range(len(cols))])
    return new_w, new_m, new_v, row["ll"] / row["n"]


def fit_mixture(df: DataFrame, cols: list[str], means: list[list[float]], tolerance: float = 1e-3, rounds: int = 100) -> dict:
    """Diagonal mixture with given first means; stops at a small change of the mean log-likelihood."""
    k = len(means)
    var0 = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    weights, variances = [1 / k] * k, [[max(float(var0[c] or 0.0), 1e-6) for c in cols] for _ in range(k)]
    last = None
    for n in range(rounds):
        weights, means, variances, score = mixture_step(df, cols, weights, means, variances)
        if last is not None and abs(score - last) < tolerance:
            break
        last = score
    return {"weights": weights, "means": means, "variances": variances, "rounds": n + 1, "score": score}


def mixture_labels(df: DataFrame, cols: list[str], model: dict, layer: int = 0) -> DataFrame:
    """label = most probable component + layer * components + 1 (ties: the first component)."""
    logs = F.array(*[_log_density(cols, m, v, w) for m, v, w in zip(model["means"], model["variances"], model["weights"])])
    return df.withColumn("label", (F.array_position(logs, F.array_max(logs)) - 1 + layer * len(model["means"]) + 1).cast("int"))


def fit_layers(df: DataFrame, cols: list[str], means: dict[int, list[list[float]]], layer_col: str = "g_layer", **options) -> DataFrame:
    """Labels of all layers; points outside the layers get -1. Layers are few: one model each.

    The features are written once, a folder a layer, so a round reads the columns of its own layer alone.
    """
    path = fresh_path(df.sparkSession, "mixture-layers")
    inside = df.where(F.col(layer_col).isin(*means))
    inside.select(*cols, F.col(layer_col).alias("_layer")).write.partitionBy("_layer").parquet(path)
    features = df.sparkSession.read.parquet(path)
    out = df.where(F.col(layer_col).isNull() | ~F.col(layer_col).isin(*means)).withColumn("label", F.lit(-1))
    for layer, first in sorted(means.items()):
        model = fit_mixture(features.where(F.col("_layer") == layer).select(*cols), cols, first, **options)
        out = out.unionByName(mixture_labels(df.where(F.col(layer_col) == layer), cols, model, layer))
    return out


def mixture_p_values(df: DataFrame, cols: list[str], model: dict, layer: int = 0) -> DataFrame:
    """(rows of df, component, p): chi-square tail of the squared distance to every component of a diagonal mixture."""
    out = []
    for k, (mean, var) in enumerate(zip(model["means"], model["variances"])):
        d2 = sum(((F.col(c) - m) * (F.col(c) - m) / v for c, m, v in zip(cols, mean, var)), F.lit(0.0))
        out.append(F.struct(F.lit(layer * len(model["means"]) + k + 1).alias("component"), chi2_survival(d2, len(cols)).alias("p")))
    return df.withColumn("_e", F.explode(F.array(*out))).select(*df.columns, "_e.component", "_e.p")


def initial_centroids(spark, grade: int, axes: dict[str, list[float]]) -> DataFrame:
    """(k, ye, b, r): corner combinations that add up to grade - 1, placed at each axis' maxima.

    An axis whose number of maxima isn't the grade falls back to an equal grid over [0, 1].
    """
    levels = {c: (sorted(v) if len(v) == grade else [i / (grade - 1) for i in range(grade)]) for c, v in axes.items()}
    combos = combinations(spark, grade, len(axes), grade - 1).orderBy(*[f"k{i}" for i in range(len(axes))]).collect()
    rows = [(n, *[float(levels[c][row[i]]) for i, c in enumerate(axes)]) for n, row in enumerate(combos)]
    return spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in axes))


def label_p_values(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """(rows of df, component, p): chi-square tail of the Mahalanobis distance to every label's own cloud.

    Means and sample covariances are aggregates; the pseudo-inverses of the few labels are driver-side.
    """
    sums = df.groupBy(label).agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.covar_samp(c, d).alias(f"c_{c}_{d}") for i, c in enumerate(cols) for d in cols[i:]])
    out = None
    for row in sums.orderBy(label).collect():
        cov = np.array([[float(row[f"c_{cols[min(i, j)]}_{cols[max(i, j)]}"] or 0.0) for j in range(len(cols))] for i in range(len(cols))])
        inv = np.linalg.pinv(cov)
        d2 = F.lit(0.0)
        for i, c in enumerate(cols):
            for j, d in enumerate(cols):
                d2 = d2 + (F.col(c) - row[f"m_{c}"]) * float(inv[i, j]) * (F.col(d) - row[f"m_{d}"])
        entry = F.struct(F.lit(row[label]).alias("component"), chi2_survival(F.greatest(d2, F.lit(0.0)), len(cols)).alias("p"))
        out = [entry] if out is None else [*out, entry]
    if out is None:
        return df.withColumns({"component": F.lit(None).cast(df.schema[label].dataType), "p": F.lit(None).cast("double")}).limit(0)
    return df.withColumn("_e", F.explode(F.array(*out))).select(*df.columns, "_e.component", "_e.p")


def confident(p_values: DataFrame, label: str, limits: dict | float) -> DataFrame:
    """Rows whose own component's p-value is above its limit, without component and p."""
    own = p_values.where(F.col(label) == F.col("component"))
    if isinstance(limits, dict):
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col(label)), F.lit(1.0))
    else:
        limit = F.lit(limits)
    return own.where(F.col("p") > limit).drop("component", "p")


def wildcards(code: Column) -> Column:
    """The code itself and the code with each place masked: two codes of one length within one substitution share one."""
    masked = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.concat(F.substring(code, F.lit(1), i - 1), F.lit("_"), F.substring(code, i + 1, F.length(code))))
    return F.array_union(F.array(code), masked)


def within_substitutions(left: DataFrame, right: DataFrame, left_col: str, right_col: str, most: int) -> DataFrame:
    """Pairs of left and right rows whose codes of one length differ in at most so many places, with the number d.

    Codes are cut into most + 1 pieces, one of which must be equal: an equi-join on (place, piece), each pair
    taken at its first equal piece, then counted exactly.
    """
    def pieces(code: Column) -> Column:
        n = F.length(code)
        cut = [F.floor(n * k / (most + 1)).cast("int") for k in range(most + 2)]
        return F.array(*[F.concat_ws(":", n.cast("string"), F.lit(k).cast("string"), F.substring(code, cut[k] + 1, cut[k + 1] - cut[k])) for k in range(most + 1)])

    a = left.select(F.struct("*").alias("l"), pieces(F.col(left_col)).alias("_p")).select("l", "_p", F.posexplode("_p").alias("_k", "_piece"))
    b = right.select(F.struct("*").alias("r"), pieces(F.col(right_col)).alias("_q")).select("r", "_q", F.explode("_q").alias("_piece"))
    d = hamming(F.col(f"l.{left_col}"), F.col(f"r.{right_col}"))
    first = F.array_position(F.zip_with("_p", "_q", lambda x, y: x == y), True) - 1
    return a.join(b, "_piece").where((first == F.col("_k")) & (d <= most)).select("l.*", "r.*", d.alias("d"))


def match_barcodes(reads: DataFrame, codebook: DataFrame, read_col: str = "sequence", code_col: str = "barcode", name_col: str = "gene") -> DataFrame:
    """Gene of each read: exact, else the only code within one substitution, else 'Ambiguous'; null if none.

    An equi-join on masked keys of the distinct reads; no pair of unlike codes is looked at.
    """
    distinct = reads.select(read_col).where(F.col(read_col).isNotNull()).distinct()
    left = distinct.withColumn("_k", F.explode(wildcards(F.col(read_col))))
    right = codebook.select(F.col(code_col).alias("_code"), F.col(name_col).alias("_name")).withColumn("_k", F.explode(wildcards(F.col("_code"))))
    hits = left.join(right, "_k").select(read_col, "_code", "_name").distinct()
    found = hits.groupBy(read_col).agg(
        F.max(F.when(F.col("_code") == F.col(read_col), F.col("_name"))).alias("_exact"), F.count_distinct("_code").alias("_n"), F.max("_name").alias("_one")
    )
    match = F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(F.col("_n") == 1, F.col("_one")).when(F.col("_n") > 1, F.lit("Ambiguous"))
    return reads.join(found, read_col, "left").withColumn("match", match).drop("_exact", "_n", "_one")


def near_reference(reads: DataFrame, codebook: DataFrame, read_col: str = "sequence", code_col: str = "barcode") -> DataFrame:
    """Reads whose sequence is within one substitution of some code."""
    keys = codebook.select(F.explode(wildcards(F.col(code_col))).alias("_k")).distinct()
    near = reads.select(read_col).distinct().withColumn("_k", F.explode(wildcards(F.col(read_col)))).join(keys, "_k").select(read_col).distinct()
    return reads.join(near, read_col, "left_semi")


def balanced(seq: Column, limits: dict[str, int] | None = None) -> Column:
    """At most so many of each base."""
    from mosaicq.functions.features import char_count

    ok = F.lit(True)
    for base, n in (limits or {"A": 5, "C": 9, "G": 8, "T": 8}).items():
        ok = ok & (char_count(seq, base) <= n)
    return ok
