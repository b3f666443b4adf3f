"""Batch integration: soft clusters that batches share, and a ridge correction for each cluster.

Cells stay rows; what a round needs of them are sums over (cluster, batch): the weight of memberships and
the weighted vectors. These are taken in the tasks, shuffled as so many rows a task and collected: clusters
x batches x (dimensions + 1) numbers, bounded by MOST_SUMS. A cell's memberships follow from the centres and
the penalties that its block of cells saw last, so they are never stored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicq.workspace import discard, materialise

#: Rows from which the first centres are chosen; the numbers of all sums that the driver may hold.
SAMPLE_ROWS, MOST_SUMS = 2048, 50_000_000


@dataclass
class Settings:
    """clusters, width of memberships, weight of the diversity penalty, ridge, blocks of cells, rounds a clustering, corrections."""

    clusters: int = 20
    sigma: float = 0.1
    theta: float = 2.0
    ridge: float = 1.0
    blocks: int = 4
    rounds: int = 4
    corrections: int = 10
    tolerance: float = 1e-4


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-12)


def memberships(unit: np.ndarray, batch: np.ndarray, centres: np.ndarray, penalty: np.ndarray, sigma: float) -> np.ndarray:
    """Of cells (rows, of length 1) in clusters: exp(-distance / sigma) times the penalty (cluster, batch), adding up to 1."""
    log = -2 * (1 - unit @ centres.T) / sigma + np.log(penalty[:, batch]).T
    out = np.exp(log - log.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def first_centres(sample: np.ndarray, clusters: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centres of length 1: far points first, then rounds of nearest means."""
    rng = np.random.default_rng(seed)
    z = _unit(sample)
    centres = z[rng.integers(len(z))][None]
    while len(centres) < min(clusters, len(z)):
        away = np.maximum(1 - (z @ centres.T).max(1), 0)
        total = away.sum()
        pick = rng.choice(len(z), p=away / total) if total > 1e-9 else rng.integers(len(z))
        centres = np.concatenate([centres, z[pick][None]])
    for _ in range(rounds):
        near = (z @ centres.T).argmax(1)
        centres = _unit(np.array([z[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centres)]))
    return centres


def penalties(seen: np.ndarray, shares: np.ndarray, theta: float) -> np.ndarray:
    """(expected + 1) / (seen + 1) to the power of theta, by cluster and batch: what a batch has too much of weighs less."""
    expected = seen.sum(1, keepdims=True) * shares
    return ((expected + 1) / (seen + 1)) ** theta


def corrections_of(weight: np.ndarray, vectors: np.ndarray, ridge: float) -> np.ndarray:
    """(cluster, batch, dimension) that a full member of the cluster is moved by: a ridge regression on the batches, its intercept kept."""
    k, b = weight.shape
    out = np.zeros_like(vectors)
    for c in range(k):
        gram = np.zeros((b + 1, b + 1))
        gram[0, 0] = weight[c].sum()
        gram[0, 1:] = gram[1:, 0] = weight[c]
        gram[1:, 1:] = np.diag(weight[c] + ridge)
        right = np.concatenate([vectors[c].sum(0)[None], vectors[c]])
        out[c] = np.linalg.lstsq(gram, right, rcond=None)[0][1:]
    return out


class _Sums:
    """Sums over (cluster, batch) of cells (id, batch number, z, now), block by block."""

    def __init__(self, cells: DataFrame, batches: int, dims: int, sigma: float):
        self.cells, self.batches, self.dims, self.sigma = cells, batches, dims, sigma

    def of(self, models: dict[int, tuple[np.ndarray, np.ndarray]], column: str) -> tuple[np.ndarray, np.ndarray, float]:
        """(weights, weighted vectors of the column, memberships' cost) of the blocks that have a model (centres, penalties)."""
        shared = self.cells.sparkSession.sparkContext.broadcast(models)
        batches, dims, sigma = self.batches, self.dims, self.sigma

        def run(frames):
            mine, total, cost = shared.value, None, 0.0
            for frame in frames:
                for block, rows in frame.groupby("block"):
                    centres, penalty = mine[block]
                    unit, batch = _unit(np.stack(rows["now"].to_numpy())), rows["b"].to_numpy()
                    r = memberships(unit, batch, centres, penalty, sigma)
                    z = unit if column == "unit" else np.stack(rows[column].to_numpy())
                    if total is None:
                        total = np.zeros((len(centres), batches, dims + 1))
                    for b in np.unique(batch):
                        at = batch == b
                        total[:, b, 0] += r[at].sum(0)
                        total[:, b, 1:] += r[at].T @ z[at]
                    cost += float((r * (2 * (1 - unit @ centres.T) + sigma * np.log(np.maximum(r, 1e-300)))).sum())
            if total is not None:
                k, b = total.shape[:2]
                yield pd.DataFrame({"k": np.repeat(np.arange(k), b), "b": np.tile(np.arange(b), k), "s": list(total.reshape(k * b, -1)), "cost": np.r_[cost, np.zeros(k * b - 1)]})

        k = len(next(iter(models.values()))[0])
        rows = self.cells.where(F.col("block").isin([int(x) for x in models])).select("block", "b", "now", "z").mapInPandas(run, "k int, b int, s array<double>, cost double")
        added = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims + 1)]
        out = np.zeros((k, batches, dims + 1))
        cost = 0.0
        for row in rows.groupBy("k", "b").agg(F.sum("cost").alias("cost"), *added).collect():
            out[row["k"], row["b"]] = row[3:]
            cost += row["cost"]
        shared.unpersist()
        return out[:, :, 0], out[:, :, 1:], cost


def integrated(cells: DataFrame, id_col: str = "id", batch_col: str = "batch", vec_col: str = "pcs", settings: Settings | None = None) -> DataFrame:
    """cells with the column integrated: vectors in which batches overlap within clusters and clusters stay apart.

    Each correction starts again from the given vectors; it ends when the clusters' cost falls no more, or
    after settings.corrections. Rows without a vector or batch come back with null.
    """
    s = settings or Settings()
    spark = cells.sparkSession
    whole = cells.where(F.col(vec_col).isNotNull() & F.col(batch_col).isNotNull())
    counts = whole.groupBy(F.col(batch_col).alias("name")).agg(F.count("*").alias("n"), F.first(F.size(vec_col)).alias("d")).orderBy("name").limit(MOST_SUMS + 1).collect()
    if not counts:
        return cells.withColumn("integrated", F.lit(None).cast("array<double>"))
    dims = counts[0]["d"]
    if len(counts) * s.clusters * (dims + 1) > MOST_SUMS:
        raise ValueError("too many batches and clusters for the driver to hold their sums")
    numbers = spark.createDataFrame([(r["name"], i) for i, r in enumerate(counts)], f"name {whole.schema[batch_col].dataType.simpleString()}, b int")
    shares = np.array([r["n"] for r in counts], float) / sum(r["n"] for r in counts)
    z = F.col(vec_col).cast("array<double>")
    rows = whole.join(F.broadcast(numbers), F.col(batch_col) == F.col("name")).select(F.col(id_col).alias("id"), "b", F.pmod(F.xxhash64(id_col), F.lit(s.blocks)).cast("int").alias("block"), z.alias("z"), z.alias("now"))
    rows = materialise(rows, "integration")
    sample = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_ROWS).select("z").collect()
    centres = first_centres(np.array([r["z"] for r in sample]), s.clusters)
    present = sorted(r["block"] for r in rows.select("block").distinct().collect())
    last = None
    for _ in range(s.corrections):
        sums = _Sums(rows, len(counts), dims, s.sigma)
        even = np.ones((len(centres), len(counts)))
        models = {x: (centres, even) for x in present}
        seen, unit, costs = {}, {}, {}
        for x in present:
            seen[x], unit[x], costs[x] = sums.of({x: models[x]}, "unit")
        for _ in range(s.rounds):
            centres = _unit(sum(unit.values()).sum(1))
            for x in present:
                others = sum((v for y, v in seen.items() if y != x), np.zeros_like(even))
                models[x] = centres, penalties(others, shares, s.theta)
                seen[x], unit[x], costs[x] = sums.of({x: models[x]}, "unit")
        found = sum(seen.values())
        expected = found.sum(1, keepdims=True) * shares
        cost = sum(costs.values()) + s.sigma * s.theta * float((found * np.log((found + 1) / (expected + 1))).sum())
        weight, vectors, _ = sums.of(models, "z")
        moved = spark.sparkContext.broadcast((models, corrections_of(weight, vectors, s.ridge), s.sigma))

        def run(frames, moved=moved):
            mine, by, sigma = moved.value
            for frame in frames:
                for block, part in frame.groupby("block"):
                    batch, given = part["b"].to_numpy(), np.stack(part["z"].to_numpy())
                    r = memberships(_unit(np.stack(part["now"].to_numpy())), batch, *mine[block], sigma)
                    part = part.copy()
                    part["now"] = list(given - np.einsum("ik,kid->id", r, by[:, batch]))
                    yield part

        before, rows = rows, materialise(rows.mapInPandas(run, rows.schema), "integration")
        discard(spark, before)
        if last is not None and abs(last - cost) <= s.tolerance * abs(last):
            break
        last = cost
    return cells.join(rows.select(F.col("id").alias("_id"), F.col("now").alias("integrated")), F.col(id_col) == F.col("_id"), "left").drop("_id")
