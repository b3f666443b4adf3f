"""A plane layout of a weighted neighbour graph by sampled attraction and repulsion, block by block.

Nodes are dealt into blocks of bounded size. In a round a task moves its block's nodes for a few epochs: along
their sampled edges, whose other ends stand where the last round left them if they belong elsewhere, and away
from nodes drawn from a sample of all places that is sent along. Edges are packed by block once; a round sends each
block the places that its edges end at, as arrays, one for each other block, and is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.workspace import MOST_PARTS, discard, materialise

#: Nodes of a block, about; places drawn from in a round; gradients are cut at this size.
BLOCK_NODES, SAMPLE_PLACES, MOST_PULL = 20_000, 4096, 4.0
#: Edges of a row of packed ones, at most; packed edges; places sent in a round.
_PIECE_EDGES = 1 << 20
_PACKED = pa.schema([("block", pa.int32()), ("other", pa.int32()), ("piece", pa.int32()), ("at", pa.list_(pa.int32())), ("end", pa.list_(pa.int32())), ("share", pa.list_(pa.float64()))])
_PLACES = "to int, from int, y array<double>, x array<double>"


def curve(min_dist: float = 0.5, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a d^2b) is nearest to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond, by least squares."""
    d = np.linspace(0, 3 * spread, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([1.0, 1.0])
    damp = 1e-2

    def value(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + p[0] * d ** (2 * p[1]))

    cost = ((value(p) - want) ** 2).sum()
    for _ in range(300):
        step = 1e-6
        jacobian = np.stack([(value(p + step * e) - value(p - step * e)) / (2 * step) for e in np.eye(2)], 1)
        square = jacobian.T @ jacobian
        new = p - np.linalg.solve(square + damp * np.diag(np.diag(square)), jacobian.T @ (value(p) - want))
        new_cost = ((value(new) - want) ** 2).sum() if (new > 0).all() else np.inf
        p, cost, damp = (new, new_cost, damp / 3) if new_cost < cost else (p, cost, damp * 3)
    return float(p[0]), float(p[1])


def _cut(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, -MOST_PULL), MOST_PULL)


def moved(places: np.ndarray, own: np.ndarray, src: np.ndarray, dst: np.ndarray, share: np.ndarray, others: np.ndarray, rates: list[float], a: float, b: float, negatives: int, rng: np.random.Generator) -> np.ndarray:
    """places after one epoch a rate: edges (src, dst) drawn by their share move their source, if it is own, and its negatives push it.

    Edges of one source are taken one after the other, those of different sources together.
    """
    (y, x), (other_y, other_x) = (np.ascontiguousarray(p.T) for p in (places, others))
    order = np.lexsort((rng.random(len(src)), src))
    src, dst, share = src[order], dst[order], share[order]
    nth = np.arange(len(src)) - np.searchsorted(src, src)
    by_turn = np.argsort(nth, kind="stable")
    turns = np.split(by_turn, np.cumsum(np.bincount(nth))[:-1]) if len(src) else []
    for rate in rates:
        drawn = (rng.random(len(src)) < share) & own[src]
        for turn in turns:
            at = turn[drawn[turn]]
            i, j = src[at], dst[at]
            here_y, here_x = y[i], x[i]
            away_y, away_x = here_y - y[j], here_x - x[j]
            d2 = away_y * away_y + away_x * away_x
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
            here_y, here_x = here_y + rate * _cut(pull * away_y), here_x + rate * _cut(pull * away_x)
            for _ in range(negatives):
                k = rng.integers(len(other_y), size=len(i))
                away_y, away_x = here_y - other_y[k], here_x - other_x[k]
                d2 = away_y * away_y + away_x * away_x
                push = np.where(d2 > 0, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0)
                here_y, here_x = here_y + rate * _cut(push * away_y), here_x + rate * _cut(push * away_x)
            y[i], x[i] = here_y, here_x
    return np.stack([y, x], 1)


def _packed(links: pa.Table) -> pa.Table:
    """A block's edges (block, at, to, to_at, share, dst) as arrays, and for each other block which of its nodes they end at.

    Rows without other hold edges: places of the sources in their block, of the ends in theirs, or, counted from -1
    down, among the nodes of other blocks by block and place. Rows with other tell its owner what to send there.
    """
    block = links.column("block")[0].as_py()
    at, to, to_at = (links.column(c).to_numpy() for c in ("at", "to", "to_at"))
    away = to != block
    key = to[away].astype(np.int64) << 32 | to_at[away]
    every, found = np.unique(key, return_inverse=True)
    end = to_at.copy()
    end[away] = -1 - found
    dst = np.empty(len(links), np.int64)
    dst[pc.sort_indices(links.column("dst")).to_numpy()] = np.arange(len(links))
    sort = np.lexsort((dst, away, at))
    at, end, share = at[sort], end[sort], links.column("share").to_numpy()[sort]
    owners, first = np.unique(every >> 32, return_index=True)
    sent = np.split((every & 0xFFFFFFFF).astype(np.int32), first[1:]) if len(every) else []
    cuts = range(0, len(at), _PIECE_EDGES)
    rows = [(block, None, n, at[c : c + _PIECE_EDGES], end[c : c + _PIECE_EDGES], share[c : c + _PIECE_EDGES]) for n, c in enumerate(cuts)]
    rows += [(int(o), block, 0, s, s[:0], share[:0]) for o, s in zip(owners, sent)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED.types)], schema=_PACKED)


def _mover(told, rates: list[float], ab: tuple[float, float], negatives: int, seeds: list[int]):
    """The function that moves a block's nodes by its packed edges and the places (to, from, y, x) sent to it, and sends theirs on.

    Without rates nothing moves. What it returns without to are the places drawn from in the next round.
    """

    def run(packed: pa.Table, sent: pa.Table) -> pa.Table:
        block, (others, next_block, next_at) = sent.column("to")[0].as_py(), told.value
        sent = sent.sort_by("from")
        froms = sent.column("from").to_numpy()
        y, x = (sent.column(c).combine_chunks() for c in ("y", "x"))
        mine = int(np.flatnonzero(froms == block)[0])
        order = [mine, *(r for r in range(len(froms)) if r != mine)]
        n = len(y[mine])
        if rates:
            where = np.stack([np.concatenate([c[r].values.to_numpy() for r in order]) for c in (y, x)], 1)
            edges = packed.filter(pc.is_null(packed.column("other"))).sort_by("piece")
            src, dst, share = (edges.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "end", "share"))
            rng = np.random.default_rng([*seeds, block])
            where = moved(where, np.arange(len(where)) < n, src, np.where(dst < 0, n - 1 - dst, dst), share, others, rates, *ab, negatives, rng)[:n]
        else:
            where = np.stack([c[mine].values.to_numpy() for c in (y, x)], 1)
        out = [(block, block, where)]
        wanted = packed.filter(pc.is_valid(packed.column("other")))
        out += [(o, block, where[at.values.to_numpy()]) for o, at in zip(wanted.column("other").to_pylist(), wanted.column("at"))]
        drawn = next_at[next_block == block]
        out += [(None, block, where[drawn])] if len(drawn) else []
        return pa.table([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), *[pa.array([o[2][:, k] for o in out], pa.list_(pa.float64())) for k in (0, 1)]], names=["to", "from", "y", "x"])

    return run


def layout(edges: DataFrame, start: DataFrame, rounds: int = 40, epochs: int = 5, min_dist: float = 0.5, spread: float = 1.0, negatives: int = 5, block_nodes: int = BLOCK_NODES, seed: int = 0) -> DataFrame:
    """(id, y, x): places of the nodes of edges (src, dst, weight; both directions) from a start (id, y, x).

    Edges whose weight is too small to be drawn in all epochs are left out, as are nodes without a start;
    the rate falls linearly to 0 over rounds * epochs epochs.
    """
    a, b = curve(min_dist, spread)
    spark, total = edges.sparkSession, rounds * epochs
    most = edges.agg(F.max("weight")).first()[0]
    ends = start.agg(F.count("*").alias("n"), F.max(F.greatest(F.abs("y"), F.abs("x"))).alias("far")).first()
    if not ends["n"]:
        return start.select("id", "y", "x")
    scale = 10.0 / max(ends["far"] or 0.0, 1e-12)
    blocks = -(-ends["n"] // block_nodes)
    parts = min(4 * blocks, MOST_PARTS)
    block = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")
    # A little noise parts nodes that start at one place.
    noise = [(F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3 for k in (1, 2)]
    nodes = start.select("id", block.alias("block"), (F.col("y") * scale + noise[0]).alias("y"), (F.col("x") * scale + noise[1]).alias("x"))
    nodes = materialise(nodes.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1), "layout-nodes")
    share = F.col("weight") / F.lit(most or 1.0)
    links = edges.where((F.col("src") != F.col("dst")) & (share * total >= 1)).select("src", "dst", share.alias("share"))
    links = links.join(nodes.select(F.col("id").alias("src"), "block", "at"), "src").join(nodes.select(F.col("id").alias("dst"), F.col("block").alias("to"), F.col("at").alias("to_at")), "dst")
    links = links.select("block", "at", "to", "to_at", "share", "dst").repartition(parts, "block").groupBy("block")
    packed = materialise(links.applyInArrow(_packed, "block int, other int, piece int, at array<int>, end array<int>, share array<double>"), "layout-edges")
    own = nodes.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "y", "x"))).alias("p"))
    places = own.select(F.col("block").alias("to"), F.col("block").alias("from"), F.col("p.y").alias("y"), F.col("p.x").alias("x"))
    others, before = np.zeros((0, 2)), None
    # The first turn moves nothing: places are sent, and those drawn from in the first round told.
    for turn in range(-1, rounds):
        rates = [1 - (turn * epochs + e) / total for e in range(epochs)] if turn >= 0 else []
        draw = nodes.orderBy(F.xxhash64("id", F.lit(seed + turn + 1)), "id").limit(SAMPLE_PLACES).select("block", "at").collect() if turn + 1 < rounds else []
        drawn = np.array([tuple(r) for r in draw], np.int64).reshape(-1, 2)
        told = spark.sparkContext.broadcast((others, drawn[:, 0], drawn[:, 1]))
        step = packed.repartition(parts, "block").groupBy("block").cogroup(places.where("to is not null").repartition(parts, "to").groupBy("to"))
        before, places = before if turn < 0 else places, materialise(step.applyInArrow(_mover(told, rates, (a, b), negatives, [seed, turn]), _PLACES), "layout")
        others = np.zeros((len(drawn), 2))
        for r in places.where("to is null").collect():
            others[drawn[:, 0] == r["from"]] = np.stack([r["y"], r["x"]], 1)
        if before is not None:
            discard(spark, before)
    found = places.where(F.col("to") == F.col("from")).select(F.col("to").alias("block"), F.posexplode(F.arrays_zip("y", "x")).alias("at", "p"))
    return nodes.select("id", "block", "at").join(found, ["block", "at"]).select("id", "p.y", "p.x")


def trustworthiness(vectors: np.ndarray, places: np.ndarray, k: int = 15) -> float:
    """1 less the normalised ranks by which neighbours in the layout are no neighbours in the vectors: a measure on bounded samples."""
    n = len(vectors)
    far = ((vectors[:, None] - vectors[None]) ** 2).sum(2)
    near = ((places[:, None] - places[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    np.fill_diagonal(near, np.inf)
    rank = np.argsort(np.argsort(far, axis=1), axis=1) + 1
    shown = np.argsort(near, axis=1)[:, :k]
    over = np.maximum(np.take_along_axis(rank, shown, 1) - k, 0).sum()
    return float(1 - 2 * over / (n * k * (2 * n - 3 * k - 1)))
