"""Communities of weighted graphs by modularity: parallel local moves, refinement, contraction, level by level.

Edges (src, dst, weight) are undirected, each given once or in both directions alike; a round is joins and
aggregates of the edge table, written to the shared folder. Nodes that would move are let through by a coin
of their own, so that neighbours don't swap places for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mosaicq.operators.graph import connected_components
from mosaicq.workspace import FEW_ROWS, materialise

#: A gain below this share of the node's strength is no gain.
_LEAST_GAIN = 1e-9
#: A round that raises modularity by less is one without success; a refinement ends when no larger share of nodes could still move.
_LEAST_RISE, _FEW_OFFERS = 1e-4, 0.01


def both_directions(edges: DataFrame) -> DataFrame:
    """(src, dst, w): every edge between two nodes in both directions, its weight the largest that either direction gives."""
    two = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return two.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").cast("double").alias("w"))


def _written(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """df written to the shared folder, and sums over its rows taken by the same job."""
    seen = Observation()
    out = materialise(df.observe(seen, *[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(k) for k, c in sums.items()]), label)
    return out, seen.get


def _coin(key: str) -> Column:
    """A coin of a node or part in the turn of its row; turns are columns, so that every round's plan compiles to the same code."""
    return F.pmod(F.xxhash64(key, "turn"), F.lit(2)) == 0


def move_gain(to_community: Column, strength: Column, community: Column, resolution: float, twice_m: float) -> Column:
    """Change of modularity times m when a node, taken out of all communities, enters one: weight to it less the expected one."""
    return to_community - F.lit(resolution) * strength * community / F.lit(twice_m)


def _kept(edges: DataFrame, few: bool) -> DataFrame:
    """edges (src, dst, w, k), kept by the executors as the rounds join them: by source where labels are few and sent to all, else by the end that meets the labels."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = edges.select("src", "dst", "w", "k").repartition(parts, "src" if few else "dst").persist()
    kept.count()  # only of rows that are there the planner knows how they lie
    return kept


def _with_loops(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, w, k): edges with their source's strength, and a loop of no weight for each node, so that it meets its own label too."""
    strengths = labels.select(F.col("node").alias("src"), "k")
    return both.join(strengths, "src").select("src", "dst", "w", "k").unionByName(strengths.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("w"), "k"))


def _links(kept: DataFrame, few: bool, labels: DataFrame, *told: str) -> DataFrame:
    """(node, to, w, k, home, told): each node's weight to each label (node, to, told) among its neighbours and its own.

    Only labels are dealt to the edges, and, where they are many, the edges found once to their source; what
    is grouped by node after needs no further exchange.
    """
    ends = labels.select(F.col("node").alias("dst"), "to", *told)
    near = kept.join(F.broadcast(ends) if few else ends, "dst").select("src", "to", "w", "k", (F.col("src") == F.col("dst")).alias("home"), *told)
    if not few:
        near = near.repartition(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src")
    near = near.groupBy("src", "to").agg(F.sum("w").alias("w"), *[F.max(c).alias(c) for c in ("k", "home", *told)])
    return near.withColumnRenamed("src", "node")


def _moved(kept: DataFrame, few: bool, labels: DataFrame, resolution: float, twice_m: float) -> DataFrame:
    """(node, k, turn, c, was, wants, inside, kc): labels (node, k, c, turn) after one round; wants tells who would gain by moving."""
    size = labels.groupBy("c").agg(F.sum("k").alias("kc"))
    told = _links(kept, few, labels.join(size, "c").withColumnRenamed("c", "to"), "kc", "turn").withColumnRenamed("to", "c")
    home = F.col("home")
    gain = move_gain(F.col("w"), F.col("k"), F.col("kc") - F.when(home, F.col("k")).otherwise(0.0), resolution, twice_m)
    best = told.groupBy("node").agg(
        F.max("k").alias("k"), (F.max("turn") + 1).alias("turn"), F.max(F.when(home, F.col("c"))).alias("was"), F.max(F.when(home, gain)).alias("stay"), F.max(F.when(home, F.col("w"))).alias("inside"), F.max(F.when(home, F.col("kc"))).alias("kc"),
        F.max(F.when(~home, F.struct(gain.alias("g"), F.xxhash64("c").alias("h"), F.col("c").alias("c")))).alias("best"),
    )
    wants = F.coalesce(F.col("best.g") > F.col("stay") + _LEAST_GAIN * F.col("k"), F.lit(False))
    return best.withColumn("wants", wants).select("node", "k", "turn", F.when(F.col("wants") & _coin("node"), F.col("best.c")).otherwise(F.col("was")).alias("c"), "was", "wants", "inside", "kc")


def local_moves(kept: DataFrame, few: bool, labels: DataFrame, resolution: float, twice_m: float, seed: int = 0, patience: int = 2) -> DataFrame:
    """(node, k, c) after rounds of moves: until nobody gains, or modularity hasn't risen for some rounds; the best state counts."""
    best, best_q, since = labels, None, 0
    labels = labels.withColumn("turn", F.lit(1000 * seed))
    while True:
        step = _moved(kept, few, labels, resolution, twice_m)
        step, seen = _written(step, "moves", inside=F.col("inside"), kk=F.col("k") * F.col("kc"), wants=F.col("wants").cast("int"))
        q = seen["inside"] / twice_m - resolution * seen["kk"] / twice_m**2
        if best_q is None or q > best_q + _LEAST_RISE:
            best, best_q, since = step.select("node", "k", F.col("was").alias("c")), q, 0
        else:
            since += 1
        if not seen["wants"] or since >= patience:
            return best
        labels = step.select("node", "k", "c", "turn")


def refined(kept: DataFrame, few: bool, labels: DataFrame, resolution: float, twice_m: float, seed: int = 0) -> DataFrame:
    """(node, k, c, r): within each community c, nodes merged one by one into connected parts r.

    In a round only nodes that are alone move, and only into parts that nobody leaves (larger ones, or single
    nodes whose coin says stay), so a part is always connected, and one that is alone bears its node's name; both
    node and part must be well connected to the rest of c.
    """
    state = labels.select("node", "k", "c", F.col("node").alias("r"), F.lit(1000 * seed).alias("turn"))
    inner = kept.join(labels.select(F.col("node").alias("src"), "c"), "src").join(labels.select(F.col("node").alias("dst"), F.col("c").alias("_c")), "dst")
    inner = _kept(inner.where(F.col("c") == F.col("_c")), few)
    whole = materialise(labels.groupBy("c").agg(F.sum("k").alias("kc")), "community-strengths")
    home = F.col("home")
    while True:
        # A node's weight to the rest of its community, and a part's: what leaves the part.
        near = _links(inner, few, state.withColumnRenamed("r", "to"), "c")
        each = near.groupBy("node").agg(F.max(F.when(home, F.col("to"))).alias("r"), F.max("k").alias("k"), F.max("c").alias("c"), F.coalesce(F.sum(F.when(~home, F.col("w"))), F.lit(0.0)).alias("out"))
        part = each.groupBy("r").agg(F.max("c").alias("c"), F.sum("k").alias("kr"), F.count("*").alias("n"), F.sum("out").alias("out")).join(whole, "c")
        bound = F.col("kr") * (F.col("kc") - F.col("kr")) * F.lit(resolution / twice_m)
        part = part.select("r", "kr", "n", (F.col("out") >= bound - _LEAST_GAIN).alias("well"))
        told = _links(inner, few, state.join(part, "r").withColumnRenamed("r", "to"), "c", "turn", "kr", "n", "well")
        gain = move_gain(F.col("w"), F.col("k"), F.col("kr"), resolution, twice_m)
        offer = ~home & F.col("well") & (gain > _LEAST_GAIN * F.col("k"))
        open_ = _coin("node") & ((F.col("n") > 1) | ~_coin("to"))
        best = told.groupBy("node").agg(
            F.max("k").alias("k"), F.max("c").alias("c"), (F.max("turn") + 1).alias("turn"), F.max(F.when(home, F.col("to"))).alias("r"),
            F.max(home & (F.col("n") == 1) & F.col("well")).alias("alone"), F.max(offer).alias("offer"),
            F.max(F.when(offer & open_, F.struct(gain.alias("g"), F.xxhash64("to").alias("h"), F.col("to").alias("to")))).alias("b"),
        )
        step = best.select("node", "k", "c", F.when(F.col("alone"), F.coalesce("b.to", "r")).otherwise(F.col("r")).alias("r"), "turn", (F.col("alone") & F.col("offer")).alias("offered"))
        step, seen = _written(step, "refined", offered=F.col("offered").cast("int"), nodes=F.lit(1))
        if seen["offered"] <= _FEW_OFFERS * seen["nodes"]:
            inner.unpersist()
            return step.select("node", "k", "c", "r")
        state = step.select("node", "k", "c", "r", "turn")


def _improved(both: DataFrame, labels: DataFrame, n: int, resolution: float, twice_m: float, seed: int) -> DataFrame:
    """(node, k, c): communities of nodes (node, k, c) after moves, refinement and contraction up to the last level."""
    first, members = labels.select("node", "k"), labels.select("node", F.col("node").alias("at"))
    while True:
        few = n <= FEW_ROWS
        kept = _kept(_with_loops(both, labels), few)
        labels = local_moves(kept, few, labels, resolution, twice_m, seed)
        parts = refined(kept, few, labels, resolution, twice_m, seed)
        kept.unpersist()
        smaller = materialise(parts.groupBy(F.col("r").alias("node")).agg(F.sum("k").alias("k"), F.max("c").alias("c")), "graph-nodes")
        left = smaller.count()
        if left == n:
            told = members.join(labels.select(F.col("node").alias("at"), "c"), "at").join(first, "node")
            return materialise(told.select("node", "k", "c"), "graph-communities")
        members = materialise(members.join(parts.select(F.col("node").alias("at"), "r"), "at").select("node", F.col("r").alias("at")), "graph-members")
        a, b = parts.select(F.col("node").alias("src"), F.col("r").alias("rs")), parts.select(F.col("node").alias("dst"), F.col("r").alias("rd"))
        both = both.join(a, "src").join(b, "dst").where("rs <> rd").groupBy(F.col("rs").alias("src"), F.col("rd").alias("dst")).agg(F.sum("w").alias("w"))
        both, labels, n, seed = materialise(both, "graph-edges"), smaller, left, seed + 1


def leiden(edges: DataFrame, resolution: float = 1.0, seed: int = 0, iterations: int = 2) -> DataFrame:
    """(node, community) of every node that has an edge; communities are connected and named by their least node.

    Each level moves nodes, refines the communities found and goes on with a graph of their parts, until the
    parts are the nodes; further iterations start from the communities found. What parallel moves may have left
    unconnected at last is told apart by its components, which can only raise the modularity.
    """
    both = materialise(both_directions(edges), "graph-edges")
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")), "graph-nodes")
    n, twice_m = labels.agg(F.count("*"), F.sum("k")).first()
    for turn in range(iterations if n else 0):
        labels = _improved(both, labels, n, resolution, twice_m, seed + 100 * turn)
    inside = both.join(labels.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(labels.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
    found = connected_components(inside.where("cs = cd and src < dst").select("src", "dst"))
    return labels.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of labels (node, community) on edges, as one row."""
    both = both_directions(edges)
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    told = both.join(a, "src").join(b, "dst")
    each = told.groupBy("cs").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = each.agg(F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.select((F.col("inside") / F.col("m2") - F.lit(resolution) * F.col("kk") / (F.col("m2") * F.col("m2"))).alias("modularity"))


#: Places of lists of neighbours, weighed at a time.
_STEP_PLACES = 1 << 20


def _weights(d: np.ndarray, sizes: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of distances d, lists of the given sizes one after the other: exp(-(d - nearest) / bandwidth) of each list."""
    start = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    # Each list from its least distance on, so that sums don't depend on its order; what is missing below the longest weighs 0.
    sort = np.lexsort((d, row))
    table = np.full((sizes.max(), len(sizes)), np.inf)
    place = np.arange(len(d)) - start[row]
    table[place, row] = d[sort]
    mean = np.where(np.isinf(table), 0.0, table).sum(0) / sizes
    rho = np.where(table > 0, table, np.inf).min(0)
    rho[np.isinf(rho)] = 0.0
    most = table[sizes - 1, np.arange(len(sizes))]
    away, want = -np.maximum(table - rho, 0.0), np.log2(sizes.astype(float))
    # At this width even the farthest weighs almost 1, so the bandwidth lies below it.
    low, high = np.zeros(len(sizes)), 1000 * (most + 1e-9)
    for _ in range(rounds):
        mid = (low + high) / 2
        many = np.exp(away / mid).sum(0) > want
        low, high = np.where(many, low, mid), np.where(many, mid, high)
    width = np.maximum(np.maximum((low + high) / 2, 1e-3 * mean), 1e-300)
    out = np.empty(len(d))
    out[sort] = np.exp(away / width)[place, row]
    return out


def fuzzy_weights(neighbours: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, dst, weight) of a kNN graph (src, dst, d2): a row's distances to weights, the two directions united.

    A weight is exp(-(d - nearest) / bandwidth), the bandwidth such that a row's weights add up to log2 of their
    number, found by bisection over the row's own list of neighbours, of many rows at a time; a + b - a * b unites
    the directions.
    """
    lists = neighbours.groupBy("src").agg(F.collect_list(F.struct("dst", F.sqrt("d2").alias("d"))).alias("near")).select("src", "near.dst", "near.d")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("d")).to_numpy(zero_copy_only=False)
            step = max(1, _STEP_PLACES // max(1, sizes.max(initial=0)))
            for at in range(0, len(sizes), step):
                some, n = batch.slice(at, step), sizes[at : at + step]
                w = _weights(some.column("d").flatten().to_numpy(zero_copy_only=False), n, rounds)
                yield pa.RecordBatch.from_arrays([some.column("src").take(pa.array(np.repeat(np.arange(len(n)), n))), some.column("dst").flatten(), pa.array(w)], names=["src", "dst", "w"])

    kinds = [neighbours.schema[c].dataType.simpleString() for c in ("src", "dst")]
    one = lists.mapInArrow(weighed, f"src {kinds[0]}, dst {kinds[1]}, w double")
    two = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    united = two.groupBy("src", "dst").agg(F.sum("w").alias("s"), F.max("w").alias("hi"))
    return united.select("src", "dst", (F.col("s") - F.col("hi") * (F.col("s") - F.col("hi"))).alias("weight"))
