"""Spatial joins, suppression, tiles and neighbour graphs as equi-joins on grid cells.

A radius join looks only at the cells around a point: one side is repeated for the squares of two by two cells
that hold them (4 in the plane, 8 in space), both sides meet by an equi-join on the square, and the exact
distance is a filter. The join is a sort-merge; adaptive execution splits crowded squares.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType

from mosaicq.workspace import MOST_PARTS, materialise


def _cell(c: str, r: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(r)))


def _distance2(a: str, b: str, dims: list[str]) -> Column:
    total = F.lit(0.0)
    for d in dims:
        delta = F.col(f"{a}.{d}").cast("double") - F.col(f"{b}.{d}").cast("double")
        total = total + delta * delta
    return total


def _around(df: DataFrame, dims: list[str], r: float) -> DataFrame:
    """Every row once for each square of two by two cells (in space: block) that holds one of its own cell and those around."""
    near = F.array(*[F.array(*[F.lit(k).cast("long") for k in o]) for o in itertools.product((0, 1), repeat=len(dims))])
    out = df.withColumn("_o", F.explode(near))
    return out.withColumns({f"_c{i}": F.shiftright(_cell(d, r) - 1, 1) + F.col("_o")[i] for i, d in enumerate(dims)}).drop("_o")


def _within(left: DataFrame, right: DataFrame, dims: list[str], r: float, strict: bool, also: list[str]) -> DataFrame:
    """Rows (l, r structs, d2) of all pairs within the radius.

    The join is a merge of shuffled rows: a broadcast of the repeated side would be held whole by every task.
    """
    a = left.select(F.struct("*").alias("l"), *[F.shiftright(_cell(d, r), 1).alias(f"_c{i}") for i, d in enumerate(dims)], *[F.col(k).alias(f"_k_{k}") for k in also])
    b = _around(right.select("*"), dims, r)
    b = b.select(F.struct(*right.columns).alias("r"), *[f"_c{i}" for i in range(len(dims))], *[F.col(k).alias(f"_k_{k}") for k in also])
    keys = [f"_c{i}" for i in range(len(dims))] + [f"_k_{k}" for k in also]
    d2 = _distance2("l", "r", dims)
    near = d2 < float(r) * r if strict else d2 <= float(r) * r
    return a.join(b.hint("merge"), keys).where(near).select("l", "r", d2.alias("d2"))


def within(left: DataFrame, right: DataFrame, dims: list[str], r: float) -> DataFrame:
    """Rows (l, r structs, d2) of all pairs of a left and a right row at most r apart."""
    return _within(left, right, dims, r, False, [])


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, dims=("y", "x"), id_col: str = "id", target_id: str = "cell_id", keep: bool = False) -> DataFrame:
    """For each point the nearest target nearer than the radius (ties: lowest id); others dropped or null."""
    pairs = _within(points.select(id_col, *dims), targets.select(target_id, *dims), list(dims), radius, True, [])
    best = pairs.groupBy(F.col(f"l.{id_col}").alias(id_col)).agg(F.min(F.struct(F.col("d2"), F.col(f"r.{target_id}").alias("t"))).alias("m"))
    best = best.select(id_col, F.col("m.t").alias(target_id), F.sqrt("m.d2").alias("distance"))
    return points.select(id_col).join(best, id_col, "left") if keep else best


def radius_pairs(points: DataFrame, radius: float, dims=("y", "x"), id_col: str = "id", group: list[str] = ()) -> DataFrame:
    """(a, b, distance) of all unordered pairs at most the radius apart, within groups if given."""
    own = points.select(*dict.fromkeys([id_col, *dims, *group]))
    pairs = _within(own, own, list(dims), radius, False, list(group)).where(F.col(f"l.{id_col}") < F.col(f"r.{id_col}"))
    return pairs.select(F.col(f"l.{id_col}").alias("a"), F.col(f"r.{id_col}").alias("b"), F.sqrt("d2").alias("distance"))


#: Points of a block, about, and at most: what one pass of the suppression decides together.
_BLOCK_POINTS, _MOST_POINTS = 20_000, 100_000


def _in_blocks(points: DataFrame, dims: list[str], radius: float) -> DataFrame:
    """points with block: squares of about _BLOCK_POINTS points, crowded ones dealt by a hash of the place."""
    ends = points.agg(F.count("*").alias("n"), *[f(F.col(d).cast("double")).alias(f"{k}{d}") for d in dims for k, f in (("a", F.min), ("b", F.max))]).first()
    spans = [max((ends[f"b{d}"] or 0.0) - (ends[f"a{d}"] or 0.0), float(radius)) for d in dims]
    side = max((math.prod(spans) * _BLOCK_POINTS / max(ends["n"], 1)) ** (1 / len(dims)), 2.0 * radius)
    while True:  # points on a line or in clumps fill few of the squares: wider ones, until they hold as many as meant
        cells = F.struct(*[_cell(d, side).alias(f"c{i}") for i, d in enumerate(dims)])
        crowds = materialise(points.groupBy(cells.alias("cell")).agg(F.count("*").alias("n")), "suppress-cells")
        if crowds.count() * _BLOCK_POINTS <= 4 * ends["n"] or side > max(spans):
            break
        side *= 2
    deal = F.pmod(F.xxhash64(*dims), F.ceil(F.col("n") / _MOST_POINTS))
    return points.withColumn("cell", cells).join(F.broadcast(crowds), "cell").withColumn("block", F.xxhash64("cell", deal)).drop("cell", "n")


def _best_of_places(points: DataFrame, priority: str, dims: list[str], id_col: str, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the best point of each place and group, points that nothing is better or worse than): what beats the best of a place beats the others there too."""
    whole = F.lit(True)
    for c in dict.fromkeys([*dims, priority, *group]):
        whole = whole & F.col(c).isNotNull()
    value = F.col(priority)
    kind = points.schema[priority].dataType
    value = -value.cast("decimal(20,0)") if isinstance(kind, IntegralType) else -value
    nan = F.isnan(priority) if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType) else F.lit(False)
    order = F.struct((~nan).alias("n"), value.alias("v"), F.col(id_col).alias("i"))
    places = points.where(whole).groupBy(*[F.col(c).alias(f"_p{i}") for i, c in enumerate([*dims, *group])]).agg(F.min_by(F.struct(*points.columns), order).alias("p"))
    return places.select("p.*"), points.where(~whole)


def suppress_within(points: DataFrame, radius: float, priority: str = "sum", dims=("y", "x"), id_col: str = "id", group: list[str] = ()) -> DataFrame:
    """Radius non-maximum suppression: greedy by falling priority, then rising id; ids are unique.

    A point is kept if no better neighbour is kept; of points at one place only the best can be. A pass goes
    through a block's points from the best down and decides all that depends on nothing undecided elsewhere, so
    that rounds are as many as the times a chain of ever better neighbours crosses from block to block, not its
    length. Pairs are dealt to blocks once; what is written to the shared folder is the decisions and the
    pairs that wait for another block.
    """
    dims, group = list(dims), list(group)
    best, unmatched = _best_of_places(points, priority, dims, id_col, group)
    best = materialise(best, "suppress-places")
    own = _in_blocks(best.select(*dict.fromkeys([id_col, priority, *dims, *group])), dims, radius)
    pairs = _within(own, own, dims, radius, False, group)
    better = (F.col(f"r.{priority}") > F.col(f"l.{priority}")) | ((F.col(f"r.{priority}") == F.col(f"l.{priority}")) & (F.col(f"r.{id_col}") < F.col(f"l.{id_col}")))
    rest = pairs.where((F.col(f"l.{id_col}") != F.col(f"r.{id_col}")) & better)
    near = F.col("l.block") == F.col("r.block")
    rest = rest.select(F.col(f"l.{id_col}").alias("lo"), F.col(f"l.{priority}").alias("lp"), F.col(f"r.{id_col}").alias("hi"), F.lit(None).cast("boolean").alias("known"), F.col("l.block").alias("block"), near.alias("near"))
    columns = rest.columns

    def decided(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lp", "lo"], ascending=[False, True], kind="stable")
        kept: dict = {}
        lows, highs, known, near = (frame[c].tolist() for c in ("lo", "hi", "known", "near"))
        below, waits = set(lows), []
        i, n = 0, len(lows)
        while i < n:
            own, state, open_ = lows[i], True, []
            while i < n and lows[i] == own:
                # Who stands in this block and under nobody is kept.
                other = known[i] if known[i] is not None else kept.get(highs[i]) if highs[i] in below else near[i] or None
                if other:
                    state = False
                elif other is None:
                    open_.append(i)
                    state = None if state else state
                i += 1
            if state is not None:
                kept[own] = state
            else:
                waits += open_
        out = pd.DataFrame({"lo": pd.Series(list(kept), dtype=frame["lo"].dtype), "kept": pd.Series(list(kept.values()), dtype=object)})
        left = frame.iloc[waits].assign(near=False, kept=None)
        return pd.concat([out.reindex(columns=left.columns).astype(object), left.astype(object)], ignore_index=True)

    kinds = ", ".join(f"{c} {rest.schema[c].dataType.simpleString()}" for c in columns)
    gone = None
    while True:
        found = materialise(rest.groupBy("block").applyInPandas(decided, f"{kinds}, kept boolean"), "suppress-decided")
        losers = found.where("not kept").select(F.col("lo").alias(id_col))
        gone = losers if gone is None else gone.unionByName(losers)
        left = found.where("kept is null").select(*columns)
        if left.isEmpty():
            return best.join(gone, id_col, "left_anti").select(*points.columns).unionByName(unmatched)
        # Who is neither decided nor waiting stands under nobody and is kept.
        told = found.groupBy(F.col("lo").alias("hi")).agg(F.max("kept").alias("_kept")).withColumn("_low", F.lit(True))
        rest = left.join(told, "hi", "left").withColumn("known", F.coalesce("known", F.when(F.col("_low").isNull(), True).otherwise(F.col("_kept")))).select(*columns)


def tile_table(spark, height: int, width: int, volume: int, overlap: int) -> DataFrame:
    """Tiles with halo: (tile_y, tile_x, pad_y, pad_x, cut_y, cut_x) of blocks of about the volume in pixels."""
    side = int(volume**0.5)

    def plan(extent: int) -> tuple[int, int]:
        n = max(1, -(-(extent - overlap) // (side - overlap)))
        return n, extent // n + overlap

    (ny, cy), (nx, cx) = plan(height), plan(width)
    ys = spark.range(ny).select(F.col("id").cast("int").alias("tile_y"))
    xs = spark.range(nx).select(F.col("id").cast("int").alias("tile_x"))
    grid = ys.crossJoin(xs)
    return grid.select("tile_y", "tile_x", (F.col("tile_y") * (cy - overlap)).alias("pad_y"), (F.col("tile_x") * (cx - overlap)).alias("pad_x"), F.lit(cy).alias("cut_y"), F.lit(cx).alias("cut_x"), F.lit(ny).alias("n_y"), F.lit(nx).alias("n_x"))


def owned_by_tile(points: DataFrame, tiles: DataFrame, trim: int = 125, compat_edges: bool = False) -> DataFrame:
    """Points of each tile (tile_y, tile_x, y, x) inside the tile but for the trimmed halo.

    First and last tiles keep their outer edge; compat_edges counts tiles from 1 in that test, so that
    tile 1 is the one without a lower trim and none is without an upper one.
    """
    joined = points.join(tiles, ["tile_y", "tile_x"])
    ok = F.lit(True)
    for d in ("y", "x"):
        first = F.col(f"tile_{d}") == (1 if compat_edges else 0)
        last = F.col(f"tile_{d}") == (F.col(f"n_{d}") if compat_edges else F.col(f"n_{d}") - 1)
        lo = F.col(f"pad_{d}") + F.when(first, 0).otherwise(trim)
        hi = F.col(f"pad_{d}") + F.col(f"cut_{d}") - F.when(last, 0).otherwise(trim)
        ok = ok & F.col(d).between(lo, hi)
    return joined.where(ok).select(*points.columns)


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: int) -> DataFrame:
    """Points inside half-open boxes (y0, x0, h, w; sides at most size): an equi-join on cells, not a theta join."""
    spread = boxes.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor((F.col("y0") + F.col("h") - 1) / size)))).withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor((F.col("x0") + F.col("w") - 1) / size))))
    cells = points.withColumn("cy", F.floor(F.col("y") / size)).withColumn("cx", F.floor(F.col("x") / size))
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w"))
    return cells.join(spread, ["cy", "cx"]).where(inside).drop("cy", "cx")


def in_box(y: Column, x: Column, y0: int, x0: int, h: int, w: int) -> Column:
    return (y >= y0) & (y < y0 + h) & (x >= x0) & (x < x0 + w)


def off_both_axes(y: Column, x: Column, y0: int, x0: int, h: int, w: int) -> Column:
    """True where neither coordinate is in its window (which is less than being outside the box)."""
    return ~((y >= y0) & (y < y0 + h)) & ~((x >= x0) & (x < x0 + w))


def in_bounds(shape: dict[str, int]) -> Column:
    ok = F.lit(True)
    for c, n in shape.items():
        ok = ok & (F.col(c) >= 0) & (F.col(c) < n)
    return ok


def mask_relabelled(points: DataFrame, mask: DataFrame, mode: str, layer: Column, height: int, width: int, xlim=(-0.8, 0.8), ylim=(-0.6, 0.8)) -> DataFrame:
    """Labels drawn as masks over the colour plane (mask: label, row, col of true pixels).

    replace: points of the layer inside a mask take its label (the last label where masks overlap);
    discard: points of the layer with a masked label outside that label's mask are removed.
    """
    row = ((ylim[1] - F.col("cd_2")) * height / (ylim[1] - ylim[0])).cast("int")
    col = ((F.col("cd_1") - xlim[0]) * width / (xlim[1] - xlim[0])).cast("int")
    at = points.withColumns({"_row": row, "_col": col, "_layer": layer})
    if mode == "replace":
        one = mask.groupBy(F.col("row").alias("_row"), F.col("col").alias("_col")).agg(F.max("label").alias("_new"))
        out = at.join(one, ["_row", "_col"], "left")
        out = out.withColumn("label", F.when(F.col("_layer") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("label")))
        return out.select(*points.columns)
    drawn = mask.select(F.col("label").alias("_drawn")).distinct()
    true = mask.select(F.col("label").alias("_label"), F.col("row").alias("_row"), F.col("col").alias("_col"), F.lit(True).alias("_in")).distinct()
    out = at.join(drawn, at["label"] == F.col("_drawn"), "left").withColumn("_label", F.col("label")).join(true, ["_label", "_row", "_col"], "left")
    return out.where(~F.col("_layer") | F.col("_drawn").isNull() | F.coalesce("_in", F.lit(False))).select(*points.columns)


def roi_of_points(points: DataFrame, mask: DataFrame, height: int, step: int = 100) -> DataFrame:
    """Region of each point by a downsampled mask (roi, order, row, col); the last region wins."""
    row = F.lit(height) - F.greatest(F.lit(1), F.floor(F.col("y") / step))
    col = F.floor(F.greatest(F.lit(0), F.col("x") / step))
    won = mask.groupBy(F.col("row").alias("_row"), F.col("col").alias("_col")).agg(F.max_by("roi", "order").alias("roi"))
    return points.withColumns({"_row": row.cast("int"), "_col": col.cast("int")}).join(won, ["_row", "_col"], "left").drop("_row", "_col")


#: Values of a block of vectors, at most; its rows, where there are few tasks otherwise, at least; tasks for each core, at least.
BLOCK_VALUES, LEAST_BLOCK_ROWS, _TASKS = 1 << 22, 256, 3
#: Rows of a product, and of those whose least one is taken first; pairs whose exact distances are taken at a time.
_STEP_ROWS, _PART_ROWS, _STEP_PAIRS = (256, 2048), 32, 1 << 14


def _nearest_in_block(p: np.ndarray, q: np.ndarray, order: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, row of q, d2) of the k nearest of q for every row of p, ties by order; same[i] is the row of q that is i itself or -1.

    Matrix products in single precision select, with room for their rounding: of every few rows the least one
    first, the others only where that one is as near as the k nearest met so far. The exact distances of what is
    left are compared. No more than a bounded number of either is held, however many rows are alike.
    """
    left, right, found = [], [], []
    middle = q.mean(0, dtype=float)
    with np.errstate(over="ignore"):
        a, b = ((x - middle).astype(np.float32) for x in (p, q))
        aa, bb = (np.einsum("ij,ij->i", x, x) for x in (a, b))
        most = 2 * (a.shape[1] + 8) * np.sqrt(aa.max()) * np.sqrt(bb.max()) + 4 * bb.max()
    if not np.isfinite(most):
        a, b = p - middle, q - middle
        bb = (b * b).sum(1)
        most = 2 * (a.shape[1] + 8) * np.sqrt((a * a).sum(1).max() * bb.max()) + 4 * bb.max()
    slack = a.dtype.type(2 * most * np.finfo(a.dtype).eps)
    # The square of a row of p is the same for the whole row, so it is left out.
    a, b = np.c_[-2 * a, np.ones(len(a), a.dtype)], np.c_[b, bb.astype(a.dtype)]

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[((p[i[n : n + _STEP_PAIRS]].astype(float) - q[j[n : n + _STEP_PAIRS]]) ** 2).sum(1) for n in range(0, len(i), _STEP_PAIRS)]])

    def best(parts: list[tuple], bound: np.ndarray) -> tuple:
        i, j, v = (np.concatenate(x) for x in zip(*parts))
        near = ~(v > bound[i])
        i, j, v = i[near], j[near], v[near]
        d2 = exact(at + i, j)
        sort = np.lexsort((order[j], d2, i))
        i, j, v, d2 = i[sort], j[sort], v[sort], d2[sort]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[first], j[first], v[first], d2[first]

    rows, step = _STEP_ROWS
    held = np.empty(rows * min(step, len(q)), a.dtype)
    for at in range(0, len(p), rows):
        some, own = np.ascontiguousarray(a[at : at + rows].T), same[at : at + rows]
        met, low, n = [], np.full((k, some.shape[1]), np.inf, a.dtype), 0
        for on in range(0, len(q), step):
            near = held[: min(step, len(q) - on) * some.shape[1]].reshape(-1, some.shape[1])
            np.matmul(b[on : on + step], some, out=near)
            mine = np.flatnonzero((own >= on) & (own < on + len(near)))
            near[own[mine] - on, mine] = np.inf
            whole = len(near) // _PART_ROWS * _PART_ROWS
            least = near[:whole].reshape(-1, _PART_ROWS, near.shape[1]).min(1)
            if whole < len(near):
                least = np.concatenate([least, near[whole:].min(0)[None]])
            # k rows, each of another part, are as near as the k-th least of the parts' nearest ones; later parts count by fours.
            few = least[: len(least) // 4 * 4].reshape(-1, 4, near.shape[1]).min(1) if on else least
            low = np.partition(np.concatenate([low, few]), k - 1, axis=0)[:k]
            bound = low[k - 1] + slack
            part, i = np.nonzero(~(least > bound))
            if not len(i):
                continue
            for cut in range(0, len(i), _STEP_PAIRS):
                ic = i[cut : cut + _STEP_PAIRS]
                j = part[cut : cut + _STEP_PAIRS, None] * _PART_ROWS + np.arange(_PART_ROWS)
                v = near[np.minimum(j, len(near) - 1), ic[:, None]]
                r, c = np.nonzero(~(v > bound[ic][:, None]))
                ic, j, v = ic[r], j[r, c], v[r, c]
                there = (j < len(near)) & (j + on != own[ic])
                met.append((ic[there], j[there] + on, v[there]))
                n += len(ic)
                if n > 2 * _STEP_PAIRS:
                    met = [best(met, bound)[:3]]
                    n = len(met[0][0]) - k * len(own)
        if met:
            i, j, _, d2 = best(met, low[k - 1] + slack)
            left.append(at + i)
            right.append(j)
            found.append(d2)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), np.concatenate([np.zeros(0), *found])


def knn(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "v", block_rows: int | None = None) -> DataFrame:
    """(src, dst, d2, rank) of the k nearest neighbours by squared distance, exactly, ties to the lowest id.

    Rows are dealt into blocks of bounded size, as large as leaves every core some pairs of blocks; a task multiplies
    two blocks, step by step, and keeps k a row, so what is shuffled and ranked after is k rows a row and block, never pairs. Rows without a vector, or with an empty place
    in it, take no part; vectors of unequal lengths are an error.
    """
    kind = vectors.schema[vec_col].dataType.simpleString()
    held = F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>")  # floats travel as they are
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), held.alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull()))
    n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} values")
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // (block_rows or max(1, BLOCK_VALUES // max(1, most or 1)))), min(math.isqrt(max(0, _TASKS * tasks - 1)) + 1, -(-n // LEAST_BLOCK_ROWS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    parts = min(4 * blocks * blocks, MOST_PARTS)  # so many that few tasks get several pairs of blocks
    a = dealt.select("id", "v", F.col("block").alias("bi"), every.alias("bj")).repartition(parts, "bi", "bj")
    b = dealt.select("id", "v", F.col("block").alias("bj"), every.alias("bi")).repartition(parts, "bi", "bj")
    kind = rows.schema["id"].dataType.simpleString()

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("v").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            none = left.column("id").slice(0, 0)
            return pa.table({"src": none, "dst": none, "d2": pa.array([], pa.float64())})
        order = np.empty(len(right), np.int64)
        order[pc.sort_indices(right.column("id")).to_numpy()] = np.arange(len(right))
        same = pc.fill_null(pc.index_in(left.column("id"), right.column("id")), -1).to_numpy()
        i, j, d2 = _nearest_in_block(matrix(left), matrix(right), order, same, k)
        return pa.table({"src": left.column("id").take(pa.array(i)), "dst": right.column("id").take(pa.array(j)), "d2": pa.array(d2)})

    near = a.groupBy("bi", "bj").cogroup(b.groupBy("bi", "bj")).applyInArrow(run, f"src {kind}, dst {kind}, d2 double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).where(F.col("rank") <= k)


def interactions(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of edges between each ordered pair of labels (labels: id, label)."""
    src = labels.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    dst = labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(src, "src").join(dst, "dst").groupBy("src_label", "dst_label").agg(F.count("*").alias("n_edges"))


def _places(rows: DataFrame, by: list[str], draw: Column, parts: int) -> DataFrame:
    """rows with n: their place from 0 in the order of draw (then id) within by, from counts of parts of the draws."""
    width = (1 << 40) // parts
    told = rows.withColumn("_d", F.pmod(draw, F.lit(1 << 40))).withColumn("_b", F.floor(F.col("_d") / width))
    counts = told.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_o", F.sum("_c").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b")) - F.col("_c")).drop("_c")
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", "id")) - 1
    return told.withColumn("_r", own).join(before, [*by, "_b"]).withColumn("n", F.col("_o") + F.col("_r")).drop("_d", "_b", "_o", "_r")


#: Rows whose places are found in one task.
_PLACED_ROWS = 1 << 12


def enrichment(edges: DataFrame, labels: DataFrame, permutations: int = 100, seed: int = 0) -> DataFrame:
    """z-scores of label pairs' edge counts against seeded permutations of the labels.

    Every permutation orders the ids by a hash of their own; no task orders a whole permutation.
    """
    seen = interactions(edges, labels)
    parts = max(1, labels.count() // _PLACED_ROWS)
    values = _places(labels.select("id", "label"), [], F.xxhash64("id", F.lit(seed)), parts).select("n", "label")
    rounds = labels.select("id", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("p"))
    shuffled = _places(rounds, ["p"], F.xxhash64("id", "p", F.lit(seed + 1)), parts).join(values, "n").select("p", "id", "label")
    src = shuffled.select("p", F.col("id").alias("src"), F.col("label").alias("src_label"))
    dst = shuffled.select("p", F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    counts = edges.select("src", "dst").join(src, "src").join(dst, ["p", "dst"]).groupBy("p", "src_label", "dst_label").agg(F.count("*").alias("n"))
    sums = counts.groupBy("src_label", "dst_label").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    mean = F.coalesce("s", F.lit(0)) / permutations
    spread = F.sqrt(F.greatest(F.coalesce("ss", F.lit(0)) / permutations - mean * mean, F.lit(0.0)))
    return seen.join(sums, ["src_label", "dst_label"], "left").select("src_label", "dst_label", "n_edges", mean.alias("expected"), F.when(spread > 0, (F.col("n_edges") - mean) / spread).alias("z"))


def co_occurrence(points: DataFrame, radius: float, rings: int, dims=("y", "x"), id_col: str = "id", label_col: str = "label") -> DataFrame:
    """P(label | other label, distance ring) / P(label | ring) of ordered pairs within the radius."""
    pairs = _within(points, points, list(dims), radius, False, []).where(F.col(f"l.{id_col}") != F.col(f"r.{id_col}"))
    ring = F.least(F.floor(F.sqrt("d2") * rings / radius), F.lit(rings - 1))
    n = pairs.groupBy(ring.alias("ring"), F.col(f"l.{label_col}").alias("given"), F.col(f"r.{label_col}").alias("label")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("ring")
    p_given = F.col("n") / F.sum("n").over(Window.partitionBy("ring", "given"))
    p = F.sum("n").over(Window.partitionBy("ring", "label")) / F.sum("n").over(whole)
    return n.withColumn("ratio", p_given / p)


def morans_i(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Moran's I of (id, value) over (src, dst, weight) edges, for each gene if values has that column."""
    keys = ["gene"] if "gene" in values.columns else []
    stats = values.groupBy(*keys).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    z = (values.join(stats, keys) if keys else values.crossJoin(F.broadcast(stats))).select(*keys, "id", (F.col("value") - F.col("m")).alias("z"), "n")
    square = z.groupBy(*keys).agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.max("n").alias("n"))
    a = z.select(*keys, F.col("id").alias("src"), F.col("z").alias("zi"))
    b = z.select(*keys, F.col("id").alias("dst"), F.col("z").alias("zj"))
    cross = edges.join(a, "src").join(b, ["dst", *keys]).groupBy(*keys).agg(F.sum(F.col("weight") * F.col("zi") * F.col("zj")).alias("c"), F.sum("weight").alias("w"))
    both = cross.join(square, keys) if keys else cross.crossJoin(square)
    return both.select(*keys, (F.col("n") / F.col("w") * F.col("c") / F.col("zz")).alias("morans_i"))


def relative_to(points: DataFrame, origins: DataFrame, key: str) -> DataFrame:
    """Coordinates counted from the origin (key, y0, x0) of each point's crop."""
    return points.join(origins, key).withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).drop("y0", "x0")


def diagonal_profiles(points: DataFrame, pixels: DataFrame, half: int) -> DataFrame:
    """(id, step, value): the pixels (y, x, value) on the diagonal through each point, half to either side; outside null."""
    steps = points.select("id", "y", "x", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("step"))
    at = steps.select("id", "step", (F.col("y") + F.col("step")).alias("y"), (F.col("x") + F.col("step")).alias("x"))
    return at.join(pixels, ["y", "x"], "left").select("id", "step", "value")


def shifted_by_tile(points: DataFrame, positions: DataFrame) -> DataFrame:
    """Tile coordinates to mosaic coordinates (positions: tile, y0, x0)."""
    out = points.join(positions, "tile")
    return out.withColumns({"y": F.col("y") + F.col("y0"), "x": F.col("x") + F.col("x0")}).drop("y0", "x0")


def shifted_by_cycle(points: DataFrame, offsets: DataFrame, reference: int = 1) -> DataFrame:
    """Registration offsets (cycle, tile, dy, dx) added outside the reference cycle; without one, unchanged."""
    out = points.join(offsets, ["cycle", "tile"], "left")
    moved = {c: F.col(c) + F.when(F.col("cycle") == reference, 0).otherwise(F.coalesce(f"d{c}", F.lit(0))) for c in ("y", "x")}
    return out.withColumns(moved).drop("dy", "dx")
