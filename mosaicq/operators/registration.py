"""Rigid registration of volumes by mutual information.

A volume is planes (keys, z, height, width, pixels). The fixed one is cut into blocks, the moving one into
the boxes where the present transform takes these blocks, with a margin; a round takes from every block its
part of the joint histogram and of the histogram's derivatives by the six parameters, which add up to bins *
bins * 7 numbers a volume on the driver. When the transform has moved a corner by the margin, boxes are cut
again. Coordinates are (z, y, x); angles turn about these axes through the fixed volume's centre.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicq.sources.images import to_array
from mosaicq.workspace import materialise


@dataclass
class Rigid:
    """x -> R (x - centre) + centre + shift; R turns about z, then x, then y."""

    centre: np.ndarray
    angles: np.ndarray = field(default_factory=lambda: np.zeros(3))  # about z, y, x
    shift: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def _turns(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Matrices of the three turns and their derivatives, in the order of the angles."""
        out = []
        for angle, (a, b) in zip(self.angles, ((1, 2), (2, 0), (0, 1))):  # the two axes that turn
            c, s = np.cos(angle), np.sin(angle)
            m, d = np.eye(3), np.zeros((3, 3))
            m[[a, a, b, b], [a, b, a, b]] = c, s, -s, c
            d[[a, a, b, b], [a, b, a, b]] = -s, c, -c, -s
            out.append((m, d))
        return out

    def matrix(self) -> np.ndarray:
        (z, _), (y, _), (x, _) = self._turns()
        return z @ x @ y

    def of(self, points: np.ndarray) -> np.ndarray:
        return (points - self.centre) @ self.matrix().T + self.centre + self.shift

    def derivatives(self) -> list[np.ndarray]:
        """Derivatives of the matrix by the three angles."""
        (z, dz), (y, dy), (x, dx) = self._turns()
        return [dz @ x @ y, z @ x @ dy, z @ dx @ y]

    def moved(self, step: np.ndarray) -> Rigid:
        return Rigid(self.centre, self.angles + step[:3], self.shift + step[3:])


def interpolated(a: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, gradients, which points lie inside) of a volume at points, linear between voxels."""
    size = np.array(a.shape)
    inside = ((points >= 0) & (points <= size - 1)).all(1)
    at = np.clip(points, 0, size - 1)
    low = np.minimum(at.astype(int), np.maximum(size - 2, 0))
    part = at - low
    value, gradient = np.zeros(len(at)), np.zeros((len(at), 3))
    for corner in np.ndindex(2, 2, 2):
        v = a[tuple(np.minimum(low + corner, size - 1).T)]
        w = [part[:, k] if c else 1 - part[:, k] for k, c in enumerate(corner)]
        value += v * w[0] * w[1] * w[2]
        for k, c in enumerate(corner):
            others = [w[i] for i in range(3) if i != k]
            gradient[:, k] += (v if c else -v) * others[0] * others[1]
    return value, gradient, inside


def _spline(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cubic B-spline and its derivative."""
    u = np.abs(t)
    value = np.where(u < 1, 2 / 3 - u**2 + u**3 / 2, np.where(u < 2, (2 - u) ** 3 / 6, 0))
    slope = np.where(u < 1, -2 * u + 1.5 * u**2, np.where(u < 2, -((2 - u) ** 2) / 2, 0)) * np.sign(t)
    return value, slope


def joint_sums(fixed: np.ndarray, corner: np.ndarray, moving: np.ndarray, box: np.ndarray, transform: Rigid, ranges: tuple, bins: int) -> np.ndarray:
    """(7, bins, bins): a block's joint histogram and its derivatives by the three angles and shifts.

    Fixed values fall into whole bins, moving ones are spread by a cubic spline, two bins left free at either end.
    """
    f0, f1, m0, m1 = ranges
    points = np.indices(fixed.shape).reshape(3, -1).T + corner
    value, gradient, inside = interpolated(moving, transform.of(points) - box)
    points, value, gradient, f = points[inside], value[inside], gradient[inside], fixed.ravel()[inside]
    width = max(m1 - m0, 1e-12) / (bins - 5)
    row = np.clip(((f - f0) / max(f1 - f0, 1e-12) * (bins - 5) + 2).astype(int), 0, bins - 1)
    place = np.clip((value - m0) / width, 0, bins - 5) + 2
    rel = points - transform.centre
    slopes = [np.einsum("nd,nd->n", gradient, rel @ d.T) for d in transform.derivatives()] + list(gradient.T)
    out = np.zeros((7, bins * bins))
    first = place.astype(int) - 1
    for k in range(4):
        b, db = _spline(first + k - place)
        cell = row * bins + np.clip(first + k, 0, bins - 1)
        out[0] += np.bincount(cell, b, bins * bins)
        for p, s in enumerate(slopes):
            out[p + 1] += np.bincount(cell, -db * s / width, bins * bins)
    return out.reshape(7, bins, bins)


def mutual_information(sums: np.ndarray) -> tuple[float, np.ndarray]:
    """Mutual information of a joint histogram and its gradient by the six parameters."""
    p = sums[0] / max(sums[0].sum(), 1e-12)
    pf, pm = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
    some = p > 1e-15
    log = np.zeros_like(p)
    np.log(p / np.maximum(pf * pm, 1e-300), out=log, where=some)
    each = np.zeros_like(p)
    np.log(p / np.maximum(pm, 1e-300), out=each, where=some)
    return float((p * log).sum()), (sums[1:] * each).sum((1, 2)) / max(sums[0].sum(), 1e-12)


def _boxes(planes: DataFrame, keys: list[str], wanted: dict, name: str) -> DataFrame:
    """(keys, block, z0, y0, x0, shape, name): the boxes (block, lowest and highest corner) of each volume, cut from its planes."""
    shared = planes.sparkSession.sparkContext.broadcast(wanted)
    kinds = ", ".join(f"`{k}` {planes.schema[k].dataType.simpleString()}" for k in keys)

    def cut(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                a = to_array(r.pixels, r.height, r.width)
                for block, (low, high) in shared.value.get(key, {}).items():
                    if low[0] <= r.z < high[0]:
                        part = a[low[1] : high[1], low[2] : high[2]]
                        out.append((*key, block, int(low[0]), int(low[1]), int(low[2]), r.z, part.shape[0], part.shape[1], part.astype("<u2").tobytes()))
            yield pd.DataFrame(out, columns=[*keys, "block", "z0", "y0", "x0", "z", "h", "w", "part"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("z")
        first = rows.iloc[0]
        return pd.DataFrame([{**{k: first[k] for k in [*keys, "block", "z0", "y0", "x0", "h", "w"]}, name: b"".join(rows["part"])}])

    of = f"{kinds}, block int, z0 int, y0 int, x0 int"
    pieces = planes.select(*keys, "z", "height", "width", "pixels").mapInPandas(cut, f"{of}, z int, h int, w int, part binary")
    return pieces.groupBy(*keys, "block").applyInPandas(joined, f"{of}, h int, w int, {name} binary")


def _corners(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.array([[(low, high)[c][k] for k, c in enumerate(corner)] for corner in np.ndindex(2, 2, 2)], float)


class _Paired:
    """Blocks of the fixed volumes with the boxes of the moving ones under the transforms they were cut for."""

    def __init__(self, fixed: DataFrame, moving: DataFrame, keys: list[str], sizes: dict, side: int, margin: float):
        self.keys, self.moving, self.sizes, self.margin = keys, moving, sizes, margin
        self.blocks = {}
        for key, size in sizes.items():
            grid = [range(0, n, side) for n in size]
            lows = [np.array(p) for p in np.stack(np.meshgrid(*grid, indexing="ij"), -1).reshape(-1, 3)]
            self.blocks[key] = {i: (p, np.minimum(p + side, size)) for i, p in enumerate(lows)}
        self.fixed = materialise(_boxes(fixed, keys, self.blocks, "fixed"), "registration-fixed")
        self.rows, self.cut_for = None, None

    def under(self, transforms: dict) -> DataFrame:
        """The pairs, cut again if a corner has moved further than the margin."""
        far = max((np.abs(t.of(_corners(np.zeros(3), self.sizes[k])) - self.cut_for[k].of(_corners(np.zeros(3), self.sizes[k]))).max() for k, t in transforms.items()), default=0) if self.cut_for else np.inf
        if far > self.margin:
            wanted = {}
            for key, t in transforms.items():
                size, wanted[key] = np.array(self.sizes[key]), {}
                for block, (low, high) in self.blocks[key].items():
                    at = t.of(_corners(low, high - 1))
                    a, b = np.floor(at.min(0) - self.margin - 1).astype(int), np.ceil(at.max(0) + self.margin + 2).astype(int)
                    a, b = np.clip(a, 0, size), np.clip(b, 0, size)
                    if (a < b).all():
                        wanted[key][block] = (a, b)
            boxes = _boxes(self.moving, self.keys, wanted, "moving").withColumnsRenamed({c: f"m_{c}" for c in ("z0", "y0", "x0", "h", "w")})
            self.rows = materialise(self.fixed.join(boxes, [*self.keys, "block"]), "registration-pairs")
            self.cut_for = dict(transforms)
        return self.rows


def _pair(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fixed block, its corner, moving box, its corner) of a row."""
    fixed, moving = (np.frombuffer(raw, "<u2").reshape(-1, h, w).astype(float) for raw, h, w in ((r.fixed, r.h, r.w), (r.moving, r.m_h, r.m_w)))
    return fixed, np.array([r.z0, r.y0, r.x0]), moving, np.array([r.m_z0, r.m_y0, r.m_x0])


def rigid_transforms(fixed: DataFrame, moving: DataFrame, keys: list[str], bins: int = 50, first_step: float = 2.0, least_step: float = 1e-4, rounds: int = 200, side: int = 128, margin: float = 8.0) -> dict[tuple, Rigid]:
    """The transform of each volume's places to the moving volume's, by descents of regular steps, all volumes in one job a round.

    A step goes along the gradient (angles counted by the way they move the corners) and is halved when
    the gradient turns round; both volumes of a key have the same size.
    """
    bounds = fixed.groupBy(*keys).agg(F.max("z"), F.max("height"), F.max("width")).collect()
    sizes = {tuple(r[: len(keys)]): (r[-3] + 1, r[-2], r[-1]) for r in bounds}
    paired = _Paired(fixed, moving, keys, sizes, side, margin)

    def extent(column: str):
        def run(frames):
            for frame in frames:
                ends = [(np.frombuffer(x, "<u2").min(), np.frombuffer(x, "<u2").max()) if len(x) else (65535, 0) for x in frame[column]]
                yield frame[keys].assign(lo=[float(a) for a, _ in ends], hi=[float(b) for _, b in ends])

        return run

    kinds = ", ".join(f"`{k}` {fixed.schema[k].dataType.simpleString()}" for k in keys)
    ranges = {}
    for df, column in ((fixed, "pixels"), (moving, "pixels")):
        for r in df.select(*keys, column).mapInPandas(extent(column), f"{kinds}, lo double, hi double").groupBy(*keys).agg(F.min("lo"), F.max("hi")).collect():
            ranges.setdefault(tuple(r[: len(keys)]), []).extend(r[-2:])
    transforms = {k: Rigid((np.array(s) - 1) / 2) for k, s in sizes.items() if len(ranges.get(k, [])) == 4}
    radius = {k: max(1.0, float(np.linalg.norm((np.array(s) - 1) / 2))) for k, s in sizes.items()}
    open_, step, last = set(transforms), dict.fromkeys(transforms, first_step), {}
    for _ in range(rounds):
        if not open_:
            break
        told = fixed.sparkSession.sparkContext.broadcast(({k: transforms[k] for k in open_}, ranges))

        def run(frames, told=told):
            now, span = told.value
            total: dict = {}
            for frame in frames:
                for r in frame.itertuples(index=False):
                    key = tuple(getattr(r, k) for k in keys)
                    if key in now:
                        total[key] = total.get(key, 0) + joint_sums(*_pair(r), now[key], tuple(span[key]), bins)
            for key, sums in total.items():
                flat = sums.ravel()
                at = np.flatnonzero(flat)
                yield pd.DataFrame({**{k: [v] * len(at) for k, v in zip(keys, key)}, "i": at, "s": flat[at]})

        found = paired.under(transforms).mapInPandas(run, f"{kinds}, i int, s double").groupBy(*keys, "i").agg(F.sum("s").alias("s")).toPandas()
        for key in list(open_):
            mine = found[(found[keys] == pd.Series(key, keys)).all(1)]
            sums = np.zeros(7 * bins * bins)
            sums[mine["i"].to_numpy()] = mine["s"].to_numpy()
            _, g = mutual_information(sums.reshape(7, bins, bins))
            g = g / np.r_[[radius[key]] * 3, [1.0] * 3]
            if key in last and g @ last[key] < 0:
                step[key] /= 2
            size = np.linalg.norm(g)
            if step[key] < least_step or size < 1e-8:
                open_.discard(key)
                continue
            last[key] = g
            transforms[key] = transforms[key].moved(step[key] * g / size / np.r_[[radius[key]] * 3, [1.0] * 3])
    return transforms


def resampled(fixed: DataFrame, moving: DataFrame, keys: list[str], transforms: dict[tuple, Rigid], side: int = 128) -> DataFrame:
    """(keys, z, height, width, pixels): the moving volumes at the fixed ones' places, 0 where they have none."""
    bounds = fixed.groupBy(*keys).agg(F.max("z"), F.max("height"), F.max("width")).collect()
    sizes = {tuple(r[: len(keys)]): (r[-3] + 1, r[-2], r[-1]) for r in bounds if tuple(r[: len(keys)]) in transforms}
    paired = _Paired(fixed, moving, keys, sizes, side, 1.0)
    told = fixed.sparkSession.sparkContext.broadcast((transforms, sizes))
    kinds = ", ".join(f"`{k}` {fixed.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                block, corner, box, low = _pair(r)
                points = np.indices(block.shape).reshape(3, -1).T + corner
                value, _, inside = interpolated(box, told.value[0][key].of(points) - low)
                values = np.where(inside, np.clip(np.rint(value), 0, 65535), 0).astype("<u2").reshape(block.shape)
                out += [(*key, int(corner[0] + z), int(corner[1]), int(corner[2]), *plane.shape, plane.tobytes()) for z, plane in enumerate(values)]
            yield pd.DataFrame(out, columns=[*keys, "z", "y0", "x0", "h", "w", "part"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        _, height, width = told.value[1][tuple(first[k] for k in keys)]
        a = np.zeros((height, width), "<u2")
        for r in frame.itertuples(index=False):
            a[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.part, "<u2").reshape(r.h, r.w)
        return pd.DataFrame([{**{k: first[k] for k in keys}, "z": first["z"], "height": height, "width": width, "pixels": a.tobytes()}])

    pieces = paired.under(transforms).mapInPandas(run, f"{kinds}, z int, y0 int, x0 int, h int, w int, part binary")
    return pieces.groupBy(*keys, "z").applyInPandas(joined, f"{kinds}, z int, height int, width int, pixels binary")
