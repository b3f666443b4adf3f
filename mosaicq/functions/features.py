"""Per-row expressions of the spot table: every function maps columns to a column, nothing runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ratio(x: Column, total: Column) -> Column:
    """IEEE division (0/0 is NaN, x/0 infinite), whatever the session's ANSI mode; nulls propagate."""
    by_zero = F.when(x == 0, F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(x.isNull() | total.isNull(), None).when(total == 0, by_zero).otherwise(x / total)


def without_crosstalk(b: Column, g: Column, rate: float = 0.25) -> Column:
    """max(b - rate * g, 0); null if either is null."""
    left = b - g * rate
    return F.when(left < 0, 0.0).otherwise(left)


def scaled(channels: dict[str, Column], factors: dict[str, float]) -> dict[str, Column]:
    return {k: c * factors.get(k, 1.0) for k, c in channels.items()}


def clamp_above(x: Column, limit: float) -> Column:
    """x, at most limit; NaN stays NaN although it compares as the greatest."""
    return F.when(~F.isnan(x) & (x > limit), F.lit(limit)).otherwise(x)


def energy_transfer(g_a: Column, ye_a: Column, b_a: Column, by_ye: float = 0.6, by_g: float = 0.1) -> tuple[Column, Column]:
    """Adjusted (g_a, b_a): the second factor uses the first one's result."""
    g = g_a * F.exp(by_ye * ye_a)
    return g, b_a * F.exp(by_g * g)


def log_compressed(g: Column, deep: bool = False) -> Column:
    """log10(1 + g), for deep panels once more and tripled, then log1p."""
    x = F.log10(1 + g)
    if deep:
        x = F.log10(1 + x) * 3
    return F.log1p(x)


def simplex(r: Column, ye: Column, b: Column) -> tuple[Column, Column, Column]:
    total = r + ye + b
    return ratio(r, total), ratio(ye, total), ratio(b, total)


def colour_plane(ye: Column, b: Column, r: Column) -> tuple[Column, Column]:
    """Coordinates of (ye, b, r) in the plane of constant sum."""
    half = math.sqrt(2) / 2
    return (b - ye) * half, r * half - (ye + b) / 2


def colour_xy(r: Column, b: Column, ye: Column) -> tuple[Column, Column]:
    return 2 * r - 1, b - ye


def jittered(x: Column, key: list[str], sigma: float = 0.01, seed: int = 0) -> Column:
    """Exact 0 and 1 are spread by normal noise, drawn from a seeded hash of the row's key: the same however a table is dealt out."""
    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *key), F.lit(1 << 52)) + 1) / float(1 << 52)

    noise = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2)) * sigma
    return F.when(x == 0, noise).when(x == 1, 1 + noise).otherwise(x)


def half_even(x: Column) -> Column:
    """Rounding with ties to even."""
    return F.rint(x)


def packed_key(y: Column, x: Column, width: int = 10_000_000) -> Column:
    return y.cast("long") * width + x.cast("long")


def direction(x: Column, y: Column, slope: float = 0.5) -> Column:
    """Length of (x, y) along the direction of the slope."""
    angle = math.atan(slope)
    return x * math.cos(angle) + y * math.sin(angle)


def mixed_rgb(ye: Column, b: Column, r: Column, g: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of four channels, divided by the largest, within 0 and 1."""
    raw = (ye + r, 0.9 * ye + 0.2 * g, b)
    top = F.greatest(*raw)
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(top == 0, 0.0).otherwise(x / top))) for x in raw)


def reordered(label: Column, order: list[int]) -> Column:
    """The label at the place that a fixed permutation gives it (labels from 1); unknown labels are null."""
    return F.try_element_at(F.array(*[F.lit(k) for k in order]), label.cast("int"))


def downsampled(x: Column, factor: int) -> Column:
    return F.floor(x / factor)


def scaled_depth(z: Column, anisotropy: float = 3.36) -> Column:
    return z * anisotropy


def mapped(key: Column, table: dict, default=None) -> Column:
    """A small dictionary with a default for missing keys."""
    got = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return got if default is None else F.coalesce(got, F.lit(default))


def char_count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def hamming(x: Column, y: Column) -> Column:
    """Differing places of the shorter length."""
    n = F.least(F.length(x), F.length(y))
    a, b = F.split(F.left(x, n), ""), F.split(F.left(y, n), "")
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.when(p != q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)


def base_call(cy3: Column, cy5: Column, cy3_limit: float = 300, cy5_limit: float = 500) -> Column:
    """Both channels A, cy3 alone T, cy5 alone C, none G."""
    p, q = cy3 >= cy3_limit, cy5 >= cy5_limit
    return F.when(p & q, "A").when(p, "T").when(q, "C").otherwise("G")


def sequence_of(calls: list[Column]) -> Column:
    return F.concat_ws("", *calls)


def overlapped(x: Column, y: Column) -> Column:
    """Two sequences read at once: equal bases stay; no G: A; else C before T."""
    def merge(p: Column, q: Column) -> Column:
        return F.when(p == q, p).when((p != "G") & (q != "G"), "A").when((p == "C") | (q == "C"), "C").when((p == "T") | (q == "T"), "T").otherwise("A")

    return F.array_join(F.zip_with(F.split(x, ""), F.split(y, ""), merge), "")


#: Terms of the power series of erf, below the change, and of the continued fraction of erfc, above it.
_SERIES, _FRACTION, _CHANGE = 40, 50, 2.2


def erfc(x: Column) -> Column:
    """1 - erf(x) with a relative error below 1e-12 up to where it underflows: a power series near 0, a continued fraction beyond."""
    a = F.abs(x)
    series = F.lit(0.0)
    for n in reversed(range(_SERIES)):
        series = series * (-a * a) + 1 / (math.factorial(n) * (2 * n + 1))
    near = 1 - 2 / math.sqrt(math.pi) * a * series
    rest = a
    for n in reversed(range(1, _FRACTION)):
        rest = a + F.lit(n / 2) / rest
    far = F.exp(-a * a) / (math.sqrt(math.pi) * rest)
    upper = F.when(a < _CHANGE, near).otherwise(far)
    return F.when(x >= 0, upper).otherwise(2 - upper)


def erf(x: Column) -> Column:
    return 1 - erfc(x)


def chi2_survival(d2: Column, k: int) -> Column:
    """P(chi-square of k degrees > d2): closed form for even k, with erfc for odd."""
    half = d2 / 2
    if k % 2 == 0:
        total = F.lit(1.0)
        term = F.lit(1.0)
        for i in range(1, k // 2):
            term = term * half / i
            total = total + term
        return F.exp(-half) * total
    total = erfc(F.sqrt(half))
    gamma = math.gamma(1.5)
    for i in range(1, (k + 1) // 2):
        total = total + F.exp(-half) * F.pow(half, i - 0.5) / gamma
        gamma *= i + 0.5
    return total


def cut(x: Column, edges: list[float], labels: list | None = None) -> Column:
    """Label of the half-open bin [a, b) that holds x; null outside."""
    labels = labels if labels is not None else list(range(len(edges) - 1))
    out = F.when(F.lit(False), F.lit(labels[0]))
    for a, b, k in zip(edges, edges[1:], labels):
        out = out.when((x >= a) & (x < b), F.lit(k))
    return out


def graded(x: Column, lower_bounds: dict, default=-2) -> Column:
    """The grade with the highest lower bound that x reaches."""
    out = F
    for grade, low in sorted(lower_bounds.items(), key=lambda kv: -kv[1]):
        out = out.when(x >= low, F.lit(grade))
    return out.otherwise(F.lit(default))


def boxes(rules: list[tuple[str, dict[str, tuple[float, float]]]], default: str = "Other") -> Column:
    """Name of the last rule whose closed ranges all hold."""
    out = F
    for name, box in reversed(rules):
        hit = F.lit(True)
        for col, (lo, hi) in box.items():
            hit = hit & F.col(col).between(lo, hi)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def readout_features(spots: DataFrame, deep: bool = False) -> DataFrame:
    """From raw channels r, ye, g, b to the features of gene calling, as chained projections."""
    out = spots.withColumn("b", without_crosstalk(F.col("b"), F.col("g")))
    out = out.withColumns({f"scaled_{k}": c for k, c in scaled({k: F.col(k) for k in ("r", "ye", "g", "b")}, {"g": 2.5, "b": 0.75}).items()})
    out = out.withColumn("sum", F.col("scaled_r") + F.col("scaled_ye") + F.col("scaled_b"))
    out = out.withColumns({f"{k}_a": ratio(F.col(f"scaled_{k}"), F.col("sum")) for k in ("r", "ye", "g", "b")})
    out = out.withColumn("g_a", clamp_above(F.col("g_a"), 5.0))
    g, b = energy_transfer(F.col("g_a"), F.col("ye_a"), F.col("b_a"))
    out = out.withColumns({"g_a": g, "b_a": b}).withColumn("g_a", log_compressed(F.col("g_a"), deep))
    r, ye, b = simplex(F.col("r_a"), F.col("ye_a"), F.col("b_a"))
    out = out.withColumns({"r_a": r, "ye_a": ye, "b_a": b})
    cd1, cd2 = colour_plane(F.col("ye_a"), F.col("b_a"), F.col("r_a"))
    return out.withColumns({"cd_1": cd1, "cd_2": cd2})


def panel_filter(spots: DataFrame, strict: bool, limit: float = 800, g_ratio: float = 3, g_limit: float = 1000) -> DataFrame:
    """Bright spots; open panels also keep green ones, strict panels drop rows with null or NaN."""
    if not strict:
        return spots.where((F.col("sum") >= limit) | ((F.col("g_a") >= g_ratio) & (F.col("scaled_g") > g_limit)))
    real = [c for c, t in spots.dtypes if t in ("double", "float")]
    bad = F.lit(False)
    for c in real:
        bad = bad | F.isnan(c)
    return spots.where(F.col("sum") >= limit).na.drop().where(~bad)
