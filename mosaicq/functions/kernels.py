"""NumPy kernels on single images; operators.images runs them per tile, stack or label."""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def _windows(a: np.ndarray, size: tuple[int, ...], mode: str = "edge") -> np.ndarray:
    pad = [(s // 2, s - 1 - s // 2) for s in size]
    return sliding_window_view(np.pad(a, pad, mode=mode), size)


def ellipse(size: tuple[int, ...]) -> np.ndarray:
    """Boolean footprint of the ellipse (or ellipsoid) inscribed in the size."""
    grid = np.indices(size).reshape(len(size), -1).T
    centre, half = (np.array(size) - 1) / 2, np.maximum(np.array(size) / 2, 0.5)
    return ((((grid - centre) / half) ** 2).sum(1) <= 1).reshape(size)


def rank_filter(a: np.ndarray, footprint: np.ndarray, largest: bool) -> np.ndarray:
    """Grey dilation (largest) or erosion over a footprint, one shift at a time."""
    pad = [(s // 2, s - 1 - s // 2) for s in footprint.shape]
    wide = np.pad(a, pad, mode="edge")
    out = None
    for at in zip(*np.nonzero(footprint)):
        part = wide[tuple(slice(o, o + n) for o, n in zip(at, a.shape))]
        out = part.copy() if out is None else (np.maximum if largest else np.minimum)(out, part, out=out)
    return out


def top_hat(a: np.ndarray, size: tuple[int, ...] = (7, 7)) -> np.ndarray:
    """Image minus its opening by an ellipse."""
    shape = ellipse(size)
    opened = rank_filter(rank_filter(a, shape, False), shape[tuple(slice(None, None, -1) for _ in size)], True)
    return a - np.minimum(opened, a)


def local_peaks(a: np.ndarray, threshold: float, distance: int = 2) -> np.ndarray:
    """Coordinates of pixels that are the largest within a Chebyshev distance and above the threshold."""
    box = np.ones((2 * distance + 1,) * a.ndim, bool)
    inner = np.zeros(a.shape, bool)
    inner[tuple(slice(distance, n - distance) for n in a.shape)] = True
    return np.argwhere((a == rank_filter(a, box, True)) & (a > threshold) & inner)


def spread_maxima(a: np.ndarray, peaks: np.ndarray, size: int = 5) -> np.ndarray:
    """Peak values spread to the square around them, zero elsewhere."""
    only = np.zeros_like(a)
    only[tuple(peaks.T)] = a[tuple(peaks.T)]
    return rank_filter(only, np.ones((size,) * a.ndim, bool), True)


def signal_to_noise(a: np.ndarray, window: int = 10) -> np.ndarray:
    """Pixel over the least of its window; infinite where that is zero."""
    low = rank_filter(a.astype(float), np.ones((window,) * a.ndim, bool), False)
    return np.divide(a, low, out=np.full(a.shape, np.inf), where=low > 0)


def gaussian(a: np.ndarray, sigma: float | tuple[float, ...]) -> np.ndarray:
    """Separable Gaussian smoothing, edges repeated."""
    sigmas = (sigma,) * a.ndim if np.isscalar(sigma) else sigma
    out = a.astype(float)
    for axis, s in enumerate(sigmas):
        if s <= 0:
            continue
        r = max(1, int(4 * s + 0.5))
        kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        kernel /= kernel.sum()
        wide = np.pad(out, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
        out = sliding_window_view(wide, 2 * r + 1, axis=axis) @ kernel
    return out


def band_pass(a: np.ndarray, narrow: float | tuple[float, ...], wide: float | tuple[float, ...]) -> np.ndarray:
    """Difference of two Gaussians."""
    return gaussian(a, narrow) - gaussian(a, wide)


def laplacian_of_gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Negative Laplacian of the smoothed image: bright blobs are positive."""
    g = np.pad(gaussian(a, sigma), 1, mode="edge")
    core = tuple(slice(1, -1) for _ in range(a.ndim))
    out = 2 * a.ndim * g[core]
    for axis in range(a.ndim):
        for shift in (slice(0, -2), slice(2, None)):
            out = out - g[tuple(shift if k == axis else slice(1, -1) for k in range(a.ndim))]
    return out


def stretched(a: np.ndarray, low: float = 1, high: float = 99.8) -> np.ndarray:
    """Percentiles to 0 and 1."""
    lo, hi = np.percentile(a, (low, high))
    return (a - lo) / max(hi - lo, 1e-12)


def isolated_maxima(smooth: np.ndarray, threshold: float, most: int | None = None) -> np.ndarray:
    """Strictly ordered maxima of the 3-cube neighbourhood above the threshold, brightest first."""
    ring = np.ones((3,) * smooth.ndim, bool)
    ring[(1,) * smooth.ndim] = False
    found = np.argwhere((smooth >= rank_filter(smooth, ring, True)) & (smooth > threshold))
    order = np.lexsort((*found.T[::-1], -smooth[tuple(found.T)]))
    return found[order][:most]


def detection_threshold(raw: np.ndarray, smooth: np.ndarray, level: float, units: str) -> float:
    """absolute; SD: mean + level * SD of positive raw pixels; legacySD: of positive smoothed ones."""
    if units == "absolute":
        return level
    base = raw[raw > 0] if units == "SD" else smooth[smooth > 0]
    return float(base.mean() + level * base.std()) if base.size else np.inf


# ---------------------------------------------------------------- fitting


def plane_background(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The image minus the least-squares plane through the pixels outside the spot."""
    at = np.argwhere(~inside)
    design = np.column_stack([np.ones(len(at)), at])
    coef, *_ = np.linalg.lstsq(design, a[~inside].astype(float), rcond=None)
    grid = np.indices(a.shape).reshape(a.ndim, -1).T
    return a - (np.column_stack([np.ones(len(grid)), grid]) @ coef).reshape(a.shape)


def median_background(a: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    return a - np.median(a if inside is None else a[~inside])


#: How light spreads from a point: by its density at a pixel's centre, by its integral over the pixel, or so in the plane and by density in depth.
SPREADS = ("gaussian", "integratedGaussian", "integratedGaussianStdZ")


def _profile(n: int, centre: float, sigma: float, integrated: bool) -> np.ndarray:
    """Light of a point on the pixels of an axis, 1 for a pixel whose middle is the point."""
    x = np.arange(n) - centre
    if not integrated:
        return np.exp(-0.5 * (x / sigma) ** 2)
    edges = np.array([math.erf(v) for v in np.append(x - 0.5, x[-1] + 0.5) / (math.sqrt(2) * sigma)])
    return np.diff(edges) / (2 * math.erf(0.5 / (math.sqrt(2) * sigma)))


def _integrated_axes(dims: int, spread: str) -> list[bool]:
    """Which axes (depth first, if there are three) integrate."""
    return [spread != "gaussian" and not (spread == "integratedGaussianStdZ" and dims == 3 and axis == 0) for axis in range(dims)]


def point_spread(shape: tuple[int, ...], centre: np.ndarray, sigma: np.ndarray, spread: str = "gaussian") -> np.ndarray:
    """The image of a point of height 1."""
    out = np.ones(())
    for n, c, s, integrated in zip(shape, centre, sigma, _integrated_axes(len(shape), spread)):
        out = out[..., None] * _profile(n, c, s, integrated)
    return out


def spread_total(sigma: np.ndarray, spread: str = "gaussian") -> float:
    """All light of a point of height 1."""
    return float(np.prod([1 / math.erf(0.5 / (math.sqrt(2) * s)) if integrated else s * math.sqrt(2 * math.pi) for s, integrated in zip(sigma, _integrated_axes(len(sigma), spread))]))


def gaussian_mask(a: np.ndarray, start: np.ndarray, sigma: np.ndarray, cut: int = 3, tolerance: float = 0.01, rounds: int = 20, spread: str = "gaussian") -> tuple[np.ndarray, float, bool]:
    """(centre, integrated intensity, converged): the centroid under the mask of a point, to a fixed point."""
    grid = np.indices(a.shape).reshape(a.ndim, -1).T.astype(float)
    values = a.ravel().astype(float)
    centre = np.array(start, float)
    ok = False
    for _ in range(rounds):
        near = (np.abs(grid - centre) <= cut * sigma).all(1)
        mask = point_spread(a.shape, centre, sigma, spread).ravel()[near]
        total = (mask * values[near]).sum()
        if total <= 0:
            return centre, 0.0, False
        moved = (grid[near] * (mask * values[near])[:, None]).sum(0) / total
        # A mask centred off the spot halves the step: the fixed point is twice as far.
        step = 2 * (moved - centre)
        centre = centre + step
        if not ((centre >= -0.5) & (centre <= np.array(a.shape) - 0.5)).all():
            return centre, 0.0, False
        if np.abs(step).max() < tolerance:
            ok = True
            break
    near = (np.abs(grid - centre) <= cut * sigma).all(1)
    mask = point_spread(a.shape, centre, sigma, spread).ravel()[near]
    amplitude = (mask * values[near]).sum() / (mask * mask).sum()
    return centre, float(amplitude * spread_total(sigma, spread)), ok


def least_squares(residual, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with a numerical Jacobian inside bounds: (parameters, sum of squares)."""
    p = np.clip(np.asarray(start, float), lower, upper)
    r = residual(p)
    cost, damping = float(r @ r), 1e-3
    for _ in range(rounds):
        h = 1e-6 * np.maximum(1, np.abs(p))
        jac = np.column_stack([(residual(p + np.eye(len(p))[k] * h[k]) - r) / h[k] for k in range(len(p))])
        normal, slope = jac.T @ jac, jac.T @ r
        for _ in range(12):
            step = np.linalg.lstsq(normal + damping * np.diag(np.diag(normal) + 1e-12), -slope, rcond=None)[0]
            q = np.clip(p + step, lower, upper)
            s = residual(q)
            if s @ s < cost:
                break
            damping *= 4
        else:
            return p, cost
        small = cost - float(s @ s) < 1e-10 * max(cost, 1e-30)
        p, r, cost, damping = q, s, float(s @ s), max(damping / 4, 1e-12)
        if small:
            break
    return p, cost


def gaussian_fit(a: np.ndarray, start: np.ndarray, sigma: np.ndarray, spread: str = "gaussian") -> dict:
    """Axis-aligned point with background, of any dimension, by bounded least squares."""
    d, values = a.ndim, a.ravel().astype(float)
    lo, hi = values.min(), values.max()

    def residual(p: np.ndarray) -> np.ndarray:
        return p[0] * point_spread(a.shape, p[1 : 1 + d], p[1 + d : 1 + 2 * d], spread).ravel() + p[-1] - values

    first = np.concatenate([[hi - lo], start, sigma, [lo]])
    lower = np.concatenate([[0], -np.ones(d), 0.3 * np.ones(d), [lo - (hi - lo) - 1]])
    upper = np.concatenate([[3 * (hi - lo) + 1], np.array(a.shape), np.array(a.shape), [hi + 1]])
    p, cost = least_squares(residual, first, lower, upper)
    return {"centre": p[1 : 1 + d], "sigma": p[1 + d : 1 + 2 * d], "background": p[-1], "integrated": float(p[0] * spread_total(p[1 + d : 1 + 2 * d], spread)), "residual": cost}


def rotated_gaussian_volume(a: np.ndarray) -> tuple[float, float]:
    """(volume 2 pi A sx sy, background) of a rotated 2-D Gaussian; (0, 0) if the fit fails."""
    if a.size < 7 or a.max() == a.min():
        return 0.0, 0.0
    yy, xx = np.indices(a.shape).reshape(2, -1).astype(float)
    values = a.ravel().astype(float)
    top = np.unravel_index(a.argmax(), a.shape)
    lo, span = values.min(), np.ptp(values)

    def residual(p: np.ndarray) -> np.ndarray:
        c, s = np.cos(p[5]), np.sin(p[5])
        u, v = c * (xx - p[2]) + s * (yy - p[1]), -s * (xx - p[2]) + c * (yy - p[1])
        return p[0] * np.exp(-0.5 * ((u / p[3]) ** 2 + (v / p[4]) ** 2)) + p[6] - values

    side = max(a.shape)
    p, cost = least_squares(residual, np.array([span, *top, side / 4, side / 4, 0.0, lo]), np.array([0, -1, -1, 0.3, 0.3, -np.pi, lo - span]), np.array([3 * span, *a.shape, side, side, np.pi, values.max()]))
    if not np.isfinite(cost) or cost > (span**2) * values.size:
        return 0.0, 0.0
    return float(2 * np.pi * p[0] * p[3] * p[4]), float(p[6])


# ---------------------------------------------------------------- stacks and registration


#: Fixed values of the selective fusion: side of the windows, steepness, ratio of signal to noise in decibels at which a
#: place is trusted, planes between the three points of the fit; of the pairwise fusion: steepness, weights of the edges.
FOCUS_WINDOW, FOCUS_STEEPNESS, FOCUS_TRUST, FOCUS_STEP = 9, 0.2, 13.0, 2
PAIR_STEEPNESS, EDGE_SLOPE, EDGE_SMOOTH = 0.1, (-1, -2, 0, 2, 1), (1, 4, 6, 4, 1)


def _averaged(a: np.ndarray, window: int) -> np.ndarray:
    """Mean of the window around each pixel, edges repeated."""
    for axis in (0, 1):
        wide = np.pad(a, [(window // 2, window - 1 - window // 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = sliding_window_view(wide, window, axis=axis).mean(-1)
    return a


def fused_focus(stack: np.ndarray, window: int = FOCUS_WINDOW, alpha: float = FOCUS_STEEPNESS, trust: float = FOCUS_TRUST) -> np.ndarray:
    """All-in-focus image of a z stack.

    Sharpness is the variance in a window. Over depth it should be a Gaussian around the sharpest plane: three
    points give its width, and what the planes leave of it is noise. Where the ratio of signal to averaged
    noise is above the trusted one, planes away from full sharpness weigh little; elsewhere all weigh alike.
    """
    stack = stack.astype(float)
    n = len(stack)
    step = min(FOCUS_STEP, (n - 1) // 2)
    if step < 1:
        return stack.mean(0)
    sharp = np.array([_averaged((p - _averaged(p, window)) ** 2, window) for p in stack]) + 1e-12
    top, best = sharp.max(0), sharp.argmax(0)
    middle = np.clip(best, step, n - 1 - step)

    def at(plane: np.ndarray) -> np.ndarray:
        return np.log(np.take_along_axis(sharp, plane[None], 0)[0])

    # A peak near the first plane is fitted from the planes after it, any other from those before it.
    side = at(np.where(best < step, middle + step, middle - step))
    bend = (side - at(middle)) / step**2
    z = np.arange(n)[:, None, None]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        rest = np.abs(sharp - np.exp(np.minimum(at(middle) + bend * (z - middle) ** 2, 700))).sum(0)
        ratio = -20 * np.log10(_averaged(rest / (n * top), window))
    ratio = np.where(np.isnan(ratio), np.nanmin(ratio) if np.isfinite(ratio).any() else 0.0, ratio)
    phi = 0.5 * (1 + np.tanh(alpha * (ratio - trust))) / alpha
    phi = np.median(sliding_window_view(np.pad(phi, 1), (3, 3)).reshape(*phi.shape, 9), axis=-1)
    weight = 0.5 + 0.5 * np.tanh(phi * (sharp / top - 1))
    return (weight * stack).sum(0) / weight.sum(0)


def _edges(a: np.ndarray) -> np.ndarray:
    """Strength of the edges along both axes, borders mirrored without repeating them."""
    out = 0.0
    for kernels_ in ((EDGE_SLOPE, EDGE_SMOOTH), (EDGE_SMOOTH, EDGE_SLOPE)):
        wide = np.pad(a, 2, mode="reflect")
        for axis, k in enumerate(kernels_):
            wide = sliding_window_view(wide, 5, axis=axis) @ np.array(k, float)
        out = out + np.abs(wide)
    return out


def pairwise_focus(stack: np.ndarray, full: float = 65535.0) -> np.ndarray:
    """Planes fused one after the other: each pixel leans to the image whose edges around it are stronger."""
    image = stack[0] / full
    for plane in stack[1:]:
        plane = plane / full
        ahead = sliding_window_view(np.pad(_edges(image) - _edges(plane), 1), (3, 3)).sum((-2, -1))
        weight = 1 / (1 + np.exp(-PAIR_STEEPNESS * ahead))
        image = weight * image + (1 - weight) * plane
    return image * full


def sharpest(stack: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Each pixel from the plane that bends most there."""
    bend = np.array([np.abs(laplacian_of_gaussian(p.astype(float), sigma)) for p in stack])
    return np.take_along_axis(stack, bend.argmax(0)[None], 0)[0].astype(float)


#: Fixed values of the illumination fit: quantiles an energy is scaled to, exponents of the weight of smoothness for
#: few and for MANY_TILES tiles, exponent of the zero-light weight, weight of the bounds, share of the places that are typical.
STANDARD_QUANTILES, SMOOTH_FEW, SMOOTH_MANY, MANY_TILES, ZERO_LIGHT, BOUNDS, TYPICAL = 200, 9.5, 6.0, 200, 0.5, 1e6, 0.25
#: Grey levels of spread for which the weight of smoothness stands; intensities are scaled to it, so exposure doesn't matter.
GREY_SPREAD = 40.0


def order_statistics(stack: np.ndarray, most: int = STANDARD_QUANTILES) -> np.ndarray:
    """Sorted values of each place over the first axis, as at most so many quantiles."""
    order = np.sort(stack.astype(float), axis=0)
    if len(order) <= most:
        return order
    at = np.linspace(0, len(order) - 1, most)
    low = np.minimum(at.astype(int), len(order) - 2)
    rest = (at - low).reshape(-1, *(1,) * (order.ndim - 1))
    return order[low] * (1 - rest) + order[low + 1] * rest


def _smoothing(n: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of Gaussian smoothing and of sigma^2 times its second derivative on n places, edges mirrored."""
    r = 3 * math.ceil(sigma)
    t = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    d = g * (t**2 / sigma**2 - 1)
    d -= d.mean()
    at = np.arange(n)[:, None] + t
    at = np.where(at % (2 * n) < n, at % (2 * n), 2 * n - 1 - at % (2 * n))
    out = np.zeros((2, n, n))
    for k, w in enumerate((g, d)):
        np.add.at(out[k], (np.arange(n)[:, None], at), np.broadcast_to(w, at.shape))
    return out[0], out[1]


def quasi_newton(f, x: np.ndarray, rounds: int = 500, memory: int = 20, tolerance: float = 1e-9) -> np.ndarray:
    """Minimum of f, which gives a value and a gradient, by limited-memory quasi-Newton steps with halved step lengths."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        step, weights = -g, []
        for s, y, rho in reversed(past):
            weights.append(rho * (s @ step))
            step = step - weights[-1] * y
        if past:
            s, y, _ = past[-1]
            step *= (s @ y) / (y @ y)
        else:
            step /= max(1.0, np.abs(g).sum())
        for (s, y, rho), w in zip(past, reversed(weights)):
            step = step + s * (w - rho * (y @ step))
        slope = g @ step
        if slope >= 0:
            past, step, slope = [], -g / max(1.0, np.abs(g).sum()), -(g @ g) / max(1.0, np.abs(g).sum())
        length = 1.0
        while True:
            new = x + length * step
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-12:
                return x
        s, y = new - x, new_g - g
        if s @ y > 1e-12 * (y @ y) ** 0.5 * (s @ s) ** 0.5:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))] if len(past) >= memory else [*past, (s, y, 1 / (s @ y))]
        done = value - new_value <= tolerance * max(abs(value), 1e-12)
        x, value, g = new, new_value, new_g
        if done:
            break
    return x


def fitted_illumination(order: np.ndarray, n_tiles: int, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(gain v, zero-light surface z) from each place's sorted values (quantiles, height, width).

    A place's quantiles are a line over those of the typical place. The lines are fitted together: a Cauchy loss
    of the residuals as wide as those of reweighted lines of their own, Laplacians of v at several scales for smoothness, and one
    point near which all lines pass, the value without light, within 0 and the least value seen.
    """
    n, h, w = order.shape
    means = order.mean(0).ravel()
    middle = np.argsort(means, kind="stable")
    half = max(1, round(TYPICAL * h * w) // 2)
    middle = middle[max(0, h * w // 2 - half) : h * w // 2 + half + 1]
    flat = order.reshape(n, -1)
    typical = flat[:, middle].mean(1)
    unit = max(1.4826 * float(np.median(np.abs(typical - np.median(typical)))), 1e-9)  # intensities are counted in it
    pivot_q, pivot = typical[n // 2], flat[n // 2]
    q, at = (flat - pivot) / unit, ((typical - pivot_q) / unit)[:, None]
    # Lines start from the middle half of the quantiles, where bright or dark tiles don't pull.
    weight, wide = np.zeros_like(q), np.inf
    weight[n // 4 : n - n // 4] = 1
    for _ in range(20):  # lines of their own first, reweighted by a width that outliers don't stretch
        total = weight.sum(0)
        mid_x, mid_y = (weight * at).sum(0) / total, (weight * q).sum(0) / total
        v = (weight * (at - mid_x) * (q - mid_y)).sum(0) / np.maximum((weight * (at - mid_x) ** 2).sum(0), 1e-12)
        b = mid_y - v * mid_x
        rest = at * v + b - q
        wide = max(1.4826 * float(np.median(np.abs(rest))), 1e-6)
        weight = 1 / (1 + (rest / wide) ** 2)
    smooth = 10 ** (SMOOTH_FEW + (SMOOTH_MANY - SMOOTH_FEW) * min(n_tiles, MANY_TILES) / MANY_TILES) / GREY_SPREAD**2
    scales = 2.0 ** np.arange(-1, int(max(1, math.log2(max(1, max(h, w) // 50)))) + 1)
    operators = [(_smoothing(h, s), _smoothing(w, s)) for s in scales]
    top = flat.min() / unit
    factor, zero = STANDARD_QUANTILES / n, 10**ZERO_LIGHT
    m = h * w

    def energy(x: np.ndarray) -> tuple[float, np.ndarray]:
        v, b, zx, zy = x[:m], x[m : 2 * m], x[2 * m], x[2 * m + 1]
        r = at * v + b - q
        ratio = r / wide
        total = factor * wide**2 / 2 * np.log1p(ratio * ratio).sum()
        pull = factor * r / (1 + ratio * ratio)
        gv, gb = (at * pull).sum(0), pull.sum(0)
        image = v.reshape(h, w)
        for (gh, dh), (gw, dw) in operators:
            bend = (dh @ image @ gw.T + gh @ image @ dw.T) / len(operators)
            total += smooth * (bend**2).sum()
            gv += smooth * 2 * ((dh.T @ bend @ gw + gh.T @ bend @ dw) / len(operators)).ravel()
        px, py = zx - pivot_q / unit, zy - pivot / unit
        miss = v * px + b - py
        total += zero * (miss**2).sum()
        gv += zero * 2 * px * miss
        gb += zero * 2 * miss
        gx, gy = zero * 2 * (v * miss).sum(), -zero * 2 * miss.sum()
        for z, add in ((zx, 0), (zy, 1)):
            beyond = min(z, 0.0) + max(z - top, 0.0)
            total += BOUNDS * beyond**2
            if add:
                gy += 2 * BOUNDS * beyond
            else:
                gx += 2 * BOUNDS * beyond
        return total, np.concatenate([gv, gb, [gx, gy]])

    x = quasi_newton(energy, np.concatenate([v, b, [0.85 * top, 0.85 * top]]), rounds)
    v, b, zx = x[:m], x[m : 2 * m], x[2 * m]
    z = pivot + b * unit - pivot_q * v + zx * unit * v
    return np.maximum(v, 1e-3).reshape(h, w), np.maximum(z, 0).reshape(h, w)


def illumination_model(stack: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(gain v, zero-light surface z) of each pixel over many images."""
    return fitted_illumination(order_statistics(stack), len(stack), rounds)


def illumination_corrected(image: np.ndarray, gain: np.ndarray, offset: np.ndarray, mode: str = "zero") -> np.ndarray:
    """zero: offset removed; range: mean gain kept; direct: mean gain and offset kept."""
    plain = (image - offset) / gain
    if mode == "zero":
        return plain
    return plain * gain.mean() + (offset.mean() if mode == "direct" else 0)


def resized(a: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bilinear resize, pixel centres aligned."""
    out = a.astype(float)
    for axis, n in enumerate(size):
        at = np.clip((np.arange(n) + 0.5) * a.shape[axis] / n - 0.5, 0, a.shape[axis] - 1)
        lo = np.minimum(at.astype(int), a.shape[axis] - 1)
        hi = np.minimum(lo + 1, a.shape[axis] - 1)
        w = (at - lo).reshape([-1 if k == axis else 1 for k in range(2)])
        out = np.take(out, lo, axis) * (1 - w) + np.take(out, hi, axis) * w
    return out


def centred_on(a: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Centre pad with zeros, or crop, to the size."""
    out = np.zeros(size, a.dtype)
    src = [max(0, (n - m) // 2) for n, m in zip(a.shape, size)]
    dst = [max(0, (m - n) // 2) for n, m in zip(a.shape, size)]
    n = [min(x, y) for x, y in zip(a.shape, size)]
    out[dst[0] : dst[0] + n[0], dst[1] : dst[1] + n[1]] = a[src[0] : src[0] + n[0], src[1] : src[1] + n[1]]
    return out


def phase_shift(reference: np.ndarray, moving: np.ndarray, upsample: int = 100) -> np.ndarray:
    """Shift that moves moving onto reference: peak of the cross correlation, refined by a local DFT."""
    f = np.fft.fftn(reference) * np.conj(np.fft.fftn(moving))
    f /= np.maximum(np.abs(f), 1e-12)
    peak = np.array(np.unravel_index(np.abs(np.fft.ifftn(f)).argmax(), f.shape), float)
    size = np.array(f.shape)
    peak[peak > size // 2] -= size[peak > size // 2]
    if upsample <= 1:
        return peak
    half = int(np.ceil(0.75 * upsample))
    fine = f
    for axis in range(f.ndim):
        freq = np.fft.fftfreq(f.shape[axis])
        at = peak[axis] + np.arange(-half, half + 1) / upsample
        fine = np.moveaxis(np.tensordot(np.exp(2j * np.pi * np.outer(at, freq)), fine, (1, axis)), 0, axis)
    best = np.unravel_index(np.abs(fine).argmax(), fine.shape)
    return peak + (np.array(best) - half) / upsample


def fourier_shifted(a: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Sub-pixel circular shift, clipped to the 16-bit range."""
    phase = np.zeros(a.shape)
    for axis, s in enumerate(shift):
        phase = phase + (np.fft.fftfreq(a.shape[axis]) * s).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
    out = np.fft.ifftn(np.fft.fftn(a) * np.exp(-2j * np.pi * phase)).real
    return np.clip(np.rint(out), 0, 65535).astype(np.uint16)


def split_shift(shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole part for the offsets table, fractional part for the pixels."""
    whole = np.rint(shift)
    return whole.astype(int), shift - whole


def overlap_correlation(a: np.ndarray, b: np.ndarray, dy: int, dx: int) -> float:
    """Normalised correlation of two tiles where b lies (dy, dx) from a; -1 without overlap."""
    h, w = a.shape
    ya, xa = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    yb, xb = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    p, q = a[ya, xa].astype(float).ravel(), b[yb, xb].astype(float).ravel()
    if p.size < 4:
        return -1.0
    p, q = p - p.mean(), q - q.mean()
    norm = np.sqrt((p @ p) * (q @ q))
    return float(p @ q / norm) if norm > 0 else -1.0


def stitch_translation(a: np.ndarray, b: np.ndarray, peaks: int = 2) -> tuple[int, int, float]:
    """(dy, dx, correlation): the best of the peaks of the phase correlation and their wrapped readings."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    surface = np.abs(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
    best = (0, 0, -1.0)
    for flat in np.argsort(surface, axis=None)[::-1][:peaks]:
        y, x = np.unravel_index(flat, surface.shape)
        for dy in (y, y - a.shape[0]):
            for dx in (x, x - a.shape[1]):
                c = overlap_correlation(a, b, int(dy), int(dx))
                best = max(best, (int(dy), int(dx), c), key=lambda t: t[2])
    return best


def climbed_translation(a: np.ndarray, b: np.ndarray, dy: int, dx: int, steps: int = 64) -> tuple[int, int, float]:
    """(dy, dx, correlation): from a start, always to the best of the eight places around, while one is better."""
    here = overlap_correlation(a, b, dy, dx)
    for _ in range(steps):
        near = [(overlap_correlation(a, b, dy + p, dx + q), dy + p, dx + q) for p in (-1, 0, 1) for q in (-1, 0, 1) if p or q]
        best = max(near)
        if best[0] <= here:
            break
        here, dy, dx = best
    return dy, dx, here


def spanning_positions(n: int, edges: list[tuple[int, int, int, int, float]]) -> dict[int, tuple[int, int]]:
    """Tile positions along the maximum spanning tree of (i, j, dy, dx, correlation), least position (0, 0)."""
    parent = list(range(n))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    near: dict[int, list[tuple[int, int, int]]] = {k: [] for k in range(n)}
    for i, j, dy, dx, _ in sorted(edges, key=lambda e: -e[4]):
        if top(i) != top(j):
            parent[top(j)] = top(i)
            near[i].append((j, dy, dx))
            near[j].append((i, -dy, -dx))
    at: dict[int, tuple[int, int]] = {}
    for first in range(n):
        if first in at:
            continue
        at[first] = (0, 0)
        todo = [first]
        while todo:
            k = todo.pop()
            for j, dy, dx in near[k]:
                if j not in at:
                    at[j] = (at[k][0] + dy, at[k][1] + dx)
                    todo.append(j)
    y0, x0 = min(y for y, _ in at.values()), min(x for _, x in at.values())
    return {k: (y - y0, x - x0) for k, (y, x) in at.items()}


# ---------------------------------------------------------------- segmentation


def labelled(mask: np.ndarray) -> np.ndarray:
    """Connected components of a mask (faces touching), numbered from 1 in raster order."""
    parent = np.arange(mask.size).reshape(mask.shape)
    parent = np.where(mask, parent, -1)
    while True:
        last = parent.copy()
        for axis in range(mask.ndim):
            a = tuple(slice(None, -1) if k == axis else slice(None) for k in range(mask.ndim))
            b = tuple(slice(1, None) if k == axis else slice(None) for k in range(mask.ndim))
            both = mask[a] & mask[b]
            low = np.minimum(parent[a], parent[b])
            parent[a] = np.where(both, low, parent[a])
            parent[b] = np.where(both, np.minimum(parent[b], low), parent[b])
        flat = parent.ravel()
        flat[mask.ravel()] = flat[flat[mask.ravel()]]
        if np.array_equal(parent, last):
            break
    out = np.zeros(mask.shape, np.int32)
    out[mask] = np.unique(parent[mask], return_inverse=True)[1] + 1
    return out


def gaussian_kernel(sigma: float) -> np.ndarray:
    """Weights of a Gaussian, four widths to either side."""
    r = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return kernel / kernel.sum()


def convolved(a: np.ndarray, kernel: np.ndarray, above: int, below: int) -> np.ndarray:
    """a with a symmetric kernel along both axes, tap by tap, so that a pixel's value doesn't depend on what else is computed.

    Along rows the edges are mirrored; above and below so many mirrored rows are added where the image ends,
    and the rows that lack neighbours are left out.
    """
    r = len(kernel) // 2
    tall = np.pad(a, ((max(0, above), max(0, below)), (0, 0)), mode="symmetric")
    n = len(tall) - 2 * r
    out = sum(w * tall[k : k + n] for k, w in enumerate(kernel))
    wide = np.pad(out, ((0, 0), (r, r)), mode="symmetric")
    return sum(w * wide[:, k : k + a.shape[1]] for k, w in enumerate(kernel))


def disc_filter(a: np.ndarray, radius: int, largest: bool) -> np.ndarray:
    """Largest or smallest value within a disc; what lies beyond the image doesn't count."""
    out = a.copy()
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius and abs(dy) < a.shape[0] and abs(dx) < a.shape[1]:
                here = tuple(slice(max(0, -d), min(n, n - d)) for d, n in zip((dy, dx), a.shape))
                there = tuple(slice(max(0, d), min(n, n + d)) for d, n in zip((dy, dx), a.shape))
                out[here] = (np.maximum if largest else np.minimum)(out[here], a[there])
    return out


def squared_depth(mask: np.ndarray, above: np.ndarray, below: np.ndarray, far: int) -> np.ndarray:
    """Exact squared distance of masked pixels to the background.

    above and below: how far from the first and from the last row the nearest background beyond them lies, column
    by column; far stands for none. Along rows a parabola stands on every squared column distance, and the
    lowest counts: parabolas from further and further away are laid on until they start above all that is left.
    """
    down, up = np.empty(mask.shape, np.int64), np.empty(mask.shape, np.int64)
    near = np.asarray(above, np.int64)
    for y in range(len(mask)):
        near = np.where(mask[y], near if y == 0 else near + 1, 0)
        down[y] = near
    near = np.asarray(below, np.int64)
    for y in range(len(mask) - 1, -1, -1):
        near = np.where(mask[y], near if y == len(mask) - 1 else near + 1, 0)
        up[y] = near
    column = np.minimum(np.minimum(down, up), far) ** 2
    out = column.copy()
    k = 1
    while k < mask.shape[1] and k * k < out.max():
        out[:, k:] = np.minimum(out[:, k:], column[:, :-k] + k * k)
        out[:, :-k] = np.minimum(out[:, :-k], column[:, k:] + k * k)
        k += 1
    return out


def peaks_within(depth: np.ndarray, distance: int) -> np.ndarray:
    """Positive pixels that nothing within the distance in either direction exceeds, so far from the left and right edge."""
    top = depth.copy()
    for axis in (0, 1):
        one = top
        top = one.copy()
        for k in range(1, min(distance, depth.shape[axis] - 1) + 1):
            low, high = (tuple(s if a == axis else slice(None) for a in (0, 1)) for s in (slice(None, -k), slice(k, None)))
            top[low] = np.maximum(top[low], one[high])
            top[high] = np.maximum(top[high], one[low])
    out = (depth > 0) & (depth == top)
    x = np.arange(depth.shape[1])
    out[:, (x < distance) | (x >= depth.shape[1] - distance)] = False
    return out


def climbs(depth: np.ndarray, peak: np.ndarray, core: slice) -> np.ndarray:
    """Index of the pixel where the climb of each pixel of the core rows ends: at peaks, summits, and before a row outside the core."""
    h, w = depth.shape
    index = np.arange(h * w).reshape(h, w)
    best, to = depth.copy(), index.copy()
    # Neighbours in the order of their places, so that of equals the earlier one stays; a pixel itself comes between.
    for dy, dx in ((1, 0), (0, 1), (0, -1), (-1, 0)):
        here = tuple(slice(max(0, -d), min(n, n - d)) for d, n in zip((dy, dx), (h, w)))
        there = tuple(slice(max(0, d), min(n, n + d)) for d, n in zip((dy, dx), (h, w)))
        higher = (depth[there] > best[here]) | ((depth[there] == best[here]) & (index[there] < to[here]))
        best[here] = np.where(higher, depth[there], best[here])
        to[here] = np.where(higher, index[there], to[here])
    outside = (to // w < core.start) | (to // w >= core.stop)
    to = np.where(outside | peak, index, to).ravel()
    while True:
        on = to[to]
        if (on == to).all():
            return to.reshape(h, w)
        to = on


def inside_hull(points: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Which grid points the convex hull of the points contains.

    In the plane by the exact edges, in space by the exact facets of an incremental hull.
    """
    points, grid = points.astype(float), grid.astype(float)
    d = points.shape[1]
    if d == 2:
        pts = np.unique(points, axis=0)
        if len(pts) < 3:
            return np.array([(pts == g).all(1).any() for g in grid])
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        chain = []
        for half in (pts, pts[::-1]):
            part: list[np.ndarray] = []
            for p in half:
                while len(part) > 1 and cross(part[-2], part[-1], p) <= 0:
                    part.pop()
                part.append(p)
            chain += part[:-1]
        hull = np.array(chain)
        ok = np.ones(len(grid), bool)
        for a, b in zip(hull, np.roll(hull, -1, axis=0)):
            ok &= (b[0] - a[0]) * (grid[:, 1] - a[1]) - (b[1] - a[1]) * (grid[:, 0] - a[0]) >= -1e-9
        return ok
    left = np.arange(len(grid))
    if len(points) == 0:
        return np.zeros(len(grid), bool)
    exact = (points == np.rint(points)).all() and (grid == np.rint(grid)).all()
    if exact:
        points, grid = points.astype(np.int64), grid.astype(np.int64)
    pts = _line_ends(points)
    tol = 0 if exact else 1e-9 * max(1.0, float(np.ptp(pts, axis=0).max()) ** 3)
    first = _tetrahedron(pts, tol)
    if len(first) < 3:  # all on one line
        way, off = pts[first[-1]] - pts[first[0]], grid - pts[first[0]]
        return (np.abs(np.cross(off, way)) <= tol).all(1) & ((grid >= pts.min(0)) & (grid <= pts.max(0))).all(1)
    if len(first) < 4:  # all in one plane: its shadow along the steepest axis
        normal = np.cross(pts[first[1]] - pts[first[0]], pts[first[2]] - pts[first[0]])
        axes = np.delete(np.arange(3), np.abs(normal).argmax())
        return (np.abs((grid - pts[first[0]]) @ normal) <= tol) & inside_hull(pts[:, axes], grid[:, axes])
    for normal, offset in _facets(pts, first, tol):
        left = left[grid[left] @ normal <= offset + tol]
    out = np.zeros(len(grid), bool)
    out[left] = True
    return out


def _line_ends(points: np.ndarray) -> np.ndarray:
    """The points that are first or last on their lines along each axis: the hull's corners among them."""
    pts = np.unique(points, axis=0)
    for axis in range(3):
        a, b = np.delete(np.arange(3), axis)
        pts = pts[np.lexsort((pts[:, axis], pts[:, b], pts[:, a]))]
        new = (pts[1:, [a, b]] != pts[:-1, [a, b]]).any(1)
        pts = pts[np.concatenate([[True], new]) | np.concatenate([new, [True]])]
    return pts


def _tetrahedron(pts: np.ndarray, tol: float) -> list[int]:
    """Indices of up to four points that span as many dimensions as all of them."""
    out = [0]
    for _ in range(3):
        off = pts - pts[0]
        if len(out) == 1:
            size = np.abs(off).sum(1)
        elif len(out) == 2:
            size = np.abs(np.cross(off, off[out[1]])).sum(1)
        else:
            size = np.abs(off @ np.cross(off[out[1]], off[out[2]]))
        if size.max() <= tol:
            break
        out.append(int(size.argmax()))
    return out


def _facets(pts: np.ndarray, first: list[int], tol: float) -> list[tuple[np.ndarray, float]]:
    """(outer normal, offset) of the hull's triangles, point by point; whole numbers stay exact."""
    middle = pts[first].sum(0)  # four times an inner point

    def plane(face: tuple[int, int, int]) -> tuple[tuple[int, int, int], np.ndarray, float]:
        a, b, c = face
        normal = np.cross(pts[b] - pts[a], pts[c] - pts[a])
        if normal @ middle > 4 * (normal @ pts[a]):
            return (a, c, b), -normal, -(normal @ pts[a])
        return face, normal, normal @ pts[a]

    made = [plane(tuple(first[:i] + first[i + 1 :])) for i in range(4)]
    faces, normals, offsets = [f for f, _, _ in made], np.array([n for _, n, _ in made]), np.array([o for _, _, o in made])
    for p in np.random.default_rng(0).permutation(len(pts)):
        seen = normals @ pts[p] > offsets + tol
        if not seen.any():
            continue
        edges = {(f[i], f[(i + 1) % 3]) for k in np.flatnonzero(seen) for f in [faces[k]] for i in range(3)}
        made = [plane((a, b, int(p))) for a, b in edges if (b, a) not in edges]
        faces = [f for f, gone in zip(faces, seen) if not gone] + [f for f, _, _ in made]
        normals = np.concatenate([normals[~seen], [n for _, n, _ in made]])
        offsets = np.concatenate([offsets[~seen], [o for _, _, o in made]])
    return list(zip(normals, offsets))


# ---------------------------------------------------------------- curves and rendering


def max_projection(stack: np.ndarray, z: int, half: int) -> np.ndarray:
    """Largest value of the planes around z."""
    return stack[max(0, z - half) : z + half + 1].max(axis=0)


def rendered(points: np.ndarray, values: np.ndarray, shape: tuple[int, ...], radius: int = 1) -> np.ndarray:
    """Points drawn as balls whose grey is their value over the largest."""
    only = np.zeros(shape)
    at = np.rint(points).astype(int)
    inside = ((at >= 0) & (at < np.array(shape))).all(1)
    top = values.max() if len(values) else 1.0
    np.maximum.at(only, tuple(at[inside].T), values[inside] / (top if top > 0 else 1.0))
    return rank_filter(only, ellipse((2 * radius + 1,) * len(shape)), True)


def peak_intervals(x: np.ndarray, y: np.ndarray, centres: list[float], z: float = 1.28) -> list[tuple[float, float, float]]:
    """(height, low, high) of a sum of Gaussians fitted to a curve: each interval is mean -+ z sigma."""
    k = len(centres)
    span = float(np.ptp(x)) or 1.0

    def residual(p: np.ndarray) -> np.ndarray:
        h, m, s = p[:k, None], p[k : 2 * k, None], p[2 * k :, None]
        return (h * np.exp(-0.5 * ((x - m) / s) ** 2)).sum(0) - y

    first = np.concatenate([np.interp(centres, x, y), centres, np.full(k, span / (4 * k))])
    lower = np.concatenate([np.zeros(k), np.full(k, x.min()), np.full(k, span / 1000)])
    upper = np.concatenate([np.full(k, 3 * max(float(y.max()), 1e-9)), np.full(k, x.max()), np.full(k, span)])
    p, _ = least_squares(residual, first, lower, upper, rounds=200)
    return [(float(p[i]), float(p[k + i] - z * p[2 * k + i]), float(p[k + i] + z * p[2 * k + i])) for i in np.argsort(p[k : 2 * k])]
