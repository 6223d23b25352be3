"""Numerical kernels on arrays: what has no relational form. Plain numpy, no other library."""

from __future__ import annotations

import math

import numpy as np


def fill_gaps(y: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    """Linear interpolation of NaN, constant beyond the ends; all NaN stays."""
    y = np.asarray(y, float)
    ok = np.isfinite(y)
    if ok.all() or not ok.any():
        return y.copy()
    x = np.arange(len(y), dtype=float) if x is None else np.asarray(x, float)
    return np.interp(x, x[ok], y[ok])


def gaussian_smooth(y: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Convolution with a sampled gaussian, mirrored at the ends."""
    if not sigma or len(y) == 0:
        return np.asarray(y, float)
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    padded = np.pad(np.asarray(y, float), r, mode="symmetric")
    return np.convolve(padded, k / k.sum(), mode="valid")


def _spread(d: np.ndarray, robust: bool) -> float:
    if robust:
        return float(np.median(np.abs(d - np.median(d))) / 0.6744897501960817)
    return float(d.std())


def _local_noise(y: np.ndarray, robust: bool) -> float:
    d = np.diff(y, 2)
    if len(d) < 2:
        return 0.0
    ranked, level = d[np.argsort(np.abs(d), kind="stable")], 0.0
    for tenths in range(9, 2, -1):
        kept = ranked[: tenths * len(d) // 10]
        if len(kept) < 3:
            break
        level = _spread(kept, robust)
        if abs(np.median(kept) if robust else kept.mean()) <= level or level == 0:
            break
    return level / 2 if level > 2e-8 else float(d.std())


def noise_level(y: np.ndarray, min_slice: int = 200, slices: int = 5, robust: bool = True) -> np.ndarray:
    """Noise of every point, constant within a slice; a short rest belongs to the last slice.

    Half the spread of the second difference. Its largest values, which come from
    peaks, are left out by tenths, from a tenth to seven, until the rest is centred on 0.
    """
    y = np.asarray(y, float)
    size = max(len(y) // slices, min_slice)
    number = max(0, (len(y) - min_slice) // size) + 1
    edges = [*range(0, number * size, size), len(y)]
    return np.concatenate([np.full(max(0, b - a), _local_noise(y[a:b], robust)) for a, b in zip(edges, edges[1:])]) if len(y) else np.zeros(0)


def local_extrema(y: np.ndarray) -> np.ndarray:
    """Indices of alternating maxima and minima with both ends; nothing for a monotone curve."""
    d = np.sign(np.diff(y))
    if len(d) == 0:
        return np.zeros(0, int)
    # a plateau takes the direction that led to it
    for i in range(1, len(d)):
        if d[i] == 0:
            d[i] = d[i - 1]
    turns = np.flatnonzero(d[1:] * d[:-1] < 0) + 1
    if len(turns) == 0:
        return np.zeros(0, int)
    return np.concatenate([[0], turns, [len(y) - 1]])


def baseline(y: np.ndarray, noise: np.ndarray, min_p: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Baseline curve and the indices of its points.

    Between two extrema the curve is noise if what lies above the lower one is likely to be
    a sum of noise; slices that are, and whose neighbours are, belong to the baseline, which
    is drawn linearly through its points and never above the curve.
    """
    n = len(y)
    ext = local_extrema(y)
    if len(ext) == 0:
        points = np.array([0, n - 1]) if n > 1 else np.arange(n)
    else:
        p = np.ones(len(ext) - 1)
        for k, (a, b) in enumerate(zip(ext[:-1], ext[1:])):
            sigma = math.sqrt(float((noise[a : b + 1] ** 2).sum()))
            above = float((y[a : b + 1] - min(y[a], y[b])).sum())
            p[k] = math.erfc(above / (sigma * math.sqrt(2))) if sigma > 0 else float(above == 0)
        quiet = p >= min_p
        around = quiet & np.concatenate([[True], quiet[:-1]]) & np.concatenate([quiet[1:], [True]])
        keep = np.zeros(n, bool)
        for k in np.flatnonzero(around):
            keep[ext[k] : ext[k + 1] + 1] = True
        keep[[0, n - 1]] = True
        points = np.flatnonzero(keep)
    curve = np.interp(np.arange(n), points, np.asarray(y, float)[points]) if n else np.zeros(0)
    return np.minimum(curve, y), points


def prominent_maxima(y: np.ndarray, prominence: np.ndarray, distance: int = 3) -> np.ndarray:
    """Local maxima that stand out by ``prominence``, the higher of two closer than ``distance``."""
    n = len(y)
    peaks, i = [], 1
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                peaks.append((i + j) // 2)
            i = j
        i += 1
    peaks = np.array(peaks, int)
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(y[peaks], kind="stable")[::-1] if len(peaks) else []:
        if keep[k]:
            close = np.abs(peaks - peaks[k]) < distance
            close[k] = False
            keep &= ~close
    out = []
    for p in peaks[keep]:
        higher = np.flatnonzero(y > y[p])
        left, right = higher[higher < p], higher[higher > p]
        lo = y[(left[-1] if len(left) else 0) : p + 1].min()
        hi = y[p : (right[0] if len(right) else n - 1) + 1].min()
        if y[p] - max(lo, hi) >= prominence[p]:
            out.append(p)
    return np.array(out, int)


def _interior_maxima(y: np.ndarray) -> np.ndarray:
    return prominent_maxima(y, np.full(len(y), -np.inf), 0)


def detect_peaks(y: np.ndarray, noise: np.ndarray, base: np.ndarray, times_noise: float = 3.0, min_snr: float | None = None) -> list[tuple[int, int, int]]:
    """(start, apex, end) of peaks: maxima above the noise, reaching to the nearest baseline points.

    A point is baseline if it is less than the noise above it; a maximum that is one is no
    peak. Peaks that overlap are parted at the lowest point between their maxima. The apex
    is the highest maximum inside the limits. end is one past the last point.
    """
    points = np.flatnonzero(y - base < noise)
    if len(points) == 0:
        points = np.array([0, len(y) - 1])
    at_base = np.zeros(len(y), bool)
    at_base[points] = True
    tops = [p for p in prominent_maxima(y, times_noise * noise) if not at_base[p]]
    if min_snr is not None:
        tops = [p for p in tops if noise[p] <= 1e-12 or (y[p] - base[p]) / noise[p] > min_snr]
    found: list[list[int]] = []
    for p in tops:
        left, right = points[points < p], points[points > p]
        start = int(left[-1]) if len(left) else 0
        end = int(right[0]) + 1 if len(right) else len(y)
        if found and start < found[-1][2]:
            before = found[-1]
            low = before[1] + int(np.argmin(y[before[1] : p + 1]))
            before[2], start = low + 1, low
        found.append([start, int(p), end])
    maxima = _interior_maxima(y)
    out = []
    for a, _, b in found:
        inside = maxima[(maxima > a) & (maxima < b - 1)]
        if len(inside):
            out.append((a, int(inside[np.argmax(y[inside])]), b))
    return out


def describe_peak(time: np.ndarray, y: np.ndarray, mz: np.ndarray | None, noise: np.ndarray, base: np.ndarray, peak: tuple[int, int, int]) -> dict[str, float]:
    """Height, area, retention, width, extension, signal to noise, mass and limits of a peak."""
    a, apex, b = peak
    t, net = time[a:b], y[a:b] - base[a:b]
    height = max(0.0, float(y[apex] - base[apex]))
    steps = (net[1:] + net[:-1]) / 2 * np.diff(t)
    area = max(0.0, float(steps.sum()))
    weight = np.maximum(net, 0)
    rt = float((weight * t).sum() / weight.sum()) if weight.sum() > 0 else float(t.mean())
    total = np.concatenate([[0.0], np.cumsum(steps)])
    if total[-1] > 0:
        share = total / total[-1]
        lo, hi = np.searchsorted(share, 0.025), np.searchsorted(share, 0.975)
        width = float(t[min(hi, len(t) - 1)] - t[max(0, min(lo, len(t)) - 1)])
    else:
        width = 0.0
    level = float(noise[apex])
    out = {"height": height, "area": area, "rt": rt, "width": width, "extension": float(t[-1] - t[0]), "snr": height / level if level > 1e-12 else math.inf, "rt_start": float(time[a]), "rt_end": float(time[b - 1])}
    if mz is not None:
        w = np.maximum(y[a:b], 0)
        m = np.asarray(mz[a:b], float)
        ok = np.isfinite(m)
        mean = float((w[ok] * m[ok]).sum() / w[ok].sum()) if w[ok].sum() > 0 else float(np.nanmean(m)) if ok.any() else math.nan
        out |= {"mz": mean, "mz_std": float(m[ok].std()) if ok.any() else math.nan}
    return out


def pick(time: np.ndarray, y: np.ndarray, mz: np.ndarray | None = None, smoothing: float = 1.0, times_noise: float = 3.0) -> list[dict[str, float]]:
    """All peaks of a trace, with their descriptors."""
    y = fill_gaps(y, time)
    if len(y) < 3 or not np.isfinite(y).all():
        return []
    s = gaussian_smooth(y, smoothing)
    noise = noise_level(s)
    base, _ = baseline(s, noise)
    return [describe_peak(time, s, mz, noise, base, p) | {"start": p[0], "apex": p[1], "end": p[2]} for p in detect_peaks(s, noise, base, times_noise)]


def centroids(mz: np.ndarray, y: np.ndarray, min_snr: float = 10.0, min_distance: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Masses and intensities of the peaks of a profile spectrum; closer ones are merged."""
    noise = noise_level(y)
    base, _ = baseline(y, noise)
    out = []
    for a, _, b in detect_peaks(y, noise, base, min_snr=min_snr):
        w = y[a:b]
        out.append([float((w * mz[a:b]).sum() / w.sum()), float(w.sum())])
    merged: list[list[float]] = []
    for m, i in out:
        if merged and m - merged[-1][0] < min_distance:
            m0, i0 = merged[-1]
            merged[-1] = [(m0 * i0 + m * i) / (i0 + i), i0 + i]
        else:
            merged.append([m, i])
    z = np.array(merged).reshape(-1, 2)
    return z[:, 0], z[:, 1]


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """Locally weighted linear regression with tricube weights and bisquare robustness, at the points themselves."""
    n = len(x)
    if n <= 3:
        return np.asarray(y, float).copy()
    x, y = np.asarray(x, float), np.asarray(y, float)
    k = min(n, max(2, int(math.ceil(frac * n - 1e-9))))
    robust = np.ones(n)
    fit = y.copy()
    for _ in range(rounds + 1):
        for i in range(n):
            fit[i] = local_line(x, y, robust, x[i], k)
        e = y - fit
        s = np.median(np.abs(e))
        if s <= 0:
            break
        u = np.clip(e / (6 * s), -1, 1)
        robust = (1 - u**2) ** 2
    return fit


def local_line(x: np.ndarray, y: np.ndarray, robust: np.ndarray, at: float, k: int) -> float:
    """Weighted line through the k nearest points, at one place."""
    d = np.abs(x - at)
    h = np.partition(d, k - 1)[k - 1]
    w = robust * np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0.0) if h > 0 else robust * (d == 0)
    if w.sum() <= 0:
        w = robust * (d <= h) + 1e-12 * (d <= h)
    mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
    sxx = (w * (x - mx) ** 2).sum()
    return float(my + ((w * (x - mx) * y).sum() / sxx * (at - mx) if sxx > 1e-12 else 0.0))


def lowess_predict(x: np.ndarray, y: np.ndarray, at: np.ndarray, frac: float) -> np.ndarray:
    """LOWESS of (x, y) at the points, carried to other places linearly."""
    order = np.argsort(x, kind="stable")
    return np.interp(at, np.asarray(x, float)[order], lowess(x, y, frac)[order])


def best_frac(x: np.ndarray, y: np.ndarray) -> float:
    """Span with the least leave-one-out error, of a fixed grid; the same at every run."""
    n = len(x)
    if n <= 4:
        return 1.0
    grid = np.unique(np.round(np.linspace(max(4 / n, 0.2), 1.0, 6), 4))
    ends = range(1, n - 1)
    errors = []
    for f in grid:
        e = 0.0
        for i in ends:
            keep = np.arange(n) != i
            e += (lowess_predict(x[keep], y[keep], x[i : i + 1], f)[0] - y[i]) ** 2
        errors.append(e)
    return float(grid[int(np.argmin(errors))])


#: numbers that an array of the kernels over rows holds at most
ROW_NUMBERS = 1 << 20


def lowess_rows(x: np.ndarray, y: np.ndarray, frac: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """``lowess`` of each row of x and y (rows, points)."""
    g, n = x.shape
    if n <= 3 or not g:
        return np.array(y, float)
    if n * n > ROW_NUMBERS:
        return np.array([lowess(a, b, frac, rounds) for a, b in zip(x, y)])
    most = ROW_NUMBERS // (n * n)
    if g > most:
        return np.concatenate([lowess_rows(x[i : i + most], y[i : i + most], frac, rounds) for i in range(0, g, most)])
    x, y = np.asarray(x, float), np.asarray(y, float)
    k = min(n, max(2, int(math.ceil(frac * n - 1e-9))))
    xs, ys = x[:, None, :], y[:, None, :]
    d = np.abs(xs - x[:, :, None])
    h = np.partition(d, k - 1, axis=2)[:, :, k - 1 : k]
    tricube = (1 - np.minimum(np.divide(d, h, out=np.ones_like(d), where=h > 0), 1) ** 3) ** 3
    near = np.where(h > 0, np.where(d < h, tricube, 0.0), d == 0)
    robust, fit, on = np.ones((g, n)), y.copy(), np.ones(g, bool)
    for _ in range(rounds + 1):
        r = robust[:, None, :]
        w = r * near
        w = np.where(w.sum(2, keepdims=True) <= 0, r * (d <= h) + 1e-12 * (d <= h), w)
        total = w.sum(2)
        mx, my = (w * xs).sum(2) / total, (w * ys).sum(2) / total
        dx = xs - mx[:, :, None]
        sxx = (w * dx**2).sum(2)
        slope = np.divide((w * dx * ys).sum(2), sxx, out=np.zeros_like(sxx), where=sxx > 1e-12)
        fit = np.where(on[:, None], my + slope * (x - mx), fit)
        e = y - fit
        s = np.median(np.abs(e), axis=1)[:, None]
        on &= s[:, 0] > 0
        if not on.any():
            break
        u = np.clip(np.divide(e, 6 * s, out=np.zeros_like(e), where=s > 0), -1, 1)
        robust = np.where(on[:, None], (1 - u**2) ** 2, robust)
    return fit


def best_frac_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``best_frac`` of each row of x, which ascends, and y (rows, points)."""
    g, n = x.shape
    if n <= 4 or not g:
        return np.ones(g)
    most = max(1, ROW_NUMBERS // (n * n))
    if g > most:
        return np.concatenate([best_frac_rows(x[i : i + most], y[i : i + most]) for i in range(0, g, most)])
    grid = np.unique(np.round(np.linspace(max(4 / n, 0.2), 1.0, 6), 4))
    keep = np.array([np.delete(np.arange(n), i) for i in range(1, n - 1)])
    xs, ys, at = x[:, keep].reshape(-1, n - 1), y[:, keep].reshape(-1, n - 1), x[:, 1:-1].reshape(-1, 1)
    rows = np.arange(len(xs))
    a = (xs <= at).sum(1) - 1
    z = np.minimum(a + 1, n - 2)
    errors = []
    for f in grid:
        fit = lowess_rows(xs, ys, f)
        lo, x0 = fit[rows, a], xs[rows, a]
        rise = np.divide(fit[rows, z] - lo, xs[rows, z] - x0, out=np.zeros_like(lo), where=z > a)
        off = ((rise * (at[:, 0] - x0) + lo).reshape(g, -1) - y[:, 1:-1]) ** 2
        # added one after the other, as best_frac does
        errors.append(np.cumsum(off, axis=1)[:, -1])
    return grid[np.argmin(np.array(errors), axis=0)]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of rows to columns with the least total cost (shortest augmenting paths)."""
    c = np.asarray(cost, float)
    flip = c.shape[0] > c.shape[1]
    c = c.T if flip else c
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[owner[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def diagonal_mixture(x: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of k diagonal gaussians by EM, begun from equal parts in the first coordinate's order."""
    n, d = x.shape
    floor = 1e-12 + 1e-6 * x.var(0)
    parts = np.array_split(np.argsort(x[:, 0], kind="stable"), k)
    mu = np.array([x[p].mean(0) for p in parts])
    var = np.array([x[p].var(0) for p in parts]) + floor
    w = np.full(k, 1 / k)
    last = -np.inf
    for _ in range(rounds if k > 1 else 1):
        if k == 1:
            break
        logp = np.log(w) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None] - mu) ** 2 / var).sum(2))
        top = logp.max(1, keepdims=True)
        r = np.exp(logp - top)
        like = (top[:, 0] + np.log(r.sum(1))).mean()
        r /= r.sum(1, keepdims=True)
        size = r.sum(0) + 1e-12
        w = size / n
        mu = (r.T @ x) / size[:, None]
        var = (r.T @ x**2) / size[:, None] - mu**2
        var = np.maximum(var, floor)
        if like - last < 1e-6:
            break
        last = like
    return mu, np.sqrt(var)


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's distribution for arrays, by the incomplete beta function's continued fraction.

    NaN where t or df is NaN or df isn't above 0; df of infinity is the normal distribution.
    """
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    normal = np.isinf(df)
    n = np.where(normal, 1.0, df)
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, n / (n + t * t))
        half = 0.5 * incomplete_beta(n / 2, np.full(n.shape, 0.5), x)
        # P(1/2, z^2 / 2) of the incomplete gamma function is the limit
        half = np.where(normal, 0.5 * np.array([math.erfc(abs(v) / math.sqrt(2)) if normal_ else 0.0 for v, normal_ in zip(t.ravel(), normal.ravel())]).reshape(t.shape), half)
        out = np.where(t > 0, half, 1 - half)
    return np.where(np.isnan(t) | ~(df > 0), np.nan, out)


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of arrays."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    # the fraction converges fast below the mean; above it, the other tail is taken
    turn = x > (a + 1) / (a + b + 2)
    a, b, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = (z > 0) & (z < 1) & (a > 0) & (b > 0)
    a, b, z = np.where(inside, a, 1.0), np.where(inside, b, 1.0), np.where(inside, z, 0.5)
    ids = np.unique(np.stack([a.ravel(), b.ravel()]), axis=1, return_inverse=True)
    front = (_log_gamma(ids[0][0] + ids[0][1]) - _log_gamma(ids[0][0]) - _log_gamma(ids[0][1]))[ids[1].ravel()].reshape(a.shape) if a.size else np.zeros(a.shape)
    front = np.exp(front + a * np.log(z) + b * np.log1p(-z)) / a
    small = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones(a.shape), 1 / small(1 - (a + b) * z / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        step = np.ones(a.shape)
        for num in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / small(1 + num * d)
            c = small(1 + num / c)
            step = d * c
            h = h * step
        if not a.size or np.abs(step - 1).max() < 1e-14:
            break
    value = np.where(inside, front * h, 0.0)
    return np.where(turn, 1 - value, value)


def knn_fill(x: np.ndarray, k: int) -> np.ndarray:
    """Each NaN from the mean of the k rows nearest in the coordinates that both have."""
    x = np.array(x, float)
    out = x.copy()
    ok = np.isfinite(x)
    z = np.where(ok, x, 0.0)
    both = ok.astype(float) @ ok.T.astype(float)
    sq = (z**2) @ ok.T + ok @ (z**2).T - 2 * z @ z.T
    dist = np.where(both > 0, np.sqrt(np.maximum(sq, 0) * x.shape[1] / np.maximum(both, 1)), np.inf)
    np.fill_diagonal(dist, np.inf)
    for j in np.flatnonzero(~ok.all(0)):
        have = np.flatnonzero(ok[:, j])
        for i in np.flatnonzero(~ok[:, j]):
            if len(have) == 0:
                out[i, j] = 0.0
                continue
            near = have[np.argsort(dist[i, have], kind="stable")[:k]]
            near = near[np.isfinite(dist[i, near])]
            out[i, j] = x[near, j].mean() if len(near) else x[have, j].mean()
    return out


def ward_order(squared: np.ndarray) -> list[int]:
    """Leaves of Ward's clustering from squared distances, each merge putting the smaller index first."""
    n = len(squared)
    d = np.array(squared, float)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    leaves = {i: [i] for i in range(n)}
    for _ in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        a, b, best = size[i], size[j], d[i, j]
        live = [k for k in leaves if k not in (i, j)]
        k = np.array(live, int)
        if len(k):
            new = ((a + size[k]) * d[i, k] + (b + size[k]) * d[j, k] - size[k] * best) / (a + b + size[k])
            d[i, k] = d[k, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i] = a + b
        leaves[i] += leaves.pop(j)
    return next(iter(leaves.values())) if n else []


def interpolated_level(x: np.ndarray, y: np.ndarray, at: np.ndarray, how: str = "linear") -> np.ndarray:
    """Level between control samples, constant beyond them: linear, or a natural cubic spline."""
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    x, first = np.unique(x, return_index=True)
    y = y[first]
    if how == "linear" or len(x) < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    n = len(x)
    a = np.zeros((n, n))
    r = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 3 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(a, r)
    q = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, q, side="right") - 1, 0, n - 2)
    t = q - x[k]
    b = (y[k + 1] - y[k]) / h[k] - h[k] * (2 * c[k] + c[k + 1]) / 3
    return y[k] + b * t + c[k] * t**2 + (c[k + 1] - c[k]) / (3 * h[k]) * t**3


def profile_sum(times: list[np.ndarray], spints: list[np.ndarray], signs: list[float], tol: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Signed sum of profile spectra on the union of their masses, linear in between; what is above 0."""
    if not times:
        return np.zeros(0), np.zeros(0)
    grid = np.sort(np.concatenate(times))
    grid = grid[np.concatenate([[True], np.diff(grid) > tol])] if len(grid) else grid
    total = np.zeros(len(grid))
    for m, y, s in zip(times, spints, signs):
        if len(m):
            total += s * np.interp(grid, m, y, left=0.0, right=0.0)
    return grid[total > 0], total[total > 0]
