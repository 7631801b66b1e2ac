"""Trend fits of many small groups at once: groups of equally many bins are the rows of one array, and numpy works on all of them.

Same fits as :mod:`opinara.plans.fitters`, for groups of ``SMALL`` bins at most. Kernels stand on the bins themselves instead of inducing points, so nothing is approximated.
``x``, ``y``, ``w`` are (groups, bins), ``grid`` is common to all groups; means and bands are (groups, days), parameters a dictionary of columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from opinara.plans.fitters import CONFUSION, bandwidth, resamples, spline_many

#: Bins of a group that is fitted together with others. Fixed value.
SMALL = 64


def _nothing(like: np.ndarray) -> np.ndarray:
    return np.full(like.shape, np.nan)


def _again(w: np.ndarray, extra: dict) -> np.ndarray:
    """Resamples of each group by its own seed: (groups, bins, resamples)."""
    return np.stack([resamples(w[i], extra | {"seed": seed}) for i, seed in enumerate(extra["seeds"])])


def _band(fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = np.clip(fits, -1, 1)
    return f.mean(-1), *np.percentile(f, [5, 95], axis=-1)


def _rbf(a: np.ndarray, b: np.ndarray, ell: np.ndarray) -> np.ndarray:
    return np.exp(-((a[..., :, None] - b[..., None, :]) ** 2) / (2 * ell * ell)[:, None, None])


def _values(k: np.ndarray, a: np.ndarray) -> np.ndarray:
    return (k @ a[..., None])[..., 0]


def _solve(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.linalg.solve(m, v[..., None])[..., 0]


def _half_logdet(m: np.ndarray) -> np.ndarray:
    return np.log(np.diagonal(np.linalg.cholesky(m), axis1=-2, axis2=-1)).sum(-1)


def _on_diagonal(k: np.ndarray, d: np.ndarray) -> np.ndarray:
    out, at = k.copy(), np.arange(k.shape[-1])
    out[..., at, at] += d
    return out


def kernelreg(x, y, w, grid, extra):
    h = extra.get("bandwidth") or bandwidth()
    many = _again(w, extra)
    u = x[:, None, :] - grid[None, :, None]
    k = np.exp(-(u**2) / (2 * h * h)) / (math.sqrt(2 * math.pi) * h)
    wn = many / many.sum(1, keepdims=True)
    wy, ku = wn * y[..., None], k * u
    s0, s1, s2, v0, v1 = k @ wn, ku @ wn, (ku * u) @ wn, k @ wy, ku @ wy
    det = s0 * s2 - s1 * s1
    ok = np.abs(det) > 1e-10
    fits = np.where(ok, (s2 * v0 - s1 * v1) / np.where(ok, det, 1), 0.0)
    return *_band(fits), {"bandwidth": np.full(len(x), h)}


def bkrr(x, y, w, grid, extra):
    ell = np.full(len(x), extra.get("lengthscale") or bandwidth())
    k, alphas = _rbf(x, x, ell), np.logspace(-3, 2, 50)
    values, vectors = np.linalg.eigh(k)
    inv = 1 / (np.maximum(values, 0)[..., None] + alphas)
    # leave-one-out errors: what the inverse makes of y, over its diagonal
    left = vectors @ (inv * (np.swapaxes(vectors, 1, 2) @ y[..., None])) / np.maximum((vectors**2) @ inv, 1e-9 / alphas)
    alpha = alphas[(left**2).sum(1).argmin(-1)]
    root = np.sqrt(np.swapaxes(_again(w, extra), 1, 2))
    system = _on_diagonal(root[..., :, None] * k[:, None] * root[..., None, :], alpha[:, None, None])
    c = root * _solve(system, root * y[:, None, :])
    return *_band(_rbf(np.broadcast_to(grid, (len(x), len(grid))), x, ell) @ np.swapaxes(c, 1, 2)), {"lengthscale": ell, "alpha": alpha}


def lowess(x, y, w, grid, extra):
    n = x.shape[1]
    r = min(n, max(2, math.ceil(extra.get("frac", 2 / 3) * n)))
    robust = np.ones(x.shape)
    mean = lambda k, v, total: (k * v).sum(-1) / total

    def at(points: np.ndarray) -> np.ndarray:
        d = np.abs(x[:, None, :] - points[:, :, None])
        reach = np.maximum(np.partition(d, r - 1, axis=-1)[..., r - 1 : r], 1e-12)
        k = np.clip(1 - (d / reach) ** 3, 0, 1) ** 3 * (w * robust)[:, None, :]
        total = k.sum(-1)
        safe = np.where(total > 0, total, 1)
        mx, my = mean(k, x[:, None, :], safe), mean(k, y[:, None, :], safe)
        dx = x[:, None, :] - mx[..., None]
        var = mean(k, dx**2, safe)
        slope = np.where(var > 1e-12, mean(k, dx * (y[:, None, :] - my[..., None]), safe) / np.where(var > 1e-12, var, 1), 0.0)
        return np.where(total > 0, my + slope * (points - mx), np.nan)

    for _ in range(extra.get("it", 3)):
        res = np.abs(y - np.nan_to_num(at(x)))
        s = 6 * np.median(res, axis=1, keepdims=True)
        robust = np.where(s > 0, np.clip(1 - (res / np.where(s > 0, s, 1)) ** 2, 0, 1) ** 2, robust)
    m = at(np.broadcast_to(grid, (len(x), len(grid))))
    for i in np.flatnonzero(np.isnan(m).any(1)):
        own = m[i, : extra["n_days"][i]]  # a view
        known = np.flatnonzero(~np.isnan(own))
        if len(known):
            own[:] = np.interp(np.arange(len(own)), known, own[known])
    return np.clip(m, -1, 1), _nothing(m), _nothing(m), {}


def climb(cost: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, rounds: int) -> np.ndarray:
    """:func:`opinara.plans.fitters.climb` of many groups: ``start`` is (groups, parameters), ``cost`` takes parameters and the numbers of their groups."""
    p, every = start.copy(), np.arange(len(start))
    step, best = np.full(len(p), 0.5), cost(p, every)
    for _ in range(rounds):
        moved = np.zeros(len(p), bool)
        for i in range(p.shape[1]):
            for sign in (1, -1):
                q = p.copy()
                q[:, i] *= np.exp(sign * step)
                c = cost(q, every)
                better = c < best - 1e-9
                p[better], best = q[better], np.where(better, c, best)
                moved |= better
        step = np.where(moved, step, step / 2)
    return p


def exact_gp(x, y, w, grid, extra):
    def parts(p, at):
        system = _on_diagonal(p[:, 1, None, None] * _rbf(x[at], x[at], p[:, 0]), p[:, 2, None] / w[at])
        return system, _solve(system, y[at])

    def cost(p, at):
        system, c = parts(p, at)
        return 0.5 * (y[at] * c).sum(-1) + _half_logdet(system)

    start = np.array([extra.get("lengthscale") or bandwidth(), 1.0, extra.get("noise", 0.5)])
    p = climb(cost, np.tile(start, (len(x), 1)), extra.get("n_iter", 10))
    system, c = parts(p, np.arange(len(x)))
    ks = p[:, 1, None, None] * _rbf(np.broadcast_to(grid, (len(x), len(grid))), x, p[:, 0])
    mean = _values(ks, c)
    known = (ks * np.swapaxes(np.linalg.solve(system, np.swapaxes(ks, 1, 2)), 1, 2)).sum(-1)
    sd = np.sqrt(np.maximum(p[:, 1, None] - known, 1e-9) + p[:, 2, None])
    cut = lambda v: np.clip(v, -1, 1)
    return cut(mean), cut(mean - 1.96 * sd), cut(mean + 1.96 * sd), {"lengthscale": p[:, 0], "amplitude": p[:, 1], "noise": p[:, 2], "inducing": np.full(len(x), x.shape[1])}


#: Values of the normal distribution's function, between which cubics run that also have its slopes: exact to thirteen digits.
_STEP, _ENDS = 1 / 512, 9.0
_KNOTS = np.arange(-_ENDS, _ENDS + _STEP, _STEP)
_PHI = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _KNOTS])


def _density(z: np.ndarray) -> np.ndarray:
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


_SLOPE = _density(_KNOTS) * _STEP


def normal(z: np.ndarray) -> np.ndarray:
    """The standard normal distribution's function."""
    t = (np.clip(z, -_ENDS, _ENDS) + _ENDS) / _STEP
    i = np.minimum(t.astype(int), len(_KNOTS) - 2)
    t = t - i
    a, b, da, db = _PHI[i], _PHI[i + 1], _SLOPE[i], _SLOPE[i + 1]
    return a + t * (da + t * (3 * (b - a) - 2 * da - db + t * (2 * (a - b) + da + db)))


def likelihood(f: np.ndarray, sigma: np.ndarray, counts: np.ndarray, c: np.ndarray, slopes: bool = True):
    """Log likelihood of class counts (groups, bins, 3) given latent f, with its first and second derivatives by f: an ordinal probit with cuts at -0.5 and 0.5, then classifier errors ``c``."""
    s, sigma = np.tanh(f), sigma[:, None]
    zl, zh = (-0.5 - s) / sigma, (0.5 - s) / sigma
    low, high = normal(zl), normal(zh)
    true = (np.stack([low, high - low, 1 - high], -1) * (1 - 2e-3) + 1e-3) / 1.001
    q = true @ c
    value = (counts * np.log(q)).sum(-1)
    if not slopes:
        return value
    ds = 1 - s * s
    by, pl, ph = ds / sigma, _density(zl), _density(zh)
    first = lambda p: -p * by
    second = lambda z, p: p * (2 * s * by - z * by**2)
    spread = lambda l, h: (np.stack([l, h - l, -h], -1) * ((1 - 2e-3) / 1.001)) @ c / q  # noqa: E731, E741
    d1, d2 = spread(first(pl), first(ph)), spread(second(zl, pl), second(zh, ph))
    return value, (counts * d1).sum(-1), (counts * (d2 - d1**2)).sum(-1)


def gp(x, y, w, grid, extra):
    loc, scale, s_loc, s_scale = (extra.get(k, v) for k, v in (("lengthscale_loc", 2.0), ("lengthscale_scale", 0.1), ("sigma_loc", 1.0), ("sigma_scale", 0.2)))
    c = np.array(extra.get("confusion") or CONFUSION)
    counts = np.stack([extra["n_neg"], w - extra["n_neg"] - extra["n_pos"], extra["n_pos"]], -1)
    mean = np.arctanh(np.clip((y * w).sum(1) / w.sum(1), -0.9, 0.9))[:, None]

    def posterior(p):
        """Kernel, weights of its columns at the mode, curvature there, and the log evidence."""
        k, sigma = _rbf(x, x, p[:, 0]), p[:, 1]

        def goal(a, of):
            g = _values(k[of], a)
            return likelihood(mean[of] + g, sigma[of], counts[of], c, False).sum(-1) - (a * g).sum(-1) / 2

        def system(of, h):
            root = np.sqrt(h)
            return root, _on_diagonal(root[:, :, None] * k[of] * root[:, None, :], 1.0)

        a, h, half = np.zeros(x.shape), np.ones(x.shape), np.zeros(len(x))
        at, on = goal(a, np.arange(len(x))), np.arange(len(x))
        for _ in range(30):
            f = _values(k[on], a[on])
            _, up, bend = likelihood(mean[on] + f, sigma[on], counts[on], c)
            h[on] = np.maximum(-bend, 1e-4)
            root, m = system(on, h[on])
            b = h[on] * f + up
            step = b - root * _solve(m, root * _values(k[on], b)) - a[on]
            half[on] = _half_logdet(m)
            size, new = np.ones(len(on)), goal(a[on] + step, on)
            while (low := (new < at[on]) & (size > 1e-3)).any():
                size[low] /= 2
                new[low] = goal(a[on[low]] + size[low, None] * step[low], on[low])
            a[on] += size[:, None] * step
            gain, at[on] = new - at[on], new
            on = on[np.abs(gain) >= 1e-6 * (1 + np.abs(new))]
            if not len(on):
                break
        return k, a, h, at - half

    def cost(p, _):
        prior = (np.log(p[:, 0]) - loc) ** 2 / (2 * scale**2) + np.log(p[:, 0]) + (p[:, 1] - s_loc) ** 2 / (2 * s_scale**2)
        return prior - posterior(p)[3]

    start = np.tile(np.array([extra.get("lengthscale") or bandwidth(loc, scale), s_loc]), (len(x), 1))
    p = start if extra.get("lengthscale") else climb(cost, start, extra.get("n_iter", 3))
    k, a, h, _ = posterior(p)
    ks = _rbf(np.broadcast_to(grid, (len(x), len(grid))), x, p[:, 0])
    known = (ks * np.swapaxes(np.linalg.solve(_on_diagonal(k, 1 / h), np.swapaxes(ks, 1, 2)), 1, 2)).sum(-1)
    m, sd = mean + _values(ks, a), np.sqrt(np.maximum(1 - known, 1e-9))
    return np.tanh(m), np.tanh(m - 2 * sd), np.tanh(m + 2 * sd), {"lengthscale": p[:, 0], "sigma": p[:, 1], "inducing": np.full(len(x), x.shape[1])}


def spline(x, y, w, grid, extra):
    m, penalty = spline_many(x, y, w, grid, extra)
    return m, _nothing(m), _nothing(m), {"penalty": penalty}


FITTERS: dict[str, Callable] = {"kernelreg": kernelreg, "bkrr": bkrr, "lowess": lowess, "exact_gp": exact_gp, "gp": gp, "spline": spline}
#: Numbers that a group's largest array has, besides days by bins: by resamples, or bins by bins.
CELLS: dict[str, Callable[[int, int, int], int]] = {
    "kernelreg": lambda n, days, again: days * again + n * again,
    "bkrr": lambda n, days, again: days * again + n * n * again,
}
#: Numbers of an array that is worked on at once. Fixed value.
MOST_CELLS = 2_000_000


def at_once(method: str, n: int, days: int, extra: dict) -> int:
    """How many groups of ``n`` bins and ``days`` days are fitted together."""
    return max(1, MOST_CELLS // (n * max(n, days, 60) + CELLS.get(method, lambda *_: 0)(n, days, extra.get("n_bootstrap", 100))))
