"""Numerical trend fits of one group, on hourly bins (x, w, sy, n_neg, n_pos): numpy only, seeded by group.

Each fitter takes (x, y, w, grid, extra) and returns (mean, lower, upper, parameters). ``y`` are means of a bin,
``w`` its counts.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd

_erf = np.vectorize(math.erf)


def bandwidth(loc: float = 2.0, scale: float = 0.1) -> float:
    """The mode of a log-normal prior."""
    return math.exp(loc - scale**2)


#: Beyond so many bandwidths a Gaussian weight is lost in the rounding of a double; so many length scales for a kernel of unit height.
REACH, NEAR = 9.0, 7.0
#: Days or observations that are handled at once.
PORTION = 256
#: Inducing points a length scale, and how many there are at most.
PER_SCALE, MOST_POINTS = 4, 1000


def local_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray, grid: np.ndarray, h: float) -> np.ndarray:
    """Local-linear fits on ``grid`` for weights ``w`` (n, or n by resamples); x is sorted. Only observations within ``REACH`` bandwidths meet a day."""
    many = w.reshape(len(x), -1)
    out, total = np.zeros((len(grid), many.shape[1])), many.sum(0)
    for g in range(0, len(grid), PORTION):
        t = grid[g : g + PORTION]
        at = slice(*np.searchsorted(x, [t[0] - REACH * h, t[-1] + REACH * h]))
        u = x[None, at] - t[:, None]
        k = np.exp(-(u**2) / (2 * h * h)) / (math.sqrt(2 * math.pi) * h)
        wn, wy = many[at] / total, many[at] * y[at, None] / total
        s0, s1, s2, v0, v1 = k @ wn, (k * u) @ wn, (k * u * u) @ wn, k @ wy, (k * u) @ wy
        det = s0 * s2 - s1 * s1
        ok = np.abs(det) > 1e-10
        out[g : g + PORTION] = np.where(ok, (s2 * v0 - s1 * v1) / np.where(ok, det, 1), 0.0)
    return out if w.ndim > 1 else out[:, 0]


def resamples(w: np.ndarray, extra: dict) -> np.ndarray:
    """Multinomial resamples of the observations, as counts by bin: n by resamples."""
    return np.random.default_rng(extra["seed"]).multinomial(int(w.sum()), w / w.sum(), size=extra.get("n_bootstrap", 100)).T.astype(float)


def band(fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and 5-95 % band of fits (days by resamples)."""
    f = np.clip(fits, -1, 1)
    return f.mean(1), np.percentile(f, 5, 1), np.percentile(f, 95, 1)


def kernelreg(x, y, w, grid, extra):
    """Bootstrap of the local-linear fit."""
    h = extra.get("bandwidth") or bandwidth()
    return *band(local_linear(x, y, resamples(w, extra), grid, h)), {"bandwidth": h}


def _rbf(a: np.ndarray, b: np.ndarray, ell: float) -> np.ndarray:
    return np.exp(-((a[:, None] - b[None, :]) ** 2) / (2 * ell * ell))


class Inducing:
    """Functions f = K(., z) c over sorted x, with inducing points z evenly over the span: ``PER_SCALE`` a length scale, ``MOST_POINTS`` at most.

    At four a length scale they stand for the full kernel to about six digits. An observation only meets the points within ``NEAR`` length
    scales, so a pass over n observations costs n times the square of a few dozen, and memory for as many; solves are of m by m.
    """

    def __init__(self, x: np.ndarray, ell: float):
        self.ell, self.n = ell, len(x)
        lo, hi = x[0] - ell, x[-1] + ell
        self.z = np.linspace(lo, hi, int(min(MOST_POINTS, max(4, math.ceil((hi - lo) / ell * PER_SCALE)))))
        self.kzz = _rbf(self.z, self.z, ell) + 1e-8 * np.eye(len(self.z))
        self.parts = [(slice(k, k + PORTION), *self._block(x[k : k + PORTION])) for k in range(0, len(x), PORTION)]

    def _block(self, t: np.ndarray) -> tuple[slice, np.ndarray]:
        at = slice(*np.searchsorted(self.z, [t[0] - NEAR * self.ell, t[-1] + NEAR * self.ell]))
        return at, _rbf(t, self.z[at], self.ell)

    def gram(self, h: np.ndarray) -> np.ndarray:
        """K(z, x) diag(h) K(x, z)."""
        out = np.zeros_like(self.kzz)
        for rows, at, k in self.parts:
            out[at, at] += k.T @ (h[rows, None] * k)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        """K(z, x) g."""
        out = np.zeros(len(self.z))
        for rows, at, k in self.parts:
            out[at] += k.T @ g[rows]
        return out

    def values(self, c: np.ndarray) -> np.ndarray:
        return np.concatenate([k @ c[at] for _, at, k in self.parts])

    def ridge(self, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
        """Coefficients of kernel ridge regression: an observation of weight w is one of noise alpha / w."""
        return np.linalg.solve(self.gram(w) + alpha * self.kzz, self.back(w * y))

    def loo_alpha(self, y: np.ndarray) -> float:
        """The ridge of least leave-one-out error over 50 from 1e-3 to 100, analytically from one eigendecomposition."""
        low = np.linalg.cholesky(self.kzz)
        whiten = np.linalg.inv(low).T
        values, vectors = np.linalg.eigh(whiten.T @ self.gram(np.ones(self.n)) @ whiten)
        turn, alphas = whiten @ vectors, np.logspace(-3, 2, 50)
        inv = 1 / (np.maximum(values, 0)[:, None] + alphas[None, :])
        part = turn.T @ self.back(y)
        wrong = np.zeros(len(alphas))
        for rows, at, k in self.parts:
            u = k @ turn[at]
            left = y[rows, None] - u @ (inv * part[:, None])
            wrong += ((left / np.maximum(1 - (u**2) @ inv, 1e-9)) ** 2).sum(0)
        return float(alphas[int(wrong.argmin())])

    def variance(self, grid: np.ndarray, precision: np.ndarray, amp: float = 1.0) -> np.ndarray:
        """Posterior variance on ``grid`` where the coefficients' precision is ``precision`` and the prior's kzz / amp."""
        k = _rbf(grid, self.z, self.ell)
        known = np.einsum("ij,ji->i", k, np.linalg.solve(self.kzz, k.T))
        return np.maximum(amp * (1 - known) + np.einsum("ij,ji->i", k, np.linalg.solve(precision, k.T)), 1e-9)


def bkrr(x, y, w, grid, extra):
    """Bayesian kernel ridge with a bootstrap band."""
    ell = extra.get("lengthscale") or bandwidth()
    model = Inducing(x, ell)
    alpha = model.loo_alpha(y)
    again, k = resamples(w, extra), _rbf(grid, model.z, ell)
    fits = np.stack([k @ model.ridge(y, again[:, b], alpha) for b in range(again.shape[1])], axis=1)
    return *band(fits), {"lengthscale": ell, "alpha": alpha}


#: Points at which robust fits are made; between them they are read off a line.
ANCHORS = 500


def lowess(x, y, w, grid, extra):
    """Robust local-linear fits over the nearest two thirds of the observations, made at ``ANCHORS`` of them and joined by lines; no band."""
    n = len(x)
    r = min(n, max(2, math.ceil(extra.get("frac", 2 / 3) * n)))
    anchors = np.unique(x[np.linspace(0, n - 1, min(n, ANCHORS)).round().astype(int)])
    robust = np.ones(n)

    def at(points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points))
        for i, g in enumerate(points):
            d = np.abs(x - g)
            reach = max(np.partition(d, r - 1)[r - 1], 1e-12)
            k = np.clip(1 - (d / reach) ** 3, 0, 1) ** 3 * w * robust
            if k.sum() <= 0:
                out[i] = np.nan
                continue
            mx, my = np.average(x, weights=k), np.average(y, weights=k)
            var = np.average((x - mx) ** 2, weights=k)
            slope = np.average((x - mx) * (y - my), weights=k) / var if var > 1e-12 else 0.0
            out[i] = my + slope * (g - mx)
        return out

    for _ in range(extra.get("it", 3)):
        res = np.abs(y - np.interp(x, anchors, np.nan_to_num(at(anchors))))
        s = 6 * np.median(res)
        if s <= 0:
            break
        robust = np.clip(1 - (res / s) ** 2, 0, 1) ** 2
    m = at(grid)
    if np.isnan(m).any() and not np.isnan(m).all():
        m = np.interp(np.arange(len(m)), np.flatnonzero(~np.isnan(m)), m[~np.isnan(m)])
    nan = np.full(len(grid), np.nan)
    return np.clip(m, -1, 1), nan, nan, {}


def climb(cost: Callable[[list[float]], float], start: list[float], rounds: int) -> list[float]:
    """Positive parameters of least cost, one coordinate at a time by growing and shrinking factors."""
    p, step, best = [*start], 0.5, cost(start)
    for _ in range(rounds):
        moved = False
        for i in range(len(p)):
            for f in (math.exp(step), math.exp(-step)):
                q = [*p]
                q[i] *= f
                if (c := cost(q)) < best - 1e-9:
                    p, best, moved = q, c, True
        step = step if moved else step / 2
    return p


def exact_gp(x, y, w, grid, extra):
    """Zero-mean Gaussian process; length scale, amplitude and noise maximise the marginal likelihood, noise included in the band."""
    models: dict[float, Inducing] = {}

    def parts(p):
        ell, amp, noise = p
        if ell not in models:
            models.clear()
            models[ell] = Inducing(x, ell)
        m = models[ell]
        precision = m.kzz / amp + m.gram(w / noise)
        return m, precision, np.linalg.solve(precision, m.back(w * y / noise))

    def cost(p) -> float:
        m, precision, c = parts(p)
        left = y - m.values(c)
        fit = (w * left**2).sum() / p[2] + c @ m.kzz @ c / p[1]
        det = np.linalg.slogdet(precision)[1] - np.linalg.slogdet(m.kzz / p[1])[1] + np.log(p[2] / w).sum()
        return float(0.5 * (fit + det))

    p = climb(cost, [extra.get("lengthscale") or bandwidth(), 1.0, extra.get("noise", 0.5)], extra.get("n_iter", 10))
    model, precision, c = parts(p)
    mean, sd = _rbf(grid, model.z, p[0]) @ c, np.sqrt(model.variance(grid, precision, p[1]) + p[2])
    cut = lambda v: np.clip(v, -1, 1)
    return cut(mean), cut(mean - 1.96 * sd), cut(mean + 1.96 * sd), {"lengthscale": p[0], "amplitude": p[1], "noise": p[2], "inducing": len(model.z)}


#: P(predicted | true) over (against, neutral, favor); an assumed profile, replaceable by a parameter.
CONFUSION = ((0.8, 0.12, 0.08), (0.12, 0.76, 0.12), (0.08, 0.12, 0.8))


def _bins(f: np.ndarray, sigma: float) -> np.ndarray:
    """P(true class | latent f): an ordinal probit with cuts at -0.5 and 0.5."""
    phi = lambda z: 0.5 * (1 + _erf(z / math.sqrt(2)))
    low, high = phi((-0.5 - np.tanh(f)) / sigma), phi((0.5 - np.tanh(f)) / sigma)
    p = np.stack([low, high - low, 1 - high], -1) * (1 - 2e-3) + 1e-3
    return p / p.sum(-1, keepdims=True)


def gp(x, y, w, grid, extra):
    """Ordinal Gaussian process with classifier error over inducing points, by Laplace's approximation.

    Length scale (log-normal prior around its location) and sigma (normal prior around 1) maximise the approximate evidence. All bins are observations, whatever their number.
    """
    loc, scale, s_loc, s_scale = (extra.get(k, v) for k, v in (("lengthscale_loc", 2.0), ("lengthscale_scale", 0.1), ("sigma_loc", 1.0), ("sigma_scale", 0.2)))
    c = np.array(extra.get("confusion") or CONFUSION)
    counts = np.stack([extra["n_neg"], w - extra["n_neg"] - extra["n_pos"], extra["n_pos"]], -1)
    mean, e = float(np.arctanh(np.clip((y * w).sum() / w.sum(), -0.9, 0.9))), 1e-4

    def posterior(ell: float, sigma: float):
        """Coefficients at the mode, their precision, and the log evidence."""
        model = Inducing(x, ell)
        like = lambda f: (counts * np.log(_bins(f, sigma) @ c)).sum(-1)
        goal = lambda a: float(like(mean + model.values(a)).sum() - a @ model.kzz @ a / 2)
        a, at = np.zeros(len(model.z)), goal(np.zeros(len(model.z)))
        for _ in range(30):
            f = mean + model.values(a)
            up, mid, down = like(f + e), like(f), like(f - e)
            h = np.maximum(-(up - 2 * mid + down) / e**2, 1e-4)
            precision = model.kzz + model.gram(h)
            step = np.linalg.solve(precision, model.back((up - down) / (2 * e)) - model.kzz @ a)
            size = 1.0
            while (new := goal(a + size * step)) < at and size > 1e-3:
                size /= 2
            a, gain, at = a + size * step, new - at, new
            if abs(gain) < 1e-6 * (1 + abs(at)):
                break
        evidence = at - (np.linalg.slogdet(precision)[1] - np.linalg.slogdet(model.kzz)[1]) / 2
        return model, a, precision, evidence

    def cost(p) -> float:
        prior = (math.log(p[0]) - loc) ** 2 / (2 * scale**2) + math.log(p[0]) + (p[1] - s_loc) ** 2 / (2 * s_scale**2)
        return prior - posterior(*p)[3]

    start = [extra.get("lengthscale") or bandwidth(loc, scale), s_loc]
    ell, sigma = start if extra.get("lengthscale") else climb(cost, start, extra.get("n_iter", 3))
    model, a, precision, _ = posterior(ell, sigma)
    m, sd = mean + _rbf(grid, model.z, ell) @ a, np.sqrt(model.variance(grid, precision))
    return np.tanh(m), np.tanh(m - 2 * sd), np.tanh(m + 2 * sd), {"lengthscale": ell, "sigma": sigma, "inducing": len(model.z)}


def spline(x, y, w, grid, extra):
    """Cubic smoothing spline over hourly bins as a penalised B-spline of at most 400 pieces, the penalty by leave-one-out error; no band.

    Bands of width four: linear in the bins and in the knots.
    """
    m, penalty = spline_many(x[None], y[None], w[None], grid, extra)
    nan = np.full(len(grid), np.nan)
    return m[0], nan, nan, {"penalty": float(penalty[0])}


def spline_many(x: np.ndarray, y: np.ndarray, w: np.ndarray, grid: np.ndarray, extra: dict) -> tuple[np.ndarray, np.ndarray]:
    """Means (groups, days) and penalties of groups of equally many bins (groups, bins). All groups and penalties go through one pass over the knots."""
    span = x[:, -1] - x[:, 0]
    gap = np.full(len(x), extra["knot"]) if "knot" in extra else np.maximum(span / min(400, max(4, x.shape[1])), 1e-9)
    knots = np.ceil(span / gap).astype(int) + 4
    mean, penalty = np.empty((len(x), len(grid))), np.empty(len(x))
    for n in np.unique(knots):
        of = np.flatnonzero(knots == n)
        mean[of], penalty[of] = _splines(x[of], y[of], w[of], grid, gap[of, None], int(n))
    return mean, penalty


def _splines(x, y, w, grid, gap, n):
    def basis(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip(np.floor((t - x[:, :1]) / gap), 0, n - 4)
        u = np.clip((t - x[:, :1]) / gap - at, 0, 1)
        b = np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3], -1) / 6
        return at.astype(int), b

    first, b = basis(x)
    each = np.arange(len(x))
    rows = np.broadcast_to(each[:, None], first.shape)
    gram = np.zeros((4, n, len(x)))  # lower bands; groups last
    right = np.zeros((n, len(x)))
    for i in range(4):
        np.add.at(right, (first + i, rows), w * y * b[..., i])
        for j in range(i, 4):
            np.add.at(gram[j - i], (first + i, rows), w * b[..., i] * b[..., j])
    d = np.array([1.0, -2.0, 1.0])
    rough = np.zeros((4, n))
    for i in range(3):
        for j in range(i, 3):
            rough[j - i, i : n - 2 + i] += d[i] * d[j]
    lams = np.logspace(-3, 4, 15)
    low = banded_cholesky(gram[:, :, None] + lams[:, None] * rough[:, :, None, None] + np.array([1e-9, 0, 0, 0])[:, None, None, None])
    c = banded_solve(low, np.repeat(right[:, None], len(lams), axis=1))
    inv = banded_inverse(low)
    fit = sum(b[..., i, None] * c[first + i, :, rows] for i in range(4))
    own = w[..., None] * sum((2 if j else 1) * (b[..., i] * b[..., i + j])[..., None] * inv[j][first + i, :, rows] for i in range(4) for j in range(4 - i))
    wrong = (w[..., None] * ((y[..., None] - fit) / np.maximum(1 - own, 1e-3)) ** 2).sum(1)
    kept = wrong.argmin(1)
    best = c[:, kept, each]
    at, b = basis(np.broadcast_to(grid, (len(x), len(grid))))
    rows = np.broadcast_to(each[:, None], at.shape)
    return np.clip(sum(b[..., i] * best[at + i, rows] for i in range(4)), -1, 1), lams[kept]


def banded_cholesky(a: np.ndarray) -> np.ndarray:
    """Lower factor of a symmetric matrix of bandwidth four, both as bands (offset, column); further axes are more matrices."""
    low, n = a.copy(), a.shape[1]
    for k in range(n):
        low[:, k] /= np.sqrt(low[0, k])
        for j in range(1, min(4, n - k)):
            low[: 4 - j, k + j] -= low[j, k] * low[j:, k]
    return low


def banded_solve(low: np.ndarray, right: np.ndarray) -> np.ndarray:
    x, n = right.astype(float).copy(), low.shape[1]
    for k in range(n):
        x[k] /= low[0, k]
        m = min(3, n - k - 1)
        x[k + 1 : k + 1 + m] -= low[1 : 1 + m, k] * x[k]
    for k in range(n - 1, -1, -1):
        m = min(3, n - k - 1)
        x[k] = (x[k] - (low[1 : 1 + m, k] * x[k + 1 : k + 1 + m]).sum(0)) / low[0, k]
    return x


def banded_inverse(low: np.ndarray) -> np.ndarray:
    """The bands of the inverse (Takahashi's recursion), four columns longer."""
    n = low.shape[1]
    inv = np.zeros((4, n + 4, *low.shape[2:]))
    for k in range(n - 1, -1, -1):
        m = min(3, n - k - 1)
        l = low[1 : 1 + m, k] / low[0, k]  # noqa: E741
        for j in range(m, 0, -1):
            inv[j, k] = -sum(l[i - 1] * (inv[abs(j - i), k + min(i, j)]) for i in range(1, m + 1))
        inv[0, k] = 1 / low[0, k] ** 2 - sum(l[i - 1] * inv[i, k] for i in range(1, m + 1))
    return inv


def banded_leverage(low: np.ndarray, first: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b' A^-1 b for rows b of four neighbouring entries."""
    inv = banded_inverse(low)
    return sum((2 if j else 1) * b[:, i] * b[:, i + j] * inv[j, first + i] for i in range(4) for j in range(4 - i))


FITTERS: dict[str, Callable] = {"kernelreg": kernelreg, "bkrr": bkrr, "lowess": lowess, "exact_gp": exact_gp, "gp": gp, "spline": spline}


def runner(method: str, hours: int, kw: dict) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A function for applyInPandas: fits one group, however many bins it has, on every day of its span."""
    fit = FITTERS[method]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        days = pd.date_range(pdf["d0"].iloc[0], pdf["d1"].iloc[0])
        grid = np.arange(len(days)) * 24.0 / hours
        base = {"target": key[0], "filter_type": key[1], "filter_value": key[2]}
        try:
            if method == "gp" and len(days) < 2:
                raise ValueError("the group spans less than a day")
            w = pdf["w"].to_numpy(float)
            extra = kw | {"seed": zlib.crc32("\0".join(map(str, key)).encode()), "n_neg": pdf["n_neg"].to_numpy(float), "n_pos": pdf["n_pos"].to_numpy(float)}
            m, lo, hi, params = fit(pdf["x"].to_numpy(float), pdf["sy"].to_numpy(float) / w, w, grid, extra)
            return pd.DataFrame(base | {"day": days.date, "trend_mean": m, "trend_lower": lo, "trend_upper": hi, "params": json.dumps(params), "error": None})
        except Exception as e:  # one group's failure is a row, not the job's end
            return pd.DataFrame([base | {"day": None, "trend_mean": None, "trend_lower": None, "trend_upper": None, "params": None, "error": str(e)[:200]}])

    return run


#: Rows that a task gathers before it fits the groups that have ended. Fixed value.
GATHERED = 100_000
KEYS = ("target", "filter_type", "filter_value")
NUMBERS = ("x", "w", "sy", "n_neg", "n_pos")


def batch_runner(method: str, hours: int, kw: dict) -> Callable:
    """A function for mapInArrow over bins sorted by group and x: fits each group on every day of its span.

    A group of few bins is fitted together with others of as many (:mod:`opinara.plans.batch_fits`), a larger one by itself. What fails together is fitted one by one, and a fit that fails alone is a row with its error.
    """
    import pyarrow as pa

    from opinara.plans import batch_fits

    one = runner(method, hours, kw)
    schema = pa.schema([*[(k, pa.string()) for k in KEYS], ("day", pa.date32()), *[(c, pa.float64()) for c in ("trend_mean", "trend_lower", "trend_upper")], ("params", pa.string()), ("error", pa.string())])

    def rows(keys: pa.Table, of: np.ndarray, first: np.ndarray, days: np.ndarray, values: tuple, params: dict) -> pa.RecordBatch:
        """Rows of the groups numbered ``of``, with values (groups, days) of which each group keeps its own days."""
        own = np.arange(values[0].shape[1])[None, :] < days[:, None]
        each = np.repeat(np.arange(len(of)), days)
        day = (first[:, None] + np.arange(own.shape[1])[None, :])[own].astype("datetime64[D]")
        text = pa.array([json.dumps({k: v[i].item() for k, v in params.items()}) for i in range(len(of))], pa.string())
        named = [keys.column(k).combine_chunks().take(pa.array(of[each])) for k in KEYS]
        return pa.RecordBatch.from_arrays([*named, pa.array(day, pa.date32()), *[pa.array(v[own], pa.float64(), from_pandas=True) for v in values], text.take(pa.array(each)), pa.nulls(len(each), pa.string())], schema=schema)

    def fitted(table: pa.Table):
        """Fits of whole groups."""
        names = [table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in KEYS]
        new = np.logical_or.reduce([np.concatenate([[True], n[1:] != n[:-1]]) for n in names])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        keys = table.select(list(KEYS)).take(pa.array(starts))
        names = keys.to_pylist()
        day0, day1 = (table.column(c).to_numpy().astype("datetime64[D]").astype(int)[starts] for c in ("d0", "d1"))
        days = day1 - day0 + 1
        numbers = {c: table.column(c).to_numpy().astype(float) for c in NUMBERS}
        seeds = [zlib.crc32("\0".join(str(names[i][k]) for k in KEYS).encode()) for i in range(len(starts))]

        def alone(i: int) -> pa.RecordBatch:
            at = slice(starts[i], starts[i] + sizes[i])
            pdf = pd.DataFrame({c: v[at] for c, v in numbers.items()} | {"d0": table.column("d0")[int(starts[i])].as_py(), "d1": table.column("d1")[int(starts[i])].as_py()})
            return pa.RecordBatch.from_pandas(one(tuple(names[i][k] for k in KEYS), pdf), schema=schema, preserve_index=False)

        def together(of: np.ndarray):
            cells = starts[of][:, None] + np.arange(sizes[of[0]])[None, :]
            x, w, sy, n_neg, n_pos = (numbers[c][cells] for c in NUMBERS)
            extra = kw | {"seeds": [seeds[i] for i in of], "n_neg": n_neg, "n_pos": n_pos, "n_days": days[of]}
            *values, params = batch_fits.FITTERS[method](x, sy / w, w, np.arange(days[of].max()) * 24.0 / hours, extra)
            return rows(keys, of, day0[of], days[of], tuple(values), params)

        small = (sizes <= batch_fits.SMALL) & ((method != "gp") | (days > 1))
        for i in np.flatnonzero(~small):
            yield alone(i)
        order = np.lexsort((days, sizes))
        order = order[small[order]]
        while len(order):
            same = order[sizes[order] == sizes[order[0]]]
            # groups of a portion are of like spans, the longest one counts
            n = len(same)
            while n > 1 and n > batch_fits.at_once(method, int(sizes[same[0]]), int(days[same[n - 1]]), kw):
                n = max(1, n // 2)
            try:
                yield together(same[:n])
            except Exception:
                for i in same[:n]:
                    yield alone(i)
            order = order[n:]

    def run(batches):
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < GATHERED:
                continue
            table = pa.Table.from_batches(held)
            last = np.logical_and.reduce([table.column(k).to_numpy() == table.column(k)[-1].as_py() for k in KEYS])
            whole = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if whole:
                yield from fitted(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                count = table.num_rows - whole
        if count:
            yield from fitted(pa.Table.from_batches(held))

    return run


def static_normal(neg: pd.Series, zero: pd.Series, pos: pd.Series) -> pd.DataFrame:
    """Per row: the normal over [-1, 1] that best explains the class counts, on a grid of locations and scales."""
    locs, sds = np.meshgrid(np.linspace(-1, 1, 41), np.linspace(0.05, 1.5, 30), indexing="ij")
    phi = lambda z: 0.5 * (1 + _erf(z / math.sqrt(2)))
    a, b = phi((-0.5 - locs) / sds), phi((0.5 - locs) / sds)
    logs = np.log(np.clip(np.stack([a, b - a, 1 - b], -1) @ np.array(CONFUSION), 1e-9, 1))
    prior = -(locs**2) / 2 - (sds - 1) ** 2 / 0.5
    out = []
    for n in zip(neg, zero, pos, strict=True):
        i = int(np.argmax(logs @ np.array(n, float) + prior))
        out.append((float(locs.ravel()[i]), float(sds.ravel()[i] ** 2)))
    return pd.DataFrame(out, columns=["stance_loc", "stance_var"])
