"""Evaluation of experiments: rankings, sensitivity, sampled comparisons; and small sequential helpers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.plans.fitters import CONFUSION


def bradley_terry(pairs: DataFrame, winner: str, loser: str, alpha: float = 1e-4, rounds: int = 200) -> dict[str, float]:
    """Log-strengths, centred, from pairwise wins. Wins are counted in Spark; the table of methods is small."""
    counts = {(r[0], r[1]): r[2] for r in pairs.groupBy(winner, loser).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted({x for pair in counts for x in pair})
    at = {x: i for i, x in enumerate(names)}
    w = np.full((len(names), len(names)), alpha)
    for (a, b), n in counts.items():
        w[at[a], at[b]] += n
    p = np.ones(len(names))
    for _ in range(rounds):
        both = (w + w.T) / (p[:, None] + p[None, :])
        np.fill_diagonal(both, 0)
        p = (w.sum(1) - np.diag(w)) / both.sum(1)
        p /= np.exp(np.log(p).mean())
    return dict(zip(names, np.log(p).tolist(), strict=True))


def threshold_sensitivity(df: DataFrame, group: str, threshold: str, metric: str) -> DataFrame:
    """Relative change of a metric from threshold 0, for each group and threshold."""
    base = df.where(F.col(threshold) == 0).groupBy(group).agg(F.max(metric).alias("_b"))
    return df.join(base, group).select(group, threshold, metric, (F.col(metric) / F.col("_b") - 1).alias("change"))


def high_variance_targets(long: DataFrame, quantile: float, target: str = "target", y: str = "y") -> DataFrame:
    """Rows of targets whose stance variance is at least the quantile of all targets' variances.

    Variances are rounded to twelve digits: targets of equal counts are then equal, in whatever order their rows were summed, and none of those at the quantile is left out.
    """
    v = long.groupBy(target).agg(F.round(F.var_samp(y), 12).alias("_v")).where("_v IS NOT NULL")
    cut = v.agg(F.percentile("_v", quantile).alias("_c"))
    return long.join(v.join(F.broadcast(cut)).where("_v >= _c").select(target), target, "left_semi")


def triads(docs: DataFrame, cluster: str, key: str, n: int, seed: int = 3) -> DataFrame:
    """(base, same, other): for ``n`` seeded documents, the next one of their cluster and one of another cluster."""
    h = F.xxhash64(F.lit(seed), key)
    each = docs.select(key, cluster, h.alias("_h"), F.floor(h / F.lit(2**50)).alias("_slot"))
    w = Window.partitionBy(cluster, "_slot").orderBy("_h", key)
    same = each.withColumn("same", F.lead(key).over(w)).where("same IS NOT NULL").orderBy("_h", key).limit(n)
    other = each.orderBy(F.desc("_h"), key).limit(4 * n).select(F.col(key).alias("other"), F.col(cluster).alias("_oc"), F.col("_h").alias("_oh"))
    return same.join(F.broadcast(other), F.col(cluster) != F.col("_oc")).groupBy(F.col(key).alias("base"), "same").agg(F.min_by("other", F.xxhash64("_h", "_oh")).alias("other"))


def sweep_summary(runs: DataFrame, config: list[str], metric: str, top: int = 5) -> DataFrame:
    return runs.groupBy(*config).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(F.lit(1)).alias("n")).orderBy("mean", *config).limit(top)


def annotator_replay(df: DataFrame, *labels: str) -> DataFrame:
    """The first label that is there: second annotation, first, initial."""
    return df.withColumn("label", F.coalesce(*labels))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k n_c) for each class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    t = c.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return c.join(F.broadcast(t)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))


def normalised_confusion(counts: dict[tuple[str, str], int], labels: tuple[str, ...]) -> tuple[tuple[float, ...], ...]:
    """P(predicted | true), rows summing to one; an unseen true label gets a uniform row."""
    rows = []
    for t in labels:
        n = [counts.get((t, p), 0) for p in labels]
        rows.append(tuple(x / sum(n) if sum(n) else 1 / len(labels) for x in n))
    return tuple(rows)


def random_walk(n_series: int, days: int, noise: float, walk: float, seed: int = 0) -> list[tuple[int, int, float, int]]:
    """(series, day, latent, observed class) of a reflected random walk seen through the error model."""
    rng, out = np.random.default_rng(seed), []
    for s in range(n_series):
        x = 0.0
        for d in range(days):
            x = float(np.clip(x + rng.normal(0, walk), -1, 1))
            z = x + rng.normal(0, noise)
            true = 0 if z < -0.5 else 2 if z > 0.5 else 1
            out.append((s, d, x, int(rng.choice(3, p=CONFUSION[true])) - 1))
    return out


def similarity_chain(sim: np.ndarray, start: int) -> list[int]:
    """Order few items so that neighbours are alike: grow a chain at both ends, greedily."""
    left, chain = set(range(len(sim))) - {start}, [start]
    while left:
        a = max(sorted(left), key=lambda i: sim[chain[0], i])
        b = max(sorted(left), key=lambda i: sim[chain[-1], i])
        if sim[chain[0], a] > sim[chain[-1], b]:
            chain.insert(0, a)
            left.remove(a)
        else:
            chain.append(b)
            left.remove(b)
    return chain


def fill_linear(y: np.ndarray) -> np.ndarray:
    """Linear interpolation over NaN gaps; the ends are held."""
    ok = ~np.isnan(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok]) if ok.any() else y


def stream_width(y: np.ndarray, points: int = 200, sigma: float = 2.0) -> np.ndarray:
    """Resample a volume series by monotone cubic steps, smooth it, clamp at 0, scale to a maximum of one."""
    x, at = np.arange(len(y)), np.linspace(0, len(y) - 1, points)
    slope = np.gradient(y) if len(y) > 1 else np.zeros(1)
    i = np.minimum(at.astype(int), max(len(y) - 2, 0))
    t = at - x[i]
    j = np.minimum(i + 1, len(y) - 1)
    z = (2 * t**3 - 3 * t**2 + 1) * y[i] + (t**3 - 2 * t**2 + t) * slope[i] + (3 * t**2 - 2 * t**3) * y[j] + (t**3 - t**2) * slope[j]
    r = math.ceil(4 * sigma)
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    z = np.maximum(np.convolve(np.pad(z, r, mode="edge"), k / k.sum(), mode="valid"), 0)
    return z / z.max() if z.max() > 0 else z


def latex_table(rows: list[tuple[str, dict[str, float]]], higher: dict[str, bool]) -> str:
    """Methods by metrics; the best bold, the second underlined."""
    lines = ["method & " + " & ".join(higher) + r" \\"]
    rank = {m: sorted((r[1][m] for r in rows), reverse=up) for m, up in higher.items()}
    for name, values in rows:
        cells = [rf"\textbf{{{values[m]:.3f}}}" if values[m] == rank[m][0] else rf"\underline{{{values[m]:.3f}}}" if len(rank[m]) > 1 and values[m] == rank[m][1] else f"{values[m]:.3f}" for m in higher]
        lines.append(f"{name} & " + " & ".join(cells) + r" \\")
    return "\n".join(lines)


def name_pairs(df: DataFrame, name: str) -> DataFrame:
    """(a, b): all pairs of the distinct values of a column of few values, each once, a before b."""
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    every = names.agg(F.array_sort(F.collect_set(name)).alias("_l"))
    return every.select(F.posexplode("_l").alias("_i", "a"), "_l").select("a", F.explode(F.slice("_l", F.col("_i") + 2, F.size("_l"))).alias("b"))


def mean_squared_error(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg((F.col(a) - F.col(b)) ** 2).alias("mse"))
