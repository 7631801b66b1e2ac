"""Projection to a plane that keeps neighbours: linked points attract each other, sampled others repel.

A k-NN graph gets weights by each point's own scale and is made symmetric. Starting from principal components, rounds deal the points at random to portions of
``PORTION`` points. A portion moves its own points for some epochs: towards their neighbours, which stand where they were at the start of the round if they are of another
portion, and away from others of the portion, drawn anew each epoch. So no task holds more than a portion and its edges, and the table is read a fixed number of times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.neighbours import knn_graph
from opinara.storage import shared, tasks

#: Points that a task moves together.
PORTION = 10_000
#: The curve 1 / (1 + A * d ** (2 * B)), fitted to a least distance of 0.1. Fixed values.
A, B = 1.577, 0.895
STEP_LIMIT = 4.0


def edge_weights(graph: DataFrame) -> DataFrame:
    """(a, b, w) in both directions: 1 for a point's nearest neighbour, falling by its own scale, joined as probabilities where both ends list each other."""

    def weigh(batches):
        for pdf in batches:
            rows = [(a, nb) for a, nb in zip(pdf["a"], pdf["nb"], strict=True) if len(nb)]
            if not rows:
                continue
            n = np.array([len(nb) for _, nb in rows])
            d = np.full((len(rows), n.max()), np.inf)
            for i, (_, nb) in enumerate(rows):
                d[i, : n[i]] = [s["d"] for s in nb]
            over = np.maximum(d - d[:, :1], 0)
            lo, hi, want = np.zeros(len(rows)), np.full(len(rows), 1e3), np.log2(np.maximum(n, 2))
            for _ in range(40):
                mid = (lo + hi) / 2
                more = np.exp(-over / np.maximum(mid, 1e-9)[:, None]).sum(1) > want
                lo, hi = np.where(more, lo, mid), np.where(more, mid, hi)
            w = np.exp(-over / np.maximum(hi, 1e-9)[:, None])
            yield pd.DataFrame([(a, s["b"], float(w[i, j])) for i, (a, nb) in enumerate(rows) for j, s in enumerate(nb)], columns=["a", "b", "w"])

    one = graph.mapInPandas(weigh, "a long, b long, w double")
    # of an edge that both ends list: w + v - w * v
    both = one.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("w").alias("s"), F.when(F.count(F.lit(1)) > 1, F.max("w") * F.min("w")).otherwise(0.0).alias("p"))
    w = shared(both.select("x", "y", (F.col("s") - F.col("p")).alias("w")))
    return w.select(F.col("x").alias("a"), F.col("y").alias("b"), "w").unionByName(w.select(F.col("y").alias("a"), F.col("x").alias("b"), "w"))


def principal_start(points: DataFrame) -> DataFrame:
    """(id, x, y): the first two principal components, scaled to a deviation of 5."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    f = points.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("f"))
    p = PCA(k=2, inputCol="f", outputCol="p").fit(f).transform(f).select("id", vector_to_array("p").alias("p"))
    p = shared(p.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")))
    s = p.agg(*[F.coalesce(f(c), F.lit(0.0)).alias(f"{n}{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return p.select("id", *[((F.col(c) - s[f"m{c}"]) * (5.0 / (s[f"s{c}"] or 1.0))).alias(c) for c in "xy"])


def _move(pdf: pd.DataFrame, epochs: int, negatives: int, rate: tuple[float, float], seed: int) -> pd.DataFrame:
    """A portion's points after ``epochs``: ``rate`` is the step size at the start and at the end."""
    rng = np.random.default_rng([seed, int(pdf["portion"].iloc[0])])
    ids, at = pdf["id"].to_numpy(), pdf[["x", "y"]].to_numpy(float)
    n, place = len(ids), {i: k for k, i in enumerate(pdf["id"])}
    edges = [(k, place.get(s["b"], -1), s["w"], s["x"], s["y"]) for k, near in enumerate(pdf["near"]) if near is not None for s in near]
    own, other = (np.array([e[c] for e in edges], dtype=np.int64) for c in (0, 1))
    w, far = np.array([e[2] for e in edges]), np.array([e[3:] for e in edges]).reshape(-1, 2)
    for e in range(epochs):
        alpha = rate[0] + (rate[1] - rate[0]) * e / epochs
        used = np.flatnonzero(rng.random(len(w)) < w)
        i = own[used]
        to = np.where((other[used] >= 0)[:, None], at[other[used]], far[used])
        delta = at[i] - to
        d2 = (delta**2).sum(1)
        pull = np.where(d2 > 0, -2 * A * B * np.power(np.maximum(d2, 1e-12), B - 1) / (1 + A * np.power(d2, B)), 0)
        step = np.clip(pull[:, None] * delta, -STEP_LIMIT, STEP_LIMIT)
        i2 = np.repeat(i, negatives)
        delta = at[i2] - at[rng.integers(0, n, len(i2))]
        d2 = (delta**2).sum(1)
        push = 2 * B / ((0.001 + d2) * (1 + A * np.power(d2, B)))
        away = np.where((d2 > 0)[:, None], np.clip(push[:, None] * delta, -STEP_LIMIT, STEP_LIMIT), 0)
        total = np.stack([np.bincount(i, step[:, c], n) + np.bincount(i2, away[:, c], n) for c in (0, 1)], axis=1)
        at = at + alpha * np.clip(total, -STEP_LIMIT, STEP_LIMIT)
    return pd.DataFrame({"id": ids, "x": at[:, 0], "y": at[:, 1]})


def project(points: DataFrame, k: int = 15, rounds: int = 5, epochs: int = 40, negatives: int = 5, seed: int = 1, graph: DataFrame | None = None) -> DataFrame:
    """(id, x, y) for points (id, v)."""
    points = shared(points.select(F.col("id").cast("long").alias("id"), "v"))
    edges = shared(edge_weights(graph if graph is not None else knn_graph(points, k)))
    n = points.count()
    if n < 3:
        return points.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    at, portions = shared(principal_start(points)), -(-n // PORTION)
    for r in range(rounds):
        rate = (1 - r / rounds, 1 - (r + 1) / rounds)
        there = edges.join(at.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.collect_list(F.struct("b", "w", "x", "y")).alias("near"))
        dealt = at.join(there, "id", "left").withColumn("portion", F.pmod(F.xxhash64(F.lit(seed + r), "id"), F.lit(portions)).cast("int"))
        at = shared(dealt.repartition(tasks(points), "portion").groupBy("portion").applyInPandas(_mover(epochs, negatives, rate, seed + r), "id long, x double, y double"))
    return at


def _mover(epochs: int, negatives: int, rate: tuple[float, float], seed: int):
    return lambda pdf: _move(pdf.sort_values("id", ignore_index=True), epochs, negatives, rate, seed)


def trustworthiness(v: np.ndarray, at: np.ndarray, k: int = 10) -> float:
    """1 where the projection's ``k`` nearest are near by all dimensions, too; for samples."""
    from opinara.operators.neighbours import exact_neighbours

    d = ((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable") + 1
    n = len(v)
    late = sum(max(0, int(rank[i, j]) - k) for i, near in enumerate(exact_neighbours(at, k)) for j in near)
    return 1 - 2 * late / (n * k * (2 * n - 3 * k - 1))
