"""Links between texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of :mod:`simhash`; a text of fewer words is one shingle, a text of none has no links. Texts of equal
sets collapse first. Candidates share one of 50 bands of 5 MinHash values each: at a similarity of 0.8 a pair is missed
with a probability of (1 - 0.8^5)^50 = 2.4e-9, above it with a lesser one. Each candidate is then compared by
its whole sets, so no pair below the threshold is linked.

Before sets are fetched, a pair's sketches are compared: a bit of each of 1024 MinHash values. Bits differ with a
probability of (1 - similarity) / 2; a pair goes if so many differ as a pair at the threshold has with a probability of 1e-9.
So texts that share a common passage and little else make no pairs, though they share bands.

A bucket (the sets that share a band) is not compared all with all: its least set is compared with the others, and
sets that are linked by then need no comparison. Only a bucket that still holds several components goes on, with those sets
whose sketch is like one of another component: the 128 least sets outside of its largest component are compared with the
sets of other components, and so on until one component is left. So a group of m near copies costs about m comparisons, and a
stranger in its buckets m more, not one round for every 128 of the group. Joins on buckets and on the sets compared are salted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import KEY, with_key, written

SHINGLE, BANDS, ROWS = 5, 50, 5
#: Bits of a sketch, and how likely it is that a pair at the threshold is missed by them.
BITS, MISS = 1024, 1e-9
SALTS = 32
#: Sets of a bucket that are compared with all others in the first round, and in each later one.
FIRST, LATER = 1, 128
#: Sets of a bucket whose sketches a task holds against as many others.
TILE = 2048
#: Below so many texts to compare, the list of them is broadcast.
FEW = 200_000
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BITS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: list[str]) -> np.ndarray:
    """The distinct hashes of the shingles of a text's words, sorted."""
    if not w:
        return np.empty(0, np.uint64)
    grams = (" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 64):
        least = np.minimum(least, (hashes[at : at + 64, None] * FACTORS).min(0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values, as signed numbers."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def bits(least: np.ndarray) -> np.ndarray:
    """A mixed bit of each MinHash value, 64 to a signed number."""
    mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def most_differing(percent: int) -> int:
    """More bits differ between sketches of sets as similar as ``percent`` with a probability of ``MISS`` at most."""
    p, k, tail = (100 - percent) / 200, BITS, 0.0
    while k > 0:
        tail += math.exp(math.lgamma(BITS + 1) - math.lgamma(k + 1) - math.lgamma(BITS - k + 1) + k * math.log(p) + (BITS - k) * math.log1p(-p)) if p else 0.0
        if tail > MISS:
            return k
        k -= 1
    return 0


def set_sketch(w: list[str]) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Of a text's words: ``node``, a digest of the set of shingles, its size ``n``, its ``bands`` and ``bits``. The set itself is not kept."""
    s = shingles(w)
    node = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))
    if not len(s):
        return node, 0, np.empty(0, np.int64), np.empty(0, np.int64)
    least = least_values(s)
    return node, len(s), bands(least), bits(least)


def grams(text: str) -> Column:
    from opinara.llm.simhash import words

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(words(t)).view(np.int64) for t in texts], dtype=object)

    return run(text)


def similar_links(docs: DataFrame, sketches: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): fingerprints of texts that are linked, directly or through others.

    docs: doc_id, text. sketches: for each row the row key, ``fp``, ``node``, ``n``, ``bands`` and ``bits``.
    """
    from opinara.llm.simhash import components

    rows = sketches.where("n > 0").select("fp", "node", "n", "bands", "bits", *KEY)
    sets = written(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min(F.struct("bands", "bits")).alias("b"), F.min(F.struct(*KEY)).alias("k")), "sets")
    least = sets.select("node", F.col("fp").alias("b"))
    same = rows.select("node", F.col("fp").alias("a")).distinct()
    links = [same.join(least, "node").where("a <> b").select("a", "b")]

    each = sets.select("node", "n", "b.bits", F.explode("b.bands").alias("band"))
    many = each.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band")
    left = written(each.join(many, "band").withColumn("root", F.col("node")).withColumn("minor", F.lit(True)), "buckets")
    whole = _whole_sets(docs, sets, left)
    tested = found = None
    k = FIRST
    while not left.isEmpty():
        pivots = written(_pivots(left, k), "pivots")
        pairs = _pairs(left, pivots, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        new = written(_compared(pairs, whole, percent), "similar")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = new if found is None else found.unionByName(new)
        roots = written(components(found), "set-roots")
        left = written(_rest(left, roots, pivots), "buckets")
        if k == FIRST:
            left = written(_like_others(left, percent), "buckets")
        k = LATER
    if found is not None:
        a, b = (sets.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}")) for c in "ab")
        links.append(found.join(a, "a").join(b, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).where("a <> b"))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _pivots(left: DataFrame, k: int) -> DataFrame:
    """For each bucket of ``left`` its k least sets outside of its largest component, and the salts that its rows use."""
    item = F.struct("node", "n", "root", "bits")
    if k == 1:
        return _salted(left).groupBy("band").agg(F.array(F.min(item)).alias("ps"), F.collect_set("_s").alias("_ss"))
    least = left.where("minor").withColumn("_k", F.row_number().over(Window.partitionBy("band").orderBy("node"))).where(F.col("_k") <= k)
    ps = least.groupBy("band").agg(F.collect_list(item).alias("ps"))  # at most k
    return ps.join(_salted(left).groupBy("band").agg(F.collect_set("_s").alias("_ss")), "band")


def _salted(rows: DataFrame, by: str = "node") -> DataFrame:
    return rows.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _pairs(left: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: the pivots of each bucket with all others of another component, where their sizes and sketches allow the similarity."""
    most = most_differing(percent)

    def fit(p: Column) -> Column:
        differ = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get(p["bits"], F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
        return (p["root"] != F.col("root")) & (F.least(F.col("n"), p["n"]) * 100 >= F.greatest(F.col("n"), p["n"]) * percent) & (differ <= most)

    ps = pivots.select("band", "ps", F.explode("_ss").alias("_s"))
    p = _salted(left).join(ps, ["band", "_s"]).select("node", F.explode(F.filter("ps", fit)).alias("p"))
    return p.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _rest(left: DataFrame, roots: DataFrame, pivots: DataFrame) -> DataFrame:
    """What is still to be compared: without the pivots, compared with all others, and without buckets of one component.

    ``minor``: whether a set is outside of its bucket's largest component.
    """
    ps = pivots.select("band", F.explode(F.col("ps.node")).alias("node"))
    r = left.drop("root", "minor").join(ps, ["band", "node"], "left_anti").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    r = written(r, "rest")
    parts = _salted(r).groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"), F.collect_set("_s").alias("_ss"))
    top = F.max_by("root", F.struct("m", "root")).alias("top")
    open_ = parts.select("band", "root", "m", F.explode("_ss").alias("_s")).groupBy("band").agg(top, F.min("root").alias("r0"), F.max("root").alias("r1"), F.collect_set("_s").alias("_ss")).where("r0 <> r1")
    of = _salted(r).join(open_.select("band", "top", F.explode("_ss").alias("_s")), ["band", "_s"])
    return of.withColumn("minor", F.col("root") != F.col("top")).drop("_s", "top")


def _like_others(left: DataFrame, percent: int) -> DataFrame:
    """The rows of ``left`` whose sizes and sketches allow that similarity with one of another component in their bucket. Buckets are compared in tiles of ``TILE`` by ``TILE`` rows."""
    most = most_differing(percent)
    parts = left.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("_n"))
    rows = left.join(parts, "band").withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    cols = ["band", "node", "n", "root", "bits"]
    own = rows.select(*cols, "_i", every.alias("_j"), F.lit(True).alias("owns"))
    others = rows.select(*cols, every.alias("_i"), F.col("_i").alias("_j"), F.lit(False).alias("owns"))

    def like(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["owns"]], pdf[~pdf["owns"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"band": [], "node": []})
        x, y = (np.stack(s["bits"].to_numpy()) for s in (a, b))
        found = np.zeros(len(a), bool)
        for at in range(0, len(a), 32):
            of = slice(at, at + 32)
            n, m = a["n"].to_numpy()[of, None], b["n"].to_numpy()[None, :]
            fit = (a["root"].to_numpy()[of, None] != b["root"].to_numpy()[None, :]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
            if fit.any():
                found[of] = (fit & (np.bitwise_count(x[of, None, :] ^ y[None, :, :]).sum(2, dtype=np.int32) <= most)).any(1)
        return a.loc[found, ["band", "node"]]

    alive = own.unionByName(others).groupBy("band", "_i", "_j").applyInPandas(like, "band long, node long").distinct()
    return left.join(alive, ["band", "node"], "left_semi")


def _whole_sets(docs: DataFrame, sets: DataFrame, left: DataFrame) -> DataFrame:
    """(node, grams): the whole sets of those that share a bucket with another."""
    keys = written(sets.join(left.select("node").distinct(), "node", "left_semi").select("node", "k.*"), "set-keys")
    if keys.count() <= FEW:
        keys = F.broadcast(keys)
    texts = with_key(docs).join(keys, list(KEY)).select("node", grams("text").alias("grams"))
    return written(texts.dropDuplicates(["node"]), "whole-sets")


def _compared(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are as similar as that. The many pairs of one set are spread over salts."""
    p = _salted(pairs, "b")
    a = whole.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    a = p.select("a", "_s").distinct().join(a, "a")
    b = whole.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return p.join(a, ["a", "_s"]).join(b, "b").where(both * 100 >= (F.size("ga") + F.size("gb") - both) * percent).select("a", "b")
