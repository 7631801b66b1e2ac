"""Texts for topic models: tokens, stop words and frequent pairs, as a transformer that is fitted on a corpus and used on any."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.storage import shared

#: Words that are left out before pairs are counted, at most; and pairs that every task looks up by itself, at most (16 bytes each).
MOST_LEFT_OUT, MOST_HELD = 1000, 1 << 20


def plain_tokens(text: Column, least: int = 2, most: int = 15, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case words of ``least`` to ``most`` letters, without e-mail addresses, quotes and stop words."""
    low = F.lower(text)
    # from a run's start only: tried at each of its characters, a long run without the sign takes the square of its length
    plain = F.when(F.contains(low, F.lit("@")), F.regexp_replace(low, r"(?<!\S)\S*@\S*\s?", "")).otherwise(low)
    clean = F.replace(plain, F.lit("'"), F.lit(""))
    words = F.filter(F.split(clean, r"[^\p{L}\p{M}]+"), lambda w: F.char_length(w).between(least, most))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def _hashed(word: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), word)


def _neighbours(tokens: str) -> Column:
    """Each two neighbouring tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("a"), F.slice(tokens, F.lit(2), n).alias("b"))


def _every_other(hit: np.ndarray) -> np.ndarray:
    """Of hits in a row every other one, from the first on."""
    at = np.arange(len(hit))
    return hit & ((at - np.maximum.accumulate(np.where(hit, -1, at))) % 2 == 1)


def _split(flat: np.ndarray, n: np.ndarray) -> pd.Series:
    ends = np.cumsum(n)
    return pd.Series([flat[e - k : e] for e, k in zip(ends, n)], dtype=object)


def _found(a: np.ndarray, b: np.ndarray):
    """A column function: of lists of hashes, which elements are joined to the next, if (a, b) are the pairs."""
    names = np.unique(np.concatenate([a, b]))
    codes = np.sort(np.searchsorted(names, a) * len(names) + np.searchsorted(names, b))

    @F.pandas_udf("array<boolean>")
    def joins(hashes: pd.Series) -> pd.Series:
        n = hashes.str.len().to_numpy().astype(int)
        flat = np.concatenate([np.zeros(0, np.int64), *hashes])
        hit = np.zeros(len(flat), bool)
        if len(codes) and len(flat):
            i = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            known = names[i] == flat
            both = np.flatnonzero(known[:-1] & known[1:])
            code = i[both] * len(names) + i[both + 1]
            hit[both] = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
            hit[np.cumsum(n)[n > 0] - 1] = False
        return _split(_every_other(hit), n)

    return joins


def _at():
    """A column function: the same from lists' lengths and the places of their hits."""

    @F.pandas_udf("array<boolean>")
    def joins(n: pd.Series, hits: pd.Series) -> pd.Series:
        n = n.to_numpy().astype(int)
        hit = np.zeros(n.sum(), bool)
        for start, places in zip(np.cumsum(n) - n, hits):
            hit[start + np.asarray(places, int)] = True
        return _split(_every_other(hit), n)

    return joins


@dataclass
class PairModel:
    """Frequent pairs of neighbouring tokens: (a, b) with (n_ab - least) * vocabulary / (n_a * n_b) over ``threshold``. Pairs are counted and found by their words' hashes, of a seed at which the fitted words' differ."""

    pairs: DataFrame
    seed: int

    @staticmethod
    def fit(docs: DataFrame, tokens: str, least: int = 5, threshold: float = 10.0) -> PairModel:
        """``least`` is not negative. As n_ab is at most n_a and n_b, a word with n_a * threshold at or over the vocabulary is in no such pair; the most frequent of these are left out of the count."""
        words = shared(docs.select(F.explode(tokens).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n_a")))
        seed = next(s for s in count() if words.groupBy(_hashed(F.col("a"), s)).count().where("count > 1").isEmpty())
        size, named = words.count(), words.withColumn("h", _hashed(F.col("a"), seed))
        often = [r["h"] for r in named.where(F.col("n_a") * threshold >= size).orderBy(F.desc("n_a"), "a").limit(MOST_LEFT_OUT).collect()]
        both = docs.select(F.explode(_neighbours(tokens)).alias("p")).select(_hashed(F.col("p.a"), seed).alias("a"), _hashed(F.col("p.b"), seed).alias("b"))
        rest = both.where(~F.col("a").isin(often) & ~F.col("b").isin(often)) if often else both
        n = rest.groupBy(F.col("a").alias("ha"), F.col("b").alias("hb")).agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= least)
        scored = n.join(named.withColumnRenamed("h", "ha"), "ha").join(named.select(F.col("h").alias("hb"), F.col("a").alias("b"), F.col("n_a").alias("n_b")), "hb")
        return PairModel(shared(scored.where((F.col("n_ab") - least) * size > threshold * F.col("n_a") * F.col("n_b")).select("a", "b")), seed)

    def joins(self, docs: DataFrame, key: str, tokens: str, name: str = "joins") -> DataFrame:
        """``docs`` with a list: whether each token is joined to the next by a fitted pair, from left to right; of pairs that overlap in a row every other one, from the first on. ``key`` is one document's."""
        pairs = self.pairs.select(_hashed(F.col("a"), self.seed).alias("a"), _hashed(F.col("b"), self.seed).alias("b"))
        if pairs.count() <= MOST_HELD:
            held = pairs.toArrow()
            find = _found(held["a"].to_numpy(), held["b"].to_numpy())
            return docs.withColumn(name, find(F.coalesce(F.transform(tokens, lambda x: _hashed(x, self.seed)), F.array().cast("array<bigint>"))))
        each = docs.select(F.col(key).alias("_key"), F.posexplode(_neighbours(tokens)).alias("_pos", "p")).select("_key", "_pos", _hashed(F.col("p.a"), self.seed).alias("a"), _hashed(F.col("p.b"), self.seed).alias("b"))
        hits = each.join(pairs, ["a", "b"], "left_semi").groupBy("_key").agg(F.collect_list("_pos").alias("_hits"))
        none, n = F.array().cast("array<int>"), F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0))
        return docs.join(hits, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(name, _at()(n, F.coalesce("_hits", none))).drop("_key", "_hits")

    def transform(self, docs: DataFrame, key: str, tokens: str) -> DataFrame:
        """(key, pos, token): the fitted pairs joined by an underscore, as :meth:`joins` has them."""
        each = self.joins(docs.select(key, tokens), key, tokens, "_joins").select(key, tokens, "_joins", F.posexplode(tokens).alias("pos", "_a"))
        here = F.get("_joins", F.col("pos"))
        return each.where(~F.coalesce(F.get("_joins", F.col("pos") - 1), F.lit(False))).select(key, "pos", F.when(here, F.concat_ws("_", "_a", F.get(tokens, F.col("pos") + 1))).otherwise(F.col("_a")).alias("token"))
