"""Most frequent n-grams of texts: words by Spark, counts by numpy for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of texts whose words are numbered together.
PORTION = 1 << 20


def most_frequent(texts: list[list[str]], sizes: list[int]) -> np.ndarray:
    """For each list of words and each size, in ascending order, how often the most frequent n-gram occurs. Exact: n-grams are numbered, not hashed."""
    out = np.zeros((len(texts), len(sizes)), np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if not len(doc):
        return out
    word, names = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    gram, at = pd.factorize(doc * len(names) + word)[0], np.arange(len(doc))
    for n in range(1, sizes[-1] + 1):
        if n > 1:
            # a gram is longer by the word behind it, if that is of the same text
            more = (at + n - 1 < len(doc)) & (doc[np.minimum(at + n - 1, len(doc) - 1)] == doc[at])
            at, gram = at[more], gram[more]
            gram = pd.factorize(gram * len(names) + word[at + n - 1])[0]
        if n in sizes and len(at):
            np.maximum.at(out[:, sizes.index(n)], doc[at], np.bincount(gram)[gram])
    return out


def ngram_repetitions(text: Column, sizes: list[int]) -> Column:
    """An array: for each of ``sizes``, ascending, how often a text's most frequent n-gram of lower-case word characters occurs; 0 for a null text."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            parts = (np.cumsum(b.str.len().to_numpy()) // PORTION).astype(int) if len(b) else np.zeros(0, int)
            found = [most_frequent([t.split() for t in rows], sizes) for _, rows in b.groupby(parts)]
            yield pd.Series([x for f in found for x in f], index=b.index, dtype=object)

    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return run(words)
