"""Topic models of several sizes, of which the most coherent is kept; documents' topics by a threshold that leaves some documents without one."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.storage import shared

#: Added to a probability before its logarithm. Fixed value.
TINY = 1e-12


def word_windows(docs: DataFrame, key: str, tokens: str, words: list[str], window: int) -> DataFrame:
    """(key, w, held): for each window of ``window`` tokens, begun at each token that leaves room for it (a shorter document is one), which of ``words`` are in it.

    ``words`` are topics' top words, a bounded list; windows that hold none of them are not made: a word at p is in the windows begun at p - window + 1 to p.
    """
    at = docs.select(key, F.greatest(F.size(tokens) - window, F.lit(0)).alias("last"), F.posexplode(tokens).alias("p", "word")).where(F.col("word").isin(words))
    begun = F.sequence(F.greatest(F.col("p") - window + 1, F.lit(0)), F.least(F.col("p"), F.col("last")))
    return at.select(key, F.explode(begun).alias("w"), "word").groupBy(key, "w").agg(F.array_sort(F.collect_set("word")).alias("held"))


def window_counts(docs: DataFrame, tokens: str, words: list[str], window: int) -> DataFrame:
    """(held, n): how many windows of :func:`word_windows` hold just these of ``words``.

    Along a text the words held change only where a word's windows begin or end; between two such places all windows are one count. So no window is a row, and a
    batch of texts gives a row for each set that it has.
    """
    at = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("p"), t.alias("word"))), lambda x: x["word"].isin(words))
    rows = docs.select(F.greatest(F.size(tokens) - window, F.lit(0)).alias("last"), F.transform(at, lambda x: x["p"]).alias("p"), F.transform(at, lambda x: x["word"]).alias("word")).where(F.size("p") > 0)

    def counted(batches):
        for pdf in batches:
            found: Counter = Counter()
            for last, places, names in zip(pdf["last"], pdf["p"], pdf["word"], strict=True):
                changes: dict[int, Counter] = {}
                for p, word in zip(places, names, strict=True):
                    changes.setdefault(max(p - window + 1, 0), Counter())[word] += 1
                    changes.setdefault(min(p, last) + 1, Counter())[word] -= 1
                held, before = {}, 0
                for w in sorted(changes):
                    if held and w > before:
                        found[tuple(sorted(held))] += w - before
                    for word, n in changes[w].items():
                        held[word] = held.get(word, 0) + n
                        if not held[word]:
                            del held[word]
                    before = w
            yield pd.DataFrame({"held": [list(h) for h in found], "n": list(found.values())})

    return rows.mapInPandas(counted, "held array<string>, n long").groupBy("held").agg(F.sum("n").alias("n"))


def coherence(docs: DataFrame, key: str, tokens: str, topics: dict[int, list[str]], window: int = 110) -> dict[int, float]:
    """For each topic the mean normalised pointwise mutual information of its top words, from how many windows hold each and each two of them.

    Both counts are of the words that some topic lists, so the driver gets a bounded table.
    """
    words = sorted({w for ws in topics.values() for w in ws})
    total = docs.agg(F.coalesce(F.sum(F.greatest(F.size(tokens) - window, F.lit(0)) + 1), F.lit(0)).alias("n")).first()["n"]
    held = shared(window_counts(docs, tokens, words, window))
    single = {r["a"]: r["n"] for r in held.select(F.explode("held").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    both = held.select(F.explode("held").alias("a"), "held", "n").select("a", F.explode("held").alias("b"), "n").where("a < b")
    pairs = {(r["a"], r["b"]): r["n"] for r in both.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    return {t: mean_npmi(ws, single, pairs, total) for t, ws in topics.items()}


def mean_npmi(words: list[str], single: dict, pairs: dict, total: int) -> float:
    import math

    scores = []
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            p, pa, pb = (n / max(total, 1) + TINY for n in (pairs.get((min(a, b), max(a, b)), 0), single.get(a, 0), single.get(b, 0)))
            scores.append(math.log(p / (pa * pb)) / -math.log(p) if p < 1 else 1.0)
    return sum(scores) / len(scores) if scores else 0.0


@dataclass
class TopicChoice:
    """``k``: the chosen number of topics; ``coherences`` by number; ``topics``: (topic, words, share of the corpus); ``documents``: (key, topics with their probabilities); ``threshold``."""

    k: int
    coherences: dict[int, float]
    topics: DataFrame
    documents: DataFrame
    threshold: float


def main_topic(documents: DataFrame, key: str) -> DataFrame:
    """(key, topic): a document's most probable topic among those that it has, the first of equal ones; null without any."""
    best = F.element_at(F.array_sort(F.transform("topics", lambda t: F.struct((-t["p"]).alias("p"), t["topic"].alias("topic")))), 1)
    return documents.select(key, F.when(F.size("topics") > 0, best["topic"]).alias("topic"))


def choose_topics(
    docs: DataFrame, key: str, tokens: str, sizes: list[int], top: int = 10, window: int = 110, vocabulary: int = 20_000, threshold: float = 0.15, step: float = 0.05, most: float = 0.8, coverage: float = 0.9, iterations: int = 10, seed: int = 1
) -> TopicChoice:
    """Fit LDA for each number of topics in ``sizes`` and keep the one whose topics are most coherent on average.

    A document has the topics of at least ``threshold``; that grows by ``step``, up to ``most``, while more than ``coverage`` of the documents have a topic. Fits run on Spark's
    own LDA over all documents; the vocabulary is the words of two documents at least, the ``vocabulary`` most frequent.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    words = CountVectorizer(inputCol=tokens, outputCol="_c", vocabSize=vocabulary, minDF=2).fit(docs)
    counts = shared(words.transform(docs.select(key, tokens)))
    fits, scores, listed = {}, {}, {}
    for k in sizes:
        fits[k] = LDA(k=k, featuresCol="_c", topicDistributionCol="_t", seed=seed, maxIter=iterations).fit(counts)
        listed[k] = {r["topic"]: [words.vocabulary[i] for i in r["termIndices"]] for r in fits[k].describeTopics(top).collect()}
        each = coherence(docs, key, tokens, listed[k], window)
        scores[k] = sum(each.values()) / len(each)
    best = max(sizes, key=lambda k: (scores[k], -k))
    mix = shared(fits[best].transform(counts).select(key, vector_to_array("_t").alias("p")))
    strongest = F.array_max("p")
    n = mix.count()
    while threshold + step <= most + 1e-9 and n and mix.where(strongest >= threshold).count() > coverage * n:
        threshold = round(threshold + step, 10)
    kept = mix.select(key, F.filter(F.transform("p", lambda p, i: F.struct(i.alias("topic"), p.alias("p"))), lambda t: t["p"] >= threshold).alias("topics"))
    mass = mix.select(F.posexplode("p").alias("topic", "p")).groupBy("topic").agg((F.sum("p") / max(n, 1)).alias("share"))
    named = docs.sparkSession.createDataFrame([(t, ws) for t, ws in listed[best].items()], "topic int, words array<string>")
    return TopicChoice(best, scores, named.join(F.broadcast(mass), "topic", "left").orderBy(F.desc("share"), "topic"), kept, threshold)
