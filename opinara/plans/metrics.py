"""Evaluation metrics as DataFrames of one row, or one row for each group."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.arrays import dot, normalise
from opinara.operators.reshape import average_rank


def stance_variance(long: DataFrame, target: str = "target", y: str = "y") -> DataFrame:
    """The mean over targets of the sample variance of their stances; targets of one stance have none."""
    return long.groupBy(target).agg(F.var_samp(y).alias("v")).agg(F.avg("v").alias("stance_variance"))


def matrix_variance(long: DataFrame, row: str, column: str, y: str = "y") -> DataFrame:
    """The mean over a matrix's columns of the population variance of what its rows have there (their means); gaps do not count."""
    cells = long.groupBy(row, column).agg(F.avg(y).alias("_m"))
    return cells.groupBy(column).agg(F.var_pop("_m").alias("_v")).agg(F.avg("_v").alias("stance_variance"))


def cluster_sizes(long: DataFrame, n_docs: int | None, doc: str = "doc", target: str = "target") -> DataFrame:
    """Mean size ratio, entropy, range and their product, over the number of documents of each target."""
    sizes = long.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("t"))
    docs = long.agg(F.countDistinct(doc).alias("d")) if n_docs is None else long.sparkSession.range(1).select(F.lit(n_docs).alias("d"))
    p = F.col("n") / F.col("t")
    return (
        sizes.join(F.broadcast(total)).join(F.broadcast(docs))  # two sides of one row
        .agg(
            F.avg(F.col("n") / F.col("d")).alias("cluster_size_ratio"),
            (-F.sum(p * F.log2(p + 1e-10))).alias("shannon_entropy"),
            ((F.max("n") - F.min("n")) / F.max("n")).alias("size_range"),
        )
        .withColumn("balanced_cluster_size", F.col("size_range") * F.col("shannon_entropy"))
    )


def inclusion(docs: DataFrame, targets: str = "Targets") -> DataFrame:
    """Share of documents with a target, and mean number of targets."""
    n = F.coalesce(F.size(targets), F.lit(0))
    return docs.agg(F.avg((n > 0).cast("int")).alias("hard_inclusion"), F.avg(n).alias("mean_num_targets"))


def multilabel_f1(pred: DataFrame, gold: DataFrame, doc: str = "doc") -> DataFrame:
    """Mean over documents of the F1 of (target, stance) pairs; a document without either side scores 0, without both 1.

    A pair's credit is the share of the other side's pairs of its target that have its stance.
    """
    def credit(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        other = b.groupBy(doc, "target", "stance").agg(F.count(F.lit(1)).alias("same"))
        every = b.groupBy(doc, "target").agg(F.count(F.lit(1)).alias("n"))
        each = a.join(every, [doc, "target"], "left").join(other, [doc, "target", "stance"], "left")
        return each.groupBy(doc).agg(F.avg(F.coalesce(F.col("same") / F.col("n"), F.lit(0.0))).alias(name))

    both = credit(pred, gold, "p").join(credit(gold, pred, "r"), doc, "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("r", F.lit(0.0)).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return both.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1"))


def confusion(df: DataFrame, reference: str = "reference", prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, reference, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, by: str, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro F1 over the labels present, for each value of ``by`` and overall (``all``)."""
    rows = df.select(F.explode(F.array(F.lit("all"), F.col(by))).alias("dataset"), F.col(reference).alias("r"), F.col(prediction).alias("p"))
    cells = rows.groupBy("dataset", "r", "p").agg(F.count(F.lit(1)).alias("n"))
    labels = cells.select("dataset", "n", F.inline(F.array(F.struct(F.col("r").alias("label"), (F.col("r") == F.col("p")).alias("hit"), F.lit(1).alias("ref")), F.struct(F.col("p").alias("label"), F.lit(False).alias("hit"), F.lit(0).alias("ref")))))
    per = labels.groupBy("dataset", "label").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"))
    macro = per.groupBy("dataset").agg(F.avg(2 * F.col("tp") / F.col("both")).alias("macro_f1"))
    acc = cells.groupBy("dataset").agg((F.sum(F.when(F.col("r") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    return acc.join(macro, "dataset")


def label_scores(df: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support) for each label of either side; a quotient without a denominator is 0."""
    cells = confusion(df, reference, prediction)
    r, p = F.col(reference), F.col(prediction)
    sides = cells.select(F.inline(F.array(F.struct(r.alias("label"), F.col("n").alias("ref"), F.lit(0).cast("long").alias("pred"), F.when(r == p, F.col("n")).otherwise(0).alias("hit")), F.struct(p.alias("label"), F.lit(0).cast("long").alias("ref"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit")))))
    s = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("ref", "pred", "hit")])
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select("label", part(F.col("hit"), F.col("pred")).alias("precision"), part(F.col("hit"), F.col("ref")).alias("recall"), part(2 * F.col("hit"), F.col("ref") + F.col("pred")).alias("f1"), F.col("ref").alias("support"))


def fleiss_kappa(ratings: DataFrame, subject: str, category: str) -> DataFrame:
    """Agreement over subjects with the same number (two or more) of ratings each."""
    cells = ratings.groupBy(subject, category).agg(F.count(F.lit(1)).alias("_n"))
    subj = cells.groupBy(subject).agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_a"))
    observed = subj.agg(F.avg(F.col("_a") / (F.col("_m") * (F.col("_m") - 1))).alias("po"))
    cats = cells.groupBy(category).agg(F.sum("_n").alias("_c"))
    expected = cats.agg((F.sum(F.col("_c") * F.col("_c")) / (F.sum("_c") * F.sum("_c"))).alias("pe"))
    return observed.join(F.broadcast(expected)).select(((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def win_rate(pairs: DataFrame, winner: str, first: str, second: str) -> DataFrame:
    each = pairs.select(F.inline(F.array(F.struct(F.col(first).alias("method"), (F.col(winner) == F.col(first)).alias("won")), F.struct(F.col(second).alias("method"), (F.col(winner) == F.col(second)).alias("won")))))
    return each.groupBy("method").agg(F.avg(F.col("won").cast("int")).alias("win_rate"), F.count(F.lit(1)).alias("n"))


def rank_sum(scores: DataFrame, dataset: str, method: str, metrics: dict[str, bool]) -> DataFrame:
    """Sum over metrics (name -> higher is better) of average ranks within a dataset, averaged by method."""
    total = sum((average_rank(m, dataset, high) for m, high in metrics.items()), F.lit(0.0))
    return scores.withColumn("_r", total).groupBy(method).agg(F.avg("_r").alias("mean_rank_sum"))


def latest(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def leaveout_polarization(tokens: DataFrame, doc: str, side: str, token: str) -> DataFrame:
    """Leave-out posterior: how well one token tells a document's side, its own document left out.

    tokens: a row for each distinct (doc, token); ``side`` is boolean. Tokens of one document are left out.
    """
    docs = tokens.select(doc, side).distinct().groupBy().agg(F.count_if(F.col(side)).alias("_na"), F.count_if(~F.col(side)).alias("_nb"))
    df = tokens.groupBy(token).agg(F.count_if(F.col(side)).alias("_a"), F.count_if(~F.col(side)).alias("_b")).where(F.col("_a") + F.col("_b") >= 2)
    each = tokens.join(df, token).join(F.broadcast(docs))
    own = F.when(F.col(side), 1).otherwise(0)
    qa = (F.col("_a") - own) / F.greatest(F.col("_na") - own, F.lit(1))
    qb = (F.col("_b") - (1 - own)) / F.greatest(F.col("_nb") - (1 - own), F.lit(1))
    rho = F.when(qa + qb > 0, qa / (qa + qb)).otherwise(0.5)
    per = each.withColumn("_post", F.when(F.col(side), rho).otherwise(1 - rho)).groupBy(doc, side).agg(F.avg("_post").alias("p"))
    return per.groupBy(side).agg(F.avg("p").alias("p")).agg(F.avg("p").alias("polarization"))


def mean_pair_cosine(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, n, distance): the sum of cosines over a group's pairs, divided by n squared.

    For unit vectors the sum over pairs is (|sum of vectors|^2 - n) / 2: no pair is made, and a large group is summed partly before it is shuffled.
    """
    unit = df.select(by, F.posexplode(normalise(F.col(vector))).alias("_i", "_x"))
    sums = unit.groupBy(by, "_i").agg(F.sum("_x").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select(by, "n", ((F.col("q") - F.col("n")) / 2 / (F.col("n") * F.col("n"))).alias("distance"))


def multilabel_similarity_f1(pred: DataFrame, gold: DataFrame, doc: str, vector: str) -> DataFrame:
    """Mean over documents of precision, recall and F1 of best cosines between a document's predicted and gold targets; 0 where one side has none."""
    p, g = pred.select(doc, F.monotonically_increasing_id().alias("pi"), normalise(F.col(vector)).alias("p")), gold.select(doc, F.monotonically_increasing_id().alias("gi"), normalise(F.col(vector)).alias("g"))
    s = p.join(g, doc).select(doc, "pi", "gi", dot(F.col("p"), F.col("g")).alias("s"))
    best = lambda i, name: s.groupBy(doc, i).agg(F.max("s").alias("m")).groupBy(doc).agg(F.avg("m").alias(name))
    every = pred.select(doc).unionByName(gold.select(doc)).distinct()
    both = every.join(best("pi", "p").join(best("gi", "r"), doc), doc, "left").na.fill(0.0, ["p", "r"])
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return both.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1"))


class References:
    """What a list of references allows: per order the most occurrences of each n-gram in one of them, and their lengths."""

    def __init__(self, references: list[list[str]], order: int = 4):
        self.most: list[dict[tuple, int]] = [{} for _ in range(order)]
        self.lengths = sorted({len(r) for r in references})
        for r in references:
            for n, most in enumerate(self.most[: len(r)], 1):
                if n == len(r):
                    most.setdefault(tuple(r), 1)
                    continue
                for g, c in Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1)).items():
                    most[g] = max(most.get(g, 0), c)
        self._near: dict[int, int] = {}

    def near(self, n: int) -> int:
        """The length nearest to ``n``, of two the lesser."""
        if n not in self._near:
            self._near[n] = min(self.lengths, key=lambda x: (abs(x - n), x))
        return self._near[n]


def bleu(candidate: list[str], references: list[list[str]] | References, order: int = 4) -> float:
    """Sentence BLEU of effective order: n-grams beyond the candidate's length are left out."""
    refs = references if isinstance(references, References) else References(references, order)
    if len(candidate) == 1 <= order:
        return min(1.0, math.exp(1 - refs.near(1))) if tuple(candidate) in refs.most[0] else 0.0
    logs = []
    for n in range(1, min(order, len(candidate)) + 1):
        grams = Counter(tuple(candidate[i : i + n]) for i in range(len(candidate) - n + 1))
        hit = sum(min(c, refs.most[n - 1].get(g, 0)) for g, c in grams.items())
        if not hit:
            return 0.0
        logs.append(math.log(hit / sum(grams.values())))
    if not logs:
        return 0.0
    near = refs.near(len(candidate))
    return math.exp(sum(logs) / len(logs)) * min(1.0, math.exp(1 - near / len(candidate)))


def bleu_targets(docs: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Mean over documents of BLEU precision, recall and F1 of target lists; each target is a sentence of words."""

    @F.pandas_udf("p double, r double, f double")
    def score(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(pred, ref, strict=True):
            a, b = [x.split() for x in a], [x.split() for x in b]
            of_a, of_b = References(a), References(b)  # once for all sentences of the other side
            p = sum(bleu(x, of_b) for x in a) / len(a) if a and b else 0.0
            r = sum(bleu(x, of_a) for x in b) / len(b) if a and b else 0.0
            out.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
        return pd.DataFrame(out, columns=["p", "r", "f"])

    s = docs.select(score(predicted, gold).alias("s"))
    return s.agg(F.avg("s.p").alias("precision"), F.avg("s.r").alias("recall"), F.avg("s.f").alias("f1"))


def confusion_profile(df: DataFrame, labels: list[str], reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """(reference, prediction, n, p_prediction, p_reference) for every two of ``labels``: the shares of a true label's predictions and of a prediction's true labels.

    A label that never occurs on a side has equal shares there. Other labels and nulls do not count.
    """
    n = confusion(df.where(F.col(reference).isin(labels) & F.col(prediction).isin(labels)), reference, prediction)
    every = lambda: F.explode(F.array(*map(F.lit, labels)))
    grid = df.sparkSession.range(1).select(every().alias(reference)).select(reference, every().alias(prediction))
    cells = grid.join(n, [reference, prediction], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))

    def share(by: str):
        total = F.sum("n").over(Window.partitionBy(by))
        return F.when(total > 0, F.col("n") / total).otherwise(1.0 / len(labels))

    return cells.select(reference, prediction, "n", share(reference).alias("p_prediction"), share(prediction).alias("p_reference"))
