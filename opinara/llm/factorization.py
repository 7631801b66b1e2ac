"""Factorization machines over hashed terms, for the toxicity and the quality classifier.

A text becomes the set of its hashed terms. The score of a set S is the logistic of

    w0 + sum_{i in S} w_i + sum_{i<j in S} <v_i, v_j>

whose last sum is half of ``|sum v_i|^2 - sum |v_i|^2``: linear time in the terms. Pairwise weights find what
single weights miss, as an insult next to the mention of a group.

Fitting uses at most ``max_rows`` labelled ids of the training fold (those of least crc32 of the id: a bounded,
deterministic sample; of rows that share an id the text of least hash) and every hashed term found in 3 of their texts or more whose
chi-squared statistic with the label is at least ``min_chi2``; terms are counted by Spark. The driver gets the texts' kept terms,
at most ``max_values`` of them (whole texts, in the order of the sample), and minimises the regularised log loss by Adam steps over batches.
Executors get the kept terms' weights, at most 2^bits of them, and score all rows.

A null text is scored as an empty one; repeated rows get equal scores; without labels of both classes the
score is the share of label 1 (a half without any). Only id and text are read, so other columns cannot leak
into a score or clash. No documents give no rows. A text costs its length and the pairs of its terms nothing beyond that.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text, written

PUNCTUATION = ".,;:!?\"'()[]{}"
#: Cached tokens are forgotten beyond this many, so a worker's memory stays bounded.
CACHE = 400_000


@dataclass(frozen=True)
class Terms:
    """How a text becomes terms: those of each token, and those of the text as a whole."""

    of_token: Callable[[str], Iterable[str]]
    of_text: Callable[[str, list[str]], Iterable[str]]
    bits: int = 20

    def reader(self, index: dict[int, int] | None = None) -> Callable[[str | None], set[int]]:
        """A function from text to ids: hashed, or positions in ``index``, which leaves out the others."""
        mask = (1 << self.bits) - 1
        cache: dict[str, tuple[int, ...]] = {}

        def ids(terms: Iterable[str]) -> tuple[int, ...]:
            hashed = [zlib.crc32(t.encode("utf-8", "surrogatepass")) & mask for t in terms]
            return tuple(hashed) if index is None else tuple(index[h] for h in hashed if h in index)

        def read(text: str | None) -> set[int]:
            text = text or ""
            tokens = text.split()
            out: set[int] = set(ids(self.of_text(text, tokens)))
            for t in set(tokens):
                if (got := cache.get(t)) is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    got = cache[t] = ids(self.of_token(t))
                if got:
                    out.update(got)
            return out

        return read


def toxic_token(token: str) -> list[str]:
    """The word without punctuation around it, lower-cased, and its beginnings: insults are inflected."""
    w = token.lower().strip(PUNCTUATION)
    if not w:
        return []
    return [f"w:{w}", *(f"p:{w[:n]}" for n in (4, 5, 7) if len(w) > n)]


def quality_token(token: str) -> list[str]:
    """The word, and the signs that it ends in."""
    end = re.search(r"[^\w\s]*$", token)[0]
    return [f"w:{token.lower().strip(PUNCTUATION)}", f"e:{end[:4]}"]


_UPPER, _DIGIT, _SIGN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>!@^~_=+\\/{}[]"


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def quality_text(text: str, tokens: list[str]) -> list[str]:
    """Structure statistics and metadata (length) in steps, each a term."""
    raw = text.encode("utf-8", "surrogatepass")
    size, n = max(1, len(raw)), max(1, len(tokens))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    ratio = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)
    again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n
    stats = {
        "upper": _level((size - len(raw.translate(None, _UPPER))) / size, ratio),
        "digit": _level((size - len(raw.translate(None, _DIGIT))) / size, ratio),
        "sign": _level((size - len(raw.translate(None, _SIGN))) / size, ratio),
        "lines": _level(1 - len(set(lines)) / max(1, len(lines)), (0.05, 0.1, 0.2, 0.3, 0.5)),
        "again": _level(again, ratio),
        "kinds": _level(len(set(tokens)) / n, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
        "words": _level(len(tokens), (1, 5, 10, 20, 50, 100, 300, 1000, 5000)),
        "letters": _level(size / n, (4, 5, 6, 7, 8, 9, 10, 12, 16)),
    }
    return [f"s:{k}:{v}" for k, v in stats.items()]


TOXICITY = Terms(toxic_token, lambda text, tokens: ())
QUALITY = Terms(quality_token, quality_text)


@dataclass
class Machine:
    """A fitted machine. ``index``: hashed term -> row of ``w`` and ``v``."""

    terms: Terms
    index: dict[int, int]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, sets: list[set[int]]) -> np.ndarray:
        at = np.fromiter((i for s in sets for i in s), np.int64)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return _logits(self.w0, self.w, self.v, at, row, len(sets))


def _logits(w0: float, w: np.ndarray, v: np.ndarray, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = w0 + np.bincount(row, w[at], n)
    for f in range(v.shape[1]):
        x = v[at, f]
        out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def useful_terms(df: np.ndarray, hit: np.ndarray, n: int, pos: float, min_chi2: float) -> np.ndarray:
    """Which terms, found in ``df`` of ``n`` texts and ``hit`` of the ``pos`` of label 1, tell the labels apart."""
    want = df * (pos / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (hit - want) ** 2 / want + (hit - want) ** 2 / (df - want) + (hit - want) ** 2 / np.maximum(n - df, 1) * (1 / (pos / n) + 1 / (1 - pos / n))
    return (df >= 3) & (np.nan_to_num(chi2) >= min_chi2)


class _Batch:
    """Some texts' terms as two orders of the same entries, by text and by term, so that sums are over neighbours."""

    def __init__(self, kept: list[np.ndarray], y: np.ndarray, pad: int):
        # each text has the padding term, of weight nothing, so none is empty
        sizes = np.array([len(k) + 1 for k in kept])
        self.at = np.concatenate([np.append(k, pad) for k in kept]).astype(np.int64)
        self.row, self.starts, self.y = np.repeat(np.arange(len(kept)), sizes), np.r_[0, np.cumsum(sizes)[:-1]], y
        self.order = np.argsort(self.at, kind="stable")
        self.ids, self.firsts = np.unique(self.at[self.order], return_index=True)

    def by_text(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, axis=0)

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.firsts, axis=0)


def fit(terms: Terms, sets: list[np.ndarray], y: np.ndarray, factors: int = 4, min_chi2: float = 14.0, steps: int = 1500, epochs: int = 30, batch: int = 512, decay: float = 2e-6, pair_decay: float = 2e-4, seed: int = 7) -> Machine:
    """Fit on hashed term sets ``sets`` with labels ``y``; the same input gives the same machine.

    Batches are passed over ``epochs`` times, or until ``steps`` steps are made. Pairs are held down more than single weights,
    so they explain what single weights leave.
    """
    n = len(y)
    base = float(y.mean()) if n else 0.5
    w0 = float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
    if n == 0 or base in (0.0, 1.0):
        return Machine(terms, {}, w0, np.zeros(1), np.zeros((1, factors)))
    every = np.concatenate([np.asarray(s, np.int64) for s in sets])
    label = np.repeat(y, [len(s) for s in sets])
    ids, inverse = np.unique(every, return_inverse=True)
    best = ids[useful_terms(np.bincount(inverse, minlength=len(ids)), np.bincount(inverse, label, len(ids)), n, y.sum(), min_chi2)] if len(ids) else ids
    place = np.full(1 << terms.bits, -1)
    place[best] = np.arange(len(best))
    kept = [k[k >= 0] for k in (place[s] for s in sets)]
    d, rng = len(best), np.random.default_rng(seed)
    shuffled = rng.permutation(n)
    batches = [_Batch([kept[i] for i in part], y[part], d) for part in np.array_split(shuffled, max(1, round(n / batch)))]
    w, v = np.zeros(d + 1), rng.normal(0, 0.02, (d + 1, factors))
    v[d] = 0
    params = [np.array([w0]), w, v]
    m, sq = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = max(epochs, -(-steps // len(batches))) * len(batches)
    for t in range(1, total + 1):
        b = batches[t % len(batches)]
        ve = v[b.at]
        sums = b.by_text(ve)
        logit = params[0][0] + b.by_text(w[b.at]) + 0.5 * ((sums**2).sum(1) - b.by_text((ve**2).sum(1)))
        g = (sigmoid(logit) - b.y) / len(b.y)
        ge = g[b.row]
        gw, gv = decay * w, pair_decay * v
        gw[b.ids] += b.by_term(ge)
        gv[b.ids] += b.by_term(ge[:, None] * (sums[b.row] - ve))
        gw[d], gv[d] = 0, 0
        rate = 0.05 * min(1.0, 2 * (1 - t / (total + 1)))
        for p, grad, m1, s1 in zip(params, (np.array([g.sum()]), gw, gv), m, sq, strict=True):
            m1 += 0.1 * (grad - m1)
            s1 += 0.01 * (grad * grad - s1)
            p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(s1 / (1 - 0.99**t)) + 1e-9)
    return Machine(terms, {int(h): i for i, h in enumerate(best)}, float(params[0][0]), w, v)


def in_fold(doc_id: Column, k: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` when divided by ``k``. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, terms: Terms, held_out: tuple[int, int], max_rows: int = 20_000, max_values: int = 12_000_000, min_chi2: float = 14.0) -> Machine:
    """Fit on labelled rows outside the fold ``held_out`` = (modulus, remainder).

    labels: doc_id, label (0/1). The sampled labels are at most ``max_rows`` rows and so are broadcast. Terms are read and
    counted by executors; the driver gets the numbers of each text and the kept terms, never texts.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~in_fold(F.col("doc_id"), *held_out))
    one = usable.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = one.orderBy(crc, "doc_id").limit(max_rows)

    @F.pandas_udf("array<int>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = terms.reader()
        for b in batches:
            yield pd.Series([np.fromiter(get(t), np.int32) for t in b], dtype=object)

    rows = id_and_text(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    read_rows = written(rows.select("doc_id", "label", F.xxhash64("text").alias("fp"), read("text").alias("terms")), "terms")
    first = written(read_rows.groupBy("doc_id", "label").agg(F.min("fp").alias("fp")), "term-rows")  # at most max_rows
    # rows alike in id and text are one: their entries are the same
    entries = read_rows.join(F.broadcast(first), ["doc_id", "label", "fp"]).select("doc_id", "label", F.explode("terms").alias("term")).distinct()
    entries = written(entries, "term-entries")
    size = first.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    if size["pos"] in (0, size["n"]):
        return fit(terms, [np.zeros(0, np.int32)] * size["n"], np.full(size["n"], float(size["pos"] > 0)))
    counts = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("hit")).where("df >= 3").toPandas()  # at most 2^bits
    kept = counts["term"][useful_terms(counts["df"].to_numpy(), counts["hit"].to_numpy(), size["n"], float(size["pos"]), min_chi2)]
    of = docs.sparkSession.createDataFrame(pd.DataFrame({"term": kept.astype("int32")}), "term int")
    sets = entries.join(F.broadcast(of), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    table = written(first.join(sets, "doc_id", "left").select("doc_id", "label", crc.alias("crc"), F.coalesce("terms", F.array().cast("array<int>")).alias("terms")), "term-sets")
    sizes = table.select("crc", F.size("terms").alias("n")).toPandas().sort_values("crc")
    within = sizes["crc"][sizes["n"].cumsum() <= max_values]
    got = table.where(F.col("crc") <= (int(within.max()) if len(within) else -1)).toArrow()
    # views of the Arrow buffers: the driver holds each set once
    found = [x.values.to_numpy() if x.is_valid and len(x.values) else np.zeros(0, np.int32) for chunk in got["terms"].chunks for x in chunk]
    ids, y = got["doc_id"].to_pylist(), got["label"].to_numpy().astype(float)
    order = sorted(range(len(ids)), key=lambda i: str(ids[i]))
    return fit(terms, [found[i] for i in order], y[order], min_chi2=min_chi2)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (by default the id as doc_id) with ``score``."""
    keep = keep or [id_col]
    packed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text_col).alias("text"))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = machine.terms.reader(machine.index)
        for b in batches:
            yield pd.Series(sigmoid(machine.logits([get(t) for t in b])))

    return packed.select("row", of("text").alias("score")).select("row.*", "score")
