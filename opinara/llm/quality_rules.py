"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Each rule compares one statistic of a text with a cutoff and rejects texts beyond it. Cutoffs are chosen on labelled
documents so that, in every stratum, the share of good documents that the rules together reject is at
most ``risk``, with confidence 1 - ``delta`` for all strata at once:

1. Labelled texts are halved by a digest of the text. Equal texts are one trial, as copies say nothing new.
2. The first half orders the steps. A step lowers one rule's cutoff by one; steps are taken from lax to strict within a rule
   and, among rules, by the share of bad texts among those that the step newly rejects. Steps that reject more good
   than bad texts end their rule's sequence.
3. The second half tests the rules as they stand after each step, in that fixed order: an exact binomial (Clopper-Pearson)
   upper bound of the share of good texts rejected, each at the full level ``delta`` / number of strata. The first
   step whose bound is over ``risk`` ends the sequence, and the rules before it are taken. As the order was fixed
   beforehand, no step needs a correction of its own; the strata do, and have it (Bonferroni).

Strata are bands of text length in words. A test without any false rejection passes only from
ln(strata / delta) / -ln(1 - risk) good texts on (:func:`labels_needed`); bands with fewer in the second half are merged with the next longer one,
and the last ones with those before them. If all together are too few, no rule is on. The counts cover all labelled documents; the
driver gets only tables of (stratum, rule, cutoff) and (stratum, step) counts, whose size is fixed.

The guarantee is on good documents that pass the base rule. Near copies count as different trials.

A null or empty text has no words and fails the base rule. Repeated rows get equal results. An empty label
table turns the learned rules off; no documents give no rows. Columns beyond those named are ignored. A text costs the sort of its windows.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import KEY, id_and_text, with_key, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Lower ends of the strata, in words.
BANDS = (0, 50, 200, 800)

#: Rule -> (statistic as SQL over the columns of text_statistics, candidate cutoffs from strict to lax). Fixed values.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7)),
    "word_length": ("word_chars / greatest(n_words, 1)", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 14.0)),
    "few_kinds": ("1 - n_kinds / greatest(n_words, 1)", (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)),
}


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def text_statistics(docs: DataFrame, window: int = 5) -> DataFrame:
    """Per row: doc_id, key, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_kinds.

    Only texts whose window hashes are not all different are sorted: equal hashes become neighbours,
    their positions are sorted again and the covered words summed in one pass. The cost is that of
    a sort, however often a window repeats.
    """
    text = F.col("text")
    some = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    base = docs.select(
        "doc_id",
        *KEY,
        F.xxhash64("text").alias("text_hash"),
        F.array_remove(F.split(text, SPACE, -1), "").alias("_words"),
        some.alias("_lines"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    w = F.col("_words")
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, window)]))
    counts = ["doc_id", *KEY, "text_hash", "word_chars", "n_symbols", "n_capitals"]
    grams = base.select(
        *counts,
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_kinds"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) > window, F.slice(hashes, F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(0)))).alias("_grams"),
    )
    counts += ["n_words", "n_kinds", "n_lines", "n_dup_lines"]
    # all windows different, as in most texts: no sort
    pairs = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sort = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), pairs)
    tied = grams.select(*counts, sort.alias("_tied"))
    t = F.col("_tied")
    same = lambda s, i: (F.get(t, i + 1)["h"] == s["h"]) | F.coalesce(F.when(i > 0, F.get(t, i - 1)["h"] == s["h"]), F.lit(False))
    at = tied.select(*counts, F.array_sort(F.transform(F.filter(t, lambda s, i: F.coalesce(same(s, i), F.lit(False))), lambda s: s["i"])).alias("_at"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "_at",
        zero,
        lambda a, p: F.struct((a["sum"] + p + window - F.greatest(p, a["end"])).alias("sum"), (p + window).alias("end")),
        lambda a: a["sum"].cast("long"),
    )
    return at.select(*counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or tiny), 1 + num / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function: P(X <= x) of a beta distribution. Its cost grows with the square root of a and b at most."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


@lru_cache(4096)
def binomial_upper(k: int, n: int, level: float) -> float:
    """The largest p for which at most ``k`` of ``n`` has probability ``level`` or more (Clopper-Pearson)."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        # P(at most k of n at p) = 1 - I_p(k + 1, n - k)
        low, high = (mid, high) if 1 - incomplete_beta(k + 1, n - k, mid) > level else (low, mid)
    return high


def labels_needed(risk: float, delta: float, strata: int = len(BANDS)) -> int:
    """How many good texts a stratum needs for a rule that rejects none of them to pass."""
    return math.ceil(math.log(strata / delta) / -math.log1p(-risk))


def _band() -> Column:
    col = F.lit(0)
    for i, b in enumerate(BANDS[1:], 1):
        col = F.when(F.col("n_words") >= b, i).otherwise(col)
    return col


def merged_bands(good: dict[int, int], needed: int) -> list[list[int]]:
    """Neighbouring bands with at least ``needed`` good texts together; decided by numbers of labels, not by what rules do to them."""
    groups, now = [], []
    for band in range(len(BANDS)):
        now.append(band)
        if sum(good.get(b, 0) for b in now) >= needed:
            groups.append(now)
            now = []
    if now and groups:
        groups[-1] += now
    return groups


def _level(name: str) -> Column:
    """At which of a rule's cutoffs, counted from the lax end from 1 on, a text is first rejected; one more than there are if at none."""
    sql, cuts = RULES[name]
    return F.lit(len(cuts) + 1) - reduce(add, [(F.expr(sql) > c).cast("int") for c in cuts])


def ordered_steps(bad: dict[tuple[str, int], int], good: dict[tuple[str, int], int]) -> list[tuple[str, int]]:
    """(rule, level) steps from the first half's numbers of bad and good texts at each level of each rule.

    A step to level j of a rule newly rejects the texts of that level (:func:`_level`).
    """
    heads, out = dict.fromkeys(RULES, 1), []

    def worth(name: str) -> tuple[float, int, str]:
        b, g = bad.get((name, heads[name]), 0), good.get((name, heads[name]), 0)
        return (b + 0.5) / (b + g + 1), b, name

    def useful(name: str) -> bool:
        # a level without any text costs nothing and leads on to the next
        return heads[name] <= len(RULES[name][1]) and bad.get((name, heads[name]), 0) >= good.get((name, heads[name]), 0)

    while names := [n for n in RULES if useful(n)]:
        best = max(names, key=worth)
        out.append((best, heads[best]))
        heads[best] += 1
    return out


def steps_passed(rejected: list[int], n: int, risk: float, level: float) -> int:
    """How many steps pass in order, where each newly rejects so many of ``n`` good texts."""
    total = 0
    for i, more in enumerate(rejected):
        total += more
        if binomial_upper(total, n, level) > risk:
            return i
    return len(rejected)


def choose_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> dict[tuple[int, str], float]:
    """(band, rule) -> cutoff. ``stats``: a written table; ``labels``: doc_id and good, a boolean. A text with any good label is good."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("good").isNotNull()).groupBy("doc_id").agg(F.bool_or("good").alias("good"))
    rows = stats.where(f"NOT ({BASE_FAILED})").join(known, "doc_id")
    levels = [_level(n).alias(f"l_{n}") for n in RULES]
    # the statistics of equal texts are equal
    trials = written(rows.groupBy("text_hash", _band().alias("band"), *levels).agg(F.bool_or("good").alias("good")).withColumn("second", F.pmod(F.xxhash64("text_hash", F.lit("half")), F.lit(2)) == 1), "trials")
    numbers = {(r["band"], r["second"]): r["n"] for r in trials.where("good").groupBy("band", "second").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = merged_bands({b: numbers.get((b, True), 0) for b in range(len(BANDS))}, labels_needed(risk, delta))
    if not groups:
        return {}
    group = F.element_at(F.create_map(*[F.lit(x) for g, bands in enumerate(groups) for b in bands for x in (b, g)]), F.col("band"))
    trials = trials.withColumn("g", group)
    at = F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"l_{n}").alias("level")) for n in RULES]))
    cells = trials.where("NOT second").select("g", "good", at).groupBy("g", "good", "rule", "level").agg(F.count(F.lit(1)).alias("n")).collect()
    count = lambda g, good: {(r["rule"], r["level"]): r["n"] for r in cells if r["g"] == g and r["good"] == good}
    paths = {g: ordered_steps(count(g, False), count(g, True)) for g in range(len(groups))}
    # a text is rejected from the first step on whose level it reaches
    when = F.lit(None).cast("int")
    for g, path in paths.items():
        first = [F.when(F.col(f"l_{name}") <= level, i) for i, (name, level) in enumerate(path)]
        when = F.when(F.col("g") == g, F.coalesce(*first) if first else F.lit(None)).otherwise(when)
    steps = trials.where("second AND good").groupBy("g", when.cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    chosen = {}
    for g, bands in enumerate(groups):
        hits = {r["step"]: r["n"] for r in steps if r["g"] == g}
        n = sum(hits.values())
        for name, level in paths[g][: steps_passed([hits.get(i, 0) for i in range(len(paths[g]))], n, risk, delta / len(BANDS))]:
            for b in bands:
                chosen[b, name] = RULES[name][1][-level]
    return chosen


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, statistics, base_failed, failed_rules (array) and kept.

    The statistics are written once to the shared folder; labels and rules then read those few
    numbers, so the texts are read once.
    """
    stats = written(text_statistics(with_key(id_and_text(docs, id_col, text_col))), "text-statistics")
    cutoffs = choose_cutoffs(stats, labels, risk, delta)
    failed = [
        F.when((_band() == band) & (F.expr(RULES[name][0]) > c), F.lit(name)) for (band, name), c in sorted(cutoffs.items())
    ]
    out = stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("failed_rules", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*KEY, "text_hash")
