"""Filter interaction audit: which of five filters removes what, in every order, and what each is worth.

Each document has a mask of the filters that it fails. All that the audit says of a part (a language) follows from how many of its documents
have each mask: 32 numbers a part, and as many for good and for toxic documents. From them the part's removal polynomial is formed,

    v(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)) = sum over sets T of a(T) * product over i in T of x_i,

the number of documents that go if filter i is in use with probability x_i (:func:`coefficients`). At a corner of the cube v is what a
set of filters removes, so corners give the survivors after every step of every order (:func:`corner`). A filter's Shapley value is the
integral over t of the partial derivative of v on the diagonal (t, ..., t); the integral of a(T) * t ** (|T| - 1) is a(T) / |T|, an exact
rational (:func:`shapley`). Summed over all orders that is 120 times as much, an integer.

Spark counts masks with partial sums. Copies are told by a 128-bit digest of the text; rows are counted by digest, part and label
before anything is joined on the digest, so a text that fills a third of the table is a few rows there. The polynomials are evaluated for each row of the
parts' table, in tasks.

Results: a null text is empty; a null part is the empty string; a null id is neither smaller nor greater than another, so such a row is no
copy and makes none; rows of one id and one text are no copies of each other. A document is good or toxic if any label of its id says so, and neither without one.
No rows give no parts. A text costs its length. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import UPPER, let, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: The white space between words.
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("n", "good", "toxic")
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> Column:
    """Bits 0 to 3 for the filters that a text fails.

    A: under 200 words. B: fewer than half of its words are distinct. C: over 3 % of its characters are A-Z. D: any of # $ % & * |.
    """
    trimmed = F.btrim(text, F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    chars = F.char_length(text)
    capitals = chars - F.char_length(F.translate(text, UPPER, ""))
    of_words = let(words, lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0))
    return of_words + F.when(100 * capitals > 3 * chars, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): a part's documents by the filters that they fail. ``labels``: (id, good, toxic), booleans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text_failures(text).alias("fails"), F.col(id_col).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part")
    )
    # equal rows are one from here on
    each = rows.groupBy("h1", "h2", "fails", "id", "part").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy(F.col(id_col).alias("id")).agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    labelled = each.join(said, "id", "left").select(*each.columns, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in COUNTS[1:]])
    has_id = F.col("id").isNotNull()
    groups = written(
        labelled.groupBy("h1", "h2", "fails", "part", "good", "toxic").agg(
            F.sum("n").alias("n"), F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("with_id"), F.min(F.when(has_id, F.struct("id", "n"))).alias("first")
        ),
        "copies",
    )
    least = groups.groupBy("h1", "h2").agg(F.min("first.id").alias("least"))
    # those of the least id are no copies; a group that holds it has it first
    own = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = groups.join(least, ["h1", "h2"]).withColumn("copies", F.col("with_id") - own)
    either = F.array(
        F.struct(F.col("fails").alias("mask"), (F.col("n") - F.col("copies")).alias("k")), F.struct((F.col("fails") + 16).alias("mask"), F.col("copies").alias("k"))
    )
    split = copies.select("part", "good", "toxic", F.inline(either)).where("k > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("k").alias("n"), *[F.coalesce(F.sum(F.when(F.col(c), F.col("k"))), F.lit(0)).alias(c) for c in COUNTS[1:]]
    )


def coefficients(counts: list[int]) -> list[int]:
    """The removal polynomial's a(T) for each set T of filters, from the documents by mask: 1 - product of (1 - x_i), multiplied out."""
    above = [sum(n for m, n in enumerate(counts) if m & t == t) for t in range(MASKS)]
    return [0, *[(-1) ** (t.bit_count() + 1) * above[t] for t in range(1, MASKS)]]


def corner(a: list[int], used: int) -> int:
    """The polynomial where x is 1 for the filters of ``used`` and 0 for others: how many documents those remove."""
    return sum(n for t, n in enumerate(a) if t & ~used == 0)


def shapley(a: list[int], i: int) -> Fraction:
    """The integral from 0 to 1 of the partial derivative by x_i at (t, ..., t)."""
    return sum((Fraction(n, t.bit_count()) for t, n in enumerate(a) if t >> i & 1), Fraction(0))


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def part_steps(part: str, counts: dict[str, list[int]]) -> list[tuple]:
    """The rows of a part, a step of an order each, from its documents by mask."""
    total, full = sum(counts["n"]), MASKS - 1
    poly = {c: coefficients(counts[c]) for c in COUNTS}
    gone = {c: [corner(poly[c], s) for s in range(MASKS)] for c in COUNTS}
    n_orders = len(orders())
    worth = [shapley(poly["n"], i) * n_orders for i in range(len(FILTERS))]
    if any(w.denominator != 1 for w in worth):
        raise ArithmeticError("sums over all orders are integers")
    rows = []
    for order in orders():
        before = 0
        for step, f in enumerate(order, 1):
            i = FILTERS.index(f)
            after = before | 1 << i
            here = {c: gone[c][after] - gone[c][before] for c in COUNTS}
            alone = gone["n"][full] - gone["n"][full & ~(1 << i)]
            rows.append((part, order, step, total - gone["n"][after], here["n"], gone["n"][1 << i] - here["n"], alone, here["good"], here["toxic"], int(worth[i])))
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step, zeros included, as the module says."""
    found = mask_counts(docs, labels, part, id_col, text_col)
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STEPS.split(", ")]
        for b in batches:
            for part, masks in zip(b["part"], b["masks"], strict=True):
                counts = {c: [0] * MASKS for c in COUNTS}
                for m in masks:
                    for c in COUNTS:
                        counts[c][m["mask"]] = int(m[c])
                yield pd.DataFrame(part_steps(part, counts), columns=names)

    return by_part.mapInPandas(evaluate, STEPS)
