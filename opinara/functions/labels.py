"""Stance vocabularies and their numeric scores. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOUN_PHRASE = {"FAVOR": 1.0, "AGAINST": -1.0, "NEUTRAL": 0.0}
CLAIM = {
    "SUPPORTING": 1.0, "LEANING SUPPORTING": 0.5, "IRRELEVANT": 0.0, "DISCUSSING": 0.0, "QUERYING": 0.0, "NEUTRAL": 0.0, "OTHER": 0.0, "LEANING REFUTING": -0.5, "REFUTING": -1.0,
}
SCORES = {"noun-phrases": NOUN_PHRASE, "claims": CLAIM}
CLASS_IDS = {"neutral": 0, "favor": 1, "against": 2}


def replace(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """Map values; those not in ``mapping`` keep theirs, or get ``default``."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col), col if default is None else default)


def replace_strict(col: Column, mapping: dict) -> Column:
    """Map values; one not in ``mapping`` raises, null stays null."""
    got = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), col)
    return F.when(col.isNull(), F.lit(None)).when(got.isNull(), F.raise_error(F.concat(F.lit("unknown value: "), col.cast("string")))).otherwise(got)


def stance_score(label: Column, target_type: str = "noun-phrases") -> Column:
    """Label, in any case, to a number in [-1, 1]."""
    if target_type not in SCORES:
        raise ValueError(f"unknown target type {target_type!r}")
    return replace_strict(F.upper(label), SCORES[target_type])


#: Ends of the named ranges of a mean stance: fixed values. The lower ones are tried first.
AGAINST = ((-0.67, "Strongly Against"), (-0.33, "Against"), (-0.1, "Slightly Against"))
FOR = ((0.67, "Strongly For"), (0.33, "For"), (0.1, "Slightly For"))


def stance_bucket(mean: Column) -> Column:
    """The name of a mean stance's range; Unknown for null."""
    name = F.when(mean.isNull(), "Unknown")
    for end, label in AGAINST:
        name = name.when(mean <= end, label)
    for end, label in FOR:
        name = name.when(mean >= end, label)
    return name.otherwise("Neutral")
