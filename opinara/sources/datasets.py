"""Loaders of labelled stance datasets: files to (Text, Target, Stance, Dataset[, ParentTexts, Context]).

Paths are parameters; the files are not part of this repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.storage import shared
from opinara.functions.labels import replace, replace_strict
from opinara.functions.text import strip
from opinara.operators.reshape import diagonal_union, positional_split

CANONICAL = ("Text", "Target", "Stance", "Dataset", "ParentTexts", "Context")
#: Labels of the datasets to canonical ones. Fixed values.
LABELS = {"FAVOR": "favor", "AGAINST": "against", "NONE": "neutral", "NEUTRAL": "neutral", "favor": "favor", "against": "against", "neutral": "neutral", "0": "against", "1": "favor", "2": "neutral"}
ENTAILMENT = ("supporting", "leaning supporting", "discussing", "querying", "irrelevant", "leaning refuting", "refuting")


def _csv(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    return spark.read.options(header=True, multiLine=True, escape='"', sep=sep).csv(path)


def semeval(spark: SparkSession, train: str, test: str, split: str) -> DataFrame:
    """train and validation are the first four fifths and the rest of the training file."""
    if split == "test":
        df = _csv(spark, test)
    else:
        rows = _csv(spark, train).withColumn("_n", F.monotonically_increasing_id())
        df = positional_split(rows, "_n", {"train": 0.8, "val": 0.2}).where(F.col("part") == split)
    return df.select(F.col("Tweet").alias("Text"), "Target", "Stance")


def vast(spark: SparkSession, path: str, drop_synthetic_neutral: bool = True) -> DataFrame:
    df = _csv(spark, path)
    return (df.where("type_idx <> 4") if drop_synthetic_neutral else df).select(F.col("post").alias("Text"), F.col("topic_str").alias("Target"), F.col("label").cast("string").alias("Stance"))


def ezstance(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path).select("Text", F.col("`Target 1`").alias("Target"), F.col("`Stance 1`").alias("Stance"))


def pstance(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _csv(spark, paths).select(F.col("Tweet").alias("Text"), "Target", "Stance")


def catalonia(spark: SparkSession, paths: list[str], target: str) -> DataFrame:
    return _csv(spark, paths, "\t").select(F.col("TWEET").alias("Text"), F.lit(target).alias("Target"), F.col("LABEL").alias("Stance"))


def french_election(spark: SparkSession, by_target: dict[str, str], split: str) -> DataFrame:
    return diagonal_union(*[_csv(spark, p).where(F.col("Set") == split).select(F.col("Tweet").alias("Text"), F.lit(t).alias("Target"), F.upper("Stance").alias("Stance")) for t, p in by_target.items()])


def mtcsd(spark: SparkSession, texts: str, index: str, target: str) -> DataFrame:
    """Threads: the index lists text ids, oldest first; the last is the text, the others its parents."""
    idx = spark.read.json(index, multiLine=True).select(F.monotonically_increasing_id().alias("n"), F.posexplode("index").alias("pos", "id"), "stance")
    rows = idx.join(_csv(spark, texts).select(F.col("id").cast(idx.schema["id"].dataType).alias("id"), "text"), "id")
    g = rows.groupBy("n", "stance").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l")).select("stance", F.col("l.text").alias("l"))
    return g.select(F.element_at("l", -1).alias("Text"), F.slice("l", F.lit(1), F.size("l") - 1).alias("ParentTexts"), F.lit(target).alias("Target"), F.col("stance").alias("Stance"))


def claims_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Conversations whose user turn has the text and whose assistant turn lists quoted claims."""
    from opinara.sources.io import chat_messages

    df = spark.read.schema("messages array<struct<role:string,content:string>>").json(path)
    return df.select(chat_messages(df, "user").alias("Text"), F.regexp_extract_all(chat_messages(df, "assistant"), F.lit('"(.*?)"'), F.lit(1)).alias("Target"))


def claims_dict(spark: SparkSession, path: str) -> DataFrame:
    from opinara.sources.io import json_dict

    return json_dict(spark, path, "struct<input_text:string,claims:array<string>>").select(F.col("input_text").alias("Text"), F.col("claims").alias("Target"))


def ctsdt(spark: SparkSession, path: str, max_depth: int = 5) -> DataFrame:
    """Threads given as a bracketed list of parent ids, at most ``max_depth`` back."""
    df = _csv(spark, path)
    ids = F.transform(F.split(strip(F.col("sub_branch"), "[]"), ","), lambda x: strip(strip(x), "'"))
    rows = df.select("id", "text", "label", F.posexplode_outer(ids).alias("pos", "pid"))
    back = 1 - F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("pos")))
    near = rows.withColumn("_b", back).where(F.col("_b") > -max_depth)
    joined = near.join(df.select(F.col("id").alias("pid"), F.col("text").alias("ptext")), "pid", "left").where(F.col("pid") != F.col("id"))
    parents = joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ptext"))).alias("l")).select("id", F.array_compact(F.col("l.ptext")).alias("ParentTexts"))
    return df.join(parents, "id", "left").select(F.col("text").alias("Text"), F.coalesce("ParentTexts", F.array().cast("array<string>")).alias("ParentTexts"), F.lit(None).cast("string").alias("Target"), F.col("label").alias("Stance"))


def reply_trees(edges: DataFrame) -> DataFrame:
    """(id, text, parent, ...) to rows with ParentTexts, oldest first: one join for each level of the tree, until a level is empty.

    Rows in a cycle of parents are in no tree and left out.
    """
    level = edges.where(F.col("parent").isNull()).withColumn("ParentTexts", F.array().cast("array<string>"))
    level = out = shared(level)
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent"), F.concat("ParentTexts", F.array("text")).alias("ParentTexts"))
        level = shared(edges.join(up, "parent").select(*out.columns))
        out = out.unionByName(level)
    return out


def context_claims(spark: SparkSession, path: str, split: str, n_ways: int, context: str, order: str) -> DataFrame:
    """Claims with their entailment from a Parquet table, split by position in ``order``, under one context for all."""
    names = {"discussing": ("leaning refuting", "leaning supporting", "neutral")}
    if n_ways == 4:
        names["discussing"] += ("querying",)
    if n_ways == 2:
        names = {"supporting": ("leaning supporting",), "other": ("leaning refuting", "neutral", "querying", "discussing", "irrelevant", "refuting")}
    if n_ways not in (2, 4, 5):
        raise ValueError(f"no scheme of {n_ways} labels")
    part = positional_split(spark.read.parquet(path), order, {"train": 0.8, "val": 0.1, "test": 0.1}).where(F.col("part") == split)
    stance = replace(F.col("stance"), {x: to for to, of in names.items() for x in of})
    return part.select("Text", F.col("MainClaims").alias("Target"), F.lower(stance).alias("Stance"), F.lit(context).alias("Context"))


def load(parts: dict[str, DataFrame], group: bool = True, map_labels: bool | dict[str, bool] = True) -> DataFrame:
    """Canonical rows of several datasets, by name; columns that some lack are null there."""
    if not parts:
        raise ValueError("name at least one dataset")
    maps = map_labels if isinstance(map_labels, dict) else dict.fromkeys(parts, map_labels)
    return diagonal_union(*[finalise(df, name, group, maps.get(name, True)) for name, df in parts.items()])


def collapse(label: Column, ways: int) -> Column:
    """The seven claim labels as 2, 3, 4, 5 or 7."""
    maps = {
        7: {}, 5: {"leaning supporting": "supporting", "leaning refuting": "refuting"},
        4: {"leaning supporting": "supporting", "leaning refuting": "refuting", "querying": "discussing"},
        3: {"leaning supporting": "supporting", "leaning refuting": "refuting", "querying": "neutral", "discussing": "neutral", "irrelevant": "neutral"},
        2: {"leaning supporting": "supporting", **{x: "other" for x in ENTAILMENT if "supporting" not in x}},
    }
    return replace(label, maps[ways]) if maps[ways] else label


def finalise(df: DataFrame, dataset: str, group: bool = True, map_labels: bool = True) -> DataFrame:
    """Canonical columns; with ``group`` one row for each text with parallel target and stance lists."""
    if map_labels and "Stance" in df.columns:
        df = df.withColumn("Stance", replace_strict(F.col("Stance"), LABELS))
    df = df.groupBy("Text", "Target").agg(*[F.min(c).alias(c) for c in df.columns if c not in ("Text", "Target")]) if dict(df.dtypes)["Target"] == "string" else df
    extra = [c for c in ("ParentTexts", "Context") if c in df.columns]
    if group and dict(df.dtypes)["Target"] == "string" and "Stance" in df.columns:
        packed = df.groupBy("Text").agg(F.array_sort(F.collect_list(F.struct("Target", "Stance"))).alias("l"), *[F.min(c).alias(c) for c in extra])
        df = packed.select("Text", F.col("l.Target").alias("Target"), F.col("l.Stance").alias("Stance"), *extra)
    df = df.withColumn("Dataset", F.lit(dataset))
    return df.select(*[c for c in CANONICAL if c in df.columns])
