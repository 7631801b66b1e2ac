"""Nested reply threads from a tree of folders: any depth of folders, files of one JSON value or of one to a line, roots of nested replies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.reshape import diagonal_union, positional_split
from opinara.storage import shared

POST = "pos int, depth int, text string, stance string, leaning string, ParentTexts array<string>"


def read_json_tree(spark: SparkSession, path: str, skip: tuple[str, ...] = ("masked.json",), glob: str = "*.json*") -> tuple[DataFrame, DataFrame]:
    """((file, n, item), (file,)): the records of all files below ``path`` as JSON texts, and the files that are neither kind.

    A file whose lines all are JSON objects is read by line, so a large one is never held whole; others are tried as one JSON array (or object). A file's name does not say which it
    is. Files named in ``skip`` are left out. ``n`` numbers a file's records.
    """
    name = F.element_at(F.split("file", "/"), -1)
    options = {"recursiveFileLookup": "true", "pathGlobFilter": glob}
    lines = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("item"))
    lines = shared(lines.where(~name.isin(*skip) & (F.col("item") != "")))
    is_object = F.coalesce(F.col("item").startswith("{") & F.get_json_object("item", "$").isNotNull(), F.lit(False))
    kind = shared(lines.groupBy("file").agg(F.bool_and(is_object).alias("by_line")))
    of_lines = lines.join(kind.where("by_line").select("file"), "file").select("file", "n", "item")
    whole = spark.read.options(**options).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    whole = whole.join(kind.where("NOT by_line").select("file"), "file")
    parsed = whole.withColumn("items", F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).when(F.get_json_object("value", "$").isNotNull(), F.array("value")))
    parsed = parsed.withColumn("items", F.when(F.get_json_object("value", "$").isNotNull(), F.col("items")))
    of_arrays = parsed.select("file", F.posexplode("items").alias("n", "item")).withColumn("n", F.col("n").cast("long"))
    return of_lines.unionByName(of_arrays), parsed.where(F.col("items").isNull()).select("file")


class WalkReplies:
    """Rows of a root post and all replies below it, parents first; texts of a post's ancestors, oldest first. A stack, so depth costs no recursion."""

    def eval(self, root: str):
        if root is None:
            return
        stack, pos = [(json.loads(root), [])], 0
        while stack:
            post, above = stack.pop()
            yield pos, len(above), post.get("text"), post.get("stance"), post.get("leaning"), above
            pos += 1
            below = [*above, post.get("text")]
            stack += [(child, below) for child in reversed(post.get("children") or ())]


def walk_replies(items: DataFrame, root: Column) -> DataFrame:
    """``items`` with a row for each post of the tree in ``root``, a JSON text: pos, depth, text, stance, leaning, ParentTexts."""
    walk = F.udtf(WalkReplies, returnType=POST)
    named = items.withColumn("_root", root)
    return named.lateralJoin(walk(F.col("_root").outer())).drop("_root")


#: Misspelt labels of the files. Fixed values.
SPELLING = {"Dicussing": "Discussing"}
#: The files' folders by split. Fixed values.
FOLDERS = {"train": "train", "dev": "val", "test": "test"}
FRACTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def ways(stance: Column, leaning: Column, n: int) -> Column:
    """The label under a scheme of 2, 3, 4, 5 or 7 labels."""
    if n == 2:
        return F.when((stance == "Supporting") | F.coalesce(leaning == "Supporting", F.lit(False)), "supporting").otherwise("other")
    if n == 3:
        return F.when(stance.isin("Supporting", "Refuting"), F.lower(stance)).otherwise("neutral")
    if n == 4:
        return F.when(stance == "Querying", "discussing").otherwise(F.lower(stance))
    if n == 5:
        return F.lower(stance)
    if n == 7:
        return F.when(leaning.isin("Refuting", "Supporting"), F.concat(F.lit("leaning "), F.lower(leaning))).otherwise(F.lower(stance))
    raise ValueError(f"no scheme of {n} labels")


def nested_threads(spark: SparkSession, path: str, split: str, n_ways: int) -> DataFrame:
    """(Text, Target, Stance, ParentTexts, language): threads by language folder. Where a file's folders name a split, that is its split; else its language's posts are split by position.

    One language has its labels in the leaning; its discussions, which have none, are left out.
    """
    items, _ = read_json_tree(spark, path)
    root = path.rstrip("/").removeprefix("file:").removeprefix("//")
    below = F.regexp_extract("file", ".*?" + "".join(f"\\{c}" if not c.isalnum() else c for c in root) + "/(.*)", 1)
    each = items.select("file", "n", F.element_at(F.split(below, "/"), 1).alias("language"), F.split(below, "/").alias("parts"), F.get_json_object("item", "$.claim").alias("Target"), F.get_json_object("item", "$.root_tweet").alias("root"))
    posts = walk_replies(each, F.col("root"))
    hindi = F.col("language") == "hindi"
    label = F.trim(F.when(hindi, F.col("leaning")).otherwise(F.col("stance")))
    for wrong, right in SPELLING.items():
        label = F.when(label == wrong, right).otherwise(label)
    posts = posts.withColumn("stance", label).where(~(hindi & (F.coalesce("stance", F.lit("Discussing")) == "Discussing")))
    posts = posts.withColumn("leaning", F.when(~hindi, F.col("leaning")))
    said = F.array_compact(F.transform("parts", lambda p: F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])[p]))
    posts = shared(posts.withColumn("split", F.get(said, F.lit(0))))
    named = posts.where("split IS NOT NULL").withColumn("part", F.col("split"))
    order, parts = F.struct("file", "n", "pos"), [named]
    for language in sorted(r[0] for r in posts.where("split IS NULL").select("language").distinct().collect()):  # folders, a handful
        own = posts.where((F.col("language") == language) & F.col("split").isNull()).withColumn("_o", order)
        parts.append(positional_split(own, "_o", FRACTIONS).drop("_o"))
    out = diagonal_union(*parts).where(F.col("part") == split)
    return out.select(F.col("text").alias("Text"), "Target", ways(F.col("stance"), F.col("leaning"), n_ways).alias("Stance"), "ParentTexts", "language")
