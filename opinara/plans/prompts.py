"""Prompts for language models as columns: conversations, and documents of a group packed into prompts of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import parse_quoted_list, parse_thinking, strip
from opinara.operators.reshape import running

MESSAGES = "array<struct<role:string,content:string>>"


def conversation(turns: Column, system_allowed: bool = True) -> Column:
    """Messages from an array of texts: the first is the system's, then user and assistant take turns. One text alone is the user's.

    Where a model takes no system message it is left out, as these prompts repeat what it says.
    """
    role = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    rest = F.transform(F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0))), lambda t, i: F.struct(role(i).alias("role"), t.alias("content")))
    first = F.array(F.struct(F.lit("system").alias("role"), F.get(turns, F.lit(0)).alias("content")))
    alone = F.array(F.struct(F.lit("user").alias("role"), F.get(turns, F.lit(0)).alias("content")))
    return F.when(F.size(turns) == 1, alone.cast(MESSAGES)).otherwise(F.concat(first, rest).cast(MESSAGES) if system_allowed else rest.cast(MESSAGES))


def fold_system(messages: Column) -> Column:
    """A leading system message goes into the first user message after it, with an empty line between."""
    leads = F.get(messages, F.lit(0))["role"] == "system"
    text, rest = F.get(messages, F.lit(0))["content"], F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    at = F.array_position(F.transform(rest, lambda m: m["role"]), "user")
    folded = F.transform(rest, lambda m, i: F.when(i + 1 == at, F.struct(m["role"].alias("role"), F.concat(text, F.lit("\n\n"), m["content"]).alias("content"))).otherwise(m))
    return F.when(leads, folded.cast(MESSAGES)).otherwise(messages)


def packed(docs: DataFrame, group: str, order: str, text: str, limit: int = 8192) -> DataFrame:
    """(group, pack, n_docs, n_chars, texts): each group's documents in order, in packs by the characters before them in the group.

    A document starts in pack floor(characters before it / limit), so a pack is longer than ``limit`` by less than its last document. Characters before come from range
    partitions over all groups, less those before the group; a group of any size spreads over tasks. A null text is empty; order values are distinct in a group.
    """
    # a null group is one of its own
    named = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))
    rows = docs.select(named.alias("_k"), F.col(group).alias("_g"), F.col(order).alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_n", F.char_length("_t").cast("long"))
    keys = running(rows.select("_k", "_o", "_n"), ["_k", "_o"], "_n").drop("_n")
    at = keys.join(keys.groupBy("_k").agg(F.min("_before").alias("_s")), "_k").select("_k", "_o", F.floor((F.col("_before") - F.col("_s")) / limit).alias("pack"))
    both = rows.join(at, ["_k", "_o"])
    lists = both.groupBy("_k", "pack").agg(F.first("_g").alias(group), F.count(F.lit(1)).alias("n_docs"), F.sum("_n").alias("n_chars"), F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_l"))
    return lists.select(group, "pack", "n_docs", "n_chars", F.transform("_l", lambda s: s["_t"]).alias("texts"))


def shared_target_prompt(texts: Column) -> Column:
    """A conversation that asks for the one target that several texts take positions on."""
    ask = F.concat(
        F.lit("Name the one target that several of the documents below express opinions about, as a noun phrase, or None if there is none. Give the reason after the word Reasoning.\n\nDocuments:\n"),
        F.array_join(F.transform(texts, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), "\n"),
    )
    return conversation(F.array(F.lit("You find what discussions across several documents are about."), ask, F.lit("Stance target: ")))


def shared_targets(generated: Column) -> Column:
    """Targets from a model's samples: what stands before a reason and in the first line, in lower case; none and repeats left out."""
    one = lambda s: F.lower(F.trim(F.split_part(F.split_part(s, F.lit("Reasoning:"), F.lit(1)), F.lit("\n"), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(generated, one), lambda t: ~t.isin("", "none")))


def multi_document_targets(docs: DataFrame, group: str, order: str, text: str, generate, limit: int = 8192) -> DataFrame:
    """(group, Targets): targets that packs of a group's documents share. ``generate``: a model from a conversation column to an array of samples."""
    asked = packed(docs, group, order, text, limit).select(group, "pack", shared_targets(generate(shared_target_prompt(F.col("texts")))).alias("t"))
    return asked.select(group, F.explode("t").alias("t")).groupBy(group).agg(F.array_sort(F.collect_set("t")).alias("Targets"))


def claims(generated: Column) -> Column:
    """Claims from a model's samples: what is quoted after its thinking, in lower case, without white space around, each once."""
    each = F.flatten(F.transform(generated, lambda s: parse_quoted_list(parse_thinking(s))))
    return F.array_distinct(F.filter(F.transform(each, lambda c: F.lower(strip(c))), lambda c: c != ""))


def claim_extractor(generate):
    """A target extractor (column to column) from a model that answers a conversation with samples."""

    def extract(text: Column) -> Column:
        ask = F.concat(F.lit("List the claims that the text makes, each in double quotes, as a bracketed list.\n\nText: "), text)
        return claims(generate(conversation(F.array(F.lit("You extract claims from texts."), ask))))

    return extract
