"""Benchmark decontamination: a prefix-filtered set join of shingles (DataFrame operations only).

A benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words is one
window). A window is the set of its positioned shingles of ``shingle`` words, and a document holds it only if it
holds all of them. So, in a containment join at threshold 1, the necessary prefix of a window is one
shingle; it is the one that the fewest documents hold, counted over all documents. The steps:

1. one pass over the texts: the number of words of each, and where it holds a shingle of the benchmark;
2. from those places alone: how many documents hold each shingle, and with that each window's rarest one;
3. join places to window prefixes on the shingle's hash; positional bound: the window must start at
   the shingle's position less its offset, not before the text; length bound: it must end within the text;
4. verify: the words of the few documents left are cut once more and must be the window's words.

Occurrences of one document are merged to intervals, which gives the words hit.

A null or empty text has no words and is clean; a null item has no windows. Repeated documents
each get their result; repeated items count as one item each id. Null item ids are left out of the
item list but their windows hit. Columns beyond id and text are ignored. No documents give no rows, no items
leave all documents clean. A text costs its length: words are cut by one split, white space of any length included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import KEY, ascii_lower, id_and_text, if_small, with_key, written

#: What stands between words, after A-Z have been lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The benchmark's shingles are broadcast up to this size, and joined by shuffle beyond it.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text: maximal runs of a-z, 0-9 and anything beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), GAP, -1), "")


def _shingle_hashes(k: int) -> Column:
    """For each position of ``_words`` the hash of ``k`` words; the tail hashes fewer, which verification sorts out."""
    w = F.col("_words")
    return F.transform(w, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(w, i + j) for j in range(1, k)]))


def shingles(tokens: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """``keep`` with (pos, h) for every shingle of the given lengths of the ``_words`` column.

    The outer forms of explode keep the optimizer from inferring a filter on the array's size: pushed
    below the projection that splits the text, it would split the text again for each word.
    """
    parts = [tokens.withColumn("_h", _shingle_hashes(k)).select(*keep, F.posexplode_outer("_h").alias("pos", "h")).where(F.col("h").isNotNull()) for k in lengths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(window_text, n, k, item_id): each window of each item with its length and its shingle length."""
    w = items.select(F.col("doc_id").alias("item_id"), words(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_words") - window, F.lit(0))))
    at = w.select("item_id", "_words", starts.alias("_s"))
    one = at.select("item_id", F.slice("_words", F.col("_s") + 1, window).alias("_w"))
    return one.select(F.array_join("_w", " ").alias("window_text"), F.size("_w").alias("n"), F.least(F.size("_w"), F.lit(shingle)).alias("k"), "item_id").distinct()


def benchmark_shingles(windows: DataFrame) -> DataFrame:
    """(window_text, n, k, pos, h): the shingles of each distinct window."""
    split = windows.select("window_text", "n", "k").distinct().withColumn("_words", F.split("window_text", " ", -1))
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())  # at most `shingle` values
    inside = [shingles(split.where(F.col("k") == k), [k], ["window_text", "n", "k"]) for k in lengths]
    out = inside[0] if inside else split.select("window_text", "n", "k", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h"))
    for p in inside[1:]:
        out = out.unionByName(p)
    return out.where(F.col("pos") <= F.col("n") - F.col("k"))


def places(tokens: DataFrame, hashes: DataFrame, lengths: list[int]) -> DataFrame:
    """Per document a row (doc_id, key, n_words, pos = -1) and one (pos, h) for each place of a benchmark shingle.

    With the hashes broadcast both come from one pass over the texts; beyond that size the places come from a shuffle join
    and the numbers of words from a pass of their own.
    """
    keep = ["doc_id", *KEY]
    size = F.size("_words").cast("long").alias("n_words")
    small = hashes.count() * 64 <= BROADCAST_BYTES
    if not lengths:
        return tokens.select(*keep, size, F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("h"))
    each = [F.transform(_shingle_hashes(k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for k in lengths]
    if not small:
        every = tokens.select(*keep, F.inline_outer(F.concat(*each))).where(F.col("h").isNotNull())
        found = every.join(hashes, "h").select(*keep, F.lit(None).cast("long").alias("n_words"), "pos", "h")
        return found.unionByName(tokens.select(*keep, size, F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("h")))
    head = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("h")))
    every = tokens.select(*keep, size, F.inline_outer(F.concat(head, *each)))
    mark = F.broadcast(hashes.withColumn("_in", F.lit(True)))
    return every.join(mark, "h", "left").where(F.col("_in") | (F.col("pos") == -1)).select(*keep, "n_words", "pos", "h")


def occurrences(tokens: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, start, n, window_text): every place where a document's words are a window's words.

    tokens: the texts' words; found: :func:`places`; wanted: :func:`benchmark_shingles`.
    """
    at = found.where("pos >= 0").select(*KEY, "pos", "h").distinct()
    held = at.select(*KEY, "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"))
    ranked = wanted.join(held, "h", "left").groupBy("window_text", "n").agg(
        F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "h", "pos")).alias("_p")
    )
    # a window with a shingle that no document holds occurs nowhere
    prefixes = written(ranked.where(F.col("_p.n_docs") > 0).select("window_text", "n", F.col("_p.h").alias("h"), F.col("_p.pos").alias("offset")), "prefixes")
    sizes = found.where("pos = -1").select(*KEY, "n_words").distinct()
    start = F.col("pos") - F.col("offset")
    near = at.join(if_small(prefixes, 512), "h").select(*KEY, start.alias("start"), "n", "window_text").where("start >= 0")
    fits = written(near.join(sizes, list(KEY)).where(F.col("start") + F.col("n") <= F.col("n_words")).drop("n_words"), "candidates")
    some = written(fits.select(*KEY).distinct(), "candidate-keys")
    # of repeated rows one is enough: rows of one key have one text
    of = tokens.join(if_small(some), list(KEY), "left_semi").select(*KEY, "_words").dropDuplicates(list(KEY))
    both = fits.join(of, list(KEY))
    return both.where(F.array_join(F.slice("_words", F.col("start") + 1, F.col("n")), " ") == F.col("window_text")).select(*KEY, "start", "n", "window_text")


def _covered(spans: Column) -> Column:
    """How many positions a sorted list of (start, end) covers."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            (a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("sum"), F.greatest(a["end"], s["end"]).alias("end")
        ),
        lambda a: a["sum"].cast("long"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, keys: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated; with ``keys`` also the row key."""
    tokens = with_key(id_and_text(docs, id_col, text_col)).select("doc_id", *KEY, words(F.col("text")).alias("_words"))
    windows = written(item_windows(id_and_text(items, item_col, item_text_col), window, shingle), "item-windows")
    wanted = written(benchmark_shingles(windows), "shingles")
    lengths = sorted(r[0] for r in wanted.select("k").distinct().collect())  # at most `shingle` values
    found = written(places(tokens, written(wanted.select("h").distinct(), "hashes"), lengths), "places")
    occ = written(occurrences(tokens, found, wanted), "occurrences")
    hit = occ.groupBy(*KEY).agg(
        _covered(F.array_sort(F.collect_set(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n")).alias("end"))))).alias("_hit")
    )
    of = written(windows.select("window_text", F.col("item_id").cast("string").alias("item_id")).where(F.col("item_id").isNotNull()), "window-items")
    which = occ.select(*KEY, "window_text").join(if_small(of, 512), "window_text").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("_items"))
    result = written(hit.join(which, list(KEY), "left"), "contaminated")
    out = found.where("pos = -1").join(if_small(result, 1024), list(KEY), "left")
    return out.select(
        "doc_id",
        *(KEY if keys else ()),
        "n_words",
        F.coalesce("_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.col("_hit") > 0, F.lit(False)).alias("contaminated"),
    )
