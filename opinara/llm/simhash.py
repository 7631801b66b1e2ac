"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's 3-word
shingles, repeats included. Documents whose fingerprints differ in ``budget`` bits or fewer are
linked, and a component is what links reach.

How links are found. Equal fingerprints collapse first, so a group of exact copies is one row. Fingerprints are cut into
four blocks of 16 bits; two that differ in at most 2 bits agree on two blocks at least, so each of
the 6 pairs of blocks roots a forest: the 32 bits of the pair name a tree, the other 32 bits are the
path in it. Each tree is joined with itself: node pairs are walked down together from (root, root), the
differing bits of a pair add up, and a pair over the budget is dropped with all below it. A tree
with over ``max_tree`` fingerprints is first opened by some levels as a distributed step, with
one task key for each surviving node pair, and that again until all are small; fingerprints in a
tree are distinct, so a node at depth t holds at most 2^(32-t). The walk yields a
spanning forest of a tree's links, not all pairs: connected components are the same, and a
group of m near copies costs m - 1 edges for each pair of blocks.

Components: large-star and small-star rounds over the edges until none changes; stars are split by
salt. Nothing of a corpus' size reaches the driver.

A text without words (null, empty) has fingerprint 0 and is linked like any other. Null ids sort
last: a component of nulls alone has a null id. Repeated rows are equal and so in one component.
Columns beyond id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import KEY, drop_table, id_and_text, table_path, with_key, written
from opinara.llm.minhash import set_sketch, similar_links

LOWER = {i: i + 32 for i in range(65, 91)}
#: Python's own split would also cut at other white space.
SPLIT = re.compile(r"[\x20\x09-\x0D]+").split

#: Of hashes held at a time for one text.
CHUNK = 1 << 14
SALTS = 32


def words(text: str | None) -> list[str]:
    return [w for w in SPLIT((text or "").translate(LOWER) if text and not text.isascii() else (text or "").lower()) if w]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    return fingerprint_of(words(text), shingle)


def fingerprint_of(of: list[str], shingle: int = 3) -> int:
    """The fingerprint of a text's words. Shingles are made and counted in chunks: memory stays bounded."""
    if not of:
        return 0
    n = max(1, len(of) - shingle + 1)
    grams = iter([" ".join(of)]) if len(of) < shingle else (" ".join(g) for g in zip(*(islice(of, i, None) for i in range(shingle)), strict=False))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    while len(part := np.fromiter((digest(g, 42) for g in islice(grams, CHUNK)), np.uint64)):
        ones += _bits(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, least first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``fp`` for each row, next to the columns other than the text."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.fromiter((fingerprint(t, shingle) for t in b), np.int64, len(b)))

    return docs.select(*[c for c in docs.columns if c != "text"], fp("text").alias("fp"))


def fingerprints_and_sketches(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``fp`` and the columns of :func:`minhash.set_sketch` for each row, next to the columns other than the text.

    One function for both: a text is cut into words once, and a task has one Python worker, not two.
    """

    @F.pandas_udf("fp long, node long, n int, bands array<long>, bits array<long>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(fingerprint_of(w, shingle), *set_sketch(w)) for w in map(words, b)]
            yield pd.DataFrame(rows, columns=["fp", "node", "n", "bands", "bits"])

    return docs.select(*[c for c in docs.columns if c != "text"], both("text").alias("_p")).select("*", "_p.*").drop("_p")


def trie_join(tree: np.ndarray, path: np.ndarray, budget: np.ndarray, side: np.ndarray, bits: int = 32) -> np.ndarray:
    """Join trees with themselves; returns for each row the least row it is linked to, directly or not.

    Rows are sorted by (tree, side, path). A tree is the rows of one key; where it holds two sides, only links between
    the sides are wanted, else those within. ``budget``: differing bits allowed, equal within a tree.
    A node is a range of rows with a common prefix; node pairs are walked breadth first in bounded portions.
    """
    n = len(tree)
    label = np.arange(n)
    if n < 2:
        return label
    cut = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1])])
    ends = np.r_[cut[1:], n]
    first_side = np.r_[0, np.cumsum(side != 0)]
    mid = ends - (first_side[ends] - first_side[cut])
    two = (mid < ends) & (mid > cut)
    one = (mid == ends) & (ends - cut > 1)
    a0, a1 = np.r_[cut[one], cut[two]], np.r_[ends[one], mid[two]]
    b0, b1 = np.r_[cut[one], mid[two]], np.r_[ends[one], ends[two]]
    stack = [(a0, a1, b0, b1, budget[a0], np.full(len(a0), bits - 1))]
    while stack:
        a0, a1, b0, b1, left, bit = stack.pop()
        if len(a0) > 200_000:
            h = len(a0) // 2
            stack += [tuple(x[:h] for x in (a0, a1, b0, b1, left, bit)), tuple(x[h:] for x in (a0, a1, b0, b1, left, bit))]
            continue
        # a pair of leaves: its remaining bits are compared at once
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[leaf], b0[leaf]
        near = (i != j) & (np.bitwise_count(path[i] ^ path[j]) <= budget[i])
        _unite(label, i[near], j[near])
        a0, a1, b0, b1, left, bit = (x[~leaf] for x in (a0, a1, b0, b1, left, bit))
        # below the last bit all rows of a node are alike: each is near the other node's first
        for x0, x1, y0 in ((a0, a1, b0), (b0, b1, a0)):
            n_rows = np.where(bit < 0, x1 - x0, 0)
            each = np.repeat(x0 - np.cumsum(n_rows) + n_rows, n_rows) + np.arange(n_rows.sum())
            _unite(label, each, np.repeat(y0, n_rows))
        a0, a1, b0, b1, left, bit = (x[bit >= 0] for x in (a0, a1, b0, b1, left, bit))
        if not len(a0):
            continue
        am, bm = _middle(path, a0, a1, bit), _middle(path, b0, b1, bit)
        own = (a0 == b0) & (a1 == b1)
        parts = []
        for x0, x1, y0, y1, cost, ok in (
            (a0, am, b0, bm, 0, True),
            (am, a1, bm, b1, 0, True),
            (a0, am, bm, b1, 1, True),
            (am, a1, b0, bm, 1, ~own),
        ):
            keep = (x1 > x0) & (y1 > y0) & (left >= cost) & ok & ~((x0 == y0) & (x1 - x0 == 1) & (y1 - y0 == 1))
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], left[keep] - cost, bit[keep] - 1))
        stack.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
    return label


def _middle(path: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For each range, where its rows' ``bit`` turns from 0 to 1; by binary search, all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        m = (lo + hi) >> 1
        one = (path[np.minimum(m, len(path) - 1)] >> bit.astype(np.uint64)) & np.uint64(1)
        hi = np.where(open_ & (one == 1), m, hi)
        lo = np.where(open_ & (one == 0), m + 1, lo)
    return lo


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j in place; a label is the least member known, and points to itself at the root."""
    while len(i):
        for x in (i, j):
            while (label[label[x]] != label[x]).any():
                label[x] = label[label[x]]
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def _roots(label: np.ndarray) -> np.ndarray:
    while (up := label[label]).tobytes() != label.tobytes():
        label = up
    return label


#: The pairs of 16-bit blocks that root the forest.
BLOCKS = list(combinations(range(4), 2))


def forest(fps: DataFrame) -> DataFrame:
    """(tree, path, fp): each fingerprint once for each pair of blocks. ``tree`` is the pair's number and 32 bits."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    rows = []
    for k, (i, j) in enumerate(BLOCKS):
        p, q = (x for x in range(4) if x not in (i, j))
        key = F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
        rows.append(F.struct(key.alias("tree"), F.shiftleft(block[p], 16).bitwiseOR(block[q]).alias("path")))
    return fps.select("fp", F.inline(F.array(*rows)))


def open_trees(rows: DataFrame, depth: int, budget: int, levels: int = 8) -> DataFrame:
    """Walk ``levels`` levels of large trees down as a distributed step: a row for each surviving node pair.

    rows: tree, side, path, left (bits still allowed), fp. The node of a row is its next
    ``levels`` bits; with each mask of at most ``left`` bits it meets the node at that distance.
    """
    masks = [m for m in range(1 << levels) if m.bit_count() <= budget]
    node = F.shiftrightunsigned("path", 32 - depth - levels).bitwiseAND(F.lit((1 << levels) - 1))
    each = rows.withColumn("_node", node).withColumn("_mask", F.explode(F.array(*map(F.lit, masks))))
    each = each.where(F.bit_count("_mask") <= F.col("left"))
    other = F.col("_node").bitwiseXOR(F.col("_mask"))
    # within one node both sides of a split pair stay apart; of two nodes the lesser is side 0
    side = F.when(F.col("_mask") == 0, F.col("side")).when(F.col("_node") < other, 0).otherwise(1)
    return each.select(
        F.concat("tree", F.lit("/"), F.least("_node", other), F.lit("~"), F.col("_mask")).alias("tree"),
        side.cast("int").alias("side"),
        F.col("path").bitwiseAND(F.lit((1 << (32 - depth - levels)) - 1)).alias("path"),
        (F.col("left") - F.bit_count("_mask")).cast("int").alias("left"),
        "fp",
    )


def _join_trees():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:  # sorted by tree: the last tree may go on in the next batch
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b["tree"].iloc[-1]
            n = int((b["tree"].to_numpy() != last).sum())
            rest = b.iloc[n:]
            if n:
                yield links(b.iloc[:n])
        if rest is not None and len(rest):
            yield links(rest)

    def links(b: pd.DataFrame) -> pd.DataFrame:
        b = b.reset_index(drop=True)
        tree = np.r_[0, np.cumsum(b["tree"].to_numpy()[1:] != b["tree"].to_numpy()[:-1])]
        path, side, left = b["path"].to_numpy().astype(np.uint64), b["side"].to_numpy(), b["left"].to_numpy()
        order = np.lexsort((path, side, tree))
        label = _roots(trie_join(tree[order], path[order], left[order], side[order]))
        fp = b["fp"].to_numpy()[order]
        far = label != np.arange(len(label))
        return pd.DataFrame({"a": fp[far], "b": fp[label[far]]})

    return run


def near_links(fps: DataFrame, budget: int = 2, max_tree: int = 20_000) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints, for each tree."""
    if budget != 2:
        raise ValueError("four blocks, two of them equal, suit a budget of 2 bits")
    rows = forest(fps).select("tree", F.lit(0).alias("side"), "path", F.lit(budget).alias("left"), "fp")
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    large = written(sizes.where(F.col("n") > max_tree).select("tree"), "large-trees")
    parts = [rows.join(sizes.where(F.col("n") <= max_tree).select("tree"), "tree")]
    depth = 0
    while not large.isEmpty() and depth < 32:
        rows = written(open_trees(rows.join(large, "tree"), depth, budget), "opened")
        depth += 8
        sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        large = written(sizes.where(F.col("n") > max_tree).select("tree"), "large-trees")
        parts.append(rows.join(sizes.where(F.col("n") <= max_tree).select("tree"), "tree"))
    found = None
    for p in parts:
        each = p.repartition("tree").sortWithinPartitions("tree").mapInPandas(_join_trees(), "a long, b long")
        found = each if found is None else found.unionByName(each)
    return found.distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u's neighbours and u. A hub's edges are spread over salts.

    The per-node aggregate lists the salts its edges use, at most SALTS, so the join's small side
    is repeated only where it is needed.
    """
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = salted.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.collect_set("_s").alias("_ss"))
    return salted.join(least.select("u", "m", F.explode("_ss").alias("_s")), ["u", "_s"]).select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node that has an edge (a, b), the least node reachable. Alternates large and small stars."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    path = table_path(spark, "stars")
    now.write.parquet(path)
    now = spark.read.schema("u long, v long").parquet(path)
    mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = _with_least(large)  # in `large` every edge leads from a greater to a lesser node
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        to = table_path(spark, "stars")
        small.select("e.u", "e.v").where("u <> v").distinct().write.parquet(to)
        drop_table(spark, path)
        path, now = to, spark.read.schema("u long, v long").parquet(to)
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, max_tree: int = 20_000, keys: bool = False, percent: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed 64 bits) and component_id, the least doc_id of its component.

    With ``keys`` also the row key and ``root``, a fingerprint that names the component. With ``percent`` texts are
    also linked whose sets of 5-word shingles are as similar as that (:mod:`minhash`).
    """
    own = id_and_text(docs, id_col, text_col)
    rows = with_key(own) if keys or percent else own
    prints = written((fingerprints_and_sketches if percent else fingerprints)(rows, shingle), "fingerprints")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    distinct = written(prints.withColumn("_s", salt).groupBy("fp").agg(F.min("doc_id").alias("least"), F.collect_set("_s").alias("_ss")), "distinct")
    links = near_links(distinct.select("fp"), budget, max_tree)
    if percent:
        links = links.unionByName(similar_links(own, prints, percent))
    joined = components(written(links, "links"))
    root = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    root = written(root, "roots")
    least = root.groupBy("root").agg(F.min("least").alias("component_id"), F.collect_set(F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).alias("_rs"))
    of = root.withColumn("_r", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(
        least.select("root", "component_id", F.explode("_rs").alias("_r")), ["root", "_r"]
    )
    out = prints.withColumn("_s", salt).join(of.select("fp", "root", "component_id", F.explode("_ss").alias("_s")), ["fp", "_s"])
    return out.select("doc_id", "fp", "component_id", *((*KEY, "root") if keys else ()))
