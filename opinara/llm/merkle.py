"""Merkle dataset manifest: ordered leaves are collapsed block by block with higher-order functions, then block roots are.

A leaf is the SHA-256 (lowercase hex) of a row's fields. Leaves of a group (a source) stand in order; every ``ARITY`` consecutive
nodes, the last run with what is left, become the digest of their hex texts, until one node remains: the group's subroot. Subroots in
the order of their groups are collapsed alike into the root.

The nodes of a level are dealt to blocks of ``ARITY ** depth`` by position. A block is one row with an array, and ``sequence``,
``transform``, ``slice`` and ``aggregate`` collapse it by ``depth`` levels at once (:func:`collapsed`). Its top is a node of the next pass;
n leaves take log(n) / (depth * log(ARITY)) passes, so a group of any size is never in one task. Going down again, a block's rows
get their siblings in the block and then those of the block's own node (:class:`Forest`).

Positions come from range partitions: a row's place in its sorted partition plus the rows of its group in partitions before.

Results: null fields have leaves of their own (``-``), a null group comes first and is none of the others, rows with a null order value
come first in their group; rows of equal order value stand by their leaf, so equal rows are interchangeable. A lone leaf is its subroot, a lone subroot the root.
No rows give no rows. Long texts cost their length, once (twice where a candidate differs). Columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import if_small, let, written

ARITY = 3
#: Levels that a block collapses: 3 ** 6 = 729 nodes a block.
DEPTH = 6

PATH = "array<struct<l:string,r:string>>"


def leaf_digest(*values: Column) -> Column:
    """Digest of fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def parents(nodes: Column) -> Column:
    """The level above ``nodes``."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / ARITY).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def collapsed(leaves: Column, open_group: Column, depth: int) -> Column:
    """All levels of a block from its leaves: ``depth`` more where its group goes on above it, else until one node remains."""
    grow = lambda a: F.concat(a, F.array(let(F.element_at(a, -1), parents)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(leaves), lambda a, _: F.when(open_group | (F.size(F.element_at(a, -1)) > 1), grow(a)).otherwise(a))


def siblings(levels: Column, j: Column, depth: int) -> Column:
    """The path of leaf ``j`` (from 0) in its block: for each level the siblings' digests to its left and to its right."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(depth + 1)])

    def step(k: Column) -> Column:
        nodes, at = F.element_at(levels, k), F.floor(j / F.element_at(powers, k)).cast("int")
        place = F.pmod(at, F.lit(ARITY))
        left, right = F.slice(nodes, at - place + 1, place), F.slice(nodes, at + 2, F.lit(ARITY - 1) - place)
        return F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))

    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda k: k < F.size(levels)), step)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to by the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``_pos``, the place from 0 in the group by ``order`` (nulls first), and ``_n``, the group's size. The group must not be null.

    Rows are range-partitioned by group and order, so a large group spreads over many tasks.
    """
    by = [F.asc(c) for c in (group, *order, "_tie")]
    # equal rows spread too: the tie is drawn once, in the table that is written
    drawn = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    placed = written(drawn.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()).drop("_tie"), "ranked")
    part = F.shiftright("_m", 33)
    runs = placed.groupBy(group, part.alias("_part")).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(group)).alias("_n")
    )
    longest = runs.agg(F.coalesce(F.max(F.octet_length(group)), F.lit(0))).first()[0]
    joined = placed.withColumn("_part", part).join(if_small(written(starts, "starts"), 128 + longest), [group, "_part"])
    return joined.withColumn("_pos", F.col("_m") - F.col("_first") + F.col("_before")).drop("_m", "_part", "_first", "_before")


class Forest:
    """The trees over ranked nodes: rows with the group, ``_pos``, ``_n``, ``_hash`` and what is carried along.

    ``roots`` has each group's root; ``paths`` goes back down to the nodes.
    """

    def __init__(self, nodes: DataFrame, group: str, carry: tuple[str, ...] = (), depth: int = DEPTH):
        self.group, self.carry, self.depth, self.block = group, carry, depth, ARITY**depth
        self.passes: list[DataFrame] = []
        largest = nodes.agg(F.max("_n")).first()[0] or 0
        while True:
            self.passes.append(self._blocks(nodes, carry if not self.passes else ()))
            done = self.passes[-1].where(F.col("_n") <= self.block).select(group, F.col("_top").alias("_root"))
            self.roots = done if len(self.passes) == 1 else self.roots.unionByName(done)
            if largest <= self.block:
                return
            up = self.passes[-1].where(F.col("_n") > self.block)
            nodes = up.select(group, F.col("_block").alias("_pos"), F.ceil(F.col("_n") / self.block).cast("long").alias("_n"), F.col("_top").alias("_hash"))
            largest = -(-largest // self.block)

    def _blocks(self, nodes: DataFrame, carry: tuple[str, ...]) -> DataFrame:
        """One row a block, written: its nodes in order and its levels."""
        block = F.floor(F.col("_pos") / self.block).cast("long")
        rows = nodes.groupBy(self.group, block.alias("_block")).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_pos", "_hash", *carry))).alias("_items"))
        levels = collapsed(F.transform("_items", lambda s: s["_hash"]), F.col("_n") > self.block, self.depth)
        return written(rows.withColumn("_levels", levels).withColumn("_top", F.element_at(F.element_at("_levels", -1), 1)), "blocks")

    def _item(self, carry: tuple[str, ...]):
        """A node of a block with its path: siblings in the block, then those of the block's own node."""

        def put(s: Column, j: Column) -> Column:
            path = F.concat(siblings(F.col("_levels"), j, self.depth), F.col("_path"))
            return F.struct(*[s[c].alias(c) for c in ("_pos", "_hash", *carry)], path.alias("_path"))

        return put

    def paths(self, above: DataFrame) -> DataFrame:
        """(group, _pos, _hash, carried columns, _path, what else ``above`` has); ``above`` has a row of ``_path`` for each group."""
        more = [c for c in above.columns if c not in (self.group, "_path")]
        over = above.withColumn("_block", F.lit(0).cast("long"))
        for k, rows in reversed(list(enumerate(self.passes))):
            last = rows.where(F.col("_n") <= self.block)
            joined = last.join(above, self.group)
            if k < len(self.passes) - 1:
                joined = joined.unionByName(rows.where(F.col("_n") > self.block).join(over, [self.group, "_block"]))
            each = joined.select(self.group, *more, F.inline(F.transform("_items", self._item(self.carry if k == 0 else ()))))
            if k == 0:
                return each
            over = written(each.select(self.group, *more, "_path", F.col("_pos").alias("_block")), "paths")
        raise AssertionError("a forest has one pass at least")


def manifest(docs: DataFrame, by: str, order: str, leaf: Column, candidate: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row for each row of ``docs``: (order value, group, leaf, subroot, root, path, candidate).

    ``leaf`` is the digest of a row, ``candidate`` the digest of what is to be checked against the manifest (null: the leaf itself).
    """
    # null groups come before all others, and keep their own key
    key = F.coalesce(F.concat(F.lit("s"), F.col(by).cast("string")), F.lit("n"))
    slim = docs.select(key.alias("_by"), F.col(order).alias("_order"), leaf.alias("_hash"), (F.lit(None).cast("string") if candidate is None else candidate).alias("_other"))
    tree = Forest(ranked(slim, "_by", "_order", "_hash"), "_by", ("_order", "_other"), depth)
    tops = written(tree.roots.withColumnRenamed("_root", "_hash").withColumn("_all", F.lit("")), "subroots")
    crown = Forest(ranked(tops, "_all", "_by"), "_all", ("_by",), depth)
    above = crown.roots.select("_all", F.col("_root").alias("root"), F.array().cast(PATH).alias("_path"))
    groups = written(crown.paths(above).select("_by", F.col("_hash").alias("subroot"), "root", "_path"), "groups")
    rows = tree.paths(groups)
    group = F.when(F.col("_by") == "n", F.lit(None)).otherwise(F.substring("_by", 2, 2147483647))
    return rows.select(F.col("_order").alias(order), group.alias(by), F.col("_hash").alias("leaf"), "subroot", "root", F.col("_path").alias("path"), F.col("_other").alias("candidate"))
