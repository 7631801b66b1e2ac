"""Lists to rows and back, spines, samples and ranks."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.storage import shared


def ensure_id(df: DataFrame, text_column: str = "text", id_column: str = "ID") -> DataFrame:
    """Check the text column; number the rows if they have no id."""
    if text_column not in df.columns:
        raise ValueError(f"no column {text_column!r}")
    if id_column in df.columns:
        return df
    # each task numbers its rows; written, so every read sees the same numbers, which the tasks' counts then make consecutive
    rows = shared(df.withColumn("_m", F.monotonically_increasing_id()))
    sizes = {r["_part"]: r["count"] for r in rows.groupBy(F.shiftright("_m", 33).alias("_part")).count().collect()}
    if not sizes:
        return rows.withColumnRenamed("_m", id_column)
    before = dict(zip(sorted(sizes), accumulate([0, *(sizes[p] for p in sorted(sizes))]), strict=False))
    offset = F.element_at(F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv]), F.shiftright("_m", 33).cast("int"))
    return rows.withColumn(id_column, (offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_m")


def explode_pairs(df: DataFrame, left: str = "Targets", right: str = "Stances", outer: bool = True) -> DataFrame:
    """One row for each position of two parallel lists, as ``pos``, ``Target`` and ``Stance``. Lists of different lengths raise."""
    same = F.when(F.coalesce(F.size(left), F.lit(0)) == F.coalesce(F.size(right), F.lit(0)), F.arrays_zip(F.col(left).alias("Target"), F.col(right).alias("Stance"))).otherwise(F.raise_error(F.lit(f"{left} and {right} differ in length")))
    return df.withColumn("_z", same).select(*[c for c in df.columns if c not in (left, right)], (F.posexplode_outer if outer else F.posexplode)("_z").alias("pos", "_p")).select("*", "_p.Target", "_p.Stance").drop("_p")


def regroup(rows: DataFrame, docs: DataFrame, key: str, lists: dict[str, str], pos: str = "pos") -> DataFrame:
    """Collect rows into lists by ``key`` in the order of ``pos`` and join them to ``docs``; [] where there are none."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, *lists))).alias("_l"))
    out = docs.join(packed, key, "left")
    cols = {new: F.coalesce(_field("_l", old), F.array().cast(f"array<{rows.schema[old].dataType.simpleString()}>")) for old, new in lists.items()}
    return out.withColumns(cols).drop("_l")


def _field(name: str, field: str) -> Column:
    return F.transform(name, lambda s: s[field])


def grouping_explode(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Each row once for all and once for each filter column: (filter_type, filter_value). Null values have no group."""
    parts = [F.struct(F.lit("all").alias("filter_type"), F.lit("all").alias("filter_value"))]
    parts += [F.struct(F.lit(name).alias("filter_type"), F.col(c).cast("string").alias("filter_value")) for name, c in filters.items()]
    return df.select("*", F.inline(F.array(*parts))).where(F.col("filter_value").isNotNull())


def daily_spine(groups: DataFrame, start: str = "d0", end: str = "d1", name: str = "day") -> DataFrame:
    """Every day from ``start`` to ``end``, both included, for each row."""
    return groups.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))))


def diagonal_union(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under all columns; missing ones are null, numbers take the widest type."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def running(df: DataFrame, order: list[str], size: str | None = None) -> DataFrame:
    """``df`` with ``_before``: the sum of ``size`` (1 if none is given) over all rows that come earlier in ``order``, which must be total.

    Rows are range-partitioned and sorted once; sums within partitions are windows by partition, and offsets, as many as there are partitions, come from the driver.
    """
    value = F.lit(1).cast("long") if size is None else F.col(size).cast("long")
    placed = shared(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.sum(value).alias("n")).collect()}
    if not sums:
        return df.withColumn("_before", F.lit(None).cast("long"))
    before = dict(zip(sorted(sums), accumulate([0, *(sums[p] for p in sorted(sums))]), strict=False))
    offset = F.element_at(F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv]), F.col("_part"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_before", (offset + F.coalesce(own, F.lit(0))).cast("long")).drop("_part")


def positional_split(df: DataFrame, order: str, fractions: dict[str, float]) -> DataFrame:
    """Label rows by their position in ``order``: consecutive parts of the given fractions, the last takes the rest.

    The order must be total. Positions come from ranks within range partitions plus the partitions' offsets, not from one global window.
    """
    ranged = shared(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))  # ranges are drawn once
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    total, offsets, at = sum(sizes.values()), [], 0
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(at)]
        at += sizes[p]
    if not total:
        return df.withColumn("part", F.lit(None).cast("string"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    pos = ranged.withColumn("_pos", local + F.element_at(F.create_map(*offsets), F.col("_part")))
    edge, col = 0, None
    for name, f in fractions.items():
        edge += int(f * total)
        col = F.when(F.col("_pos") < edge, name) if col is None else col.when(F.col("_pos") < edge, name)
    return pos.withColumn("part", col.otherwise(list(fractions)[-1])).select(*df.columns, "part")


def stratified_sample(df: DataFrame, by: str, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``n`` rows of each stratum, in the order of a seeded hash of ``key``: the same rows however they are partitioned."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def average_rank(column: str, by: str, descending: bool = False) -> Column:
    """Rank with ties sharing their mean rank."""
    w = Window.partitionBy(by).orderBy(F.desc(column) if descending else F.asc(column))
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(by, column)) - 1) / 2
