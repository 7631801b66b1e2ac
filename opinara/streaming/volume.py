"""Structured Streaming extensions: daily volumes and mean stances, and incremental target counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stance(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(window, target, volume, mean) of a stream of long rows (createtime timestamp, target, y)."""
    return stream.withWatermark("createtime", lateness).groupBy(F.window("createtime", "1 day"), "target").agg(F.count(F.lit(1)).alias("volume"), F.avg("y").alias("mean"))


def count_merger(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's counts are a file set of their own, named by the batch, so a replay overwrites itself."""

    def merge(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("target").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return merge


def merged_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("target").agg(F.sum("n").alias("n"))
