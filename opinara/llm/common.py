"""Column helpers and shared-storage helpers that the operators of this folder use."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Row key columns of :func:`with_key`.
KEY = ("_key_id", "_key_fp")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def free_name(base: str, taken: list[str]) -> str:
    """``base``, with underscores appended until no column of the input has that name."""
    names = {c.lower() for c in taken}
    while base.lower() in names:
        base += "_"
    return base


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under names of its own: extra columns cannot clash.

    A null text becomes an empty one; a null id stays null.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's argument is not evaluated again for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add a row key: digests of the id and of id and text together, 128 bits (for null ids, of which the first says nothing, 64).

    Two rows share a key only if they have the same id and the same text, and then every result
    of theirs is the same; so repeated rows and null ids go through joins on the key unharmed.
    """
    return df.withColumn(KEY[0], F.xxhash64(F.col(id_col))).withColumn(
        KEY[1], F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit("")), F.col(id_col))
    )


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="opinara-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/opinara-{os.getpid()}/{tag}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`table_path` through Spark's file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_table(spark, path)
        except Exception:  # the session has ended: its shared folder is the cluster's to empty
            return


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage is cut, lost executors cost nothing.

    ``partition_by`` must be the last column.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(side: DataFrame, row_bytes: int = 64, limit: int = 64 << 20) -> DataFrame:
    """Broadcast a written table if its rows, of at most ``row_bytes`` in memory, fit; counted, not estimated from compressed files."""
    return F.broadcast(side) if side.count() * row_bytes <= limit else side
