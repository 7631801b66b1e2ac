"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the files that a query has shuffled are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    """Delete what :func:`shared` wrote, when the driver ends."""
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: its shared folder is the cluster's to empty
            return


def shared(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder in spark.checkpoint.dir and read it again: lineage is cut and a lost executor costs nothing. It is deleted when the driver ends, or by :func:`drop`.

    What the write has shuffled is not read again, so those files go at once; else they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="opinara-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/opinara-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`shared` that nothing will read any more."""
    for t in tables:
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if path.rpartition("/")[2].startswith("opinara-"):
                p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def tasks(df: DataFrame) -> int:
    """How many partitions to deal rows to whose work, not size, is large: adaptive execution would put a few MB into one."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
