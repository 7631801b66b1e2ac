"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.reshape import ensure_id


def from_list(spark: SparkSession, docs: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(docs)), "ID long, text string")


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", text_column: str = "text", schema: str | None = None, **options) -> DataFrame:
    """Documents from parquet, csv, tsv, json (one value) or jsonl, with an id."""
    kind, opts = {"tsv": ("csv", {"sep": "\t"}), "jsonl": ("json", {}), "json": ("json", {"multiLine": True})}.get(fmt, (fmt, {}))
    if kind == "csv":
        opts = {"header": True, "multiLine": True, "escape": '"'} | opts
    r = spark.read.format(kind).options(**opts | options)
    return ensure_id((r.schema(schema) if schema else r).load(path), text_column)


def read_merged(spark: SparkSession, paths: list[str] | str, columns: list[str]) -> DataFrame:
    """Parquet files of drifting schemas, projected; columns that no file has are null."""
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def files_with(spark: SparkSession, paths: list[str], column: str) -> list[str]:
    """Paths whose files have a column; others, and unreadable ones, are left out."""
    good = []
    for p in paths:
        try:
            if column in spark.read.parquet(p).columns:
                good.append(p)
        except Exception as e:  # an unreadable file is reported, not fatal
            print(f"skipped {p}: {str(e)[:120]}")
    return good


def json_dict(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object file of id -> record, as rows (key, record's fields)."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", f"map<string,{value_schema}>"))
    return raw.select(F.inline(entries)).select("key", "value.*")


def chat_messages(df: DataFrame, role: str, column: str = "messages"):
    """The content of a conversation's first message by ``role``."""
    return F.get(F.filter(column, lambda m: m["role"] == role), F.lit(0))["content"]


def write_long(df: DataFrame, path: str, target: str = "Target", mode: str = "overwrite") -> None:
    """Long stance rows sorted by target within range partitions, so that a filter on a target skips row groups."""
    df.repartitionByRange(F.col(target)).sortWithinPartitions(target).write.mode(mode).option("compression", "zstd").parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def to_rows(df: DataFrame, limit: int = 1000) -> list[dict]:
    """At most ``limit`` rows as dicts, for a response."""
    return [r.asDict(recursive=True) for r in df.limit(limit).toLocalIterator()]


def to_columns(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each value of ``by`` with a list for each column, in the order of ``order``."""
    packed = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("_l"))
    return packed.select(by, *[F.col(f"_l.{c}").alias(c) for c in columns])
