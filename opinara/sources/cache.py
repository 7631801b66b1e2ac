"""Caches that last: append-only parts under a manifest, so that a repeated batch or a second writer loses and doubles nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.storage import shared


class Versions:
    """Numbered manifest files in a folder, each a small JSON object. The newest whole one holds; writing one that another writer has written fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> tuple[int, dict]:
        """The next free number, and what the newest manifest says; one that is cut off is passed over."""
        root = self._path(self.path)
        names = sorted(n for f in (self._fs.listStatus(root) if self._fs.exists(root) else []) if (n := f.getPath().getName()).startswith("manifest-"))
        free = 1 + int(names[-1].split("-")[1]) if names else 1
        for name in reversed(names):
            stream = self._fs.open(self._path(f"{self.path}/{name}"))
            try:
                return free, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue
            finally:
                stream.close()
        return free, {}

    def write(self, number: int, said: dict) -> bool:
        """Whether this writer was the first to write manifest ``number``."""
        at = self._path(f"{self.path}/manifest-{number:08d}")
        try:
            out = self._fs.create(at, False)
        except Exception:
            if self._fs.exists(at):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(said).encode()))
        finally:
            out.close()
        return True


class VectorCache:
    """Texts and their vectors. ``get`` encodes what is missing, once, and keeps it."""

    def __init__(self, spark: SparkSession, path: str, dim: int, key: str = "text", element: str = "float"):
        self.spark, self.dim, self.key, self.element = spark, dim, key, element
        self.versions = Versions(spark, path)

    def table(self, parts: list[str] | None = None) -> DataFrame:
        """(text, embedding) of all parts that the manifest names."""
        parts = self.versions.read()[1].get("parts", []) if parts is None else parts
        schema = f"{self.key} string, embedding array<{self.element}>"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.versions.path}/{p}" for p in parts])

    def get(self, rows: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
        """``rows`` with their texts' vectors; a null text has none. A vector of another length than the cache's raises."""
        texts = rows.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        right = F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector is not of length {self.dim}")))
        number, said = self.versions.read()
        new = shared(texts.join(self.table(said.get("parts", [])), self.key, "left_anti").withColumn("embedding", encode(F.col(self.key)).cast(f"array<{self.element}>")).withColumn("embedding", right))
        while not new.isEmpty():
            part = f"part-{uuid.uuid4().hex}"
            new.write.option("compression", "zstd").parquet(f"{self.versions.path}/{part}")
            if self.versions.write(number, {"parts": [*said.get("parts", []), part]}):
                break
            # another writer came first: only what that one has not added goes on
            number, said = self.versions.read()
            new = shared(new.join(self.table(said.get("parts", [])), self.key, "left_anti"))
        return rows.join(self.table(), self.key, "left")


class ResultCache:
    """A table computed from another, kept by a digest of its input: computed again only when the input's rows have changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    @staticmethod
    def digest(rows: DataFrame, more: str = "") -> str:
        """Of all rows in any order, and of ``more``, such as the parameters of what is computed."""
        h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.bitwiseAND(F.lit((1 << 20) - 1))), F.lit(0)).alias("s")).first()
        return f"{more}/{r['n']}-{r['x'] & (1 << 64) - 1:016x}-{r['s']:x}"

    def get(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], more: str = "") -> DataFrame:
        key = self.digest(rows, more)
        number, said = self.versions.read()
        while key not in said:
            part = f"part-{uuid.uuid4().hex}"
            compute(rows).write.option("compression", "zstd").parquet(f"{self.versions.path}/{part}")
            if self.versions.write(number, said | {key: part}):
                break
            number, said = self.versions.read()
        return self.spark.read.parquet(f"{self.versions.path}/{self.versions.read()[1][key]}")
