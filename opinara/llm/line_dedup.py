"""Line dedup with levelled sorted runs of line hashes (DataFrame operations only).

A *run* is a table ``(h1, h2, n_docs)``: 128-bit hashes of normalised lines with the number of documents that hold the
line, in buckets by hash and sorted within each, one file a bucket. :class:`LineRuns` keeps runs by level, as a log-structured
merge tree does:

* a new batch's counts are merge-anti-joined with the runs, which drops the lines that a run already knows as
  frequent, and what is left becomes a run of level 0;
* when a level has two runs they are compacted, by a merge join of the sorted buckets that adds their counts, into one run of the
  next level; so a hash is rewritten O(log batches) times and never shuffled again.

Buckets are as many as shuffle partitions, so the aggregate that counts a batch writes them without a further
shuffle. Each batch has an id, by default a digest of its rows: one that was added before is not added again, so a repeated attempt changes
nothing, in the same session or another. A line's places are joined with the frequent lines of all runs, and the documents with the line numbers found.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at
least ``min_chars`` code points found in at least ``min_docs`` documents loses all its lines.
Each row counts as a document, repeated rows too. A null or empty text is one empty line. Columns
other than the text stay as they are, whatever their names. No documents give no rows. A text costs its
length and the sort of its line numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.common import KEY, ascii_lower, drop_table, free_name, let, table_path, with_key, written

#: The white space that a line loses at both ends: space and \x09-\x0D.
BLANK = " \t\n\x0b\x0c\r"
#: A line held by more than this share of all lines' places is joined by a broadcast: there can be no more than 1 / share of them.
HEAVY = 1e-4
#: The documents' line numbers are broadcast up to this size, and joined by shuffle beyond it.
BROADCAST_BYTES = 32 << 20
#: In which batches the query's documents enter the runs.
BATCHES = 4
RUN = "h1 long, h2 long, n_docs long"


def line_hashes(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``docs``' key columns with ``_lines``: per line a struct (pos, h1, h2) for each key of ``min_chars`` or more."""
    lines = docs.select(*KEY, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_raw"))
    keys = lines.select(*KEY, F.transform("_raw", lambda x: ascii_lower(F.btrim(x, F.lit(BLANK)))).alias("_keys"))
    hashed = F.transform(
        "_keys",
        lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))),
    )
    return keys.select(*KEY, F.array_compact(hashed).alias("_lines"))


def document_counts(hashes: DataFrame) -> DataFrame:
    """(h1, h2, n_docs): in how many rows of :func:`line_hashes` a key occurs; partly summed before the shuffle.

    A text's repeated lines are found by a sort: equal ones are neighbours.
    """
    pairs = F.sort_array(F.transform("_lines", lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"))))
    once = let(pairs, lambda t: F.filter(t, lambda s, i: F.when(i > 0, F.get(t, i - 1) != s).otherwise(True)))
    return hashes.select(F.inline(once)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))


def batch_names(hashes: DataFrame) -> dict[int, str]:
    """A name for each batch that has rows, from its rows' keys in any order."""
    key = F.xxhash64(*KEY)
    sums = hashes.groupBy("_batch").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(key).alias("x"), F.sum(key.bitwiseAND(F.lit((1 << 20) - 1))).alias("s"))
    return {r["_batch"]: f"{r['n']}-{r['x'] & (1 << 64) - 1:016x}-{r['s']:x}" for r in sums.collect()}


class LineRuns:
    """Levelled sorted runs in a folder that driver and executors share; they outlive the session.

    ``add`` takes a batch's counts, ``compact`` merges full levels, ``counts`` is the sum over all runs,
    ``frequent`` the keys that reach ``min_docs``. Lines that a run already knows as frequent are not counted on: their
    ``n_docs`` is a lower bound from then on.

    A manifest file names the runs by level and the batches that are in them. Each change writes its run first and then the next manifest, which is one small new file: whoever opens the
    folder sees all of a change or nothing of it. A batch that was added before changes nothing; a run that no manifest came to name is left over (:meth:`sweep` drops those).
    Two writers cannot write the same manifest: the second one fails and has changed nothing. ``path`` may hold runs already; without one they are the session's own.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, path: str | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.path = path.rstrip("/") if path else table_path(spark, "line-runs")
        jvm = spark._jvm
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets, self.version = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        self.levels: list[list[str]] = []
        self.batches: set[str] = set()
        self._open()

    def add(self, batch_id: str, counts: DataFrame) -> None:
        """Merge-anti-join a batch's counts with the runs and add them as a run; a known ``batch_id`` changes nothing."""
        if batch_id not in self.batches:
            with self._sorted():
                for run in self._runs():
                    known = run.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
                    counts = counts.join(known.hint("merge"), ["h1", "h2"], "left_anti")
                name = self._write(counts)
            first, *rest = self.levels or [[]]
            self._commit([[*first, name], *rest], self.batches | {batch_id})
        self.compact()

    def compact(self) -> None:
        """Merge each level's pair of runs into one run of the level above; the pair goes once the manifest names the merged run."""
        level = 0
        while level < len(self.levels):
            if len(names := self.levels[level]) >= 2:
                with self._sorted():
                    merged = self._write(self._merged(*map(self._read, names[:2])))
                above = self.levels[level + 1] if level + 1 < len(self.levels) else []
                self._commit([*self.levels[:level], names[2:], [*above, merged], *self.levels[level + 2 :]], self.batches)
                for n in names[:2]:
                    self._drop(n)
            level += 1

    def counts(self) -> DataFrame:
        """The sum of all runs. Lines are in one run of each level at most, so there are as many joins as levels."""
        if not (runs := self._runs()):
            return self.spark.createDataFrame([], RUN)
        return reduce(self._merged, runs)

    def frequent(self) -> DataFrame:
        """(h1, h2, n_docs) of the lines of ``min_docs`` or more documents, as a written table."""
        with self._sorted():
            return written(self.counts().where(F.col("n_docs") >= self.min_docs), "frequent-lines")

    def sweep(self) -> None:
        """Drop runs that the manifest does not name, such as those of a change that was broken off, and manifests before it."""
        named = {n for level in self.levels for n in level}
        for name in self._names():
            if name.startswith("run-") and name not in named:
                self._drop(name)
            elif name.startswith("manifest-") and int(name.split("-")[1]) < self.version:
                self._fs.delete(self._fs_path(f"{self.path}/{name}"), True)

    def close(self) -> None:
        """Drop all runs and the folder."""
        for n in [n for level in self.levels for n in level]:
            self._drop(n)
        drop_table(self.spark, self.path)
        self.levels, self.batches = [], set()

    def _names(self) -> list[str]:
        root = self._fs_path(self.path)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def _open(self) -> None:
        """Take up the newest whole manifest; one whose writer was stopped halfway is passed over."""
        found = [n for n in self._names() if n.startswith("manifest-")]
        self._next = 1 + max((int(n.split("-")[1]) for n in found), default=0)
        for name in reversed(found):
            stream = self._fs.open(self._fs_path(f"{self.path}/{name}"))
            try:
                said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue
            finally:
                stream.close()
            self.buckets, self.levels, self.batches, self.version = said["buckets"], said["levels"], set(said["batches"]), int(name.split("-")[1])
            return

    def _commit(self, levels: list[list[str]], batches: set[str]) -> None:
        """Write the next manifest; it fails if another writer has written one of that number."""
        said = json.dumps({"buckets": self.buckets, "levels": levels, "batches": sorted(batches)})
        out = self._fs.create(self._fs_path(f"{self.path}/manifest-{self._next:08d}"), False)
        try:
            out.write(bytearray(said.encode()))
        finally:
            out.close()
        self.levels, self.batches, self.version, self._next = levels, batches, self._next, self._next + 1

    @contextmanager
    def _sorted(self) -> Iterator[None]:
        """Let the scans of buckets of one sorted file say so: their merge joins need neither a shuffle nor a sort."""
        name, conf = "spark.sql.legacy.bucketedTableScan.outputOrdering", self.spark.conf
        was = conf.get(name)
        conf.set(name, "true")
        try:
            yield
        finally:
            conf.set(name, was)

    def _runs(self) -> list[DataFrame]:
        return [self._read(n) for level in self.levels for n in level]

    def _table(self, name: str) -> str:
        return f"opinara_line_{name.replace('-', '_')}"

    def _write(self, counts: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        out = counts.select("h1", "h2", "n_docs").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        out.option("path", f"{self.path}/{name}").option("compression", "zstd").format("parquet").saveAsTable(self._table(name))
        return name

    def _read(self, name: str) -> DataFrame:
        table = self._table(name)
        if not self.spark.catalog.tableExists(table):  # another session wrote it
            at = f"{self.path}/{name}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return self.spark.table(table)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        drop_table(self.spark, f"{self.path}/{name}")

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("n_docs", "_n").hint("merge"), ["h1", "h2"], "full_outer")
        return both.select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("n_docs"))


def dropped_positions(hashes: DataFrame, frequent: DataFrame, n_places: int) -> DataFrame:
    """(key, _drop): the line numbers, from 0, that a document loses; rows only for documents that lose some.

    Lines of more than ``HEAVY`` of all ``n_places`` documents' lines are few, whatever the corpus: they are broadcast. No
    other line has so many places that a task's share of the shuffle join would be large.
    """
    each = hashes.select(*KEY, F.inline("_lines"))
    is_heavy = F.col("n_docs") > max(1.0, HEAVY * n_places)
    heavy = F.broadcast(frequent.where(is_heavy).select("h1", "h2", F.lit(True).alias("_heavy")))
    marked = each.join(heavy, ["h1", "h2"], "left")
    rest = marked.where("_heavy IS NULL").join(frequent.where(~is_heavy).select("h1", "h2"), ["h1", "h2"])
    found = marked.where("_heavy").select(*KEY, "pos").unionByName(rest.select(*KEY, "pos"))
    return found.groupBy(*KEY).agg(F.collect_set("pos").alias("_drop"))


def _few(drop: DataFrame) -> DataFrame:
    """A written table of :func:`dropped_positions`, broadcast if its counted size allows it."""
    n = drop.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("_drop")), F.lit(0)).alias("values")).first()
    return F.broadcast(drop) if 64 * n["rows"] + 8 * n["values"] <= BROADCAST_BYTES else drop


def dedup_lines(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_chars: int = 1,
    min_docs: int = 10,
    n_batches: int = BATCHES,
    runs: LineRuns | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    """``docs`` with frequent lines cut from the text, and with ``n_lines`` and ``n_dropped``.

    ``docs`` enter the runs as ``n_batches`` batches, by a digest of id and text; ``runs`` of earlier calls
    count too. ``batch_id`` names the rows; without one the same rows are the same batches whenever they come. Names ``n_lines`` and ``n_dropped`` get underscores where the input has them.
    """
    runs, own = runs or LineRuns(docs.sparkSession, min_docs), runs is None
    # the row travels as one struct, so no column of it can clash
    packed = with_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    batch = F.pmod(F.col(KEY[1]), F.lit(n_batches)).cast("int")
    hashes = written(line_hashes(packed, "_text", min_chars).withColumn("_batch", batch), "lines", partition_by="_batch")
    names = {k: f"{batch_id}/{n_batches}/{k}" for k in range(n_batches)} if batch_id else {k: f"none-{k}" for k in range(n_batches)} | batch_names(hashes)
    for k in sorted(names):
        runs.add(names[k], document_counts(hashes.where(F.col("_batch") == k)))
    frequent = runs.frequent()
    n_places = hashes.agg(F.sum(F.size("_lines"))).first()[0] or 0
    drop = _few(written(dropped_positions(hashes, frequent, n_places), "line-numbers"))
    if own:
        runs.close()
    n_lines, n_dropped = free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns)
    raw = packed.join(drop, list(KEY), "left").withColumn("_raw", F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    # the numbers that stay are a difference of sets, by hash: a text of many lines is not searched for each
    stay = F.array_except(F.sequence(F.lit(0), F.size("_raw") - 1), F.col("_drop"))
    left = F.array_join(F.transform(stay, lambda i: F.get("_raw", i)), "\n")
    text = F.when(F.col("_drop").isNull(), F.coalesce("_text", F.lit(""))).otherwise(left)
    return raw.withColumn("_new", text).select(
        *[F.col("_new").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns],
        F.size("_raw").cast("long").alias(n_lines),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias(n_dropped),
    )
