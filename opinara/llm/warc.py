"""WARC archives as a chunked record table.

An archive's bytes are rows ``(archive, record, chunk, n_chunks, data)``: joined in order they are a WARC 1.1 file. A
payload beyond ``chunk_bytes`` is cut into rows by the JVM, so no Python worker ever holds a whole oversized
record: writers and readers see one chunk at a time and carry the running digest from chunk to chunk.
Rows go through Spark's own writer and reader, so the archive can lie in any store that
Spark reaches; :func:`export_files` turns it into ``.warc`` files in a folder.

Equal payloads (same length and SHA-1) of at least ``min_revisit_bytes`` are stored once: the row with the largest
page_id is the response, the others are revisit records without a payload that name it. Ties at the largest
page_id are all responses. A null page_id counts as smaller than any; where a group has no other, its
rows are responses. A null html is an empty payload. Repeated rows each get a record. Columns beyond
id, url and html are ignored; null urls are written as an empty target.

The digest and the choice of the response are DataFrame operations; a payload that a third of the pages share is
spread over salts.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.common import table_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SALTS = 32
CHUNK_BYTES = 1 << 16
#: Dates are not part of the pages; records carry this one, so archives are reproducible.
DATE = "2000-01-01T00:00:00Z"
COLUMNS = "archive string, record long, chunk long, n_chunks long, data binary"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of ``data``: 5 hex digits are 20 bits are 4 letters."""
    digest = F.sha1(data)
    letters = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def record_types(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, refers_to): one row for each distinct page_id and payload.

    refers_to is null for responses.
    """
    own = pages.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")).distinct()
    salted = own.withColumn("_s", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    key = ["payload_digest", "payload_bytes"]
    group = salted.groupBy(*key).agg(F.max("page_id").alias("largest"), F.collect_set("_s").alias("_ss"))
    each = salted.join(group.select(*key, "largest", F.explode("_ss").alias("_s")), [*key, "_s"])
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")) & (F.col("payload_bytes") >= min_revisit_bytes)
    return each.select("page_id", *key, F.when(revisit, F.col("largest")).alias("refers_to"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _header() -> Column:
    """A record's header block; the payload and two line ends follow."""
    revisit = F.col("refers_to").isNotNull()
    length = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), _text(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), _text(F.col("refers_to")), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")


def chunk_rows(pages: DataFrame, types: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The archive's rows for ``pages`` (page_id, url, payload); an archive is what one task writes."""
    of = types.select(F.xxhash64("page_id").alias("_h"), F.col("page_id").alias("_id"), F.col("payload_digest").alias("_d"), "payload_bytes", "refers_to")
    full = pages.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("_h", F.xxhash64("page_id"))
    joined = full.join(of.hint("shuffle_hash"), (full["_h"] == of["_h"]) & (full["payload_digest"] == of["_d"]) & full["page_id"].eqNullSafe(of["_id"]))
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    whole = joined.select(
        F.format_string("part-%05d", F.spark_partition_id()).alias("archive"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("record"),
        _header().alias("_head"),
        body.alias("_body"),
        F.greatest(F.ceil(F.octet_length(body) / chunk_bytes), F.lit(1)).alias("n_chunks"),
    )
    cut = whole.select("archive", "record", "_head", "_body", "n_chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk"))
    part = F.substring(F.col("_body"), (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    end = F.lit(b"\r\n\r\n")
    data = F.concat(F.when(F.col("chunk") == 0, F.col("_head")).otherwise(F.lit(b"")), part, F.when(F.col("chunk") == F.col("n_chunks") - 1, end).otherwise(F.lit(b"")))
    return cut.select("archive", "record", "chunk", "n_chunks", data.alias("data"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row of ``pages`` to the chunked record table at ``path``."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    chunk_rows(own, record_types(own, min_revisit_bytes), chunk_bytes).write.option("compression", "zstd").parquet(path)


class _Reader:
    """Reads chunk rows in order: header fields from the first chunk, then a running length and digest."""

    def __init__(self):
        self.at, self.done = None, []

    def feed(self, archive: str, record: int, chunk: int, n_chunks: int, data: bytes) -> None:
        if chunk == 0:
            head, _, data = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            self.fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            self.at, self.next, self.size, self.sha = (archive, record), 0, 0, hashlib.sha1()
            self.left = int(self.fields["Content-Length"])
        if self.at != (archive, record) or self.next != chunk:
            raise ValueError(f"record {record} of {archive}: chunk {chunk} out of order")
        self.next += 1
        body = memoryview(data)[: self.left]
        self.left -= len(body)
        self.size += len(body)
        self.sha.update(body)
        if chunk == n_chunks - 1:
            self._close()

    def _close(self) -> None:
        f = self.fields
        kind, claimed = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
        found = base64.b32encode(self.sha.digest()).decode() if kind == "response" else claimed
        if self.left or found != claimed:
            raise ValueError(f"record {self.at[1]} of {self.at[0]}: payload does not fit its header")
        of = lambda k: f[k].removeprefix("<urn:page:").removesuffix(">") if k in f else None
        size = self.size if kind == "response" else int(f["WARC-Payload-Length"])
        self.done.append((of("WARC-Record-ID"), size, found, kind, of("WARC-Refers-To"), f["WARC-Target-URI"]))


READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, reader = [x.split()[0] for x in READ.split(", ")], _Reader()
    for b in batches:
        for row in zip(b["archive"], b["record"], b["chunk"], b["n_chunks"], b["data"], strict=True):
            reader.feed(*row)
        yield pd.DataFrame(reader.done, columns=names)
        reader.done = []


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the table at ``path``; payload digests are computed again and checked.

    Records of one chunk are read where they lie. Only oversized ones are brought together, sorted by chunk,
    and streamed: what a worker holds is a chunk and a digest state.
    """
    rows = spark.read.schema(COLUMNS).parquet(path)
    long = rows.where("n_chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    got = rows.where("n_chunks = 1").mapInPandas(_read, READ).unionByName(long.mapInPandas(_read, READ))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long").alias(c)
    return got.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "url")


def export_files(spark: SparkSession, path: str, folder: str) -> None:
    """Write each archive as ``folder/<archive>.warc``, chunk by chunk. ``folder`` must be mounted on all executors."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name = None, None
        for b in batches:
            for archive, data in zip(b["archive"], b["data"], strict=True):
                if archive != name:
                    if out:
                        out.close()
                    out, name = open(os.path.join(folder, f"{archive}.warc"), "wb"), archive
                out.write(data)
        if out:
            out.close()
        yield pd.DataFrame({"done": [1]})

    rows = spark.read.schema(COLUMNS).parquet(path)
    rows.repartition("archive").sortWithinPartitions("archive", "record", "chunk").mapInPandas(write, "done int").count()


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    path = table_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit_bytes, chunk_bytes)
    return read_archives(pages.sparkSession, path)
