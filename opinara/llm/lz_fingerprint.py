"""Document fingerprints from Lempel-Ziv phrases: likeness as a compressor sees it.

A text is parsed into dictionary phrases (LZ78): each phrase is the longest known one plus a character, and becomes known. Texts that share
passages share phrases. The set of a text's phrases is kept as a minimum-hash signature of ``SLOTS`` numbers of 16 bits: each slot is the least of the set's hashes under
a hash function of its own. The share of equal slots estimates the Jaccard similarity of two phrase sets (standard error 0.044 at most), which is :func:`likeness`.

The parse of a beginning is the beginning of the parse (:class:`Parse` goes on from any point, and back to one), so a text and an edited form that starts alike share it.

Neighbours in an order over the whole table are found without a global window: rows are range-partitioned and sorted once, each task
goes through its rows with one row held back, and the first and last rows of all partitions, two a partition, are matched afterwards.

Results: a null text is empty. An empty text has no phrases; its slots are all 65535, equal only to another empty text's. Equal texts have equal fingerprints. A text of one
document alone is its own neighbour. Rows of equal ids stand by a digest of their text, null ids come last. No rows give no rows. A text costs its length; its
dictionary, about a fifth of its characters, is held while it is parsed. Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import written

SLOTS = 128
#: Phrases whose slots are computed at once.
PORTION = 1024
#: Base of the phrases' own hashes, and its inverse modulo 2 ** 64. Fixed values.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
EMPTY = np.full(SLOTS, 0xFFFF, dtype=">u2").tobytes()

FIRST, LAST = 1, 2
ROW = "edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly (an xorshift-multiply finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd factor and an offset for each slot's hash function, 32 bits.
FACTORS = (mixed(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)[:, None]
OFFSETS = mixed(np.arange(1001, SLOTS + 1001, dtype=np.uint64)).astype(np.uint32)[:, None]

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE ** k and INVERSE ** k modulo 2 ** 64 for k below n, kept for the next text."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            grown = np.full(max(n, 2 * len(_powers[k])), base, dtype=np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown, dtype=np.uint64)
    return [x[:n] for x in _powers]


NEW = False


class Parse:
    """LZ78 phrases of the text fed so far, in a tree of characters (None: a phrase that none extends yet). ``ends`` are the phrases' ends."""

    def __init__(self):
        self.root: dict[str, dict] = {}
        self.node, self.text = self.root, ""
        self.ends: list[int] = []
        self.above: list[dict] = []

    def feed(self, text: str) -> Parse:
        node, root, end, made = self.node, self.root, self.ends.append, self.above.append
        for i, c in enumerate(text, len(self.text) + 1):
            below = node.get(c, NEW)
            if below is NEW:
                node[c] = None
                made(node)
                end(i)
                node = root
            elif below is None:
                node[c] = node = {}
            else:
                node = below
        self.node = node
        self.text += text
        return self

    def mark(self) -> tuple:
        return self.node, len(self.text), len(self.ends)

    def back(self, mark: tuple) -> Parse:
        """Forget what was fed after ``mark``."""
        node, chars, n = mark
        for k in range(len(self.ends) - 1, n - 1, -1):
            del self.above[k][self.text[self.ends[k] - 1]]
        del self.ends[n:], self.above[n:]
        self.node, self.text = node, self.text[:chars]
        return self

    def hashes(self) -> np.ndarray:
        """32 bits for each phrase: a polynomial of its characters, from differences of the text's prefix sums."""
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        up, down = powers(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:-1], dtype=np.uint64)])
        ends = np.array(self.ends, dtype=np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        return (mixed((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(32)).astype(np.uint32)

    def signature(self) -> bytes:
        """``SLOTS`` big-endian 16-bit minima over the phrases."""
        if not self.ends:
            return EMPTY
        x, least = self.hashes(), np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint32)
        for k in range(0, len(x), PORTION):
            np.minimum(least, (x[k : k + PORTION] * FACTORS + OFFSETS).min(axis=1), out=least)
        # 16 bits of a minimum, spread again: the minima's own high bits are small. 65535 is kept for empty texts
        return np.minimum(mixed(least.astype(np.uint64)) >> np.uint64(48), np.uint64(0xFFFE)).astype(">u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots of two signatures."""
    return float(np.mean(np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")))


def fingerprint(text: str | None) -> bytes:
    return Parse().feed(text or "").signature()


def fingerprints() -> Column:
    """A pandas UDF from text to signature, for tables of any kind."""

    @F.pandas_udf("binary")
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return sign


class Held:
    """A row that waits for the one after it: its text, its signature, and the parse of the part that an edit keeps."""

    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.cut = len(self.text) - len(self.text) // 2
        self.begun = Parse().feed(self.text[: self.cut])
        mark = self.begun.mark()
        self.fp = self.begun.feed(self.text[self.cut :]).signature()
        self.begun.back(mark)

    def beside(self, after_text: str, after_fp: bytes) -> tuple:
        """(edited_sha256, fp, edited_fp, near_edited, near_next): the text's second half is replaced by as much of the start of the next text."""
        new = after_text[: len(self.text) - self.cut]
        edited = hashlib.sha256((self.text[: self.cut] + new).encode("utf-8", "surrogatepass")).hexdigest()
        fp = self.begun.feed(new).signature()
        return edited, self.fp, fp, likeness(self.fp, fp), likeness(self.fp, after_fp)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next): each document beside the next one in descending id, the last beside the first.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by = [F.desc_nulls_last("doc_id"), F.asc("_digest"), F.asc("_tie")]
    # the tie spreads equal rows; it says nothing else
    drawn = rows.withColumns({"_digest": F.xxhash64("text"), "_tie": F.xxhash64(F.monotonically_increasing_id())})
    placed = drawn.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n_chars", *[c.split()[0] for c in ROW.split(", ")], "edge", "part", "edge_text"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        edge = lambda h, which: (h.doc_id, len(h.text), None, h.fp, None, None, None, which, part, h.text)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                row = Held(None if pd.isna(doc_id) else doc_id, text)
                out.append(edge(row, FIRST) if held is None else (held.doc_id, len(held.text), *held.beside(row.text, row.fp), 0, part, None))
                held = row
            yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([edge(held, LAST)], columns=columns)

    table = written(placed.mapInPandas(walk, f"doc_id {kind}, n_chars long, {ROW}, edge int, part int, edge_text string"), "neighbours")
    inner = table.where("edge = 0").drop("edge", "part", "edge_text")
    # as many numbers as there are partitions: each partition that has rows, and the one after it
    parts = sorted(r["part"] for r in table.where(F.col("edge") == FIRST).select("part").collect())
    if not parts:
        return inner
    after = F.broadcast(docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, after int"))
    last = table.where(F.col("edge") == LAST).select("doc_id", "n_chars", "part", F.col("edge_text").alias("text")).join(after, "part")
    first = table.where(F.col("edge") == FIRST).select(F.col("part").alias("after"), F.col("edge_text").alias("after_text"), F.col("fp").alias("after_fp"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, len(t), *Held(i, t).beside(at, af)) for i, t, at, af in zip(b["doc_id"], b["text"], b["after_text"], b["after_fp"], strict=True)]
            yield pd.DataFrame([(None if pd.isna(r[0]) else r[0], *r[1:]) for r in out], columns=columns[:-3])

    ends = last.join(first, "after").select("doc_id", "text", "after_text", "after_fp").mapInPandas(close, f"doc_id {kind}, n_chars long, {ROW}")
    return inner.unionByName(ends)
