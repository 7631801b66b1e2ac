"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokenization.

Each stage gets what the one before kept, from the Parquet table that it was written to; all but the last
return the columns of ``documents``. A stage that changes a text sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.common import KEY, drop_table, if_small, table_path, with_key, written
from opinara.llm.decontaminate import decontaminate
from opinara.llm.factorization import TOXICITY, score, train
from opinara.llm.line_dedup import dedup_lines
from opinara.llm.sentencepiece_bpe import encode_decode, read_model
from opinara.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The score is op4's; a document of unknown text stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    machine = train(docs, labels, TOXICITY, (3, 1))
    return score(docs, machine, keep=COLUMNS).where(F.col("score") < 0.7).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 or more documents go from every text; no document goes."""
    return dedup_lines(docs.select(*COLUMNS)).select("doc_id", "text", "lang", "source", F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays (a null id only where the group has no other); of repeated rows one.

    Near copies have 5-word shingles of a Jaccard similarity of 0.8 or more, or op10's fingerprints within 2 bits.
    """
    rows = near_duplicates(docs, keys=True, percent=80)
    each = written(rows.groupBy(*KEY, "root").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "group-rows")
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("s")).select(*[F.col(f"s.{k}").alias(k) for k in KEY])
    kept = written(each.join(first, list(KEY), "left_semi"), "kept")
    # rows that go, and keys that several rows share: only the latter's texts are shuffled, to keep one of them
    shared = written(kept.where("n > 1").select(*KEY), "shared-keys")
    others = written(each.join(kept.where("n = 1"), list(KEY), "left_anti").select(*KEY), "other-keys")
    own = with_key(docs.select(*COLUMNS))
    alone = own.join(if_small(others), list(KEY), "left_anti")
    one = own.join(if_small(shared), list(KEY), "left_semi").dropDuplicates(list(KEY))
    return alone.unionByName(one).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = written(decontaminate(docs, items, keys=True).where("contaminated").select(*KEY).distinct(), "contaminated-keys")
    return with_key(docs.select(*COLUMNS)).join(if_small(found), list(KEY), "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of what is left, as op8 returns them: token count and digests."""
    import public_tokenizers

    return encode_decode(docs, read_model(public_tokenizers.path("piece_bpe_32k.model")), digests=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenize", tokenize),
]

#: The first stage's learned scores and the last one's ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = table_path(spark, f"stage-{name}")
        out.write.parquet(path)
        if before:
            drop_table(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
