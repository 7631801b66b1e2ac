"""The thin queries that apply each operator to its whole table and derive the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.decontaminate import decontaminate

    got = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.crf import KINDS, find_secrets, fit_tagger

    got = find_secrets(_table(spark, sf_dir, "documents"), fit_tagger())
    tag = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = [_of_kind(k) for k in KINDS[:3]]
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], rank(s), tag(s).alias("tag"))))
    return got.select(
        "doc_id", *count, F.sha2(F.array_join(F.transform("base", tag), ","), 256).alias("base_sha256"), F.array_join(F.transform(every, lambda s: s["tag"]), ",").alias("spans")
    )


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.pii import BASE, find_pii, fit_trees

    got = find_pii(_table(spark, sf_dir, "documents"), fit_trees(spark))
    tag = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base, added = F.transform("base", tag), F.transform("added", tag)
    count = [F.regexp_count("b", F.lit(rf"\b{k}:")).cast("long").alias(f"n_{k}") for k in BASE]
    return got.select("doc_id", F.array_join(base, ",").alias("b"), F.array_join(F.concat(base, added), ",").alias("spans")).select(
        "doc_id", *count, F.sha2("b", 256).alias("base_sha256"), "spans"
    )


def _scored(spark: SparkSession, sf_dir: str, label: str, terms, fold: tuple[int, int], cut: float) -> DataFrame:
    from opinara.llm.factorization import in_fold, score, train

    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    got = score(docs, train(docs, labels, terms, fold))
    return got.select("doc_id", in_fold(F.col("doc_id"), *fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.factorization import TOXICITY

    return _scored(spark, sf_dir, "toxic", TOXICITY, (3, 1), 0.7)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.factorization import QUALITY

    return _scored(spark, sf_dir, "quality", QUALITY, (5, 0), 0.3)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from opinara.llm.sentencepiece_bpe import encode_decode, read_model

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return encode_decode(_table(spark, sf_dir, "documents"), model, digests=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.line_dedup import dedup_lines

    got = dedup_lines(_table(spark, sf_dir, "documents"), min_chars=1, min_docs=10)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), min_revisit_bytes=0).drop("url")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.quality_rules import apply_rules

    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    got = apply_rules(_table(spark, sf_dir, "documents"), labels)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.simhash import near_duplicates

    got = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, budget=2)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.common import let
    from opinara.llm.merkle import fold, leaf_digest, manifest, proof_digest

    # what is checked: texts that lost their line ends, where the id's checksum is even
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    digest = lambda text: leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    candidate = F.when(tampered & F.col("text").contains("\n"), digest(F.translate("text", "\n", "")))
    got = manifest(_table(spark, sf_dir, "documents"), "source", "doc_id", digest(F.col("text")), candidate)
    both = let(F.col("path"), lambda p: F.struct(proof_digest(p).alias("proof"), fold(F.coalesce("candidate", "leaf"), p).alias("folded")))
    return got.withColumn("_b", both).select(
        "doc_id", "leaf", "subroot", "root", F.col("_b.proof").alias("proof_sha256"), F.col("_b.folded").alias("folded_root"), (F.col("_b.folded") == F.col("root")).alias("verified")
    )


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.lz_fingerprint import with_next

    got = with_next(_table(spark, sf_dir, "documents"))
    hexed = [F.lower(F.hex(c)).alias(name) for c, name in (("fp", "fingerprint"), ("edited_fp", "edited_fingerprint"))]
    return got.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opinara.llm.filter_audit import audit

    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit(_table(spark, sf_dir, "documents"), labels)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fingerprint": op12_fingerprint,
    "op13_filter_audit": op13_filter_audit,
}
