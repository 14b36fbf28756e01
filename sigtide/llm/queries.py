"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.llm import pieces, pii, secrets, warc
from sigtide.llm.ann import nearest
from sigtide.llm.common import table
from sigtide.llm.packing import pack
from sigtide.llm.phrases import collocations
from sigtide.llm.quality_model import quality
from sigtide.llm.quality_rules import quality_rules
from sigtide.llm.repeats import remove_repeats
from sigtide.llm.simhash import near_duplicates
from sigtide.llm.spelling import spelling_variants
from sigtide.llm.sql import SQL
from sigtide.llm.toxicity import toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, found = secrets.scan(table(spark, sf_dir, "documents"), secrets.new_ledger(spark), "doc_id", "text")
    d = secrets.spans_by_path(paths, found)
    d = d.withColumn("base", F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE)))
    return d.select(F.col("path").alias("doc_id"), *(number(k) for k in secrets.BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), PIECE_BPE), PIECE_BPE)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.personal_data(table(spark, sf_dir, "documents"))
    return d.select("doc_id", *(number(k) for k in pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return d.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
