"""The operators as registered queries over the standard tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import byte_bpe, decontamination, html_text, langid, licenses, merkle, mixing, orc_tokens, simhash, suffix_dedup, toxicity, vector_codes, vptree
from cairn.llm.common import checkpointed, fold, shared_dir, small, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    few = small(labels)
    training = docs.where(fold("doc_id", 5) != 0).join(few, "doc_id")
    if few is labels:  # texts cross the network once, not once for each of the passes of a fit
        training = checkpointed(training)
    fitted = toxicity.fit(training, "text", "toxic")
    return toxicity.score(docs.withColumn("held_out", fold("doc_id", 5) == 0), "text", fitted).select("doc_id", "held_out", "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fitted = langid.fit(docs.where(fold("doc_id", 3) != 1), "text", "lang")
    return langid.identify(docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out")), "text", fitted).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    orc_tokens.write(table(spark, sf_dir, "documents"), "doc_id", "text", path, public_tokenizers.path("byte_bpe_50k.json"))
    return orc_tokens.with_crc(orc_tokens.read(spark, path))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html").select("page_id", "url", "text", "n_chars")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source").select("doc_id", "size", "source_size", "target", "taken")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vec_id % 50 = 0", k=5)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), "doc_id", "text").drop("spans")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digest(licenses.scans(docs, "text").drop("text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = [merkle.lowered(c) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    claimed = F.when(F.col("doc_id").isNotNull() & (fold("doc_id", 5) == 0), merkle.leaf(tampered))
    return merkle.folded(merkle.manifest(docs, "doc_id", "source", merkle.COLUMNS, {"claimed": claimed}), "claimed")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return vector_codes.label_errors(checkpointed(coded)).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_language_id, op4_orc_tokens, op5_main_text, op6_source_mixing, op7_nearest_neighbours, op8_repeated_passages, op9_license_scan, op10_decontamination, op11_merge_replay, op12_merkle_manifest, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": mixing.ORACLE, "op12_merkle_manifest": merkle.oracle(), "op13_vector_codes": vector_codes.oracle()}
