"""A corpus pipeline over `documents`: language, near-duplicates, benchmarks, mix, token files.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all
but the last return the columns of `documents`.  Between stages a table is
written to the shared folder, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontamination, langid, mixing, orc_tokens, simhash
from cairn.llm.common import shared_dir, table

#: Near-duplicates: words of a shingle, and the Jaccard similarity from which texts are copies.
WIDTH, SIMILARITY = 5, 0.8
#: Candidates, which the exact similarity then confirms: bits in which fingerprints may differ, and equal places of 32 in
#: sketches.  At similarity 0.8, of random texts about one pair in 2,800 differs in more bits or agrees in fewer places.
RADIUS, AGREE = 20, 16

#: No SQL: the stages' models, fingerprints and tilings are beyond it.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has; those that the identifier rejects go.

    Null and empty texts and those without a letter are rejected.  Repeated
    rows stay; extra columns, whatever their names, come along.  Where no
    document has both a text and a language, none is known and all go.
    """
    return langid.known(docs, "text", langid.fit(docs, "text", "lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id stays, null ids last.

    Of rows that repeat an id and a text, one stays.  Texts without a word, null
    ones too, are copies of each other.
    """
    return simhash.one_of_each(docs, "doc_id", "text", width=WIDTH, similarity=SIMILARITY, radius=RADIUS, agree=AGREE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and null and empty items are held by none."""
    return decontamination.clean(docs, "text", table(spark, sf_dir, "benchmark"), "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source of its own.  Texts without a word go, as no mix
    needs them; rows that repeat an id and a text are one document, taken as
    often as all of them together.
    """
    return mixing.mixed(docs, "doc_id", "text", "source")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; returns, as read back, each document's place, length and checksum.

    Copies of a document are documents of their own.  Null texts count as empty.
    """
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    orc_tokens.write(docs, "doc_id", "text", path, public_tokenizers.path("byte_bpe_50k.json"))
    return orc_tokens.with_crc(orc_tokens.read(spark, path))


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("source mixing", mix), ("token files", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents at `sf_dir`."""
    out, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        if k:
            out.write.parquet(f"{folder}/{k}")
            out = spark.read.parquet(f"{folder}/{k}")
        out = stage(spark, out, sf_dir)
    return out
