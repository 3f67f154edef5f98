"""The corpus pipeline: toxicity, near-dedup, decontamination, PII, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of `documents`, and any
further ones under whatever names. Null and empty texts are clean and stay in
every filtering stage (near_dedup keeps one of each group of texts without
words); rows with a null id stay; repeated rows fare alike until near_dedup
keeps one of them; texts of any length are read whole; an empty table stays
empty. A stage's folder is removed when the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import remove_dir, shared_dir
from paperloom.llm.decontaminate import decontaminate
from paperloom.llm.pii import redact
from paperloom.llm.sentencepiece_bpe import piece_digests
from paperloom.llm.simhash import one_of_each
from paperloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on the labelled rows of `docs` that are not held out."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, of its rows the one of the smallest text hash."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark passages go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind's name; n_chars follows."""
    return redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("sentencepiece", sentencepiece)]

#: SQL can't express the trained stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_dir(spark, before)
        before = folder
    return docs
