"""Corpus pipeline: quality rules, near-dedup, decontamination, pseudonyms, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, folder)
and returns a DataFrame, which is written as Parquet and read again as the
next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.llm import feistel_pii, latent_decontamination, quality_rules, simhash_dedup, transducer_bpe
from meterbook.llm.common import prepare, table, written
from meterbook.llm.queries import word_bpe
from meterbook.session import tune


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without benchmark items."""
    return latent_decontamination.clean(docs, table(spark, folder, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with personal data replaced; the number of characters follows the text."""
    done = feistel_pii.pseudonymise(docs)
    if "n_chars" not in done.columns:
        return done
    size = F.length("text").cast(done.schema["n_chars"].dataType)
    return done.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in done.columns])


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each document (little-endian 32 bit), and digests of ids and decoded text."""
    done = transducer_bpe.encode_documents(docs, word_bpe())
    n_tokens = (F.octet_length("ids") / 4).cast("bigint")
    return done.select("doc_id", n_tokens.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("pseudonymise", pseudonymise), ("encode", encode)]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(prepare(tune(spark)), folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)


#: Fingerprints, latent search, pseudonyms and tokens are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None
