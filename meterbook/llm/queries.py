"""The queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.llm import backoff_lm, conversation_repair, crf_quality, elias_fano, feistel_pii, fragment_join, html_layout, kk_sharding, latent_decontamination, quality_rules, shallot_clusters, simhash_dedup, transducer_bpe
from meterbook.llm.common import table
from meterbook.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of near copies for every document."""
    return simhash_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op5_quality_rules", quality_rules.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts and adaptive verdict for every document."""
    return quality_rules.quality(table(spark, folder, "documents"))


@query("op10_feistel_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with personal data replaced by pseudonyms, and how many of them."""
    done = feistel_pii.pseudonymise(table(spark, folder, "documents"), kinds_col="kinds")
    return done.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_join(F.array_distinct("kinds"), ",").alias("kinds"))


@query("op2_kk_sharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot for every document."""
    return kk_sharding.shard_rows(table(spark, folder, "documents"))


@query("op3_crf_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return crf_quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_html_layout")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Visible text of every page."""
    done = html_layout.extract(table(spark, folder, "pages"))
    return done.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def word_bpe() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_transducer_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    return transducer_bpe.digest_documents(table(spark, folder, "documents"), word_bpe())


@query("op8_elias_fano")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of the ids of every document, read back from the files."""
    return elias_fano.store_and_read(table(spark, folder, "documents"), word_bpe())


@query("op6_backoff_lm", backoff_lm.SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all documents; rounded, as sums differ in their last bits."""
    scored = backoff_lm.score_documents(table(spark, folder, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


@query("op9_latent_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, and which."""
    return latent_decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repair of every conversation, damaged first."""
    rows = table(spark, folder, "conversations")
    return conversation_repair.audits(conversation_repair.damage(rows), rows)


@query("op12_shallot_clusters", shallot_clusters.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector, with inertia and centroid."""
    return shallot_clusters.cluster(table(spark, folder, "embeddings"))


@query("op13_fragment_join")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Number of five-word shingles and group of every document."""
    return fragment_join.jaccard_groups(table(spark, folder, "documents"))
