"""One query an operator, with production parameters, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.common import table
from tideglass.llm.decontaminate import contained_items
from tideglass.llm.embedding_dedup import embedding_duplicates
from tideglass.llm.language import identify_language
from tideglass.llm.lm_score import lm_score
from tideglass.llm.mixing import mix_sources
from tideglass.llm.near_dup import near_duplicates
from tideglass.llm.oracle import SQL  # noqa: F401
from tideglass.llm.pii import digest, find_pii
from tideglass.llm.quality import score_quality
from tideglass.llm.sharding import shard
from tideglass.llm.substring_dedup import substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


# Every query reads whole tables; nulls, empty texts, ties, repeated rows and empty tables are treated as the operator
# that it applies says. Columns beside those that an operator needs are never read.


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and removed of every document, by windows of 20 words that also start earlier."""
    return substring_dedup(table(spark, sf_dir, "documents"), window=20, keep_text=False)


def op2_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff scores of every document under all others, rounded so that sums in any order agree."""
    scores = lm_score(table(spark, sf_dir, "documents"), order=3, backoff=0.4)
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, repeated towards source shares by the square root of their rows, and shuffled globally."""
    return mix_sources(table(spark, sf_dir, "documents"), temperature=2.0, epochs=1.0, seed="mix")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, checksum and spans of personal data in every document."""
    return digest(find_pii(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out third."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a Jaccard similarity of 0.75 on five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=75)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fifth."""
    return identify_language(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a benchmark item's five-word shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, threshold=0.75)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 24."""
    out = shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_substring_dedup, op2_embedding_duplicates, op3_lm_score, op4_mix_sources, op5_pii, op6_quality, op7_near_duplicates, op8_language, op9_decontaminate, op10_shard)
}

