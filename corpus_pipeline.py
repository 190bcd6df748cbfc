"""The corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm.common import materialise, table
from tideglass.llm.decontaminate import drop_contaminated
from tideglass.llm.mixing import mix_sources
from tideglass.llm.near_dup import drop_near_duplicates
from tideglass.llm.quality import keep_quality
from tideglass.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject.

    Null and empty texts get the score of a text without features; a score of just 0.5 stays; repeated rows and null
    ids are judged like others; without labels all stay. An empty table gives an empty result."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the least id.

    Null, empty and blank texts and null ids are in no class and stay; of rows that repeat an id one stays; a
    similarity of just 0.75 links. An empty table gives an empty result."""
    return drop_near_duplicates(docs, width=5, percent=75)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; items without words are in no document; a containment of just 0.75 counts;
    repeated rows are judged alike. An empty table gives an empty result, and without items all rows stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=5, threshold=0.75)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) so that sources have their target shares, in a global shuffle.

    A null source is a source of its own; a null id is drawn by its text; rows that repeat an id are drawn alike. An
    empty table gives an empty result."""
    return mix_sources(docs, temperature=2.0, epochs=1.0, seed="mix").select(*docs.columns)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there.

    A null text counts no bytes; a null id is keyed by its text and stands last in its block; repeated rows share a
    shard and get a slot each. An empty table gives an empty result."""
    return shard(docs, shards=24)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", to_shards)]

#: A fitted classifier and MinHash are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
