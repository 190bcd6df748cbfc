"""The partitioned store: tables under ``<base>/data/table_type=T/service=S/date=D/*.parquet``."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tideglass.operators.compaction import live_paths
from tideglass.schemas import EVENT_TIME, PARTITIONS, TABLES

TTL_S = 10.0


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/data/table_type={name}"


def scan(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table under its fixed schema. Files that are not Parquet are passed over, a missing or empty
    directory is an empty table, and files that a compaction has replaced are not read."""
    schema, path = TABLES[name], table_path(base, name)
    reader = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("basePath", path)
    paths = live_paths(base, name)
    try:
        df = reader.parquet(*paths) if paths else reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return df.select(*schema.names)


class Catalog:
    """Temporary views over a store. A view pins its file list, so views older than ``ttl`` are made anew;
    new files show after that time at most, or at once after ``refresh``."""

    def __init__(self, spark: SparkSession, base: str, ttl: float = TTL_S, clock=time.monotonic):
        self.spark, self.base, self.ttl, self.clock, self.made = spark, base, ttl, clock, None

    def refresh(self) -> None:
        for name in TABLES:
            scan(self.spark, self.base, name).createOrReplaceTempView(name)
        self.made = self.clock()

    def ensure(self) -> None:
        if self.made is None or self.clock() - self.made > self.ttl:
            self.refresh()

    def table(self, name: str) -> DataFrame:
        self.ensure()
        return self.spark.table(name)


#: Rows of one partition that one task writes at most, about a file of 128 MB.
FILE_ROWS = 2_000_000


def append(df: DataFrame, base: str, name: str, file_rows: int = FILE_ROWS) -> None:
    """Add rows, as few files a partition; rows within a file are in time order, which makes statistics useful.

    The rebalance before the write brings a partition's rows together, and splits partitions that are large, so
    that a busy service's day is neither one task nor one file."""
    kept = df.select(*TABLES[name].names).hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, EVENT_TIME[name])
    kept.write.mode("append").option("maxRecordsPerFile", file_rows).partitionBy(*PARTITIONS).parquet(table_path(base, name))
