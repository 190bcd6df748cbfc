"""Session helpers that every operator here shares."""

from __future__ import annotations

import pickle
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a session that runs all
    in one process may do without that setting; on a cluster a folder of one machine would lose files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/tideglass"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. Results are lazy and may still read
    the files long after, so they go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that a partition of an explicit shuffle holds at most, on average.
PART_BYTES = 64 << 20


def parts(spark: SparkSession, size: int = 0) -> int:
    """Partitions for a shuffle of ``size`` bytes: the session's number, or more if the input is large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def index_of(df: DataFrame, name: str) -> int:
    """The place of a column: the exact name first, else the first one that differs in case alone."""
    if name in df.columns:
        return df.columns.index(name)
    low = [c.lower() for c in df.columns]
    if name.lower() not in low:
        raise ValueError(f"no column {name} among {df.columns}")
    return low.index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ...: no name of the input can then clash with one of an operator."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """``pick(df, doc_id=("id", "long"))``: the named columns cast and renamed, whatever else the table has."""
    plain = numbered(df)
    return plain.select(*(F.col(f"c{index_of(df, name)}").cast(kind).alias(to) for to, (name, kind) in wanted.items()))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes in all texts: one narrow aggregate, it sizes the blocks of the block exchange."""
    return pick(docs, text=(text, "string")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


class Shared:
    """A broadcast of any object. Spark pickles broadcasts by reference to their modules; these bytes carry
    this package's classes along."""

    def __init__(self, spark: SparkSession, value):
        self.raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "got" not in self.__dict__:
            self.got = pickle.loads(self.raw.value)
        return self.got

    def __getstate__(self):
        return {"raw": self.raw}


def filter_rows(docs: DataFrame, keep) -> DataFrame:
    """Rows for which ``keep(batch) -> mask`` holds, columns and their order untouched, without a shuffle.

    ``keep`` gets batches whose columns are named c0, c1, ... as names may repeat up to case.
    """

    plain = numbered(docs)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
