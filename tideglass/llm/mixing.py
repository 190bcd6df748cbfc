"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import index_of, numbered, parts, text_bytes

#: More sources than this are joined by shuffle; a source's row has at most some 500 numbers. Each source is then
#: dealt to SALTS keys, so that a large one is joined by many tasks.
BROADCAST_SOURCES, SALTS = 2000, 64
ADDED = ("copies", "copy", "shuffle_key")
#: A larger mean is the sum of several independent draws: exp(-mean) stays a normal number.
MOST_MEAN = 256.0


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from 52 bits of MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below double precision."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["cdf"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, epochs: float) -> DataFrame:
    """For each source: its rows, target weight, mean number of copies of a row, draws and their distribution."""
    stats = docs.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(1 / temperature))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("of").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(raw)
    stats = stats.withColumn("w", raw)
    total = stats.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))  # one row
    rate = F.when(F.col("all_w") > 0, F.lit(float(epochs)) * F.col("all_n") * F.col("w") / F.col("all_w") / F.col("n")).otherwise(0.0)
    stats = stats.join(F.broadcast(total)).withColumn("rate", rate)
    stats = stats.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int"))
    return stats.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws"))).select("of", "draws", "cdf")


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 2.0, epochs: float = 1.0, seed: str = "mix",
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Replicate rows so that sources have the target shares, and shuffle them globally.

    A source's rows are repeated ``epochs * rows * share / rows of the source`` times on average; each row's
    number is the Poisson quantile at a hash of seed and id. Targets: ``weights`` by source (0 for others),
    else rows to the power 1/temperature. Adds copies, copy (1 to copies) and shuffle_key, by whose hash rows
    are dealt to partitions, sorted by it within each; input columns of these names are replaced, all others
    stay, whatever their names.

    A null source is a source of its own; rows with a null id are drawn by their text (null and empty alike), so
    equal ones alike, as are rows that repeat an id. No positive weight, or no rows: no output.
    """
    spark = docs.sparkSession
    own = {name: F.col(f"c{index_of(docs, name)}") for name in (doc_id, source, text)}
    key = F.coalesce(own[doc_id].cast("string"), F.md5(F.coalesce(own[text].cast("string"), F.lit(""))))
    rows = numbered(docs).withColumns({"source": own[source].cast("string"), "key": key})
    rates = source_rates(rows, weights, temperature, epochs)
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("of")))
    else:
        rates = rates.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        joined = joined.join(rates, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda n, i: n + F.size(F.filter(F.col("cdf"), lambda c: c <= uniform(F.lit(seed), F.col("key"), i.cast("string")))),
    )
    out = joined.withColumn("copies", drawn).filter("copies > 0")
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in ADDED]
    out = out.select(*(f"c{i}" for i in keep), "key", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("key"), F.lit("copy"), F.col("copy").cast("string")))).drop("key")
    size = int(text_bytes(docs, text) * max(1.0, epochs))
    return out.repartition(parts(spark, size), "shuffle_key").sortWithinPartitions("shuffle_key").toDF(*(docs.columns[i] for i in keep), *ADDED)
