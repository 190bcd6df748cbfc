"""Jump consistent hashing of stable keys to shards, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import index_of, numbered

#: The generator's fixed multiplier in the published algorithm.
MULTIPLIER = 2862933555777941757
LIMB = 22
MASK = (1 << LIMB) - 1
BLOCKS = 256
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the key's shard among ``shards``, and among one more.

    Unsigned 64-bit products are taken in limbs of 22, 22 and 20 bits, which never overflow a long.
    """
    c0, c1, c2 = MULTIPLIER & MASK, MULTIPLIER >> LIMB & MASK, MULTIPLIER >> 2 * LIMB

    def step(a: Column, _: Column) -> Column:
        k0, k1, k2 = a["k0"], a["k1"], a["k2"]
        low = k0 * c0 + 1
        mid = k0 * c1 + k1 * c0 + F.shiftright(low, LIMB)
        top = (k0 * c2 + k1 * c1 + k2 * c0 + F.shiftright(mid, LIMB)).bitwiseAND((1 << 20) - 1)
        mid_kept = mid.bitwiseAND(MASK)
        high = F.shiftleft(top, 11) + F.shiftright(mid_kept, 11)  # bits 33 to 63
        nxt = F.floor((a["next"] + 1) * (F.lit(2147483648.0) / (high + 1)))
        moved = F.struct(
            low.bitwiseAND(MASK).alias("k0"), mid_kept.alias("k1"), top.alias("k2"),
            nxt.cast("long").alias("next"),
            F.when(a["next"] < shards, a["next"]).otherwise(a["shard"]).alias("shard"),
            a["next"].alias("grown"),
        )
        return F.when(a["next"] > shards, a).otherwise(moved)

    zero = F.lit(0).cast("long")
    start = F.struct(
        key.bitwiseAND(MASK).alias("k0"), F.shiftright(key, LIMB).bitwiseAND(MASK).alias("k1"), F.shiftrightunsigned(key, 2 * LIMB).alias("k2"),
        zero.alias("next"), zero.alias("shard"), zero.alias("grown"),
    )
    out = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)
    return F.struct(out["shard"].cast("int").alias("shard"), out["grown"].cast("int").alias("grown"))


def shard(docs: DataFrame, shards: int = 24, blocks: int = BLOCKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Give every row a shard by its key, and a slot in that shard.

    Adds size (UTF-8 bytes of the text plus 8), text_crc32, law (``key``: the id and the number of shards
    decide), shard, slot (0, 1, ... without gaps in each shard) and grown_shard (the shard with one more
    shard; it differs from ``shard`` only where it is the new one). Input columns of these names are replaced.

    Slots follow (block, id); a block is id plus checksum modulo ``blocks``, so that no task orders a whole
    shard. Only ``shards * blocks`` counts are broadcast, whatever the input's size.

    A null text has size 8 and the checksum of no bytes, 0. A null id is keyed by the checksum and stands
    last in its block. Repeated rows share a shard and get a slot each. An empty table gives an empty result.
    Other columns stay, whatever their names.
    """
    own, body = F.col(f"c{index_of(docs, doc_id)}").cast("long"), F.col(f"c{index_of(docs, text)}").cast("string")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.encode(F.coalesce(body, F.lit("")), "UTF-8"))
    keyed = numbered(docs).withColumns({"id": own, "size": size, "text_crc32": crc}).withColumn("key", F.coalesce("id", "text_crc32"))
    block = F.pmod(F.pmod(F.col("key"), F.lit(blocks)) + F.col("text_crc32"), F.lit(blocks))
    keyed = keyed.withColumns({"to": jump(F.col("key"), shards), "block": block})
    keyed = keyed.withColumns({"law": F.lit("key"), "shard": F.col("to.shard"), "grown_shard": F.col("to.grown")})
    before = Window.partitionBy("of_shard").orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(F.col("shard").alias("of_shard"), F.col("block").alias("of_block")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("of_shard", "of_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy(F.col("id").asc_nulls_last(), "text_crc32")
    placed = keyed.withColumn("row", F.row_number().over(within))
    joined = placed.join(F.broadcast(offsets), (F.col("shard") == F.col("of_shard")) & (F.col("block") == F.col("of_block")))
    joined = joined.withColumn("slot", F.col("offset") + F.col("row") - 1)
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in ADDED]
    return joined.select(*(f"c{i}" for i in keep), *ADDED).toDF(*(docs.columns[i] for i in keep), *ADDED)
