"""A bounded sample of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 1 << 30


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(n))


def bounded_sample(rows: DataFrame, fit_rows: int, fit_bytes: int) -> DataFrame:
    """Rows with columns doc_id and text, picked by a hash of the id: ``fit_rows`` and ``fit_bytes`` of text at most.

    Ids are taken in the order of their hash as long as all rows of an id fit. Only ids and sizes of about
    ``fit_rows`` rows come to the driver."""
    share = min(1.0, 1.2 * fit_rows / max(1, rows.count()))
    rows = rows.withColumn("pick", F.xxhash64("doc_id")).filter(F.pmod("pick", F.lit(UNIT)) < int(share * UNIT))
    sizes = rows.groupBy("pick").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    chosen, n, size = [], 0, 0
    for r in sorted(sizes.collect(), key=lambda r: (r.pick % UNIT, r.pick)):
        if n + r.n <= fit_rows and size + r["size"] <= fit_bytes:
            chosen.append((r.pick,))
            n, size = n + r.n, size + r["size"]
    picked = rows.sparkSession.createDataFrame(chosen, "pick long")
    return rows.join(F.broadcast(picked), "pick", "left_semi").drop("pick")
