"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is its least reachable node.

    Every round hooks each label to its least neighbour if that is smaller, follows the hooks twice, and
    contracts the links to labels, until none is left between two labels. Links stay distributed; one row
    comes to the driver each round to tell whether any is left.

    Links with a null end and links of a node to itself count for nothing; repeated links and both directions of
    one are one link. No links give an empty result.
    """
    links = materialise(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b"), "links")
    labels = materialise(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while links.limit(1).count():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("to")).filter("to < label")
        hooks = materialise(hooks, "hooks")
        for _ in range(2):
            further = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(further, "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        hooks = materialise(hooks, "hooks")

        def moved(df: DataFrame, column: str, hooks: DataFrame = hooks) -> DataFrame:
            at = hooks.select(F.col("label").alias(column), F.col("to").alias("__to"))
            return df.join(at, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")

        labels = materialise(moved(labels, "component"), "labels")
        links = materialise(moved(moved(links, "a"), "b").filter("a <> b").distinct(), "links")
    return labels
