"""Connected components by repeated contraction, without gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, for every node of links (columns a and b, bigint).

    Each round points a node at its smallest neighbour, shortens those pointers to their ends by doubling, and
    carries the links over to the ends; links within one component vanish. Rounds grow with the logarithm of the
    longest path. All joins have a hash-partitioned stored table on both sides, so adaptive execution can split
    the partition of a hub. Null ends, loops and repeated links are ignored; no links give no rows.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        while True:
            ahead = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = step.join(ahead, "root")
            if further.where("next <> root").isEmpty():
                break
            step = stored(further.select("node", F.col("next").alias("root")))
        if roots is None:
            roots = step
        else:
            again = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stored(roots.join(again, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        to = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        half = edges.join(to, "a").select("ra", F.col("b").alias("a"))
        edges = stored(
            half.join(to.withColumnRenamed("ra", "rb"), "a")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots
