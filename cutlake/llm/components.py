"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.llm.common import staged

_MAX_ROUNDS = 200


def _min_by_node(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of every node in ``links`` (a, b).

    Each round points all neighbours of a node at the smallest one, first the larger ones
    (large star), then the smaller ones (small star), and writes what is left to the shared
    folder. A hot node costs a partial minimum and a join that adaptive execution can
    split; nothing is gathered. The rounds end when every node points at a root.
    """
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = staged(down, "links")
    for _ in range(_MAX_ROUNDS):
        both = down.unionAll(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _min_by_node(both)
        large = both.join(least, both["a"] == least["node"]).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        least = _min_by_node(large)
        pointed = large.join(least, large["a"] == least["node"]).select("a", "b", "least")
        small = pointed.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("x"))
        down = staged(small.select("x.*").where("a <> b").distinct(), "links")
        parents = down.select(F.col("b").alias("parent")).distinct()
        if down.join(parents, down["a"] == parents["parent"], "left_semi").isEmpty():
            return down.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("the components did not settle")
