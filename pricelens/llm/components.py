"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..tables import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``(v, c)`` for every vertex of ``edges`` (``a``, ``b``, both long): ``c`` is a label that exactly the vertices of its component have.

    In each round a vertex joins its least neighbour if that is less than itself; edges are
    then drawn between what the vertices have become. An edge within one label goes, so the
    table shrinks to nothing. Nothing but emptiness tests comes to the driver.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v"))
    while edges.limit(1).count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("to"))
        up = checkpointed(up)
        for _ in range(2):  # pointer jumping
            up = up.join(up.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.col("next").alias("to"))
        up = checkpointed(up)
        labels = checkpointed(labels.join(up.select(F.col("v").alias("c"), "to"), "c", "left").select("v", F.coalesce("to", "c").alias("c")))
        moved = edges.join(up.select(F.col("v").alias("a"), F.col("to").alias("a2")), "a").join(up.select(F.col("v").alias("b"), F.col("to").alias("b2")), "b")
        edges = checkpointed(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    return labels
