"""Nearest neighbours of a stated set of query vectors among all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .pairs import top

#: Vectors in a block of queries, and in a chunk of all vectors, about.
BLOCK, CHUNK = 256, 2048


def _best(frames: Iterator[pd.DataFrame], k: int, digits: int) -> Iterator[pd.DataFrame]:
    """Of one block of queries and one chunk of vectors, each query's best ``k`` and those that tie with the last."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            ids, names = (np.array([x["id"] for x in side], dtype=np.int64) for side in (row.queries, row.vectors))
            q, v = (np.stack([np.asarray(x["v"], dtype=np.float64) for x in side]) for side in (row.queries, row.vectors))
            found = np.floor(q @ v.T * 10**digits + 0.5) / 10**digits
            found[ids[:, None] == names] = -np.inf
            least = np.partition(found, -k, axis=1)[:, -k] if k < len(names) else np.full(len(ids), -np.inf)
            a, b = np.nonzero((found >= least[:, None]) & (found > -np.inf))
            yield pd.DataFrame({"query_id": ids[a], "neighbour_id": names[b], "similarity": found[a, b]})


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """The ``k`` most similar other vectors of each query: ``query_id``, ``neighbour_id``, ``similarity``, ``rank``.

    The stated queries meet all rows in blocks, exactly: queries are packed :data:`BLOCK` a row,
    all vectors :data:`CHUNK` a row, a block of the fewer queries is sent to every chunk (an
    equi-join on the chunk's number; a chunk moves once), and one matrix product gives the best
    ``k`` of the two. So no pair is a row, and a query moves about ``k`` rows a chunk. Similarity is rounded, and equal ones go by id; null
    keys and vectors are left out. All vectors are of one length.
    """
    def packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        parts = max(1, -(-rows.count() // size))
        named = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).dropna()
        return named.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias(name)), parts

    blocks, _ = packed(queries, BLOCK, "queries")
    chunks, n = packed(vectors, CHUNK, "vectors")
    sent = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"), "queries")
    best = chunks.join(sent, "part").select("queries", "vectors").mapInPandas(partial(_best, k=k, digits=digits), "query_id long, neighbour_id long, similarity double")
    return top(best, ["query_id"], [F.desc("similarity"), F.col("neighbour_id")], k)


def vote(neighbours: DataFrame, labels: DataFrame, key: str = "vec_id") -> DataFrame:
    """The commonest label of each query's neighbours; of equally common ones the least."""
    counted = neighbours.join(labels.select(F.col(key).alias("neighbour_id"), "label"), "neighbour_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    best = counted.groupBy("query_id").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"))
    return best.select("query_id", (-F.col("b.l")).cast("int").alias("label"), F.col("b.n").alias("votes"))
