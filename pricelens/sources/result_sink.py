"""A table of results that a stream fills: exactly once over restarts, the last word on each item kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(folder: str, order: str):
    """A batch writer for ``foreachBatch``: the batch takes the partition of its number.

    Spark replays a batch that a crash has left open under its old number, so a replay writes
    over what the first try has left, whole or in part, and changes nothing else. A batch
    without rows writes nothing.
    """

    def save(batch: DataFrame, number: int) -> None:
        ordered = batch.withColumns({"batch": F.lit(number).cast("long"), "arrival": F.col(order).cast("string")})
        ordered.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)

    return save


def stream_results(results: DataFrame, folder: str, log: str, order: str = "finished_at", **trigger) -> StreamingQuery:
    """Starts writing the stream ``results`` (``run_id``, ``idx``, ``order`` and further columns) below ``folder``; ``log`` is the query's checkpoint."""
    return results.writeStream.foreachBatch(write_batch(folder, order)).option("checkpointLocation", log).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that was written, with ``batch`` and ``arrival``."""
    return spark.read.parquet(folder)


def saved_items(written: DataFrame, order: Column | None = None) -> DataFrame:
    """The last result of each run and index: of the latest batch, in it the latest by ``order`` (else by ``arrival``). Aggregated before the shuffle; rows without a run or index are left out."""
    rest = [c for c in written.columns if c not in ("run_id", "idx")]
    last = F.max_by(F.struct(*rest), F.struct("batch", (F.col("arrival") if order is None else order).alias("o")))
    return written.where("run_id is not null AND idx is not null").groupBy("run_id", "idx").agg(last.alias("x")).select("run_id", "idx", "x.*")


def done_counts(written: DataFrame) -> DataFrame:
    """How many items each run has results for, counted anew: replaced items count once."""
    return written.where("run_id is not null AND idx is not null").groupBy("run_id").agg(F.countDistinct("idx").alias("done_count"))


def as_lines(items: DataFrame) -> DataFrame:
    """A line of JSON for each item, with its ``index``, in the order of arrival (``batch``, ``arrival``)."""
    fields = [c for c in items.columns if c not in ("batch", "arrival", "idx")]
    return items.select("batch", "arrival", F.to_json(F.struct(F.col("idx").alias("index"), *fields)).alias("value")).orderBy("batch", "arrival").select("value")
