"""Event-time jobs over the event stream, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import shared_folder


def source(spark: SparkSession, path: str) -> DataFrame:
    """The event files as a stream, in the schema of the table."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives by the end of the present input, read back as a table from the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/rows")

        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{at}/log").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def hourly_totals(events: DataFrame) -> DataFrame:
    """Events and their value by hour and type; late rows within two hours count."""
    return (
        events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents"))
        .select(F.col("window.start").alias("hour"), "event_type", "n", "cents")
    )


def first_of_candidates(events: DataFrame) -> DataFrame:
    """Each event id once, whatever its repeats within the watermark."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])


def sliding_counts(events: DataFrame) -> DataFrame:
    """Events by user in windows of a day that start every six hours, while the watermark holds them."""
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day", "6 hours"), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def session_counts(events: DataFrame) -> DataFrame:
    """Sessions of a user with gaps of less than an hour."""
    return events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
