"""Structured Streaming: windowed counts of events with late data, and the answer filter over arriving samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.modelfilter import FilterOptions, ask_model, evaluate
from millrace.storage import new_path, read_table


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total): tumbling or sliding windows of event time; state of closed windows is dropped."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n): events of a user with no pause of `gap` between them."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def run_once(spark: SparkSession, folder: str, table: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Streams a folder's Parquet table through a plan until it is drained; the last state of each key is returned.

    Each micro-batch's updates replace what earlier ones said in full, since mode `complete` hands over all groups.
    """
    batch = spark.read.parquet(f"{folder}/{table}.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{table}.parquet" if not batch.inputFiles()[0].rsplit("/", 1)[1].startswith("part-") else "*.parquet")
    source = folder if not batch.inputFiles()[0].rsplit("/", 1)[1].startswith("part-") else f"{folder}/{table}.parquet"
    out, progress = new_path(spark, "stream"), new_path(spark, "stream-progress")
    plan_df = plan(stream.parquet(source))

    def save(part: DataFrame, _: int) -> None:
        part.write.mode("overwrite").parquet(out)

    query = plan_df.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_table(spark, out, plan_df)


def filter_stream(samples: DataFrame, ask: Callable[[str], str], opts: FilterOptions, kept_path: str, rejected_path: str, checkpoint: str):
    """Starts a stream that asks the model for each arriving sample and routes it; files of a batch are written again if it is repeated."""

    def route(batch: DataFrame, number: int) -> None:
        done = evaluate(ask_model(batch, ask, opts), opts).persist()
        done.filter("passed").write.mode("overwrite").json(f"{kept_path}/batch={number}")
        done.filter("not passed").write.mode("overwrite").json(f"{rejected_path}/batch={number}")
        done.unpersist()

    return samples.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
