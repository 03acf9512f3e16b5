"""Incremental processing: streams over landing folders, queues, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over all that has landed and return what it
    wrote; the checkpoint in `folder` makes a rerun take only what is new."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def landed(spark: SparkSession, folder: str, schema, per_batch: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and type; rows later than `late` behind
    the watermark are left out of a stream's windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def claim(queue: DataFrame, now, n: int, lease_minutes: int = 10) -> DataFrame:
    """The n next items of a queue (id, priority, status, locked_at): pending
    ones and those whose lease has run out, by priority, then id."""
    free = (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("locked_at") < now - F.expr(f"interval {lease_minutes} minutes")))
    return queue.filter(free).orderBy(F.desc("priority"), "id").limit(n)


def after_failure(queue: DataFrame, now, most: int = 3, minutes: int = 2) -> DataFrame:
    """Failed items wait `minutes` times their attempts, or fail for good."""
    again = F.col("attempts") + 1 < most
    wait = F.make_dt_interval(mins=(F.col("attempts") + 1) * minutes)
    return queue.select("*", F.when(again, "pending").otherwise("failed").alias("next_status"), F.when(again, now + wait).alias("retry_at"))


def enqueue(queue: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add what is not there yet, once a key: rerunning changes nothing."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    fresh = new.withColumn("_rn", rn).filter("_rn = 1").drop("_rn").join(queue.select(*keys), keys, "left_anti")
    return queue.unionByName(fresh, allowMissingColumns=True)
