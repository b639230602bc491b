"""Windowed aggregates over event streams; each is the same function on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, n, total) per fixed window.  Values are summed as decimals, so order does not matter."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(user_id, session_start, session_end, n) of runs of events without a longer gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now; the result as a table.

    The folder holds the checkpoint and each batch as Parquet under its number: a batch that is run again replaces
    itself, and no rows pass the driver.  Without any batch the table is empty.
    """
    done: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        done.append(f"{folder}/rows/{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    paths = done[-1:] if mode == "complete" else done
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The events below a folder as a stream with a timestamp in the session's zone."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
