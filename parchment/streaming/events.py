"""Structured Streaming forms of the batch operators. Additions: the batch model needs none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpointed


def first_deliveries(stream: DataFrame, key: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each key once, though delivered again within ``delay``; state is dropped behind the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, size: str, by: str, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, by: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions by gap, merged as late rows arrive."""
    s = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for the input at hand: run to its end, each batch written to the shared folder."""
    from uuid import uuid4

    checkpointed(spark.range(1))  # makes sure that a checkpoint folder is set
    out = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"
    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
