"""Windowed aggregates over an event stream, and a run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def hourly(log: DataFrame, late: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "type", "n")


def storms(log: DataFrame, seconds: int = 60, slide: int = 10, least: int = 5) -> DataFrame:
    bad = log.where("http_status >= 500").withWatermark("ts", f"{seconds} seconds")
    per = bad.groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), "path").agg(F.count("*").alias("n"))
    return per.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "path", "n")


def sessions(log: DataFrame, gap: str = "10 minutes") -> DataFrame:
    per = log.withWatermark("ts", gap).groupBy(F.session_window("ts", gap), "sid").agg(F.count("*").alias("n"))
    return per.select("sid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def after_cutoff(log: DataFrame, cutoff: str, late: str = "1 hour") -> DataFrame:
    """Late rows of before a clear do not come back."""
    return log.withWatermark("ts", late).where(F.col("ts") >= F.lit(cutoff).cast("timestamp"))


def drained(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """The result of a streaming query once everything there has been read, as a table in the shared folder.

    Complete mode replaces the table with each micro-batch. In append mode each micro-batch has a
    folder of its own, which a batch that is run again replaces.
    """
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/quietlake-{label}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out)
    return found if mode == "complete" else found.select(*stream.columns)
