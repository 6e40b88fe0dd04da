"""Structured Streaming over arriving files: windows that close by a watermark, and keys not seen before.

A run takes what has arrived since the checkpoint and ends (availableNow); a crashed or stopped run goes on from
there. A batch is written to a folder of its own number, over what a crashed attempt left of it, so every row of
the result is there once whatever happens in between. State is a row an open window and key, or a row a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators.temporal import micros
from ..plans.tables import filesystem


def arrivals(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A stream of the parquet files that come into a folder and the folders in it."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def closed_windows(stream: DataFrame, at: str, by: list[str], width: str, delay: str) -> DataFrame:
    """start (microseconds since 1970), by and n: the rows of each window and key, once its end is delay behind the
    latest time of an earlier batch. Rows of windows that were closed before their batch are late and left out;
    rows without a time have no window."""
    timed = stream.withColumn("__at", F.timestamp_micros(micros(at))).withWatermark("__at", delay)
    counted = timed.groupBy(F.window("__at", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_micros("w.start").alias("start"), *by, "n")


def unseen(stream: DataFrame, text: Column) -> DataFrame:
    """text: stripped texts, not blank, each when it first arrives."""
    return stream.select(T.strip(text).alias("text")).where(T.non_blank("text")).dropDuplicates(["text"])


def run(results: DataFrame, checkpoint: str, out: str) -> None:
    """Takes all that has arrived and appends the results below out, a folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    started = results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()


def results(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All batches so far; an empty table before the first."""
    fs, p = filesystem(spark, out)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
