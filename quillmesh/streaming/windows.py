"""Windowed aggregates, de-duplication and staleness, in batch and in streams.

Each function takes a DataFrame that may be streaming; with ``late`` set, a
watermark bounds the state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if late else df


def tumbling(df: DataFrame, ts: str, size: str, by: tuple[str, ...], value: str, late: str | None = None) -> DataFrame:
    g = _marked(df, ts, late).groupBy(F.window(ts, size).alias("w"), *by)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, ts: str, size: str, slide: str, by: tuple[str, ...], value: str, late: str | None = None) -> DataFrame:
    g = _marked(df, ts, late).groupBy(F.window(ts, size, slide).alias("w"), *by)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: tuple[str, ...], late: str | None = None) -> DataFrame:
    g = _marked(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by)
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def deduplicated(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first of equal keys; in a stream within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def stream_of(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """A table of a folder as a stream of its files, times read as UTC. A round takes
    files of so many bytes, or so many files: each round starts every state task anew."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a stream source takes a folder: that of the file, filtered to it
    single = path.rsplit("/", 1)
    df = spark.readStream.schema(schema).option(*(("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", bytes_per_trigger))).option("pathGlobFilter", "*.parquet")
    out = df.parquet(f"{single[0]}/{name}.parquet*")
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return out.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else out


def run_to_table(df: DataFrame, shared: str, mode: str = "append", finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drive a stream over what is available now; the result as a table in the
    shared folder. Complete and update results go through foreachBatch."""
    spark = df.sparkSession
    at = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/out").start()
    else:
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    out = spark.read.schema(df.schema).parquet(f"{at}/out")
    return finish(out) if finish else out
