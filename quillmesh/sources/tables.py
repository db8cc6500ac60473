"""Tables of a data folder, with one convention for time: UTC timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``; zoneless timestamps are read as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
