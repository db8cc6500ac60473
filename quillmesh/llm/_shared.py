"""Where intermediate tables live, and small DataFrame helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In place of a null id: it sorts before all others, as nulls do in Spark.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a session on one machine names none (tests) is a temporary folder
    made, and remembered in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quillmesh.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.quillmesh.shared.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage is cut, and what one
    executor wrote outlives it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_lowest(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID).cast("long"))


def versioned(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(doc, ver, text) and the columns that identify a text.

    Ids are normally unique and then nothing is shuffled beyond the ids. Where
    an id comes with several texts each gets a version number, in text order;
    rows that repeat both share a version and so have the same result.
    """
    base = docs.select(id_or_lowest(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated = not docs.groupBy(id_or_lowest(id_col).alias("doc")).count().filter("count > 1").isEmpty()
    if not repeated:
        return base.select("doc", F.lit(0).alias("ver"), "text"), ["doc"]
    digest = base.select("doc", "text", F.sha2("text", 256).alias("dig"))
    ver = digest.select("doc", "dig").distinct()
    from pyspark.sql import Window

    ver = ver.select("doc", "dig", F.row_number().over(Window.partitionBy("doc").orderBy("dig")).alias("ver"))
    return digest.join(ver, ["doc", "dig"]).select("doc", "ver", "text"), ["doc", "ver"]


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of at most about ``size`` bytes for what runs meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def emit(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch from NumPy or Arrow columns; uint64 is taken bit for bit."""
    arrays = []
    for field in schema:
        v = columns[field.name]
        if not isinstance(v, pa.Array):
            if getattr(v, "dtype", None) is not None and v.dtype == "uint64":
                v = v.view("int64")
            v = pa.array(v, type=field.type)
        elif v.type != field.type:
            v = v.cast(field.type)
        arrays.append(v)
    pa.default_memory_pool().release_unused()  # idle workers of one executor add up
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Regroup a stream that is sorted by ``keys`` into tables of about ``rows``
    rows that never cut a group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            last = [t.column(k)[n - 1].as_py() for k in keys]
            lo, hi = 0, n - 1  # first row of the last group
            while lo < hi:
                mid = (lo + hi) // 2
                if [t.column(k)[mid].as_py() for k in keys] == last:
                    hi = mid
                else:
                    lo = mid + 1
            if lo:
                yield t.slice(0, lo)
                held, n = t.slice(lo).to_batches(), n - lo
    if n:
        yield pa.Table.from_batches(held)
