"""Writers: partitioned tables, Markdown documents, and upserts as new versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.scalar import cell_escape


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type and edges by relation, replacing what was there."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row as a line of a Markdown table."""
    cells = [F.coalesce(cell_escape(F.col(c).cast("string")), F.lit("")) for c in columns]
    return df.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_documents(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str], title: Column) -> DataFrame:
    """One Markdown document per group: a heading and a table of its rows in order."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    lined = markdown_rows(df, columns)
    items = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lined.groupBy(by).agg(items.alias("_i")).select(by, F.concat(F.lit("# "), title, F.lit("\n\n" + head + "\n"), F.array_join(F.transform("_i", lambda x: x["line"]), "\n")).alias("document"))


def write_csv(df: DataFrame, path: str, nulls: str = "") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", nulls).csv(path)


def append_batch(path: str):
    """A foreachBatch function that appends each micro-batch once: a batch that is
    run again replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
