"""Review queues, score reports, validators and comparison of result sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.graph import settled


def review_queue(rows: DataFrame, key: str, reasons: Sequence[tuple[str, Column]], draw: Column, size: int, reviewed: DataFrame | None = None) -> DataFrame:
    """Rows by their first reason, reasons in order, filled up with a drawn sample."""
    left = rows.join(reviewed.select(key), key, "left_anti") if reviewed is not None else rows
    rank = F.lit(len(reasons))
    reason = F.lit("sample")
    for i, (name, when) in reversed(list(enumerate(reasons))):
        rank, reason = F.when(when, i).otherwise(rank), F.when(when, name).otherwise(reason)
    return left.select(key, reason.alias("reason"), rank.alias("priority"), draw.alias("draw")).orderBy("priority", "draw", key).limit(size).select(key, "reason")


def score_report(scores: DataFrame, specs: DataFrame, value: str = "value") -> DataFrame:
    """pass at the target, watch down to the watch line, below under it; null stays unassessed."""
    j = specs.join(scores, "name", "left")
    v = F.col(value)
    return j.withColumn("status", F.when(v.isNull(), "not assessed").when(v >= F.col("goal"), "pass").when(v >= F.col("watch"), "watch").otherwise("below"))


def call_scores(calls: DataFrame, by: Sequence[str], error: Column, signature: Column) -> DataFrame:
    """Error rate and share of repeated calls; groups without calls have no row."""
    g = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(error).alias("errors"), F.countDistinct(signature).alias("different"))
    rate = lambda c: F.round(c.cast("double") / F.col("calls"), 4)
    return g.select(*by, "calls", rate(F.col("errors")).alias("error_rate"), (F.col("calls") - F.col("different")).alias("repeats"), rate(F.col("calls") - F.col("different")).alias("repeat_share"))


def violations(rows: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for every rule a row breaks; a rule that cannot be judged is not broken."""
    broken = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(broken).alias("rule"))


def same_rows(reference: DataFrame, got: DataFrame) -> DataFrame:
    """Rows as a bag over the reference's columns; further columns of ``got`` are allowed."""
    cols = reference.columns
    missing, extra = reference.exceptAll(got.select(*cols)), got.select(*cols).exceptAll(reference)
    a, b = (d.agg(F.count("*").alias(n)) for d, n in ((missing, "missing"), (extra, "extra")))
    return a.crossJoin(b).withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0))  # one row each


def holds_values(reference: DataFrame, got: DataFrame) -> DataFrame:
    """Whether every value of the reference occurs somewhere in ``got``."""
    cells = lambda d: d.select(F.explode(F.array(*(F.lower(F.col(c).cast("string")) for c in d.columns))).alias("v")).filter("v is not null").distinct()
    lost = cells(reference).join(cells(got), "v", "left_anti")
    return lost.agg(F.count("*").alias("missing")).withColumn("same", F.col("missing") == 0)


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Rows with their place from 1 in an order that leaves no ties. Ranges are sorted
    each by itself and counted, so that no task sees all rows."""
    ranged = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    placed = ranged.withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_at", "_part", "_nth", "_before")
