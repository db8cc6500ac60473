"""Fit/gap registers and alignment scores over rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.scalar import clamp, code_rollup, question_key

# What each proposed disposition is worth as a starting point.
HARMONIZATION_BASE = {
    "ADOPT_GT": 90,
    "RETIRE_LEGACY": 85,
    "CONFIGURE_STANDARD": 80,
    "ADOPT_SAP_BP": 75,
    "USE_SAP_LOCALIZATION": 70,
    "REDESIGN_GT": 60,
    "REQUIRES_DECISION": 50,
    "OUT_OF_SCOPE": 50,
    "RETAIN_LOCAL_EXCEPTION": 30,
    "EXTEND_STANDARD": 20,
}
# The most that each localization state leaves.
HARMONIZATION_CAP = {"CONFIRMED_STATUTORY": 15, "SAP_DELIVERED": 25, "SUSPECTED": 50}
FIT_STEP = 5
MANDATORY = ("CONFIRMED_STATUTORY", "SAP_DELIVERED")
# Lower bounds of the alignment and harmonization bands.
BANDS = (90, 75, 60, 40, 0)
HARMONIZATION_BANDS = (80, 60, 40, 20, 0)


def pick(column: Column, table: dict, default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out if default is None else out.otherwise(default)


def band(value: Column, floors: Sequence[int] = BANDS) -> Column:
    """Index of the band, 0 the best; null stays null."""
    out = None
    for i, floor in enumerate(floors):
        out = F.when(value >= floor, i) if out is None else out.when(value >= floor, i)
    return out


def harmonization(disposition: Column, fit: Column, state: Column) -> Column:
    """Base of the disposition, moved by the fit, capped by the localization, in 0..100."""
    value = pick(disposition, HARMONIZATION_BASE) + F.lit(FIT_STEP) * (fit - 2)
    return clamp(F.least(value, pick(state, HARMONIZATION_CAP, 1000)), 0, 100).cast("int")


def alignment(ratings: DataFrame, weights: DataFrame, by: Sequence[str], dimension: str = "dimension", rating: str = "rating") -> DataFrame:
    """Weighted percentage of 0..4 ratings; unrated dimensions drop out, and
    nothing rated gives null."""
    w = ratings.join(F.broadcast(weights), dimension)  # one row a dimension
    rated = F.col(rating).isNotNull()
    total = F.sum(F.when(rated, F.col(rating) / 4 * 100 * F.col("weight")))
    return w.groupBy(*by).agg(F.round(F.round(F.try_divide(total, F.sum(F.when(rated, F.col("weight")))), 6), 1).alias("score"))


def localization_share(rows: DataFrame, by: Sequence[str], weight: Column, state: Column) -> DataFrame:
    """Share of the weight that is confirmed or delivered; suspected does not count."""
    part = F.sum(F.when(state.isin(*MANDATORY), weight).otherwise(0))
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.try_divide(part.cast("double"), F.sum(weight).cast("double")), F.lit(0.0)), 4).alias("share"))


def weighted_average(rows: DataFrame, by: Sequence[str], value: Column, weight: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.try_divide(F.sum(value * weight).cast("double"), F.sum(weight).cast("double")), 1).alias("average"))


def leading(rows: DataFrame, by: str, order: Sequence[Column], value: str, k: int, name: str, ways: int = 64) -> DataFrame:
    """(by, name): the first ``k`` values of each group in order, joined by commas.
    A group is dealt in ``ways`` first, each of which passes on its own first k."""
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64(value), F.lit(ways)))
    mine = dealt.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_way").orderBy(*order))).filter(F.col("_k") <= k)
    first = mine.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_k") <= k)
    items = F.array_sort(F.collect_list(F.struct("_k", F.col(value).cast("string").alias("v"))))
    return first.groupBy(by).agg(F.array_join(F.transform(items, lambda x: x["v"]), ",").alias(name))


def heatmap(rows: DataFrame, dims: DataFrame, dimension: str, materiality: str, state: Column, id_col: str) -> DataFrame:
    """Every dimension, also the quiet ones: count, musts, worst, and the first ids."""
    g = rows.groupBy(dimension).agg(F.count("*").alias("n"), F.count_if(state.isin(*MANDATORY)).alias("must"), F.max(materiality).alias("worst"))
    first = leading(rows, dimension, [F.col(id_col)], id_col, 5, "first_ids")
    return dims.join(g, dimension, "left").join(first, dimension, "left").select(dimension, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("must", F.lit(0)).alias("must"), "worst", F.coalesce("first_ids", F.lit("")).alias("first_ids"))


def risk_grid(rows: DataFrame, row: str, column: Column, bands: Sequence[int]) -> DataFrame:
    return rows.groupBy(row).pivot("_band", [str(b) for b in bands]).count() if "_band" in rows.columns else rows.withColumn("_band", column.cast("string")).groupBy(row).pivot("_band", [str(b) for b in bands]).count()


def agenda(rows: DataFrame, by: Sequence[str], order: Sequence[Column], minutes: str) -> DataFrame:
    """Position, and start and end minute, in running order."""
    w = Window.partitionBy(*by).orderBy(*order)
    end = F.sum(minutes).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"position": F.row_number().over(w), "start_minute": end - F.col(minutes), "end_minute": end})


def reuse(rows: DataFrame, code: str, classification: str, reusable: Sequence[str]) -> DataFrame:
    """Per rollup code and in total: steps, known, reused, coverage and reuse %."""
    level = rows.withColumn("l3", code_rollup(F.col(code)))
    known = F.col(classification) != "UNKNOWN"
    g = level.rollup("l3").agg(F.count("*").alias("steps"), F.count_if(known).alias("known"), F.count_if(F.col(classification).isin(*reusable)).alias("reused"))
    pct = lambda a, b: F.round(F.try_divide(F.col(a).cast("double") * 100, F.col(b).cast("double")), 1)
    return g.select(F.coalesce("l3", F.lit("ALL")).alias("l3"), "steps", "known", "reused", pct("known", "steps").alias("coverage"), pct("reused", "known").alias("reuse"))


def decision_pack(rows: DataFrame, code: str, question: str, options: str, weight: str) -> DataFrame:
    """Questions that read alike within a rollup code, with all their options and weight."""
    keyed = rows.withColumns({"l3": code_rollup(F.col(code)), "key": question_key(F.col(question))})
    each = keyed.groupBy("l3", "key").agg(F.count("*").alias("asked"), F.round(F.sum(weight), 4).alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(options)))).alias("options"))
    return each


def integration_impacts(rows: DataFrame, system: str, impact: str, step: str, interface: str) -> DataFrame:
    g = rows.groupBy(system).agg(F.countDistinct(step).alias("steps"), F.array_sort(F.collect_set(interface)).alias("interfaces"))
    per = rows.groupBy(system, impact).agg(F.count("*").alias("n")).groupBy(system).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(impact, "n")))).alias("impacts"))
    return g.join(per, system)


def gap_register(rows: DataFrame, materiality: Column, confidence: str, id_col: str) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("group").orderBy(materiality.desc(), confidence, id_col)))
