"""A judge's working in one shape, whatever its model answered.

Answers are JSON texts of several shapes, read as they come: an object or a list of
objects, whose fields are looked up by path in a ``variant`` and cast where they can
be. Missing and odd fields are null; what is no JSON gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Answer models, the kinds they make in order of precedence, and what ratings say.
KINDS = {"NLIStatementOutput": "claims", "ContextPrecisionOutput": "excerpts", "AnswerRelevanceOutput": "questions", "ContextRelevanceOutput": "ratings"}
RATINGS = {0: "not relevant", 1: "partly relevant", 2: "relevant"}
HIGHEST = 2


def _get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _truth(v: str, path: str) -> Column:
    """true, a number other than zero, or a text that is not empty."""
    words = F.when(_get(v, path, "string").isin("", "false", "0", "0.0"), False).when(_get(v, path, "string").isNotNull(), True)
    return F.coalesce(_get(v, path, "boolean"), _get(v, path, "double") != 0, words, F.lit(False))


def items(calls: DataFrame, by: str) -> DataFrame:
    """(by, kind, n, text, flag, reason, rating, label), one row an item.

    ``calls``: by, at (their order), model, answer, contexts (how many excerpts were
    judged). Of each group only its first kind counts. Excerpts are numbered by the
    order of their calls if there are as many calls as excerpts, else not at all;
    the other kinds by their order."""
    kind = F.lit(None).cast("string")
    for model, name in KINDS.items():
        kind = F.when(F.col("model") == model, name).otherwise(kind)
    read = calls.select(by, "at", "contexts", kind.alias("kind"), F.try_parse_json("answer").alias("v")).filter("kind is not null")
    rank = F.array_position(F.array(*map(F.lit, KINDS.values())), F.col("kind"))
    per = F.count_if(F.col("kind") == "excerpts").over(Window.partitionBy(by))
    read = read.withColumn("calls", per).filter("v is not null")
    # a list of rows, or one row
    rows = F.coalesce(_get("v", "$", "array<variant>"), F.array("v"))
    flat = read.select(by, "at", "contexts", "kind", "calls", F.posexplode(rows).alias("i", "r"))
    inner = F.when(F.col("kind") == "claims", F.coalesce(_get("r", "$.statements", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array("r"))
    flat = flat.select(by, "at", "contexts", "kind", "calls", "i", F.posexplode(inner).alias("j", "x"))
    first = flat.withColumn("rank", rank).withColumn("least", F.min("rank").over(Window.partitionBy(by))).filter("rank = least")
    place = F.row_number().over(Window.partitionBy(by).orderBy("at", "i", "j"))
    rating = F.when(F.col("kind") == "ratings", _get("x", "$.rating", "int"))
    label = F.lit("unrated")
    for value, name in RATINGS.items():
        label = F.when(rating == value, name).otherwise(label)
    numbered = (F.col("kind") != "excerpts") | (F.col("calls") == F.col("contexts"))
    by_kind = lambda **of: F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in of.items()))
    return first.select(
        by, "kind", F.when(numbered, place).alias("n"),
        by_kind(claims=_get("x", "$.statement", "string"), questions=_get("x", "$.question", "string")).alias("text"),
        by_kind(claims=_truth("x", "$.verdict"), excerpts=_truth("x", "$.verdict"), questions=_truth("x", "$.noncommittal")).alias("flag"),
        by_kind(claims=_get("x", "$.reason", "string"), excerpts=_get("x", "$.reason", "string")).alias("reason"),
        rating.alias("rating"), F.when(F.col("kind") == "ratings", label).alias("label"), place.alias("place"),
    )


def workings(calls: DataFrame, by: str) -> DataFrame:
    """(by, working): {"kind": ..., "items": [...]} as a JSON text, items in order."""
    found = items(calls, by)
    item = F.struct("place", F.struct("n", "text", "flag", "reason", "rating", "label").alias("item"))
    g = found.groupBy(by, "kind").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["item"]).alias("items"))  # one answer's items
    return g.select(by, F.to_json(F.struct("kind", "items")).alias("working"))
