"""Support scores, independence of sources, quotes and audit trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.scalar import clamp, jaccard, normal_text
from quillmesh.functions.vectors import cosine
from quillmesh.operators.graph import settled

# Fixed values of the support score.
BASE = 0.50
PER_SOURCE = 0.15
GRAPH = 0.10
CONTRADICTED = -0.25
MACHINE_READ = -0.15
IDENTIFIER_ABSENT = -0.10
CAP_DISCUSSION = 0.40
CAP_TEMPLATE = 0.35
CAP_BOILERPLATE = 0.30
GRAPH_ONLY = 0.35
CONTEXT_ONLY = 0.20
LOWEST, HIGHEST = 0.05, 0.95
NEAR = 0.93  #: cosine from which two documents count as one source


def support_score(independent: Column, graph: Column, contradicted: Column, machine_read: Column, identifier_absent: Column, discussion: Column, template: Column, boilerplate: Column, context: Column) -> Column:
    """Terms add up from the base; the lowest cap that applies holds; nothing at
    all scores 0, and facts or context alone have fixed scores."""
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    total = F.lit(BASE) + PER_SOURCE * (independent - 1) + on(graph, GRAPH) + on(contradicted, CONTRADICTED) + on(machine_read, MACHINE_READ) + on(identifier_absent, IDENTIFIER_ABSENT)
    cap = F.least(F.when(discussion, CAP_DISCUSSION).otherwise(1.0), F.when(template, CAP_TEMPLATE).otherwise(1.0), F.when(boilerplate, CAP_BOILERPLATE).otherwise(1.0))
    scored = clamp(F.least(total, cap), LOWEST, HIGHEST)
    return F.round(F.when(independent >= 1, scored).when(graph, GRAPH_ONLY).when(context, CONTEXT_ONLY).otherwise(0.0), 4)


def centroids(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """Mean vector per group; sums are pre-aggregated by component, so that a
    group's vectors never meet in one place."""
    parts = vectors.select(by, F.posexplode(vector_col).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def near_pairs(lists: DataFrame, by: str, id_col: str, vector_col: str, least: float = NEAR) -> DataFrame:
    """(by, a, b, similarity) of the pairs in each bounded list (the hits of one
    question), a < b, at or above ``least``."""
    a = lists.select(by, F.col(id_col).alias("a"), F.col(vector_col).alias("va"))
    b = lists.select(by, F.col(id_col).alias("b"), F.col(vector_col).alias("vb"))
    near = a.join(b, by).filter("a < b").select(by, "a", "b", cosine(F.col("va"), F.col("vb")).alias("s"))
    return near.filter(F.col("s") >= least).select(by, "a", "b", F.round("s", 6).alias("similarity"))


CELL = 512  #: about so many sets of one token are held against each other in one piece


def similar_sets(items: DataFrame, id_col: str, tokens: Column, percent: int = 50) -> DataFrame:
    """(a, b, jaccard): items whose token sets are at least ``percent`` alike.

    Items of one set are a class, named by its smallest id and told as pairs
    (class, member, 1.0). Classes meet by a prefix: tokens are numbered from rare
    to frequent, and two sets that are alike enough share one of their first few,
    fewer in the shorter set than in the longer. They are compared at the first
    token that they share, and a token of many sets is dealt in cells.
    """
    sets = settled(items.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("w")).filter("size(w) > 0"), "sets")
    heads = settled(sets.groupBy("w").agg(F.min("id").alias("head")).filter("head is not null").withColumn("class", F.monotonically_increasing_id()), "heads")
    each = heads.select("class", "head", F.explode("w").alias("word"))
    # any numbers do that differ and are written once; their order only decides how many sets meet
    order = each.groupBy(F.col("word").alias("t")).agg(F.count("*").alias("df")).orderBy("df", "t").select("t", F.monotonically_increasing_id().alias("place"))
    numbered = each.join(settled(order, "places"), F.col("word").eqNullSafe(F.col("t"))).groupBy("class", "head").agg(F.array_sort(F.collect_list("place")).alias("s"))
    numbered = settled(numbered.withColumns({"n": F.size("s"), "named": F.count("*").over(Window.partitionBy("head"))}), "numbered")

    def prefix(least: Column) -> DataFrame:
        return numbered.select("*", F.posexplode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(least) + 1).cast("int"))).alias("k", "t"))

    # of a set, what it shares at least with one as long or longer, and with one as long or shorter
    shorter, longer = prefix(F.col("n") * 2 * percent / (100 + percent)), prefix(F.col("n") * percent / 100)
    many = longer.groupBy("t").agg(F.ceil(F.count("*") / CELL).alias("cells")).filter("cells > 1")
    cells = F.coalesce("cells", F.lit(1))
    own, every = F.pmod(F.xxhash64("class"), cells), F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))
    side = lambda df, c, i, j: df.join(many, "t", "left").select("t", i.alias("i"), j.alias("j"), *(F.col(x).alias(x + c) for x in ("head", "n", "k", "s")))
    enough = lambda shared: (100 + percent) * shared >= percent * (F.col("nx") + F.col("ny"))
    shared = F.size(F.array_intersect("sx", "sy"))
    fits = (
        F.when(F.col("nx") == F.col("ny"), F.col("headx") < F.col("heady")).otherwise((F.col("nx") < F.col("ny")) & (F.col("headx") != F.col("heady")))
        & (100 * F.col("nx") >= percent * F.col("ny"))
        & enough(F.least(F.col("nx") - F.col("kx"), F.col("ny") - F.col("ky")))  # no more than what follows in both
        & ~F.arrays_overlap(F.slice("sx", F.lit(1), F.col("kx")), F.slice("sy", F.lit(1), F.col("ky")))  # else they met before
        & enough(shared)
    )

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        # sets travel with their prefixes and are compared where they meet, so that only pairs that are alike are written
        # merge: the files that tell a side's size hold sets, not what their prefixes become
        both = side(x, "x", own, every).hint("merge").join(side(y, "y", every, own), ["t", "i", "j"]).filter(fits)
        return both.select(F.least("headx", "heady").alias("a"), F.greatest("headx", "heady").alias("b"), (shared / (F.col("nx") + F.col("ny") - shared)).alias("j"))

    # only an id that names several classes can give a pair twice; the others' pairs are written as they are found
    several = met(shorter.filter("named > 1"), longer).unionByName(met(shorter.filter("named = 1"), longer.filter("named > 1"))).distinct()
    alike = several.unionByName(met(shorter.filter("named = 1"), longer.filter("named = 1")))
    copies = sets.join(heads, "w").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("j"))
    return alike.unionByName(copies).select("a", "b", F.round("j", 6).alias("jaccard"))


def same_identity(ticket_a: Column, ticket_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """The same ticket, or titles that share half of their words."""
    return F.coalesce(ticket_a == ticket_b, F.lit(False)) | (F.coalesce(jaccard(tokens_a, tokens_b), F.lit(0.0)) >= 0.5)


def quote_status(quote: Column, text: Column) -> Column:
    """verbatim, elided (parts around ... in order), or not found; null text was never retrieved."""
    q, t = normal_text(quote), normal_text(text)
    parts = F.filter(F.transform(F.split(q, r"\s*(?:\.\.\.|…)\s*"), lambda x: F.trim(x)), lambda p: F.length(p) > 0)
    literal = F.transform(parts, lambda p: F.regexp_replace(p, r"([%_\\])", r"\\$1"))
    elided = (F.size(parts) > 1) & F.like(t, F.concat(F.lit("%"), F.array_join(literal, "%"), F.lit("%")))
    return F.when(text.isNull(), "never retrieved").when((q != "") & t.contains(q), "verbatim").when(elided, "elided").otherwise("not found")


def best_verification(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """The strongest status per quote over all texts it was held against."""
    order = F.when(F.col(status) == "verbatim", 3).when(F.col(status) == "elided", 2).when(F.col(status) == "not found", 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.max_by(status, order).alias(status), F.count("*").alias("held_against"))


def carried_intent(log: DataFrame, by: list[str], order: str, is_intent: Column, resets: Column, text: str) -> DataFrame:
    """Each row gets the last intent before it, back to the last reset."""
    w = Window.partitionBy(*by).orderBy(order)
    part = F.sum(F.when(resets, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    carried = F.last(F.when(is_intent, F.col(text)), ignorenulls=True).over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("_part", part).withColumn("intent", carried).drop("_part")


def redundant(calls: DataFrame, by: list[str], signature: Column, order: str) -> DataFrame:
    """A call is redundant when the same signature came before."""
    return calls.withColumn("_s", signature).withColumn("occurrence", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(order))).withColumn("redundant", F.col("occurrence") > 1).drop("_s")


def provenance(text: Column) -> dict[str, Column]:
    """Counts that tell machine-read, sparse and boilerplate text."""
    lines = F.split(text, "\n")
    rows = F.filter(lines, lambda x: F.trim(x).startswith("|"))
    cells = F.flatten(F.transform(rows, lambda r: F.split(F.btrim(F.trim(r), F.lit("|")), r"\|")))
    empty = F.filter(cells, lambda c: F.trim(c) == "")
    return {
        "pictures": F.regexp_count(text, F.lit(r"!\[|<!-- image")),
        "prose_chars": F.aggregate(F.filter(lines, lambda x: ~F.trim(x).startswith("|")), F.lit(0), lambda a, x: a + F.length(x)),
        "cells": F.size(cells),
        "empty_cells": F.size(empty),
        "boilerplate": F.regexp_count(F.lower(text), F.lit(r"lorem ipsum|all rights reserved|licensed under|released under|to be defined|n/a")),
    }


def sparse(cells: Column, empty: Column) -> Column:
    return (cells >= 100) & (empty / cells >= 0.6)


def trace_status(checks: DataFrame, by: list[str], passed: str) -> DataFrame:
    """traced where all checks hold, untraced where none does."""
    g = checks.groupBy(*by).agg(F.count("*").alias("checks"), F.count_if(F.col(passed)).alias("passed"))
    return g.withColumn("status", F.when(F.col("passed") == F.col("checks"), "traced").when(F.col("passed") > 0, "partial").otherwise("untraced"))


def least_confidence(claims: DataFrame, by: list[str], score: str, load_bearing: Column) -> DataFrame:
    return claims.groupBy(*by).agg(F.round(F.min(F.when(load_bearing, F.col(score))), 4).alias("confidence"))


def unseen(rows: DataFrame, known: DataFrame, digest: str, id_col: str) -> DataFrame:
    """(digest, id, copies) of contents that are not known yet, each once."""
    return rows.groupBy(digest).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies")).join(known.select(digest), digest, "left_anti")
