"""What a derived store was built from, as a tree of digests.

Inputs are rows (kind, category, key, fingerprint): a corpus file is one, and so is
whatever else the store reads. Keys are placed by the first digits of their hash, a
fixed number of places per branch, so a branch's digest depends on its own rows
alone and no task sees a branch whole: leaves give places, places give wider places,
these give categories, categories kinds, and kinds the root. Two trees that agree at
the root agree everywhere; where they do not, the differing branches, and in them
the differing keys, say what is to be built again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.graph import settled

PLACES = (4, 2)  #: hexadecimal digits of a key's hash by which it is placed, the finest first


def _digest(of: Column) -> Column:
    """Of a group's few parts in order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(of)), "\n"), 256)


def branches(inputs: DataFrame, by: Sequence[str] = ("kind", "category"), key: str = "key", fingerprint: str = "fingerprint") -> DataFrame:
    """(by, digest, n) of each branch. Repeated rows count; null keys and fingerprints are told apart from empty ones."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    level = inputs.select(*by, F.md5(told(key)).alias("at"), F.concat(told(key), F.lit("\t"), told(fingerprint)).alias("part"), F.lit(1).cast("long").alias("n"))
    for digits in PLACES:
        place = F.left("at", F.lit(digits))
        level = level.groupBy(*by, place.alias("at")).agg(_digest(F.col("part")).alias("part"), F.sum("n").alias("n")).withColumn("part", F.concat("at", F.lit(":"), "part"))
    return level.groupBy(*by).agg(_digest(F.col("part")).alias("digest"), F.sum("n").alias("n"))


def tree(inputs: DataFrame) -> DataFrame:
    """(level, branch, digest, n): 2 a category of a kind, 1 a kind, 0 the root."""
    leaf = settled(branches(inputs), "branches")
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    two = leaf.select(name("kind").alias("kind"), F.concat(name("kind"), F.lit("/"), name("category")).alias("branch"), "digest", "n")
    part = F.concat("branch", F.lit(":"), "digest")
    one = two.groupBy("kind").agg(_digest(part).alias("digest"), F.sum("n").alias("n")).select(F.col("kind").alias("branch"), "digest", "n")
    root = one.agg(_digest(part).alias("digest"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n")).select(F.lit("").alias("branch"), "digest", "n")
    level = lambda df, n: df.select(F.lit(n).alias("level"), "branch", "digest", "n")
    return level(root, 0).unionByName(level(one, 1)).unionByName(level(two, 2))


def changed(was: DataFrame, now: DataFrame) -> DataFrame:
    """(level, branch, change): branches that came, went or differ, from the root down."""
    a, b = was.select("level", "branch", F.col("digest").alias("old")), now.select("level", "branch", F.col("digest").alias("new"))
    change = F.when(F.col("old").isNull(), "came").when(F.col("new").isNull(), "went").otherwise("differs")
    return a.join(b, ["level", "branch"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select("level", "branch", change.alias("change"))


def changed_inputs(was: DataFrame, now: DataFrame, differing: DataFrame) -> DataFrame:
    """(kind, category, key, change) of the inputs in branches that differ; the rest is not compared."""
    where = differing.filter("level = 2").select("branch")
    name = F.concat(F.coalesce("kind", F.lit("")), F.lit("/"), F.coalesce("category", F.lit("")))
    inside = lambda df, c: df.withColumn("branch", name).join(where, "branch", "left_semi").groupBy("kind", "category", F.col("key").cast("string").alias("key")).agg(F.array_sort(F.collect_list(F.coalesce("fingerprint", F.lit("")))).alias(c))
    o, n = inside(was, "old"), inside(now, "new")
    same = F.lit(True)
    for c in ("kind", "category", "key"):
        same = same & o[c].eqNullSafe(n[c])
    change = F.when(F.col("old").isNull(), "came").when(F.col("new").isNull(), "went").otherwise("differs")
    j = o.join(n, same, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return j.select(*(F.coalesce(o[c], n[c]).alias(c) for c in ("kind", "category", "key")), change.alias("change"))


def served(cached: DataFrame, now: DataFrame) -> DataFrame:
    """(fresh, built_from, current): whether a stored result, kept with the root digest
    it was built from (``built_from``, one row or none), may still be served."""
    root = now.filter("level = 0").select(F.col("digest").alias("current"))
    kept = cached.agg(F.max("built_from").alias("built_from"))
    return root.crossJoin(kept).select(F.col("built_from").eqNullSafe(F.col("current")).alias("fresh"), "built_from", "current")  # one row each
