"""Grouping of texts by meaning: average linkage, medoids and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.scalar import terms
from quillmesh.operators.graph import settled

LARGEST = 2000  #: clusters of one group that one task merges
BLOCK = 1000  #: clusters of a larger group that one task compares with as many others


def average_linkage(x: np.ndarray, cut: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of average-linkage clusters merged while closer than ``cut`` (cosine
    distance); by the Lance-Williams update, nearest pair first. With ``sizes``,
    each row is a cluster of that many items and ``x`` holds their means of unit
    vectors."""
    n = len(x)
    if n == 0:
        return np.zeros(0, int)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if sizes is None else x
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n) if sizes is None else sizes.astype(float), np.arange(n)
    while True:
        i, j = divmod(int(np.argmin(d)), n)
        if not d[i, j] < cut:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    order = {old: new for new, old in enumerate(sorted(set(label), key=lambda c: (-(label == c).sum(), np.flatnonzero(label == c)[0])))}
    return np.array([order[c] for c in label])


def _nearest(cut: float):
    """For each cluster of two blocks its nearest one in the other block, if closer than ``cut``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = np.stack(pdf["_s"].to_list()) / pdf["_n"].to_numpy()[:, None]
        key, block = pdf["_k"].to_numpy(), pdf["_block"].to_numpy()
        x, y = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        out = []
        if len(x) and len(y) and (block.min() != block.max() or pdf["_block"].iloc[0] == pdf["_other"].iloc[0]):
            d = 1 - mean[x] @ mean[y].T
            if block.min() == block.max():
                np.fill_diagonal(d, np.inf)
            # equal distances are told apart by the pair, alike from both sides
            tie = (key[x][:, None] ^ key[y][None, :]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)
            for m, t, a, b in ((d, tie, x, y), (d.T, tie.T, y, x)):
                least = m.min(axis=1)
                at = np.where(m == least[:, None], t, np.uint64(1 << 63)).argmin(axis=1)
                ok = least < cut
                out.append(pd.DataFrame({"_k": key[a][ok], "_d": least[ok], "_tie": t[np.arange(len(a)), at][ok].astype(np.int64), "_to": key[b][at][ok]}))
        return pd.concat(out) if out else pd.DataFrame({"_k": [], "_d": [], "_tie": [], "_to": []})

    return run


def clusters(items: DataFrame, by: str, id_col: str, vector_col: str, cut: float = 0.42) -> DataFrame:
    """(by, id, cluster) per group, by average linkage at every size; larger
    clusters have smaller numbers, of equal ones that with the smaller first id.

    A cluster is kept as its size and its sum of unit vectors, which give the mean
    distance of two clusters exactly. Equal vectors are one cluster from the start
    (``cut`` is above 0). In a group of more than ``LARGEST`` clusters, all pairs
    that are each other's nearest merge at once, round by round; a merged cluster
    is never nearer to a third than its parts were, so this gives the same
    clusters as merging the nearest pair of all, and what has nothing nearer than
    ``cut`` is done. One task compares two blocks of about ``BLOCK``; what is left of a group is merged by one task as soon as it
    has no more than ``LARGEST`` clusters. Work grows with the square of the
    largest group's different vectors.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = items.select(F.col(by).alias("_by"), F.col(id_col).alias("_id"), vector.alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("_norm", norm).withColumn("_zero", F.when(F.col("_norm") == 0, F.col("_id")))  # nothing is near a zero vector
    start = rows.groupBy("_by", "_v", "_norm", "_zero").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    unit = F.transform("_v", lambda x: x / F.greatest(F.col("_norm"), F.lit(1e-12)))
    start = settled(start.withColumn("_k", F.monotonically_increasing_id()), "vectors")
    now = settled(start.select("_by", "_k", "_n", "_first", F.transform(unit, lambda x: x * F.col("_n")).alias("_s")), "clusters")
    member = start.select("_k", F.col("_k").alias("_c"))  # vector, and the cluster it is in
    finished = None  # clusters of large groups that are nearer than ``cut`` to none

    while True:
        large = now.groupBy("_by").agg(F.count("*").alias("_m")).filter(F.col("_m") > LARGEST).select(F.col("_by").alias("_g"), F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
        active = now.join(large, F.col("_by").eqNullSafe(F.col("_g"))).withColumn("_block", F.pmod(F.xxhash64("_k"), "_blocks").cast("int"))
        if large.isEmpty():
            break
        dealt = active.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        dealt = dealt.select("_by", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_k", "_n", "_s", "_block", "_other")
        near = dealt.groupBy("_by", "_low", "_high").applyInPandas(_nearest(cut), "_k long, _d double, _tie long, _to long")
        best = settled(near.groupBy("_k").agg(F.min(F.struct("_d", "_tie", "_to")).alias("_b")).select("_k", F.col("_b._to").alias("_to")), "nearest")
        other = best.select(F.col("_to").alias("_k"), F.col("_k").alias("_to"))
        pairs = settled(best.join(other, ["_k", "_to"]).filter("_k > _to"), "pairs")  # each the other's nearest
        # what has nothing nearer than ``cut`` never will: merged clusters are no nearer than their parts
        over = active.join(best, "_k", "left_anti").select("_by", "_k", "_n", "_first")
        finished = settled(over if finished is None else finished.union(over), "finished")
        kept = now.join(finished.select("_k"), "_k", "left_anti").join(pairs, "_k", "left").withColumn("_k", F.coalesce("_to", "_k"))
        add = F.aggregate(F.slice("_l", 2, 1), F.col("_l")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        now = settled(kept.groupBy("_by", "_k").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.collect_list("_s").alias("_l")).select("_by", "_k", "_n", "_first", add.alias("_s")), "clusters")
        member = settled(member.join(pairs.select(F.col("_k").alias("_c"), "_to"), "_c", "left").select("_k", F.coalesce("_to", "_c").alias("_c")), "member")

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_first")
        size = pdf["_n"].to_numpy()
        label = average_linkage(np.stack(pdf["_s"].to_list()) / size[:, None], cut, size)
        key = pdf["_k"].to_numpy()
        head = dict(zip(label[::-1], key[::-1], strict=True))
        return pd.DataFrame({"_c": key, "_to": [head[c] for c in label]})

    last = settled(now.groupBy("_by").applyInPandas(rest, "_c long, _to long"), "last")
    member = member.join(last, "_c", "left").select("_k", F.coalesce("_to", "_c").alias("_c"))
    whole = now.select("_by", "_k", "_n", "_first")
    whole = (whole if finished is None else whole.union(finished)).withColumnRenamed("_k", "_c").join(last, "_c", "left").withColumn("_c", F.coalesce("_to", "_c"))
    whole = whole.groupBy("_by", "_c").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    # numbered by ranges of the order, so that no task sorts all clusters of a group
    ranged = settled(whole.repartitionByRange("_by", F.desc("_n"), "_first", "_c").withColumn("_p", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_by", "_p").agg(F.count("*").alias("_m"))
    before = before.select(F.col("_by").alias("_g"), F.col("_p").alias("_q"), (F.sum("_m").over(Window.partitionBy("_by").orderBy("_p")) - F.col("_m")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_by", "_p").orderBy(F.desc("_n"), "_first", "_c"))
    numbered = ranged.withColumn("_at", at).join(before, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))).select("_c", (F.col("_at") + F.col("_before") - 1).cast("int").alias("cluster"))
    of = start.select(F.col("_by").alias("_g"), F.col("_v").alias("_w"), F.col("_zero").alias("_y"), "_k").join(member, "_k").join(numbered, "_c")
    same = F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_v") == F.col("_w")) & F.col("_zero").eqNullSafe(F.col("_y"))
    return rows.join(of, same).select(F.col("_by").alias(by), F.col("_id").alias(id_col), "cluster")


def medoids(items: DataFrame, by: str, id_col: str, vector_col: str) -> DataFrame:
    """The item nearest to all others of its group: the sum of its cosines is the
    product with the sum of unit vectors, so no pairs are formed."""
    unit = items.withColumn("_n", F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).filter("_n > 0")
    unit = unit.select(by, id_col, F.transform(vector_col, lambda x: x.cast("double") / F.col("_n")).alias("_u"))
    sums = unit.select(by, F.posexplode("_u").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("s")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("_sum"))
    near = unit.join(sums, by).withColumn("closeness", F.round(F.aggregate(F.zip_with("_u", "_sum", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6))
    best = Window.partitionBy(by).orderBy(F.desc("closeness"), id_col)
    return near.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(by, id_col, "closeness")


def labels(items: DataFrame, by: str, text_col: str, top: int = 3) -> DataFrame:
    """Terms that set a group apart: frequency times ln(groups / groups with it)."""
    groups = items.select(by).distinct().agg(F.count("*").alias("g"))
    tf = items.select(by, F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).filter("length(term) > 2").groupBy(by, "term").agg(F.count("*").alias("tf"))
    spread = tf.groupBy("term").agg(F.count("*").alias("spread"))
    scored = tf.join(spread, "term").crossJoin(F.broadcast(groups)).withColumn("score", F.round(F.col("tf") * F.log(F.col("g") / F.col("spread")), 6)).filter("score > 0")
    w = Window.partitionBy(by).orderBy(F.desc("score"), "term")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select(by, "place", "term", "score")

