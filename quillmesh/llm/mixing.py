"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to). Tokens then flow from patterns to the quotas of their sources. A
pattern may be used up to ``max_copies`` times over; the first copy costs
nothing and each further one more than the last, so the cheapest flow repeats
no document before the unused ones are taken. Within a pattern the flow is
met by whole copies of every document and, for the remainder, by documents in
the order of a seeded hash.

Up to ``PATTERNS`` patterns (rows of members and a sum) come to the driver, where
the flow is solved, for each set of sources that overlap by itself. Beyond that,
patterns whose one source occurs in no other pattern stay where they are: their
flow has one path, which takes their quota or all their copies, in a plain
expression. More than ``PATTERNS`` patterns of sources that overlap are refused
(:class:`ValueError`). Documents are chosen where they are: a histogram of hash buckets per pattern, whose number follows the
table, finds the bucket in which the remainder ends, and only that bucket's
documents are put in order.

A null source is a source of its own, last in order. Documents of no source
(members empty or null) keep their rows and are never taken. Null texts have size 0 and
are never taken. Rows that repeat are chosen one by one; nothing else depends on
ids being unique. An empty table gives none. Extra columns are kept, whatever
their names; only those named like a column of the result give way to it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm._shared import stage

BUCKETS = 4096  #: hash buckets of a pattern at least
IN_BUCKET = 4096  #: documents of a bucket, about
PATTERNS = 20_000  #: patterns that come to the driver to be routed, at most
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> dict[str | None, float]:
    """Share the sum of all sizes by weight. Sources, in order of their names
    with null last, take the weights in turn; none gets more than ``cap`` times
    its size, and what it cannot take is shared among the others."""
    order = sorted((s for s in sizes), key=lambda s: (s[0] is None, s[0] or ""))
    named = [(name, size, weights[i % len(weights)]) for i, (name, size) in enumerate(order)]
    # those that reach their cap first have the least cap for their weight
    by_cap = sorted(named, key=lambda s: (cap * s[1] / s[2], s[0] is None, s[0] or ""))
    left, weight = sum(s[1] for s in named), sum(s[2] for s in named)
    out: dict[str | None, float] = {}
    for i, (name, size, w) in enumerate(by_cap):
        if left * w <= cap * size * weight:
            for other, _, v in by_cap[i:]:
                out[other] = left * v / weight
            break
        out[name] = float(cap * size)
        left -= cap * size
        weight -= w
    return out


class Flow:
    """Minimum-cost flow by successive cheapest paths with potentials."""

    def __init__(self, n: int):
        self.n = n
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> int:
        potential = [0] * self.n  # all first costs are at least 0
        total = 0
        while True:
            dist, via = [math.inf] * self.n, [-1] * self.n
            dist[source] = 0
            heap = [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for e in self.edges[x]:
                    y = self.to[e]
                    nd = d + self.cost[e] + potential[x] - potential[y]
                    if self.room[e] and nd < dist[y]:
                        dist[y], via[y] = nd, e
                        heapq.heappush(heap, (nd, y))
            if dist[sink] == math.inf:
                return total
            for x in range(self.n):
                if dist[x] < math.inf:
                    potential[x] += int(dist[x])
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
            total += amount


def _apart(patterns: Sequence[tuple[tuple, int]]) -> list[list[int]]:
    """Places of the patterns that share sources with each other, directly or not."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for i, (members, _) in enumerate(patterns):
        for m in members:
            up[top(("source", m))] = top(("pattern", i))
    groups: dict = {}
    for i in range(len(patterns)):
        groups.setdefault(top(("pattern", i)), []).append(i)
    return list(groups.values())


def route(patterns: Sequence[tuple[tuple, int]], quotas: dict, max_copies: int = 3) -> list[int]:
    """Tokens to take from each (sources, size) pattern, for the given quotas."""
    taken = [0] * len(patterns)
    for group in _apart(patterns):  # what shares no source needs no common flow
        for i, n in zip(group, _route([patterns[i] for i in group], quotas, max_copies), strict=True):
            taken[i] = n
    return taken


def _route(patterns: Sequence[tuple[tuple, int]], quotas: dict, max_copies: int) -> list[int]:
    held = sorted({m for members, _ in patterns for m in members if m in quotas}, key=lambda m: (m is None, m or ""))
    names = {s: i for i, s in enumerate(held)}
    flow = Flow(2 + len(patterns) + len(names))
    first = 2 + len(patterns)
    tiers: list[list[int]] = []
    for i, (members, size) in enumerate(patterns):
        tiers.append([flow.edge(0, 2 + i, size, copy) for copy in range(max_copies)])  # convex: each copy dearer
        for s in members:
            if s in names:
                flow.edge(2 + i, first + names[s], max_copies * size, 0)
    for s, i in names.items():
        flow.edge(first + i, 1, quotas[s], 0)
    flow.solve(0, 1)
    return [sum(flow.room[e ^ 1] for e in t) for t in tiers]


def _positions(sources: DataFrame) -> DataFrame:
    """(name, size, place): places from 0 in code-point order, null last. Ranges of
    names are counted first, so that no task sees them all."""
    order = [F.col("name").isNull(), F.col("name")]
    ranged = sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND((1 << 33) - 1)}), "sources")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ranged.join(before, "part").select("name", "size", (F.col("before") + F.col("nth")).alias("place"))


def targets_of(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """:func:`capped_targets` of any number of sources: (name, size, target).

    Each round gives those that cannot take their share their cap, and shares the
    rest anew; the share per weight only grows, so a capped source stays capped.
    """
    whole = "decimal(38,0)"
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    held = _positions(sources).select("name", "size", weight.cast(whole).alias("w"), (F.col("size") * cap).cast(whole).alias("most"))
    left, share, capped = None, None, F.lit(False)
    while True:
        r = held.agg(F.sum(F.when(~capped, F.col("w"))).alias("w"), F.sum(F.when(capped, F.col("most"))).alias("m"), F.sum(F.col("size").cast(whole)).alias("t")).first()
        now = (r["t"] or 0) - (r["m"] or 0), r["w"] or 0
        if now == (left, share):
            break
        left, share = now
        capped = F.lit(left).cast(whole) * F.col("w") > F.col("most") * F.lit(share).cast(whole)
    even = (F.lit(left).cast(whole) * F.col("w")).cast("double") / F.lit(max(int(share), 1)).cast("double")
    return held.select("name", "size", F.when(capped, F.col("most").cast("double")).otherwise(even).alias("target"))


def _unused(names: Sequence[str]) -> str:
    tag = "_mix_"
    while any(n.lower().startswith(tag) for n in names):
        tag += "_"
    return tag


def _take(patterns: DataFrame, quotas: DataFrame, max_copies: int) -> DataFrame:
    """(members, sum, taken): tokens that each pattern gives."""
    routed, plain = patterns.filter(F.size("members") > 0), patterns.filter(F.size("members") == 0).select("members", "sum", F.lit(0).cast("long").alias("taken"))
    if routed.count() > PATTERNS:
        each = routed.select("members", F.explode("members").alias("name"))
        alone = each.groupBy(F.col("name").alias("n")).agg(F.count("*").alias("patterns"))
        lone = each.filter(F.size("members") == 1).join(alone.filter("patterns = 1"), F.col("name").eqNullSafe(F.col("n"))).select("members", "name")
        of = lone.join(quotas.withColumnRenamed("name", "q"), F.col("name").eqNullSafe(F.col("q")), "left").select("members", "quota")
        plain = plain.unionByName(routed.join(of, "members").select("members", "sum", F.least(F.coalesce("quota", F.lit(0)), F.col("sum") * max_copies).cast("long").alias("taken")))
        routed = stage(routed.join(lone.select("members"), "members", "left_anti"), "patterns")
        if routed.count() > PATTERNS:
            raise ValueError(f"sources overlap in more than {PATTERNS} patterns")
    rows = routed.select("members", "sum").collect()  # PATTERNS rows at most
    if not rows:
        return plain
    names = routed.select(F.explode("members").alias("q")).distinct()
    wanted = {r["name"]: int(r["quota"]) for r in quotas.join(names, F.col("name").eqNullSafe(F.col("q"))).select("name", "quota").collect() if r["quota"] is not None}
    sums = {tuple(r["members"]): int(r["sum"] or 0) for r in rows}
    shared = sorted(sums, key=lambda p: [(m is None, m or "") for m in p])
    taken = route([(p, sums[p]) for p in shared], wanted, max_copies)
    found = patterns.sparkSession.createDataFrame([(list(p), sums[p], t) for p, t in zip(shared, taken, strict=True)], "members array<string>, sum long, taken long")
    return plain.unionByName(found)


def mix(docs: DataFrame, members: Column, size: Column, quotas, max_copies: int = 3, seed: str = "mix", id_col: str = "doc_id", told: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``size`` and ``copies`` (0 to ``max_copies``) columns.

    ``members`` is an array of source names. ``quotas`` maps source names to
    tokens, is a DataFrame (name, quota, ...), or makes one of a DataFrame
    (members, sum). ``told`` names further columns of it that a document of one
    source is given.
    """
    spark, told = docs.sparkSession, told or {}
    tag = _unused(docs.columns)
    of = lambda c: F.col(tag + c)
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sources = F.coalesce(F.array_sort(F.array_distinct(members)), F.array().cast("array<string>"))
    rows = docs.withColumns({tag + "members": sources, tag + "u": F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")})
    bits = min(28, max(BUCKETS.bit_length() - 1, (docs.count() // IN_BUCKET).bit_length()))
    rows = rows.withColumn(tag + "bucket", F.shiftright(of("u"), 32 - bits).cast("int"))
    sums = stage(rows.groupBy(of("members").alias("members"), of("bucket").alias("bucket")).agg(F.sum(size).cast("long").alias("sum")), "sums")
    patterns = stage(sums.groupBy("members").agg(F.coalesce(F.sum("sum"), F.lit(0)).cast("long").alias("sum")), "patterns")
    if callable(quotas):
        quotas = quotas(patterns)
    if isinstance(quotas, dict):
        quotas = spark.createDataFrame([(s, int(q)) for s, q in quotas.items()], "name string, quota long")
    taken = _take(patterns, quotas.select("name", "quota"), max_copies)
    known = stage(taken.select("members", F.expr("taken div greatest(sum, 1)").alias("whole"), F.expr("taken % greatest(sum, 1)").alias("rest")), "plan")
    so_far = Window.partitionBy("members").orderBy("bucket")
    cut = (
        sums.join(known, "members").select("members", "bucket", "rest", (F.sum("sum").over(so_far) - F.col("sum")).alias("before"), "sum")
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest")))
        .groupBy("members").agg(F.min(F.struct("bucket", "before")).alias("cut"))
    )
    plan = known.join(cut, "members", "left")
    if told:
        named = quotas.select(F.array("name").alias("members"), *told)
        plan = plan.join(named, "members", "left")
    plan = stage(plan.select(F.col("members").alias(tag + "members"), F.col("whole").alias(tag + "whole"), F.col("rest").alias(tag + "rest"), F.coalesce("cut.bucket", F.lit(-1)).alias(tag + "last"), F.coalesce("cut.before", F.lit(0)).alias(tag + "before"), *(F.col(c).alias(tag + "told_" + c) for c in told)), "plan")
    joined = rows.join(plan, tag + "members")
    edge = of("bucket") == of("last")
    extra = [of("told_" + c).alias(name) for c, name in told.items()]
    kept = [F.col(c) for c in docs.columns if c not in {"size", "copies", *told.values()}]
    copies = lambda more: F.least(of("whole") + F.when(more, 1).otherwise(0), F.lit(max_copies)).cast("long").alias("copies")
    # sizes are counted after the filter: the edge is one bucket of each pattern
    clear = joined.filter(~edge).withColumn(tag + "size", size.cast("long")).select(*kept, of("size").alias("size"), copies(of("bucket") < of("last")), *extra)
    # equal ids of equal size are told apart by their other columns, so that reruns agree
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    running = Window.partitionBy(tag + "members").orderBy(of("u"), F.asc_nulls_first(id_col), of("size"), F.xxhash64(*plain)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = of("before") + F.sum(of("size")).over(running)
    # the document across which the remainder ends is taken if most of it lies before the end
    near = (upto - of("size") < of("rest")) & (2 * upto - of("size") <= 2 * of("rest"))
    close = joined.filter(edge).withColumn(tag + "size", size.cast("long")).withColumn(tag + "near", near).select(*kept, of("size").alias("size"), copies(of("near")), *extra)
    return clear.unionByName(close)


def mix_sources(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Mix documents of one source each to the weights of :func:`targets_of`:
    ``docs`` with size, copies, source_size and target."""

    def quotas(patterns: DataFrame) -> DataFrame:
        sources = patterns.select(F.col("members")[0].alias("name"), F.col("sum").alias("size"))
        return stage(targets_of(sources, weights, cap).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")), "targets")

    return mix(docs, F.array(F.col(source_col).cast("string")), n_words(text_col), quotas, cap, id_col=id_col, told={"size": "source_size", "target": "target"})
