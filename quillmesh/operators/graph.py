"""Property graphs as two DataFrames: nodes (id, type, ...) and edges (source,
target, relation, ...).

Traversals are loops of joins. Each round writes its frontier to the shared
folder, so plans stay small and a lost executor costs one round; the driver sees
counts only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a
    session on one machine that names none gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quillmesh.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.quillmesh.shared.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """Written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One edge per (source, target, relation), both ends known."""
    ids = nodes.select("id").distinct()
    known = edges.dropDuplicates(["source", "target", "relation"])
    known = known.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return known.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).filter("a <> b").distinct()


PER_TASK = 500_000  #: rows of one task where a table is dealt by its keys


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by keys over as many tasks as so many rows need, so that what one task
    holds does not follow the size of the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PER_TASK)), *keys)


def links(edges: DataFrame) -> DataFrame:
    """both_ways, written once: the edges are derived once, and each pair of ends is
    made distinct before it is turned round."""
    ends = settled(edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")), "ends")
    once = dealt(ends, ends.count(), "a", "b").distinct()
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return settled(once.select(turned.alias("e")).select("e.a", "e.b"), "pairs")


def next_to(frontier: DataFrame, pairs: DataFrame, rows: int, *by: str) -> DataFrame:
    """(by, id): distinct ends of the pairs (a, b), ``rows`` in number, that begin at the
    frontier's (by, id). A large frontier and the pairs are dealt over many tasks."""
    if (n := frontier.count()) > PER_TASK:
        frontier, pairs = dealt(frontier, max(n, rows), "id"), dealt(pairs, max(n, rows), "a")
    return frontier.join(pairs, frontier["id"] == pairs["a"]).select(*by, F.col("b").alias("id")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In plus out; nodes without edges have 0."""
    ends = edges.select(F.col("source").alias("id")).unionAll(edges.select("target")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def edge_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by type of source, relation and type of target."""
    t = nodes.select("id", "type")
    e = edges.join(t.select(F.col("id").alias("source"), F.col("type").alias("from_type")), "source").join(t.select(F.col("id").alias("target"), F.col("type").alias("to_type")), "target")
    return e.groupBy("from_type", "relation", "to_type").agg(F.count("*").alias("n"))


def hops(edges: DataFrame, start: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """(id, hop): fewest steps from any start node, up to ``most``."""
    # once: every round then joins without deriving the edges anew
    return _walked(settled(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "pairs") if directed else links(edges), start, most)


def _walked(pairs: DataFrame, start: DataFrame, most: int) -> DataFrame:
    rows = pairs.count()
    seen = settled(start.select("id", F.lit(0).alias("hop")).distinct())
    frontier = seen
    for h in range(1, most + 1):
        frontier = settled(next_to(frontier.select("id"), pairs, rows).join(seen, "id", "left_anti").withColumn("hop", F.lit(h)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 6) -> DataFrame:
    """(step, id): the shortest undirected route, of equal ones that with the
    smallest ids from the end backwards; empty if there is none."""
    spark = edges.sparkSession
    pairs = links(edges)
    found = settled(_walked(pairs, spark.createDataFrame([(start,)], "id string"), most))
    at = found.filter(F.col("id") == end).select("id", "hop").first()
    if at is None:
        return spark.createDataFrame([], "step int, id string")
    path = [(int(at["hop"]), end)]
    for h in range(int(at["hop"]) - 1, -1, -1):  # at most ``most`` rounds, one row each
        back = pairs.filter(F.col("a") == path[-1][1]).join(found.filter(F.col("hop") == h), F.col("b") == F.col("id")).agg(F.min("id").alias("id")).first()
        path.append((h, back["id"]))
    return spark.createDataFrame(path[::-1], "step int, id string")


def path_verdict(path: DataFrame, nodes: DataFrame, edges: DataFrame, weak_types: Sequence[str], hub: int = 40) -> DataFrame:
    """A path through a weak type is rejected; one through a hub gets a warning."""
    inner = path.join(degrees(nodes, edges), "id").withColumn("last", F.max("step").over(Window.partitionBy())).filter((F.col("step") > 0) & (F.col("step") < F.col("last")))
    return inner.agg(F.coalesce(F.bool_or(F.col("type").isin(*weak_types)), F.lit(False)).alias("rejected"), F.coalesce(F.bool_or(F.col("degree") >= hub), F.lit(False)).alias("hub"))


def ancestors(parents: DataFrame, most: int = 20) -> DataFrame:
    """(id, ancestor, depth) over (child, parent) pairs; loops end where they close."""
    p = parents.select(F.col("child"), F.col("parent")).distinct()
    level = settled(p.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    every = level
    for d in range(2, most + 1):
        up = level.join(p, level["ancestor"] == p["child"]).select("id", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")).distinct()
        level = settled(up.join(every, ["id", "ancestor"], "left_anti"))
        if level.isEmpty():
            break
        every = every.union(level)
    return every


def on_cycle(parents: DataFrame, most: int = 20) -> DataFrame:
    """Nodes that reach themselves over their first parent (in order of id)."""
    first = parents.groupBy("child").agg(F.min("parent").alias("parent"))
    return ancestors(first, most).filter("id = ancestor").select("id").distinct()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable. Labels take the minimum of
    their neighbours' and then their label's own label, so chains halve."""
    pairs = settled(both_ways(edges))
    label = settled(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(rounds):
        near = pairs.join(label, pairs["b"] == label["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        new = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = settled(new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("far", "component")).alias("component")))
        changed = new.join(label.withColumnRenamed("component", "was"), "id").filter("component <> was").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def scoped(nodes: DataFrame, edges: DataFrame, inside: Column, up: str) -> tuple[DataFrame, DataFrame]:
    """The subgraph of documents ``inside`` a scope: what they point to, the
    ancestors of that over relation ``up``, and the edges among all of these."""
    docs = nodes.filter(inside).select("id")
    targets = edges.join(docs, edges["source"] == docs["id"]).select(F.col("target").alias("id"))
    chain = ancestors(edges.filter(F.col("relation") == up).select(F.col("source").alias("child"), F.col("target").alias("parent")))
    above = chain.join(targets.distinct(), "id", "left_semi").select(F.col("ancestor").alias("id"))
    keep = docs.union(targets).union(above).distinct()
    kept = nodes.join(keep, "id", "left_semi")
    e = edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, e


def two_hop(nodes: DataFrame, edges: DataFrame, anchor: str, bridge_type: str, target_type: str) -> DataFrame:
    """(target, bridges): targets of a type that share a bridge of a type with the anchor."""
    pairs = both_ways(edges)
    t = nodes.select("id", "type")
    bridges = pairs.filter(F.col("a") == anchor).select(F.col("b").alias("id")).join(t.filter(F.col("type") == bridge_type), "id", "left_semi")
    far = bridges.withColumnRenamed("id", "a").join(pairs, "a").filter(F.col("b") != anchor).select("a", F.col("b").alias("id"))
    return far.join(t.filter(F.col("type") == target_type), "id", "left_semi").groupBy(F.col("id").alias("target")).agg(F.countDistinct("a").alias("bridges"))


def enumerate_neighbours(nodes: DataFrame, edges: DataFrame, node: str, type_: str | None = None) -> DataFrame:
    near = both_ways(edges).filter(F.col("a") == node).select(F.col("b").alias("id"))
    found = nodes.join(near, "id", "left_semi")
    return found.filter(F.col("type") == type_) if type_ else found


def capped(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n with a flag on every row whether more were cut off."""
    top = df.orderBy(*order).limit(n + 1).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    return top.withColumn("truncated", F.max("_r").over(Window.partitionBy()) > n).filter(F.col("_r") <= n).drop("_r")


def first_links(links: DataFrame, most: int) -> DataFrame:
    """(node, neighbour, relation, links): the first ``most`` neighbours of every node by
    name and relation; ``links`` says how many links each row stands for, in all those of the node."""
    here = links.filter("neighbour is not null").select("node", "neighbour", F.coalesce("relation", F.lit("")).alias("relation"))
    of_node = Window.partitionBy("node")
    placed = here.withColumns({"_place": F.row_number().over(of_node.orderBy("neighbour", "relation")), "_all": F.count("*").over(of_node)})
    stands = F.when(F.col("_place") == 1, F.col("_all") - F.least(F.col("_all"), F.lit(most)) + 1).otherwise(1)
    return placed.filter(F.col("_place") <= most).select("node", "neighbour", "relation", stands.cast("long").alias("links"))


def resolve(nodes: DataFrame, text: str, most: int = 8) -> DataFrame:
    """Nodes by exact code or label first, then by a part of either."""
    q = F.lit(text.lower())
    code, label = F.lower(F.coalesce("code", F.lit(""))), F.lower(F.coalesce("label", F.lit("")))
    tier = F.when((code == q) | (label == q), 0).when(code.startswith(q) | label.startswith(q), 1).when(code.contains(q) | label.contains(q), 2)
    return nodes.withColumn("tier", tier).filter("tier is not null").orderBy("tier", F.length(label), "id").limit(most)


def schema_conformance(nodes: DataFrame, edges: DataFrame, allowed: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Share of edges whose end types the schema allows."""
    ok = edges.sparkSession.createDataFrame(list(allowed), "from_type string, relation string, to_type string").withColumn("ok", F.lit(True))
    t = nodes.select("id", "type")
    e = edges.join(t.select(F.col("id").alias("source"), F.col("type").alias("from_type")), "source", "left").join(t.select(F.col("id").alias("target"), F.col("type").alias("to_type")), "target", "left")
    j = e.join(F.broadcast(ok), ["from_type", "relation", "to_type"], "left")
    return j.agg(F.count("*").alias("edges"), F.count("ok").alias("conforming"), F.round(F.try_divide(F.count("ok").cast("double"), F.count("*").cast("double")), 6).alias("share"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct().withColumn("ok", F.lit(True))
    e = edges.join(ids.select(F.col("id").alias("source"), F.col("ok").alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.col("ok").alias("t")), "target", "left")
    return e.filter("s is null or t is null").drop("s", "t")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target", "relation").agg(F.count("*").alias("n")).filter("n > 1")


def multi_parent(edges: DataFrame, relation: str) -> DataFrame:
    return edges.filter(F.col("relation") == relation).groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("parents")).filter("parents > 1")


def property_conflicts(nodes: DataFrame, key: str, prop: str) -> DataFrame:
    return nodes.groupBy(key).agg(F.countDistinct(prop).alias("n")).filter("n > 1")


def property_model(nodes: DataFrame, props: Sequence[str]) -> DataFrame:
    """(type, property, present, rows, nullable) per label."""
    long = nodes.select("type", F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("v")) for p in props))).alias("x"))
    return long.groupBy("type", "x.property").agg(F.count("x.v").alias("present"), F.count("*").alias("rows")).withColumn("nullable", F.col("present") < F.col("rows"))


def mentions(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code, mentions) for a small table of (code, pattern) rules."""
    hit = docs.crossJoin(F.broadcast(rules)).select(id_col, "code", F.regexp_count(F.col(text_col), F.col("pattern")).alias("mentions"))  # rules are a fixed list
    return hit.filter("mentions > 0")


def edge_evidence(found: DataFrame, key: Sequence[str], chunk: str, count: str, most: int = 5) -> DataFrame:
    """Mentions, chunks and the first five chunk keys behind each edge. Chunks are
    counted one by one, and of each edge only the first few are kept in each task."""
    each = found.groupBy(*key, chunk).agg(F.sum(count).alias("_n"))
    sums = each.groupBy(*key).agg(F.sum("_n").alias("mentions"), F.count(chunk).alias("chunk_count"))
    first = each.filter(F.col(chunk).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(chunk))).filter(F.col("_k") <= most)
    held = first.groupBy(*key).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    kind = found.schema[chunk].dataType.simpleString()
    return sums.join(held, list(key), "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(f"array<{kind}>")))


def judged_paths(hops_: DataFrame, nodes: DataFrame, edges: DataFrame, streams: Sequence[str], labels: Sequence[str], hub: int = 40) -> DataFrame:
    """(path, hops, verdict, via_streams, via_labels, via_hubs): what many paths are worth.

    ``hops_`` are the steps of all paths: (path, step, source, target, relation), step
    from 1. A path through a stream, or over a relation that only labels, is no
    connection; one through a hub is to be confirmed; any other stands. Interior
    nodes are those that one hop enters and another one leaves; a relation counts
    at its own hop. Everything is joined and grouped by path."""
    known = degrees(nodes.select("id", "type"), edges)
    last = hops_.groupBy("path").agg(F.max("step").alias("last"))
    inner = hops_.join(last, "path").filter("step < last").select("path", F.col("target").alias("id")).join(known, "id")
    is_stream, is_hub = F.col("type").isin(*streams), F.col("degree") >= hub
    sorted_set = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  of one path's few nodes
    via = inner.groupBy("path").agg(sorted_set(F.when(is_stream, F.col("id"))).alias("via_streams"), sorted_set(F.when(is_hub, F.col("id"))).alias("via_hubs"))
    over = hops_.groupBy("path").agg(F.max("step").alias("hops"), sorted_set(F.when(F.col("relation").isin(*labels), F.col("relation"))).alias("via_labels"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    j = over.join(via, "path", "left").withColumns({"via_streams": none("via_streams"), "via_hubs": none("via_hubs")})
    verdict = F.when(F.size("via_streams") > 0, "rejected: stream").when(F.size("via_labels") > 0, "rejected: label").when(F.size("via_hubs") > 0, "confirm: hub").otherwise("stands")
    return j.select("path", "hops", verdict.alias("verdict"), "via_streams", "via_labels", "via_hubs")


#: What a picture of the graph adds to nodes and edges, and no store needs.
PRESENTATION = ("color", "size", "x", "y", "width")


def loadable(rows: DataFrame, drop: Sequence[str] = PRESENTATION) -> DataFrame:
    """Nodes or edges without their presentation fields, those that are there."""
    return rows.drop(*drop)
