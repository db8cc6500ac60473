"""Graph queries over the star schema read as a property graph.

Regions are streams, nations processes under them, customers documents,
suppliers systems, parts specifications and orders passages. A document mentions
the systems that its orders' lines name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import tables
from quillmesh.operators import graph
from quillmesh.plans.book import Book
from quillmesh.sources.tables import load

BOOK = Book()

_N = """n AS (SELECT 'r' || r_regionkey AS id, 'stream' AS type, r_name AS label, NULL AS category FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'process', n_name, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'document', c_name, c_mktsegment FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'system', s_name, CASE WHEN s_acctbal > 5000 THEN 'third_party' ELSE 'own' END FROM supplier)"""
_E = """m AS (SELECT o_custkey AS c, l_suppkey AS s, count(*) AS mentions, count(DISTINCT o_orderkey) AS chunk_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
  e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'subprocess_of' AS relation, 1 AS mentions FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'specifies_process', 1 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'used_in', 1 FROM supplier
  UNION ALL SELECT 'c' || c, 's' || s, 'mentions_system', mentions FROM m)"""
_G = f"WITH RECURSIVE {_N}, {_E}"


def _id(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    parts = [
        load(spark, d, "region").select(_id("r", "r_regionkey").alias("id"), F.lit("stream").alias("type"), F.col("r_name").alias("label"), none.alias("category")),
        load(spark, d, "nation").select(_id("n", "n_nationkey"), F.lit("process"), "n_name", none),
        load(spark, d, "customer").select(_id("c", "c_custkey"), F.lit("document"), "c_name", "c_mktsegment"),
        load(spark, d, "supplier").select(_id("s", "s_suppkey"), F.lit("system"), "s_name", F.when(F.col("s_acctbal") > 5000, "third_party").otherwise("own")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _lines(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """Lines with their orders, dealt by their number and, if asked for, by columns."""
    o, l = load(spark, d, "orders").select("o_orderkey", "o_custkey"), load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linenumber")
    n = l.count()  # from the files' footers
    met = graph.dealt(l, n, "l_orderkey").join(graph.dealt(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.dealt(met, n, *by) if by else met


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "o_custkey", "l_suppkey").groupBy(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("mentions"), F.countDistinct("o_orderkey").alias("chunk_count"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(1).cast("long")
    parts = [
        load(spark, d, "nation").select(_id("n", "n_nationkey").alias("source"), _id("r", "n_regionkey").alias("target"), F.lit("subprocess_of").alias("relation"), one.alias("mentions")),
        load(spark, d, "customer").select(_id("c", "c_custkey"), _id("n", "c_nationkey"), F.lit("specifies_process"), one),
        load(spark, d, "supplier").select(_id("s", "s_suppkey"), _id("n", "s_nationkey"), F.lit("used_in"), one),
        mentions(spark, d).select(_id("c", "c"), _id("s", "s"), F.lit("mentions_system"), "mentions"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@BOOK.add("graph_nodes_edges", f"{_G} SELECT 'node' AS kind, type AS name, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', relation, count(*) FROM e GROUP BY relation")
def graph_nodes_edges(spark, d):
    a = nodes(spark, d).groupBy("type").count().select(F.lit("node").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"))
    b = edges(spark, d).groupBy("relation").count().select(F.lit("edge"), "relation", "count")
    return a.union(b)


@BOOK.add("graph_degree", f"{_G}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e), g AS (SELECT id, count(*) AS degree FROM x GROUP BY id) SELECT n.id, n.type, coalesce(degree, 0) AS degree FROM n LEFT JOIN g USING (id)")
def graph_degree(spark, d):
    return graph.degrees(nodes(spark, d), edges(spark, d)).select("id", "type", "degree")


@BOOK.add("graph_edge_types", f"{_G} SELECT a.type AS from_type, relation, b.type AS to_type, count(*) AS n FROM e JOIN n a ON source = a.id JOIN n b ON target = b.id GROUP BY ALL")
def graph_edge_types(spark, d):
    return graph.edge_types(nodes(spark, d), edges(spark, d))


_U = "u AS (SELECT source AS a, target AS b FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target)"
_HOPS = f"""{_G}, {_U}, h0 AS (SELECT 's1' AS id), h1 AS (SELECT DISTINCT b AS id FROM u SEMI JOIN h0 ON a = id WHERE b <> 's1'),
  h2 AS (SELECT DISTINCT b AS id FROM u SEMI JOIN h1 ON a = id WHERE b <> 's1' AND b NOT IN (SELECT id FROM h1)),
  h3 AS (SELECT DISTINCT b AS id FROM u SEMI JOIN h2 ON a = id WHERE b <> 's1' AND b NOT IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h2)),
  h AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3)"""


@BOOK.add("graph_bfs_hops", f"{_HOPS} SELECT id, hop FROM h")
def graph_bfs_hops(spark, d):
    return graph.hops(edges(spark, d), spark.createDataFrame([("s1",)], "id string"), 3)


@BOOK.add("graph_k_hop", f"{_HOPS} SELECT h.id, hop, type FROM h JOIN n USING (id) WHERE hop BETWEEN 1 AND 2")
def graph_k_hop(spark, d):
    near = graph.hops(edges(spark, d), spark.createDataFrame([("s1",)], "id string"), 2).filter("hop > 0")
    return near.join(nodes(spark, d).select("id", "type"), "id")


@BOOK.add(
    "graph_shortest_path",
    f"""{_G}, {_U}, k AS (SELECT a FROM u WHERE b = 'r0'), p AS (SELECT x.a AS n1, x.b AS n2 FROM u x WHERE x.a IN (SELECT a FROM k)),
    f AS (SELECT min(n1) AS mid FROM p WHERE n2 = 's1'),
    g AS (SELECT n1, min(n2) AS n2 FROM (SELECT y.a AS n2, x.n1 FROM p x JOIN u y ON x.n2 = y.a WHERE y.b = 's1') GROUP BY n1),
    o AS (SELECT min(n1) AS n1 FROM g)
    SELECT * FROM (SELECT 0 AS step, 's1' AS id UNION ALL SELECT 1, (CASE WHEN (SELECT mid FROM f) IS NOT NULL THEN (SELECT mid FROM f) ELSE (SELECT n2 FROM g JOIN o USING (n1)) END)
    UNION ALL SELECT 2, CASE WHEN (SELECT mid FROM f) IS NOT NULL THEN 'r0' ELSE (SELECT n1 FROM o) END UNION ALL SELECT 3, CASE WHEN (SELECT mid FROM f) IS NULL THEN 'r0' END) WHERE id IS NOT NULL""",
)
def graph_shortest_path(spark, d):
    return graph.shortest_path(edges(spark, d), "s1", "r0")


@BOOK.add("graph_path_length", f"{_HOPS} SELECT hop FROM h WHERE id = 's2'")
def graph_path_length(spark, d):
    return graph.hops(edges(spark, d), spark.createDataFrame([("s1",)], "id string"), 6).filter("id = 's2'").select("hop")


@BOOK.add("graph_enumerate", f"{_G}, {_U} SELECT n.id, n.label FROM n SEMI JOIN (SELECT b FROM u WHERE a = 's1') x ON n.id = x.b WHERE type = 'document'")
def graph_enumerate(spark, d):
    return graph.enumerate_neighbours(nodes(spark, d), edges(spark, d), "s1", "document").select("id", "label")


@BOOK.add(
    "graph_two_hop_typed",
    f"""{_G}, {_U}, b AS (SELECT u.b AS id FROM u JOIN n ON u.b = n.id WHERE u.a = 's1' AND type = 'document')
    SELECT n.id AS target, count(DISTINCT b.id) AS bridges FROM b JOIN u ON u.a = b.id JOIN n ON u.b = n.id WHERE n.type = 'system' AND n.id <> 's1' GROUP BY n.id""",
)
def graph_two_hop_typed(spark, d):
    return graph.two_hop(nodes(spark, d), edges(spark, d), "s1", "document", "system")


_SCOPE = f"""{_G}, dx AS (SELECT id FROM n WHERE category = 'BUILDING'), tx AS (SELECT DISTINCT target AS id FROM e SEMI JOIN dx ON source = id),
  up AS (SELECT DISTINCT e.target AS id FROM e SEMI JOIN tx ON source = id WHERE relation = 'subprocess_of'), kx AS (SELECT id FROM dx UNION SELECT id FROM tx UNION SELECT id FROM up)"""


@BOOK.add("graph_scope", f"{_SCOPE} SELECT 'node' AS kind, type AS name, count(*) AS n FROM n SEMI JOIN kx USING (id) GROUP BY type UNION ALL SELECT 'edge', relation, count(*) FROM e SEMI JOIN kx a ON source = a.id SEMI JOIN kx b ON target = b.id GROUP BY relation")
def graph_scope(spark, d):
    n, e = graph.scoped(nodes(spark, d), edges(spark, d), F.col("category") == "BUILDING", "subprocess_of")
    a = n.groupBy("type").count().select(F.lit("node").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"))
    return a.union(e.groupBy("relation").count().select(F.lit("edge"), "relation", "count"))


@BOOK.add("graph_ancestors", "SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS ancestor, 1 AS depth FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world', 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 'world', 2 FROM nation")
def graph_ancestors(spark, d):
    return graph.ancestors(_hierarchy(spark, d))


def _hierarchy(spark, d):
    return (
        load(spark, d, "nation").select(_id("n", "n_nationkey").alias("child"), _id("r", "n_regionkey").alias("parent"))
        .union(load(spark, d, "region").select(_id("r", "r_regionkey"), F.lit("world")))
    )


@BOOK.add("graph_property_model", f"{_G}, x AS (SELECT type, 'label' AS property, label AS v FROM n UNION ALL SELECT type, 'category', category FROM n) SELECT type, property, count(v) AS present, count(*) AS rows, count(v) < count(*) AS nullable FROM x GROUP BY ALL")
def graph_property_model(spark, d):
    return graph.property_model(nodes(spark, d), ["label", "category"])


@BOOK.add("graph_stats", f"{_G} SELECT type, category, count(*) AS n FROM n GROUP BY ALL")
def graph_stats(spark, d):
    return nodes(spark, d).groupBy("type", "category").agg(F.count("*").alias("n"))


@BOOK.add(
    "graph_edge_evidence",
    "SELECT o_custkey AS c, l_suppkey AS s, count(*) AS mentions, count(DISTINCT o_orderkey) AS chunk_count, array_to_string(list_sort(list(DISTINCT o_orderkey))[1:5], ',') AS chunks FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
)
def graph_edge_evidence(spark, d):
    rows = _lines(spark, d, "o_custkey", "l_suppkey").select("o_orderkey", F.lit(1).alias("one"), F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"))
    return graph.edge_evidence(rows, ["c", "s"], "o_orderkey", "one").withColumn("chunks", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ","))


@BOOK.add("graph_chunk_mentions", "SELECT l_orderkey AS chunk, l_suppkey AS entity, count(*) AS mentions FROM lineitem GROUP BY ALL")
def graph_chunk_mentions(spark, d):
    """Passages as maps of entity counts, expanded again into relationships."""
    maps = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk"), "l_suppkey").agg(F.count("*").alias("n")).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("l_suppkey", "n"))).alias("mentions"))
    return maps.select("chunk", F.explode("mentions").alias("entity", "mentions"))


# --- structure checks; faults are planted by rules on the keys ----------------

_BAD = f"""{_G}, bad AS (SELECT source, target, relation FROM e
  UNION ALL SELECT source, 'x' || substr(target, 2), relation FROM e WHERE relation = 'used_in' AND length(source) = 2
  UNION ALL SELECT source, target, relation FROM e WHERE relation = 'specifies_process' AND length(source) = 3
  UNION ALL SELECT source, 'r0', relation FROM e WHERE relation = 'subprocess_of' AND target IN ('r1', 'r2')
  UNION ALL SELECT target, source, 'subprocess_of' FROM e WHERE relation = 'subprocess_of' AND source = 'n3')"""


def _planted(spark, d):
    e = edges(spark, d).drop("mentions")
    return (
        e.union(e.filter("relation = 'used_in' and length(source) = 2").select("source", F.concat(F.lit("x"), F.substring("target", 2, 20)), "relation"))
        .union(e.filter("relation = 'specifies_process' and length(source) = 3"))
        .union(e.filter("relation = 'subprocess_of' and target in ('r1', 'r2')").select("source", F.lit("r0"), "relation"))
        .union(e.filter("relation = 'subprocess_of' and source = 'n3'").select("target", "source", F.lit("subprocess_of")))
    )


@BOOK.add("graph_quality_dangling", f"{_BAD} SELECT source, target, relation FROM bad ANTI JOIN n ON target = id UNION ALL SELECT source, target, relation FROM bad SEMI JOIN n ON target = id ANTI JOIN n m2 ON source = m2.id")
def graph_quality_dangling(spark, d):
    return graph.dangling(nodes(spark, d), _planted(spark, d)).select("source", "target", "relation")


@BOOK.add("graph_quality_duplicates", f"{_BAD} SELECT source, target, relation, count(*) AS n FROM bad GROUP BY ALL HAVING count(*) > 1")
def graph_quality_duplicates(spark, d):
    return graph.duplicate_edges(_planted(spark, d))


_ALLOWED = [("process", "subprocess_of", "stream"), ("document", "specifies_process", "process"), ("system", "used_in", "process"), ("document", "mentions_system", "system")]


@BOOK.add(
    "graph_quality_conformance",
    f"""{_BAD}, ok(f, r, t) AS (VALUES {', '.join(map(str, _ALLOWED))}),
    x AS (SELECT a.type AS f, relation AS r, b.type AS t FROM bad LEFT JOIN n a ON source = a.id LEFT JOIN n b ON target = b.id)
    SELECT count(*) AS edges, count(ok.f) AS conforming, round(count(ok.f) / count(*), 6) AS share FROM x LEFT JOIN ok ON x.f = ok.f AND x.r = ok.r AND x.t = ok.t""",
)
def graph_quality_conformance(spark, d):
    return graph.schema_conformance(nodes(spark, d), _planted(spark, d), _ALLOWED)


@BOOK.add(
    "graph_quality_cycles",
    f"""{_BAD}, f AS (SELECT source AS child, min(target) AS parent FROM bad WHERE relation = 'subprocess_of' GROUP BY source),
    w(id, up, depth) AS (SELECT child, parent, 1 FROM f UNION SELECT w.id, f.parent, depth + 1 FROM w JOIN f ON w.up = f.child WHERE depth < 6) SELECT DISTINCT id FROM w WHERE id = up""",
)
def graph_quality_cycles(spark, d):
    p = _planted(spark, d).filter("relation = 'subprocess_of'").select(F.col("source").alias("child"), F.col("target").alias("parent"))
    return graph.on_cycle(p, 6)


@BOOK.add("graph_quality_multi_parent", f"{_BAD} SELECT source AS id, count(DISTINCT target) AS parents FROM bad WHERE relation = 'subprocess_of' GROUP BY 1 HAVING count(DISTINCT target) > 1")
def graph_quality_multi_parent(spark, d):
    return graph.multi_parent(_planted(spark, d), "subprocess_of")


@BOOK.add("graph_quality_property_conflicts", "SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def graph_quality_property_conflicts(spark, d):
    return graph.property_conflicts(load(spark, d, "part"), "p_name", "p_brand")


@BOOK.add("graph_quality_isolated", "SELECT 'part' || p_partkey AS id FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) x ON l_partkey = p_partkey")
def graph_quality_isolated(spark, d):
    n = load(spark, d, "part").select(_id("part", "p_partkey").alias("id"))
    e = load(spark, d, "lineitem").filter("l_quantity > 49").select(_id("part", "l_partkey").alias("source"), _id("s", "l_suppkey").alias("target"))
    return graph.degrees(n, e).filter("degree = 0").select("id")


@BOOK.add(
    "graph_quality_largest_component",
    """WITH RECURSIVE p AS (SELECT DISTINCT 'c' || c_custkey AS a, 'a' || (c_acctbal::BIGINT // 50) AS b FROM customer WHERE c_nationkey = 3
      UNION SELECT DISTINCT 's' || s_suppkey, 'a' || (s_acctbal::BIGINT // 50) FROM supplier WHERE s_nationkey = 3),
    e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a), k AS (SELECT id, min(c) AS c FROM r GROUP BY id),
    z AS (SELECT c, count(*) AS size FROM k GROUP BY c) SELECT count(*) AS components, max(size) AS largest, sum(size)::BIGINT AS nodes FROM z""",
)
def graph_quality_largest_component(spark, d):
    # half to even, then towards zero, as a cast and // do
    acct = lambda c: F.concat(F.lit("a"), F.expr(f"cast(rint({c}) AS bigint) div 50").cast("string"))
    c = load(spark, d, "customer").filter("c_nationkey = 3").select(_id("c", "c_custkey").alias("source"), acct("c_acctbal").alias("target"))
    s = load(spark, d, "supplier").filter("s_nationkey = 3").select(_id("s", "s_suppkey"), acct("s_acctbal"))
    e = c.union(s).distinct()
    n = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    z = graph.components(n, e).groupBy("component").agg(F.count("*").alias("size"))
    return z.agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.sum("size").alias("nodes"))


@BOOK.add("graph_quality_hubs", f"{_G}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e) SELECT id, count(*) AS degree FROM x GROUP BY id HAVING count(*) >= 40")
def graph_quality_hubs(spark, d):
    return graph.degrees(nodes(spark, d), edges(spark, d)).filter("degree >= 40").select("id", "degree")


@BOOK.add("graph_evidence_valid", "SELECT count(*) AS cited, count(*) FILTER (x.ok) AS valid FROM (SELECT o_orderkey, exists(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_orderkey % 10) AS ok FROM orders) x")
def graph_evidence_valid(spark, d):
    """Cited passages that really name what they are cited for."""
    cited = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("entity"))
    named = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("entity"), F.lit(True).alias("ok")).distinct()
    return cited.join(named, ["o_orderkey", "entity"], "left").agg(F.count("*").alias("cited"), F.count("ok").alias("valid"))


@BOOK.add("graph_completeness", "SELECT count(*) AS nations, count(r_regionkey) AS linked, (SELECT count(*) FROM customer SEMI JOIN orders ON o_custkey = c_custkey) AS active_documents FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def graph_completeness(spark, d):
    r = load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(1).alias("ok"))
    a = load(spark, d, "nation").join(r, "n_regionkey", "left").agg(F.count("*").alias("nations"), F.count("ok").alias("linked"))
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return a.crossJoin(load(spark, d, "customer").join(o, "c_custkey", "left_semi").agg(F.count("*").alias("active_documents")))


@BOOK.add("graph_resolve", "SELECT s_suppkey AS key, CASE WHEN lower(s_name) = 'supplier#000000001' THEN 0 WHEN starts_with(lower(s_name), 'supplier#000000001') THEN 1 ELSE 2 END AS tier FROM supplier WHERE contains(lower(s_name), 'supplier#00000000') ORDER BY tier, length(s_name), s_suppkey LIMIT 8")
def graph_resolve(spark, d):
    n = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("").alias("code"))
    q, label = F.lit("supplier#000000001"), F.lower("label")
    tier = F.when(label == q, 0).when(label.startswith(q), 1).when(label.contains("supplier#00000000"), 2)
    return n.withColumn("tier", tier).filter("tier is not null").orderBy("tier", F.length("label"), "id").limit(8).select(F.col("id").alias("key"), "tier")


# --- the answerable reference questions, as patterns over this graph -----------


def _docs(spark, d, supplier):
    return mentions(spark, d).filter(F.col("s") == supplier).select("c")


def _mentioned(supplier):
    return f"(SELECT DISTINCT o_custkey AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey = {supplier})"


_M = "m AS (SELECT o_custkey AS c, l_suppkey AS s, count(*) AS mentions FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


@BOOK.add("cy_q01", f"WITH {_M} SELECT s_name AS system, count(DISTINCT c) AS documents FROM m JOIN supplier ON s = s_suppkey GROUP BY s_name")
def cy_q01(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_name").alias("system"))
    return mentions(spark, d).join(s, "s").groupBy("system").agg(F.countDistinct("c").alias("documents"))


@BOOK.add("cy_q02", f"SELECT c AS document FROM {_mentioned(1)} SEMI JOIN {_mentioned(2)} b USING (c)")
def cy_q02(spark, d):
    return _docs(spark, d, 1).join(_docs(spark, d, 2), "c", "left_semi").select(F.col("c").alias("document"))


@BOOK.add("cy_q03", f"WITH {_M} SELECT DISTINCT s_name AS system FROM m JOIN customer ON c = c_custkey JOIN supplier ON s = s_suppkey WHERE c_mktsegment = 'BUILDING' AND s_acctbal > 5000")
def cy_q03(spark, d):
    c = load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("c"))
    s = load(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("s"), F.col("s_name").alias("system"))
    return mentions(spark, d).join(c, "c", "left_semi").join(s, "s").select("system").distinct()


@BOOK.add("cy_q04", f"SELECT c AS document FROM {_mentioned(1)} ANTI JOIN {_mentioned(2)} b USING (c)")
def cy_q04(spark, d):
    return _docs(spark, d, 1).join(_docs(spark, d, 2), "c", "left_anti").select(F.col("c").alias("document"))


@BOOK.add("cy_q05", "SELECT l_orderkey AS chunk FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def cy_q05(spark, d):
    li = load(spark, d, "lineitem").filter("l_suppkey in (1, 2)")
    return li.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.countDistinct("l_suppkey").alias("k")).filter("k = 2").select("chunk")


@BOOK.add("cy_q06", f"WITH {_M} SELECT s_suppkey AS system, count(DISTINCT c) AS documents FROM supplier LEFT JOIN m ON s = s_suppkey WHERE s_suppkey IN (1, 2, 3, 4) GROUP BY 1")
def cy_q06(spark, d):
    s = load(spark, d, "supplier").filter("s_suppkey in (1, 2, 3, 4)").select(F.col("s_suppkey").alias("s"))
    return s.join(mentions(spark, d), "s", "left").groupBy(F.col("s").alias("system")).agg(F.countDistinct("c").alias("documents"))


_IMPL = "l_returnflag = 'A' AND l_linenumber = 1"


@BOOK.add("cy_q07", f"SELECT DISTINCT l_partkey AS ticket, o_custkey AS document FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {_IMPL}")
def cy_q07(spark, d):
    return _lines(spark, d).filter(_IMPL).select(F.col("l_partkey").alias("ticket"), F.col("o_custkey").alias("document")).distinct()


@BOOK.add("cy_q08", "SELECT DISTINCT o_custkey AS document FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey = 7")
def cy_q08(spark, d):
    return _lines(spark, d).filter("l_partkey = 7").select(F.col("o_custkey").alias("document")).distinct()


@BOOK.add("cy_q09", "SELECT l_partkey AS ticket, count(DISTINCT o_custkey) AS documents FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) > 30")
def cy_q09(spark, d):
    return _lines(spark, d).groupBy(F.col("l_partkey").alias("ticket")).agg(F.countDistinct("o_custkey").alias("documents")).filter("documents > 30")


@BOOK.add("cy_q10", f"SELECT DISTINCT o_custkey AS document FROM orders JOIN lineitem ON o_orderkey = l_orderkey SEMI JOIN {_mentioned(3)} x ON o_custkey = x.c WHERE {_IMPL}")
def cy_q10(spark, d):
    docs = _docs(spark, d, 3).withColumnRenamed("c", "o_custkey")
    return _lines(spark, d).filter(_IMPL).join(docs, "o_custkey", "left_semi").select(F.col("o_custkey").alias("document")).distinct()


@BOOK.add("cy_q11", "SELECT 'n7' AS code UNION ALL SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'world'")
def cy_q11(spark, d):
    """From a node up to its root, itself included."""
    own = load(spark, d, "nation").filter("n_nationkey = 7").select(_id("n", "n_nationkey").alias("code"))
    return own.union(graph.ancestors(_hierarchy(spark, d)).filter("id = 'n7'").select("ancestor"))


@BOOK.add("cy_q12", "SELECT n_nationkey AS code, n_name AS step FROM nation WHERE n_regionkey = 2")
def cy_q12(spark, d):
    return load(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("step"))


@BOOK.add("cy_q13", "SELECT n_nationkey AS code FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5")
def cy_q13(spark, d):
    n = load(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("code"))
    c = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.count("*").alias("documents"))
    return n.join(c, "code").orderBy(F.desc("documents"), "code").limit(5).select("code")


@BOOK.add("cy_q14", "SELECT DISTINCT c_nationkey AS code FROM customer ANTI JOIN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) s ON c_nationkey = s_nationkey")
def cy_q14(spark, d):
    known = load(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("code"))
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("code")).distinct().join(known, "code", "left_anti")


@BOOK.add("cy_q15", "SELECT c_custkey AS document FROM customer WHERE c_nationkey = 5")
def cy_q15(spark, d):
    return load(spark, d, "customer").filter("c_nationkey = 5").select(F.col("c_custkey").alias("document"))


@BOOK.add("cy_q16", "SELECT r_name AS stream, count(DISTINCT c_custkey) AS documents FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def cy_q16(spark, d):
    r, n, c = load(spark, d, "region"), load(spark, d, "nation"), load(spark, d, "customer")
    j = r.join(n, r["r_regionkey"] == n["n_regionkey"], "left").join(c, n["n_nationkey"] == c["c_nationkey"], "left")
    return j.groupBy(F.col("r_name").alias("stream")).agg(F.countDistinct("c_custkey").alias("documents"))


def _streams(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("k")).join(n, "k")
    return mentions(spark, d).filter("mentions > 1").join(s.select("s", "n_regionkey"), "s").select("c", "s", "n_regionkey")


_STREAMS = f"WITH {_M}, b AS (SELECT c, s, n_regionkey AS r FROM m JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE mentions > 1)"


@BOOK.add("cy_q17", f"{_STREAMS} SELECT DISTINCT c AS document FROM b WHERE r = 1 AND c IN (SELECT c FROM b WHERE r = 2)")
def cy_q17(spark, d):
    b = _streams(spark, d)
    return b.filter("n_regionkey = 1").select("c").distinct().join(b.filter("n_regionkey = 2").select("c"), "c", "left_semi").select(F.col("c").alias("document"))


@BOOK.add("cy_q18", f"{_STREAMS} SELECT DISTINCT b2.s AS system FROM b b2 WHERE b2.c IN (SELECT c FROM b WHERE r = 3)")
def cy_q18(spark, d):
    b = _streams(spark, d)
    return b.join(b.filter("n_regionkey = 3").select("c"), "c", "left_semi").select(F.col("s").alias("system")).distinct()


@BOOK.add("cy_q19", "SELECT c_mktsegment AS category, c_acctbal < 0 AS overdrawn, count(*) AS documents FROM customer GROUP BY ALL")
def cy_q19(spark, d):
    return load(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("category"), (F.col("c_acctbal") < 0).alias("overdrawn")).agg(F.count("*").alias("documents"))


@BOOK.add("cy_q20", f"{_HOPS} SELECT hop AS length FROM h WHERE id = 's3'")
def cy_q20(spark, d):
    return graph.hops(edges(spark, d), spark.createDataFrame([("s1",)], "id string"), 6).filter("id = 's3'").select(F.col("hop").alias("length"))


@BOOK.add("cy_q21", f"SELECT c AS document FROM {_mentioned(5)} SEMI JOIN {_mentioned(6)} b USING (c)")
def cy_q21(spark, d):
    return _docs(spark, d, 5).join(_docs(spark, d, 6), "c", "left_semi").select(F.col("c").alias("document"))


@BOOK.add("cy_q22", f"SELECT c_name AS document FROM customer SEMI JOIN {_mentioned(1)} x ON c_custkey = x.c")
def cy_q22(spark, d):
    docs = _docs(spark, d, 1).withColumnRenamed("c", "c_custkey")
    return load(spark, d, "customer").join(docs, "c_custkey", "left_semi").select(F.col("c_name").alias("document"))


@BOOK.add("cy_q24", "SELECT DISTINCT l_orderkey AS chunk FROM lineitem WHERE l_suppkey = 3 AND l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1)")
def cy_q24(spark, d):
    li = load(spark, d, "lineitem")
    small = load(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    specs = li.join(small, "l_partkey", "left_semi").select("l_orderkey")
    return li.filter("l_suppkey = 3").join(specs, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("chunk")).distinct()


@BOOK.add("cy_q25", f"WITH {_M}, r AS (SELECT s AS system, c AS document, mentions, row_number() OVER (PARTITION BY s ORDER BY mentions DESC, c) AS k FROM m) SELECT system, document, mentions FROM r WHERE k = 1")
def cy_q25(spark, d):
    w = Window.partitionBy("s").orderBy(F.desc("mentions"), "c")
    return mentions(spark, d).withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.col("s").alias("system"), F.col("c").alias("document"), "mentions")


@BOOK.add("cy_q26", f"{_G} SELECT relation AS relationship, count(*) AS relationships FROM e GROUP BY 1")
def cy_q26(spark, d):
    return edges(spark, d).groupBy(F.col("relation").alias("relationship")).agg(F.count("*").alias("relationships"))


@BOOK.add(
    "tool_neighbours",
    f"""{_G}, x AS (SELECT source AS node, target AS neighbour, relation FROM e UNION ALL SELECT target, source, relation FROM e),
    r AS (SELECT node, neighbour, relation, row_number() OVER (PARTITION BY node ORDER BY neighbour, relation)::INTEGER AS place, count(*) OVER (PARTITION BY node) AS links FROM x)
    SELECT node, neighbour, relation, place, links FROM r WHERE place <= 5""",
)
def tool_neighbours(spark, d):
    """The table function of SQL: five neighbours of every node, and how many it has."""
    tables.register(spark)
    e = edges(spark, d)
    links = e.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "relation").unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "relation"))
    return spark.sql("SELECT * FROM graph_neighbours(TABLE(SELECT * FROM {links}) PARTITION BY (node), most => 5)", links=graph.first_links(links, 5))


@BOOK.add(
    "tool_top_rows",
    "SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC)::INTEGER AS place FROM part) WHERE place <= 3",
)
def tool_top_rows(spark, d):
    """A table function that takes any table: the three newest parts of each brand."""
    tables.register(spark)
    parts = load(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return spark.sql("SELECT * FROM top_rows(TABLE(SELECT * FROM {parts}), by => 'p_brand', first => 'p_partkey', n => 3)", parts=parts)
