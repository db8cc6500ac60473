"""Review queues, reports, validators and result comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.operators import graph, review
from quillmesh.plans import graph_queries as g
from quillmesh.plans.book import Book
from quillmesh.sources import sinks
from quillmesh.sources.tables import load

BOOK = Book()


@BOOK.add(
    "review_queue",
    """SELECT doc_id, reason FROM (SELECT d.doc_id, CASE WHEN quality = 0 AND length(text) >= 2000 THEN 'disagree' WHEN quality = 1 AND length(text) < 100 THEN 'split' WHEN n_chars % 17 = 0 THEN 'unstable' ELSE 'sample' END AS reason, sha256(d.doc_id::VARCHAR) AS draw
      FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
    ORDER BY CASE reason WHEN 'disagree' THEN 0 WHEN 'split' THEN 1 WHEN 'unstable' THEN 2 ELSE 3 END, draw, doc_id LIMIT 30""",
)
def review_queue(spark, d):
    labels = load(spark, d, "labels")
    rows = load(spark, d, "documents").join(labels.select("doc_id", "quality"), "doc_id")
    n, q = F.length("text"), F.col("quality")
    reasons = [("disagree", (q == 0) & (n >= 2000)), ("split", (q == 1) & (n < 100)), ("unstable", F.col("n_chars") % 17 == 0)]
    return review.review_queue(rows, "doc_id", reasons, F.sha2(F.col("doc_id").cast("string"), 256), 30, labels.filter("toxic = 1"))


@BOOK.add(
    "score_report",
    """WITH s AS (SELECT event_type AS name, round(avg(least(value / 100, 1)), 6) AS value FROM events WHERE event_type <> 'view' GROUP BY 1), k(name, goal, watch) AS (VALUES ('click', 0.5, 0.3), ('view', 0.5, 0.3), ('error', 0.2, 0.1), ('purchase', 0.9, 0.38), ('signup', 0.9, 0.8))
    SELECT k.name, goal::DOUBLE AS goal, watch::DOUBLE AS watch, value, CASE WHEN value IS NULL THEN 'not assessed' WHEN value >= goal THEN 'pass' WHEN value >= watch THEN 'watch' ELSE 'below' END AS status FROM k LEFT JOIN s USING (name)""",
)
def score_report(spark, d):
    s = load(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg(F.least(F.col("value") / 100, F.lit(1.0))), 6).alias("value"))
    specs = spark.createDataFrame([("click", 0.5, 0.3), ("view", 0.5, 0.3), ("error", 0.2, 0.1), ("purchase", 0.9, 0.38), ("signup", 0.9, 0.8)], "name string, goal double, watch double")
    return review.score_report(s, specs)


@BOOK.add(
    "agent_scores",
    """WITH c AS (SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type || ':' || json_extract(props, '$.k')) AS different FROM events GROUP BY 1)
    SELECT user_id, calls, round(errors / calls, 4) AS error_rate, calls - different AS repeats, round((calls - different) / calls, 4) AS repeat_share FROM c""",
)
def agent_scores(spark, d):
    return review.call_scores(load(spark, d, "events"), ["user_id"], F.col("event_type") == "error", F.concat_ws(":", F.col("event_type"), F.get_json_object("props", "$.k")))


@BOOK.add(
    "constraint_violations",
    """SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 40 THEN 'returned while open' END, CASE WHEN l_discount >= 0.09 AND l_tax >= 0.07 THEN 'discount and tax' END,
      CASE WHEN l_extendedprice < 0 THEN 'negative price' END]) AS rule FROM lineitem) WHERE rule IS NOT NULL""",
)
def constraint_violations(spark, d):
    rules = {
        "returned while open": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40),
        "discount and tax": (F.col("l_discount") >= 0.09) & (F.col("l_tax") >= 0.07),
        "negative price": F.col("l_extendedprice") < 0,
    }
    return review.violations(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], rules)


@BOOK.add("judge_agreement", "SELECT lang, count(*) AS pairs, round(count(*) FILTER ((quality = 1) = (length(text) >= 200)) / count(*), 4) AS agreement FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def judge_agreement(spark, d):
    j = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    same = (F.col("quality") == 1) == (F.length("text") >= 200)
    return j.groupBy("lang").agg(F.count("*").alias("pairs"), F.round(F.count_if(same) / F.count("*"), 4).alias("agreement"))


@BOOK.add("metric_findings", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') || ' of ' || count(*) || ' supported; first useful at ' || coalesce(min(l_linenumber) FILTER (l_returnflag = 'A')::VARCHAR, 'none') AS finding FROM lineitem GROUP BY 1")
def metric_findings(spark, d):
    """One line per answer from its judged items."""
    good = F.col("l_returnflag") == "A"
    a = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(good).alias("k"), F.count("*").alias("n"), F.min(F.when(good, F.col("l_linenumber"))).alias("f"))
    return a.select("l_orderkey", F.concat(F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" supported; first useful at "), F.coalesce(F.col("f").cast("string"), F.lit("none"))).alias("finding"))


@BOOK.add("judge_caveats", "SELECT user_id, CASE WHEN count(*) >= 5 AND count(*) FILTER (value > 100) / count(*) > 0.15 THEN 'unstable' WHEN count(*) FILTER (value < 5) / count(*) > 0.10 THEN 'dropped' END AS caveat FROM events GROUP BY 1")
def judge_caveats(spark, d):
    n = F.count("*")
    unstable, dropped = (n >= 5) & (F.count_if(F.col("value") > 100) / n > 0.15), F.count_if(F.col("value") < 5) / n > 0.10
    return load(spark, d, "events").groupBy("user_id").agg(F.when(unstable, "unstable").when(dropped, "dropped").alias("caveat"))


@BOOK.add("area_peaks", "SELECT l_orderkey, max(l_quantity) AS peak, sum(l_quantity) AS total, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY max(l_quantity) DESC, sum(l_quantity) DESC, l_orderkey)::INTEGER AS position FROM lineitem GROUP BY 1")
def area_peaks(spark, d):
    a = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("peak"), F.sum("l_quantity").alias("total"))
    area = (F.col("l_orderkey") % 100).alias("area")
    placed = review.numbered(a.select("*", area), F.asc("area"), F.desc("peak"), F.desc("total"), F.asc("l_orderkey"))
    first = placed.groupBy("area").agg(F.min("number").alias("first"))
    return placed.join(first, "area").select("l_orderkey", "peak", "total", (F.col("number") - F.col("first") + 1).cast("int").alias("position"))


@BOOK.add("check_rates", "SELECT o_orderpriority, count(*) AS asked, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS accuracy, round(count(*) FILTER (o_orderstatus <> 'P') / count(*), 4) AS valid, count(*) FILTER (o_totalprice < 20000) AS empty FROM orders GROUP BY 1")
def check_rates(spark, d):
    s, n = F.col("o_orderstatus"), F.count("*")
    g_ = load(spark, d, "orders").groupBy("o_orderpriority")
    return g_.agg(n.alias("asked"), F.round(F.count_if(s == "F") / n, 4).alias("accuracy"), F.round(F.count_if(s != "P") / n, 4).alias("valid"), F.count_if(F.col("o_totalprice") < 20000).alias("empty"))


@BOOK.add("compare_rows", "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, true AS same")
def compare_rows(spark, d):
    """Two plans of one question give the same bag of rows."""
    li = load(spark, d, "lineitem").filter("l_suppkey in (1, 2)")
    other = li.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_set("l_suppkey").alias("s")).filter("size(s) = 2").select("chunk", F.lit("more").alias("note"))
    return review.same_rows(g.cy_q05(spark, d), other)


@BOOK.add("compare_values", "SELECT 0::BIGINT AS missing, true AS same")
def compare_values(spark, d):
    return review.holds_values(g.cy_q13(spark, d), g.cy_q12(spark, d).union(load(spark, d, "nation").select("n_nationkey", "n_name")))


@BOOK.add("graph_schema_text", f"{g._G}, p AS (SELECT a.type AS f, relation, b.type AS t, count(*) AS n FROM e JOIN n a ON source = a.id JOIN n b ON target = b.id GROUP BY ALL) SELECT f AS type, string_agg('(' || f || ')-[' || relation || ']->(' || t || ') ' || n, chr(10) ORDER BY relation, t) AS text FROM p GROUP BY 1")
def graph_schema_text(spark, d):
    p = graph.edge_types(g.nodes(spark, d), g.edges(spark, d))
    line = F.concat(F.lit("("), "from_type", F.lit(")-["), "relation", F.lit("]->("), "to_type", F.lit(") "), F.col("n").cast("string"))
    items = F.array_sort(F.collect_list(F.struct("relation", "to_type", line.alias("line"))))
    return p.groupBy(F.col("from_type").alias("type")).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("text"))


@BOOK.add("graph_anchors", f"{g._G}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e) SELECT id, count(*) AS degree FROM x GROUP BY id ORDER BY degree DESC, id LIMIT 5")
def graph_anchors(spark, d):
    return graph.degrees(g.nodes(spark, d), g.edges(spark, d)).orderBy(F.desc("degree"), "id").limit(5).select("id", "degree")


@BOOK.add("graph_samples", f"{g._G}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e), q AS (SELECT n.id, n.type, count(x.id) AS degree FROM n LEFT JOIN x USING (id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY degree DESC, id)::INTEGER AS place FROM q) SELECT id, type, degree, place FROM r WHERE place <= 14")
def graph_samples(spark, d):
    deg = graph.degrees(g.nodes(spark, d), g.edges(spark, d)).select("id", "type", "degree")
    return review.top_per_group(deg, ["type"], [F.desc("degree"), F.col("id")], 14)


@BOOK.add("graph_chunks_of_entity", "SELECT DISTINCT l_orderkey AS chunk FROM lineitem WHERE l_suppkey = 3")
def graph_chunks_of_entity(spark, d):
    """Passages whose map of mentions holds an entity."""
    maps = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk"), "l_suppkey").agg(F.count("*").alias("n")).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("l_suppkey", "n"))).alias("mentions"))
    return maps.filter(F.map_contains_key("mentions", F.lit(3).cast("long"))).select("chunk")


@BOOK.add("session_compare", "WITH e AS (SELECT l_partkey AS p, l_orderkey AS doc, l_orderkey % 100 = 0 AS mine FROM lineitem) SELECT p, count(*) FILTER (mine) AS mentions, count(*) FILTER (NOT mine) AS corpus_mentions, coalesce(array_to_string(list_sort(list(DISTINCT doc) FILTER (NOT mine))[1:3], ','), '') AS documents FROM e GROUP BY p HAVING count(*) FILTER (mine) > 0")
def session_compare(spark, d):
    """Entities of a session with their mentions and a few corpus documents."""
    e = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") % 100 == 0).alias("mine"))
    a = e.groupBy("p").agg(F.count_if("mine").alias("mentions"), F.count_if(~F.col("mine")).alias("corpus_mentions"), F.slice(F.array_sort(F.collect_set(F.when(~F.col("mine"), F.col("doc")))), 1, 3).alias("t")).filter("mentions > 0")
    return a.select("p", "mentions", "corpus_mentions", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("documents"))


@BOOK.add("cluster_sizes", "WITH c AS (SELECT label, count(*) AS size, min(vec_id) AS first FROM embeddings GROUP BY 1) SELECT label, size, row_number() OVER (ORDER BY size DESC, first)::INTEGER AS cluster FROM c")
def cluster_sizes(spark, d):
    """Clusters numbered by size, equal ones by their first member."""
    c = load(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("size"), F.min("vec_id").alias("first"))
    return review.numbered(c, F.desc("size"), F.asc("first"), name="cluster").select("label", "size", F.col("cluster").cast("int").alias("cluster"))


@BOOK.add("register_markdown", "SELECT s_nationkey AS nation, '# Suppliers of ' || s_nationkey || chr(10) || chr(10) || '| s_suppkey | s_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) ORDER BY s_suppkey) AS document FROM supplier GROUP BY 1")
def register_markdown(spark, d):
    s = load(spark, d, "supplier").withColumn("nation", F.col("s_nationkey"))
    title = F.concat(F.lit("Suppliers of "), F.col("nation").cast("string"))
    return sinks.markdown_documents(s, "nation", ["s_suppkey"], ["s_suppkey", "s_name"], title)
