"""Catalogue, retention, decision-log and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.operators import catalog
from quillmesh.plans.book import Book
from quillmesh.sources.tables import load

BOOK = Book()
NOW = "2024-01-30 00:00:00"


def _orders(spark, d):
    return load(spark, d, "orders")


@BOOK.add("ret_retention_top_n", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def ret_retention_top_n(spark, d):
    return catalog.newest(_orders(spark, d), 3, [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_custkey"]).select("o_custkey", "o_orderkey")


@BOOK.add("retention_newest_500", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def retention_newest_500(spark, d):
    return catalog.newest(_orders(spark, d), 500, [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey")


_LOG = "SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def _log(spark, d):
    return catalog.decision_log(_orders(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@BOOK.add("scd2_supersedes", f"SELECT o_orderkey, supersedes FROM ({_LOG})")
def scd2_supersedes(spark, d):
    return _log(spark, d).select("o_orderkey", "supersedes")


@BOOK.add("scd2_current", f"SELECT o_custkey, o_orderkey FROM ({_LOG}) WHERE is_current")
def scd2_current(spark, d):
    return _log(spark, d).filter("is_current").select("o_custkey", "o_orderkey")


@BOOK.add(
    "standing_and_superseded",
    "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS standing, count(*) - 1 AS superseded, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS history FROM orders GROUP BY 1",
)
def standing_and_superseded(spark, d):
    items = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    g = _orders(spark, d).groupBy("o_custkey").agg(items.alias("h"))
    return g.select("o_custkey", F.element_at("h", -1)["o_orderkey"].alias("standing"), (F.size("h") - 1).cast("long").alias("superseded"), F.array_join(F.transform("h", lambda x: x["o_orderkey"].cast("string")), ",").alias("history"))


@BOOK.add(
    "stale_status",
    f"SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '{NOW}' - INTERVAL 300 MINUTE THEN 'abandoned' ELSE 'running' END AS status FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1",
)
def stale_status(spark, d):
    now = F.lit(NOW).cast("timestamp")
    last = load(spark, d, "events").filter(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("started"))
    return last.select("user_id", catalog.run_status(F.lit("running"), F.col("started"), now, 300).alias("status"))


@BOOK.add("ttl_expired", f"SELECT user_id, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS expires FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 12 HOUR < TIMESTAMP '{NOW}'")
def ttl_expired(spark, d):
    e = catalog.expired(load(spark, d, "events"), "ts", 12, F.lit(NOW).cast("timestamp"), "user_id")
    return e.select("user_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@BOOK.add("ttl_orphans", "SELECT s_suppkey FROM supplier ANTI JOIN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0) x ON l_suppkey = s_suppkey")
def ttl_orphans(spark, d):
    used = load(spark, d, "lineitem").filter("l_quantity = 50 and l_discount = 0").select(F.col("l_suppkey").alias("s_suppkey"))
    return catalog.orphans(load(spark, d, "supplier").select("s_suppkey"), used, "s_suppkey")


@BOOK.add(
    "upsert_latest",
    """WITH b AS (SELECT o_custkey AS k, o_orderdate AS v, o_orderkey AS x, 0 AS new FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, new DESC, x DESC) AS n FROM b) SELECT k, x FROM r WHERE n = 1""",
)
def upsert_latest(spark, d):
    o = _orders(spark, d).select(F.col("o_custkey").alias("k"), F.struct("o_orderdate", (F.col("o_orderkey") % 2).alias("new"), "o_orderkey").alias("v"), F.col("o_orderkey").alias("x"))
    return catalog.upsert(o.filter("x % 2 = 0"), o.filter("x % 2 = 1"), ["k"], "v").select("k", "x")


@BOOK.add("insert_if_absent", "SELECT c_custkey FROM customer WHERE c_nationkey < 10 UNION SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 8 AND 12")
def insert_if_absent(spark, d):
    c = load(spark, d, "customer")
    return catalog.insert_if_absent(c.filter("c_nationkey < 10"), c.filter("c_nationkey between 8 and 12"), ["c_custkey"]).select("c_custkey")


@BOOK.add("replace_documents", "SELECT doc_id, 'old' AS version FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 5 = 0")
def replace_documents(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    return catalog.replace_by(docs.withColumn("version", F.lit("old")), docs.filter("doc_id % 5 = 0").withColumn("version", F.lit("new")), "doc_id")


@BOOK.add(
    "fingerprint_delta",
    """WITH o AS (SELECT doc_id, sha256('v1' || chr(10) || text) AS f, lang AS c FROM documents WHERE doc_id % 10 <> 1),
    n AS (SELECT doc_id, sha256('v1' || chr(10) || CASE WHEN doc_id % 10 = 3 THEN text || '.' ELSE text END) AS f, CASE WHEN doc_id % 10 = 4 THEN 'xx' ELSE lang END AS c FROM documents WHERE doc_id % 10 <> 2)
    SELECT doc_id, CASE WHEN o.f IS NULL THEN 'added' WHEN n.f IS NULL THEN 'gone' WHEN o.f <> n.f THEN 'updated' WHEN o.c IS DISTINCT FROM n.c THEN 'recategorised' ELSE 'unchanged' END AS status FROM o FULL JOIN n USING (doc_id)""",
)
def fingerprint_delta(spark, d):
    docs = load(spark, d, "documents")
    at = lambda text: catalog.document_fingerprint(text)
    old = docs.filter("doc_id % 10 <> 1").select("doc_id", at(F.col("text")).alias("fingerprint"), F.col("lang").alias("category"))
    text = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    new = docs.filter("doc_id % 10 <> 2").select("doc_id", at(text).alias("fingerprint"), F.when(F.col("doc_id") % 10 == 4, "xx").otherwise(F.col("lang")).alias("category"))
    return catalog.fingerprint_delta(old, new, "doc_id")


@BOOK.add("document_fingerprint", "SELECT doc_id, sha256('v1' || chr(10) || text) AS fingerprint FROM documents")
def document_fingerprint(spark, d):
    return load(spark, d, "documents").select("doc_id", catalog.document_fingerprint(F.col("text")).alias("fingerprint"))


def _bucketed(table: str, by: str, key: str, value: str) -> str:
    """SQL of catalog.bucketed_digest for keys below 10,000 squared."""
    group = f"{by}, " if by else ""
    return f"""WITH b AS (SELECT {group}floor({key} / 10000)::BIGINT AS k, sha256(string_agg({key} || ':' || {value}, chr(10) ORDER BY {key})) AS v, count(*) AS n FROM {table} GROUP BY ALL)
    SELECT {group}left(sha256(string_agg(v, chr(10) ORDER BY k)), 16) AS fingerprint, sum(n)::BIGINT AS n FROM b {f"GROUP BY {by}" if by else ""}"""


@BOOK.add("corpus_fingerprint_by_source", _bucketed("documents", "source", "doc_id", "md5(text)"))
def corpus_fingerprint_by_source(spark, d):
    docs = load(spark, d, "documents").select("source", "doc_id", F.md5("text").alias("f"))
    return catalog.bucketed_digest(docs, ["source"], "doc_id", "f")


@BOOK.add("corpus_fingerprint", _bucketed("documents", "", "doc_id", "sha256(text)"))
def corpus_fingerprint(spark, d):
    """One fingerprint of all documents, by way of bucket digests."""
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return catalog.bucketed_digest(docs, [], "doc_id", "fingerprint")


@BOOK.add("digest_by_group", _bucketed("customer", "c_nationkey", "c_custkey", "c_name"))
def digest_by_group(spark, d):
    return catalog.bucketed_digest(load(spark, d, "customer"), ["c_nationkey"], "c_custkey", "c_name")


@BOOK.add("index_signature", "SELECT o_custkey, min(o_orderkey) AS first_chunk, count(*) AS chunks, left(sha256(o_custkey || ':' || min(o_orderkey) || ':' || count(*)), 16) AS signature FROM orders GROUP BY 1")
def index_signature(spark, d):
    g = _orders(spark, d).groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_chunk"), F.count("*").alias("chunks"))
    return g.withColumn("signature", F.left(F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("o_custkey", "first_chunk", "chunks"))), 256), F.lit(16)))


_COV = """WITH k AS (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings),
  f AS (SELECT k.doc_id, k.doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 50 <> 0) AS on_disk, k.doc_id IN (SELECT doc_id FROM labels) AS in_corpus, k.doc_id IN (SELECT vec_id FROM embeddings) AS in_graph FROM k),
  c AS (SELECT *, CASE WHEN NOT on_disk THEN 'file gone' WHEN NOT in_corpus AND NOT in_graph THEN 'unused' WHEN NOT in_corpus THEN 'not indexed' WHEN NOT in_graph THEN 'not in graph' ELSE 'clean' END AS issue FROM f WHERE on_disk OR in_corpus OR in_graph)"""


def _coverage(spark, d):
    disk = load(spark, d, "documents").filter("doc_id % 50 <> 0").select("doc_id")
    return catalog.coverage(disk, load(spark, d, "labels").select("doc_id"), load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@BOOK.add("coverage_3way", f"{_COV} SELECT * FROM c")
def coverage_3way(spark, d):
    return _coverage(spark, d)


@BOOK.add("coverage_summary", f"{_COV}, s(issue, severity) AS (VALUES ('file gone', 0), ('not indexed', 1), ('not in graph', 2), ('unused', 3), ('clean', 4)) SELECT s.issue, severity, count(c.issue) AS n FROM s LEFT JOIN c USING (issue) GROUP BY ALL")
def coverage_summary(spark, d):
    return catalog.coverage_summary(_coverage(spark, d))


@BOOK.add("shadowed_files", "SELECT p_partkey, first_value(p_partkey) OVER w AS kept, row_number() OVER w > 1 AS shadowed FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_brand, p_partkey)")
def shadowed_files(spark, d):
    return catalog.shadowed(load(spark, d, "part"), "p_name", ["p_brand", "p_partkey"]).select("p_partkey", "kept", "shadowed")


@BOOK.add("duplicate_keys", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return load(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


@BOOK.add("id_remap", "SELECT l_orderkey, l_linenumber, coalesce(m.new_id, l_partkey) AS l_partkey FROM lineitem LEFT JOIN (SELECT p_partkey AS old_id, p_partkey + 1000000 AS new_id FROM part WHERE p_size > 25) m ON l_partkey = old_id")
def id_remap(spark, d):
    mapping = load(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") + 1000000).alias("new_id"))
    return catalog.remap(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), mapping, "l_partkey")


@BOOK.add(
    "id_remap_nested",
    """SELECT l_orderkey, string_agg((CASE WHEN p_size > 25 THEN l_partkey + 1000000 ELSE l_partkey END)::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS cited FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def id_remap_nested(spark, d):
    cited = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("cited"))
    mapping = load(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") + 1000000).alias("new_id"))
    out = catalog.remap_array(cited, mapping, "l_orderkey", "cited")
    return out.select("l_orderkey", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"))


@BOOK.add(
    "preflight_checks",
    """SELECT 'vector width' AS "check", count(*) FILTER (len(embedding) <> 64) AS violations, count(*) FILTER (len(embedding) <> 64) = 0 AS passed FROM embeddings
    UNION ALL SELECT 'empty documents', count(*), count(*) = 0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL SELECT 'duplicate names', count(*), count(*) = 0 FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'dangling lines', count(*), count(*) = 0 FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey""",
)
def preflight_checks(spark, d):
    orders = _orders(spark, d)
    return catalog.checks(
        spark,
        ("vector width", load(spark, d, "embeddings").filter(F.size("embedding") != 64)),
        ("empty documents", load(spark, d, "customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")),
        ("duplicate names", duplicate_keys(spark, d)),
        ("dangling lines", load(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")),
    )


@BOOK.add(
    "batch_validation",
    """WITH b AS (SELECT o_custkey AS gap, CASE o_orderstatus WHEN 'F' THEN 'adopt' WHEN 'O' THEN 'reject' ELSE 'maybe' END AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'because' END AS reason FROM orders WHERE o_orderdate >= DATE '2001-07-01'),
    t AS (SELECT *, count(*) OVER (PARTITION BY gap) AS times, gap IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) AS known FROM b)
    SELECT DISTINCT gap, problem FROM (SELECT gap, unnest([CASE WHEN NOT known THEN 'unknown' END, CASE WHEN times > 1 THEN 'duplicate' END, CASE WHEN verdict NOT IN ('adopt', 'reject') THEN 'bad verdict' END,
      CASE WHEN verdict = 'reject' AND reason = '' THEN 'no rationale' END]) AS problem FROM t) WHERE problem IS NOT NULL""",
)
def batch_validation(spark, d):
    o = _orders(spark, d).filter("o_orderdate >= date'2001-07-01'")
    batch = o.select(F.col("o_custkey").alias("gap"), F.when(F.col("o_orderstatus") == "F", "adopt").when(F.col("o_orderstatus") == "O", "reject").otherwise("maybe").alias("verdict"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("because").alias("reason"))
    known = load(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("gap"))
    return catalog.batch_violations(batch, known, "gap", "verdict", "reason", ["adopt", "reject"], ["reject"])


@BOOK.add("single_baseline", "SELECT s_suppkey, s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 7) AS baseline FROM supplier")
def single_baseline(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    chosen = s.filter("s_nationkey = 7").agg(F.min("s_suppkey").alias("chosen"))
    return catalog.single_baseline(s.crossJoin(F.broadcast(chosen)), "s_suppkey", F.col("chosen")).select("s_suppkey", "baseline")


@BOOK.add("documents_listing", "SELECT o_custkey AS doc, count(*) AS chunks, sum(greatest(1, floor(o_totalprice / 4)::BIGINT))::BIGINT AS tokens FROM orders GROUP BY 1")
def documents_listing(spark, d):
    return _orders(spark, d).groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("chunks"), F.sum(F.greatest(F.lit(1), F.floor(F.col("o_totalprice") / 4).cast("long"))).alias("tokens"))


@BOOK.add("totals_by_category", "SELECT c_mktsegment AS category, count(DISTINCT c_custkey) AS documents, count(o_orderkey) AS chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def totals_by_category(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))
    j = c.join(_orders(spark, d).select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey", "left")
    return j.groupBy("category").agg(F.countDistinct("c_custkey").alias("documents"), F.count("o_orderkey").alias("chunks"))


@BOOK.add("catalogue_listing", "SELECT doc_id, 'indexed' AS state FROM labels UNION ALL SELECT doc_id, 'on disk' FROM documents ANTI JOIN labels USING (doc_id)")
def catalogue_listing(spark, d):
    indexed = load(spark, d, "labels").select("doc_id")
    return indexed.withColumn("state", F.lit("indexed")).unionByName(load(spark, d, "documents").select("doc_id").join(indexed, "doc_id", "left_anti").withColumn("state", F.lit("on disk")))


@BOOK.add("category_drift", "SELECT s_suppkey, p.n_regionkey AS parent, s_nationkey % 5 AS own FROM supplier JOIN nation p ON s_nationkey = n_nationkey WHERE p.n_regionkey <> s_nationkey % 5 OR s_suppkey % 9 = 0")
def category_drift(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("parent"))
    j = load(spark, d, "supplier").join(n, "s_nationkey").withColumn("own", F.col("s_nationkey") % 5)
    return j.filter((F.col("parent") != F.col("own")) | (F.col("s_suppkey") % 9 == 0)).select("s_suppkey", "parent", "own")


@BOOK.add("stable_score_ids", "SELECT event_id, left(sha256(event_id || ':' || event_type), 32) AS score_id FROM events")
def stable_score_ids(spark, d):
    from quillmesh.functions.scalar import stable_id

    return load(spark, d, "events").select("event_id", stable_id(F.col("event_id").cast("string"), F.col("event_type")).alias("score_id"))


@BOOK.add("run_set_difference", "SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS left_out, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS entered FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-03'), []) AS a, coalesce(list(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-28'), []) AS b FROM events GROUP BY 1)")
def run_set_difference(spark, d):
    """What entered and what left between two runs."""
    e = load(spark, d, "events")
    early, late = F.col("ts") < F.lit("2024-01-03").cast("timestamp"), F.col("ts") >= F.lit("2024-01-28").cast("timestamp")
    g = e.groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("a"), F.collect_set(F.when(late, F.col("event_type"))).alias("b"))
    diff = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return g.select("user_id", diff("a", "b").alias("left_out"), diff("b", "a").alias("entered"))


@BOOK.add("capped_with_flag", "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 10) > 200 AS truncated FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 200")
def capped_with_flag(spark, d):
    from quillmesh.operators.graph import capped

    return capped(load(spark, d, "part").filter("p_size > 10"), 200, F.desc("p_retailprice"), "p_partkey").select("p_partkey", "truncated")


@BOOK.add("budget_flags", "SELECT conv_id, turn, sum(length(text) // 4) OVER w AS used, sum(length(text) // 4) OVER w >= 300 AS exhausted FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def budget_flags(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.floor(F.length("text") / 4).cast("long")).over(w)
    return load(spark, d, "conversations").select("conv_id", "turn", used.alias("used"), (used >= 300).alias("exhausted"))
