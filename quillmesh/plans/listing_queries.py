"""Listings, scopes, formats and checks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import scalar
from quillmesh.operators import catalog, evidence, guardrails
from quillmesh.plans.book import Book
from quillmesh.sources.tables import load

BOOK = Book()


@BOOK.add(
    "cell_formats",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'FALSE' END AS done, strftime(o_orderdate, '%Y-%m-%d') AS ordered, CASE WHEN o_totalprice = floor(o_totalprice) THEN (o_totalprice::BIGINT)::VARCHAR ELSE o_totalprice::VARCHAR END AS price,
    strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS noted FROM orders""",
)
def cell_formats(spark, d):
    o = load(spark, d, "orders")
    return o.select(
        "o_orderkey",
        scalar.cell_format(F.col("o_orderstatus") == "F", "boolean").alias("done"),
        scalar.cell_format(F.col("o_orderdate"), "timestamp").alias("ordered"),
        scalar.cell_format(F.col("o_totalprice"), "double").alias("price"),
        scalar.cell_format(F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(1)), "timestamp").alias("noted"),
    )


@BOOK.add("named_pages", r"SELECT page_id FROM pages WHERE split_part(url, '?', 1) LIKE '%/825' OR url = '825' OR split_part(url, '?', 1) LIKE '%/index.html'")
def named_pages(spark, d):
    path = F.substring_index("url", "?", 1)
    return load(spark, d, "pages").filter(scalar.path_named(path, "825") | scalar.path_named(path, "index.html")).select("page_id")


@BOOK.add("codes_under", "SELECT p_partkey FROM (SELECT p_partkey, p_type, (p_size % 7)::VARCHAR || '.' || p_size AS code FROM part) WHERE (code = '3' OR code LIKE '3.%') AND lower(p_type) = lower('Economy')")
def codes_under(spark, d):
    code = F.concat((F.col("p_size") % 7).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    return load(spark, d, "part").filter(scalar.under(code, "3") & (F.lower("p_type") == F.lower(F.lit("Economy")))).select("p_partkey")


_WORD = r"(^|[^\p{L}\p{N}_])(?:the|und|le)($|[^\p{L}\p{N}_])"


@BOOK.add("held_out_documents", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_WORD}', '\1•••\2', 'g'), '{_WORD}', '\1•••\2', 'g')) AS masked FROM documents WHERE source IS NULL OR NOT lower(source) LIKE 'src1%'")
def held_out_documents(spark, d):
    """Documents of held-out sources are left out, telling words of the others are masked."""
    docs = load(spark, d, "documents").filter(~F.coalesce(scalar.glob_like(F.col("source"), "SRC1*"), F.lit(False)))
    return docs.select("doc_id", F.md5(scalar.mask_words(F.col("text"), "the", "und", "le")).alias("masked"))


@BOOK.add("agreeing_keys", "SELECT c_custkey FROM customer WHERE split_part(CASE WHEN c_nationkey < 12 THEN c_mktsegment ELSE 'FURNITURE' END || ':' || c_custkey, ':', 1) = c_mktsegment")
def agreeing_keys(spark, d):
    key = F.concat(F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).otherwise("FURNITURE"), F.lit(":"), F.col("c_custkey").cast("string"))
    c = load(spark, d, "customer").withColumn("key", key)
    return c.filter(scalar.key_agrees(F.col("key"), F.col("c_mktsegment"), F.col("c_custkey"))).select("c_custkey")


@BOOK.add("open_categories", "SELECT DISTINCT c_mktsegment AS category FROM customer WHERE c_mktsegment NOT IN ('ALL', 'UNFILED') AND c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9000)")
def open_categories(spark, d):
    c = load(spark, d, "customer").select(F.col("c_mktsegment").alias("category"), "c_acctbal")
    known = c.filter("c_acctbal > 9000").select("category").distinct()
    return c.filter(~F.col("category").isin(*catalog.RESERVED)).select("category").distinct().join(known, "category", "left_semi")


@BOOK.add("history_list", "SELECT o_orderkey, count(l_orderkey) AS evaluations, round(avg(l_discount), 6) AS overall FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1 GROUP BY 1")
def history_list(spark, d):
    """Every run with its evaluations, those without any too."""
    e = load(spark, d, "lineitem").filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("evaluations"), F.round(F.avg("l_discount"), 6).alias("overall"))
    return load(spark, d, "orders").select("o_orderkey").join(e, "o_orderkey", "left").select("o_orderkey", F.coalesce("evaluations", F.lit(0).cast("long")).alias("evaluations"), "overall")


@BOOK.add("experiment_list", "SELECT user_id, count(*) AS items, round(avg(value), 4) AS overall, round(avg((json_extract(props, '$.k'))::DOUBLE), 4) AS metric FROM events GROUP BY 1")
def experiment_list(spark, d):
    metric = F.get_json_object("props", "$.k").cast("double")
    return load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("items"), F.round(F.avg("value"), 4).alias("overall"), F.round(F.avg(metric), 4).alias("metric"))


@BOOK.add("distinct_lines", "SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10))) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def distinct_lines(spark, d):
    """Each document's lines once, in the order of their first places."""
    return load(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.array_distinct(F.split("text", "\n")), "\n")).alias("digest"))


@BOOK.add(
    "settings_that_differ",
    """SELECT a.o_orderkey, concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'status' END, CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'priority' END, CASE WHEN a.o_custkey <> b.o_custkey THEN 'customer' END) AS differs FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""",
)
def settings_that_differ(spark, d):
    s = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("customer"), F.col("o_custkey").cast("string"))
    o = load(spark, d, "orders").select("o_orderkey", s.alias("a"))
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("a").alias("b"))
    return o.join(b, "o_orderkey").select("o_orderkey", F.array_join(scalar.keys_that_differ(F.col("a"), F.col("b"), "status", "priority", "customer"), ",").alias("differs"))


@BOOK.add(
    "regressions_first",
    """SELECT event_id, verdict, delta FROM (SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS delta, CASE WHEN delta IS NULL THEN 'missing' WHEN delta < -50 THEN 'regressed' WHEN delta > 50 THEN 'improved' ELSE 'unchanged' END AS verdict FROM events)
    ORDER BY CASE verdict WHEN 'regressed' THEN 0 WHEN 'improved' THEN 1 WHEN 'missing' THEN 2 ELSE 3 END, CASE WHEN verdict = 'regressed' THEN delta ELSE -delta END, event_id LIMIT 100""",
)
def regressions_first(spark, d):
    """The first page of a comparison: what got worse, worst first, then what got better."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = load(spark, d, "events").select("event_id", F.round(F.col("value") - before, 4).alias("delta"))
    verdict = F.when(F.col("delta").isNull(), "missing").when(F.col("delta") < -50, "regressed").when(F.col("delta") > 50, "improved").otherwise("unchanged")
    rank = F.array_position(F.array(*map(F.lit, ("regressed", "improved", "missing", "unchanged"))), F.col("verdict"))
    worst = F.when(F.col("verdict") == "regressed", F.col("delta")).otherwise(-F.col("delta"))
    return e.withColumn("verdict", verdict).orderBy(rank, worst.asc_nulls_last(), "event_id").limit(100).select("event_id", "verdict", "delta")


@BOOK.add("redact_nested", f"SELECT doc_id, md5(regexp_replace(text, '{guardrails.EMAIL}', '{guardrails.MASK}', 'g')) AS digest FROM documents")
def redact_nested(spark, d):
    """Addresses masked inside arrays of structs, structure kept."""
    rows = load(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"))).alias("items"))
    masked = F.transform("items", lambda s: s.withField("line", guardrails.mask_email(s["line"])))
    return rows.select("doc_id", F.md5(F.array_join(F.transform(masked, lambda s: s["line"]), "\n")).alias("digest"))


@BOOK.add("redact_nested_contacts")
def redact_nested_contacts(spark, d):
    """Addresses and phone numbers masked inside arrays of structs, keys and structure kept."""
    rows = load(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.length(x).alias("size"))).alias("items"))
    masked = guardrails.redact_fields(rows, "items")
    return masked.select("doc_id", F.md5(F.array_join(F.transform("items", lambda s: s["line"]), "\n")).alias("digest"), F.size("items").alias("lines"))


@BOOK.add("client_copy", "SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\",\"item\":{\"priority\":\"' || o_orderpriority || '\"}}' AS copy FROM orders")
def client_copy(spark, d):
    from quillmesh.operators.entries import without_fields

    item = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("chunk_id"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("score")).alias("item"))
    return load(spark, d, "orders").select("o_orderkey", F.to_json(without_fields(item, "chunk_id", "item.score")).alias("copy"))


@BOOK.add("new_texts", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) GROUP BY 1")
def new_texts(spark, d):
    """Texts still to embed: each once, those of labelled documents are known."""
    docs = load(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    known = docs.join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("digest").distinct()
    return evidence.unseen(docs, known, "digest", "doc_id")


@BOOK.add("store_reads", "SELECT o_custkey, coalesce(split_part(k, ':', 1), 'searched') AS store, count(*) AS hits FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ':' || o_orderkey WHEN o_orderstatus = 'O' THEN 'graph:' || o_orderkey END AS k FROM orders) GROUP BY ALL")
def store_reads(spark, d):
    """Hits by the store their key names; calls without a key count for what was searched."""
    key = F.when(F.col("o_orderstatus") == "F", F.concat_ws(":", "o_orderpriority", "o_orderkey")).when(F.col("o_orderstatus") == "O", F.concat_ws(":", F.lit("graph"), "o_orderkey"))
    o = load(spark, d, "orders").select("o_custkey", F.coalesce(F.substring_index(key, ":", 1), F.lit("searched")).alias("store"))
    return o.groupBy("o_custkey", "store").agg(F.count("*").alias("hits"))


@BOOK.add("declared_categories", "SELECT doc_id, md5('---' || chr(10) || 'title: ' || doc_id || chr(10) || 'category: ' || upper(lang) || chr(10) || '---' || chr(10) || text) AS digest FROM documents")
def declared_categories(spark, d):
    """The category line of each document's front matter rewritten; all else is kept."""
    front = F.concat(F.lit("---\ntitle: "), F.col("doc_id").cast("string"), F.lit("\nCategory: old\n---\n"), F.col("text"))
    rows = load(spark, d, "documents").select("doc_id", catalog.declare(catalog.declare(front, F.upper("lang")), F.upper("lang")).alias("text"))
    return rows.select("doc_id", F.md5("text").alias("digest"))
