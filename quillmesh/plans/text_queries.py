"""Text, evidence and guardrail queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import scalar
from quillmesh.operators import chunking, evidence, graph, guardrails, layout
from quillmesh.plans.book import Book
from quillmesh.sources.readers import html_text
from quillmesh.sources.tables import load

BOOK = Book()


def _docs(spark, d):
    return load(spark, d, "documents")


@BOOK.add("token_estimates", "SELECT doc_id, greatest(1, length(text) // 4)::INTEGER AS tokens FROM documents")
def token_estimates(spark, d):
    return _docs(spark, d).select("doc_id", scalar.token_estimate(F.col("text")).alias("tokens"))


@BOOK.add("md_chunks")
def md_chunks(spark, d):
    """Retrieval chunks of every document."""
    return chunking.chunks(_docs(spark, d)).select("doc_id", "index", "heading_path", "content", "tokens")


@BOOK.add("contextual_text", "SELECT doc_id, 'Document: ' || coalesce(source, '') || CASE WHEN coalesce(lang, '') <> '' THEN chr(10) || 'Section: ' || lang ELSE '' END || chr(10) || chr(10) || text AS text FROM documents")
def contextual_text(spark, d):
    return _docs(spark, d).select("doc_id", chunking.contextual(F.col("source"), F.col("lang"), F.col("text")).alias("text"))


@BOOK.add(
    "provenance_counts",
    r"""SELECT doc_id, len(regexp_extract_all(lower(text), 'lorem ipsum|all rights reserved|licensed under|released under|to be defined|n/a')) AS boilerplate,
    list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(trim(x), '|')), lambda x: length(x)))::INTEGER AS prose_chars FROM documents""",
)
def provenance_counts(spark, d):
    p = evidence.provenance(F.col("text"))
    return _docs(spark, d).select("doc_id", p["boilerplate"].cast("long").alias("boilerplate"), p["prose_chars"].alias("prose_chars"))


@BOOK.add("boilerplate_flag", "SELECT doc_id, regexp_matches(lower(text), 'licensed under|released under|all rights reserved') AS boilerplate FROM documents")
def boilerplate_flag(spark, d):
    return _docs(spark, d).select("doc_id", F.lower("text").rlike("licensed under|released under|all rights reserved").alias("boilerplate"))


@BOOK.add("pii_email_redact", f"SELECT doc_id, md5(regexp_replace(text, '{guardrails.EMAIL}', '{guardrails.MASK}', 'g')) AS digest FROM documents")
def pii_email_redact(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(guardrails.mask_email(F.col("text"))).alias("digest"))


@BOOK.add("pii_email_counts", f"SELECT source, sum(len(regexp_extract_all(text, '{guardrails.EMAIL}')))::BIGINT AS mails FROM documents GROUP BY 1")
def pii_email_counts(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(guardrails.EMAIL))).cast("long").alias("mails"))


@BOOK.add("pii_phone_redact")
def pii_phone_redact(spark, d):
    """E-mail addresses and phone numbers masked in every document."""
    return _docs(spark, d).select("doc_id", guardrails.redact("text").alias("text"))


@BOOK.add("credential_mask", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{guardrails.EMAIL}', '{guardrails.MASK}', 'g'), '{guardrails.SECRET}', '[credential removed]', 'g')) AS digest FROM documents")
def credential_mask(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(guardrails.mask_secrets(F.col("text"))).alias("digest"))


@BOOK.add(
    "scope_signal",
    r"SELECT doc_id, CASE WHEN regexp_matches(text, '\b[A-Z]{2,5}-[0-9]{3,}\b') THEN 'code' WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(password|licensed|license)($|[^\p{L}\p{N}_])') THEN 'word' WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(the|und)($|[^\p{L}\p{N}_])') THEN 'system' END AS signal FROM documents",
)
def scope_signal(spark, d):
    s = guardrails.scope_signal(F.col("text"), r"\b[A-Z]{2,5}-[0-9]{3,}\b", ["password", "licensed", "license"], ["the", "und"])
    return _docs(spark, d).select("doc_id", s.alias("signal"))


@BOOK.add("scope_verdicts", r"SELECT item_id, CASE WHEN trim(text) = '' THEN 'refused: empty' WHEN item_id % 10 = 0 THEN 'allowed: off' WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(the)($|[^\p{L}\p{N}_])') THEN 'allowed: word' WHEN item_id % 3 = 0 THEN 'refused: cache' ELSE 'allowed: no verdict' END AS verdict FROM benchmark")
def scope_verdicts(spark, d):
    b = load(spark, d, "benchmark")
    signal = guardrails.scope_signal(F.col("text"), r"\bZZ-\d{9}\b", ["the"], ["no such system"])
    none = F.lit(None).cast("string")
    return b.select("item_id", guardrails.scope_verdict(F.col("text"), F.col("item_id") % 10 != 0, signal, F.when(F.col("item_id") % 3 == 0, "refused"), none).alias("verdict"))


@BOOK.add(
    "outbound_gate",
    rf"SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 200 THEN 'too long' WHEN regexp_matches(text, '{guardrails.EMAIL}') THEN 'contact' WHEN regexp_matches(text, '{guardrails.SECRET}') THEN 'credential' WHEN regexp_matches(text, '\b[0-9]{{8,}}\b') THEN 'record number' END AS reason FROM conversations WHERE role = 'user'",
)
def outbound_gate(spark, d):
    return load(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", guardrails.outbound_gate(F.col("text")).alias("reason"))


@BOOK.add("html_to_text")
def html_to_text(spark, d):
    """Every page's body with tags dropped and white space collapsed."""
    text = F.pandas_udf(lambda s: s.map(html_text, na_action="ignore"), "string")
    return load(spark, d, "pages").select("page_id", text("html").alias("text"))


@BOOK.add("page_hosts", r"SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS pages, count(*) FILTER (regexp_matches(url, '^[a-z]+://([^/]*\.)?example\.org([/:?#]|$)')) AS allowed FROM pages GROUP BY 1")
def page_hosts(spark, d):
    p = load(spark, d, "pages").select(F.try_parse_url("url", F.lit("HOST")).alias("host"), scalar.allowed_host(F.col("url"), ("example.org",)).alias("ok"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.count_if("ok").alias("allowed"))


@BOOK.add(
    "asof_intent",
    "WITH x AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN left(text, 40) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS intent FROM conversations) SELECT conv_id, turn, intent FROM x WHERE role = 'assistant'",
)
def asof_intent(spark, d):
    c = load(spark, d, "conversations").withColumn("t", F.left("text", F.lit(40)))
    out = evidence.carried_intent(c, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "system", "t")
    return out.filter("role = 'assistant'").select("conv_id", "turn", "intent")


@BOOK.add("audit_trail", "SELECT conv_id, count(*) AS steps, count(*) FILTER (role = 'assistant') AS answers, string_agg(role, '>' ORDER BY turn) AS trail FROM conversations GROUP BY 1")
def audit_trail(spark, d):
    items = F.array_sort(F.collect_list(F.struct("turn", "role")))
    g = load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.count_if(F.col("role") == "assistant").alias("answers"), items.alias("i"))
    return g.select("conv_id", "steps", "answers", F.array_join(F.transform("i", lambda x: x["role"]), ">").alias("trail"))


@BOOK.add("redundant_calls", "SELECT event_id, row_number() OVER w AS occurrence, row_number() OVER w > 1 AS redundant FROM events WINDOW w AS (PARTITION BY user_id, event_type || ':' || json_extract(props, '$.k') ORDER BY ts, event_id)")
def redundant_calls(spark, d):
    e = load(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    out = evidence.redundant(e, ["user_id"], F.concat_ws(":", F.col("event_type"), F.get_json_object("props", "$.k")), "o")
    return out.select("event_id", F.col("occurrence").cast("long").alias("occurrence"), "redundant")


@BOOK.add(
    "quote_verbatim",
    r"""WITH n AS (SELECT item_id, doc_id, lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))) AS t FROM benchmark b, documents d WHERE length(d.text) >= length(b.text))
    SELECT item_id, count(*) AS documents, min(doc_id) AS first_document FROM n WHERE contains(t, q) GROUP BY 1""",
)
def quote_verbatim(spark, d):
    """Which documents hold a benchmark passage word for word."""
    found = passages_in(load(spark, d, "benchmark"), _docs(spark, d))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))


FEW_KEYS = 2000  #: of passages, that fit into one row


def passages_in(items, docs):
    """(item_id, doc_id) where a document holds the passage, blanks and case aside.

    Passages and documents meet by a key and are not paired all with all; then
    the whole passage is looked for. Its first and last word may be parts of a
    document's words, so the key is the four words after the first; passages of
    fewer than six words meet by their first three characters, or their first."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    b = items.select("item_id", squeeze(F.col("text")).alias("q")).filter("q <> ''").withColumn("w", F.split("q", " "))
    t = docs.filter("text is not null").select("doc_id", squeeze(F.col("text")).alias("t"))
    long_, short = b.filter("size(w) > 5"), b.filter("size(w) < 6")
    pairs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.lit(" "), F.get(c, i + 1)))
    shingled = t.withColumn("w", F.split("t", " ")).filter("size(w) > 3").withColumn("w", pairs(F.col("w")))
    fours = F.zip_with("w", F.slice("w", 3, F.size("w")), lambda x, y: F.concat(x, F.lit(" "), y))
    keys = long_.select("item_id", F.array_join(F.slice("w", 2, 4), " ").alias("k"))
    if keys.select("k").distinct().count() <= FEW_KEYS:  # then only shingles that are keys leave their document
        held = keys.agg(F.array_sort(F.collect_set("k")).alias("keys"))
        shingled, fours = shingled.crossJoin(F.broadcast(held)), F.array_intersect(fours, "keys")
    by_words = shingled.select("doc_id", F.explode_outer(fours).alias("k")).join(keys, "k")  # outer: nothing is inferred and asked beneath
    grams = lambda n: F.when(F.length("t") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - (n - 1)), lambda i: F.substr(F.col("t"), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    first = F.substr(F.col("q"), F.lit(1), F.when(F.length("q") < 3, 1).otherwise(3))
    by_letters = t.select("doc_id", F.explode(F.concat(grams(3), grams(1))).alias("k")).join(short.select("item_id", first.alias("k")), "k")
    met = by_words.select("item_id", "doc_id")
    if not short.isEmpty():
        met = met.union(by_letters.select("item_id", "doc_id"))
    return met.distinct().join(t, "doc_id").join(b.select("item_id", "q"), "item_id").filter(F.col("t").contains(F.col("q"))).select("item_id", "doc_id")


_PLAIN = r"""lower(trim(regexp_replace(regexp_replace(translate({}, '‘’“”–—' || chr(160), '''''""-- '), '[*_`|#>]+', ' ', 'g'), '\s+', ' ', 'g')))"""


@BOOK.add(
    "quote_status",
    rf"""WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
    r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN array_to_string(w[1:4], ' ') || ' ... ' || array_to_string(w[-4:], ' ') ELSE string_split(text, chr(10))[1] END AS q,
          CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN right(text, 20) ELSE text END AS t FROM w),
    n AS (SELECT doc_id, {_PLAIN.format("q")} AS q, {_PLAIN.format("t")} AS t FROM r),
    p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(q, '\s*(?:\.\.\.|…)\s*'), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM n)
    SELECT doc_id, CASE WHEN t IS NULL THEN 'never retrieved' WHEN q <> '' AND contains(t, q) THEN 'verbatim'
      WHEN len(p) > 1 AND regexp_matches(t, array_to_string(list_transform(p, lambda x: regexp_escape(x)), '.*')) THEN 'elided' ELSE 'not found' END AS status FROM p""",
)
def quote_status(spark, d):
    """A quote from each document (its first line, or its first and last words with an
    ellipsis between) held against the whole text, its end, or nothing."""
    docs = load(spark, d, "documents").withColumn("w", F.split("text", " "))
    ends = F.concat(F.array_join(F.slice("w", 1, 4), " "), F.lit(" ... "), F.array_join(F.slice("w", F.greatest(F.size("w") - 3, F.lit(1)), F.lit(4)), " "))
    quote = F.when(F.col("doc_id") % 7 == 2, ends).otherwise(F.split("text", "\n")[0])
    held = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 7 == 1, F.right("text", F.lit(20))).otherwise(F.col("text"))
    return docs.select("doc_id", evidence.quote_status(quote, held).alias("status"))


@BOOK.add(
    "support_score",
    """WITH s AS (SELECT doc_id, doc_id % 5 AS i, doc_id % 2 = 0 AS g, doc_id % 7 = 0 AS c, doc_id % 3 = 0 AS m, doc_id % 11 = 0 AS a, doc_id % 13 = 0 AS disc, doc_id % 17 = 0 AS tpl, regexp_matches(lower(text), 'licensed under') AS boil FROM documents),
    t AS (SELECT *, 0.5 + 0.15 * (i - 1) + CASE WHEN g THEN 0.1 ELSE 0 END - CASE WHEN c THEN 0.25 ELSE 0 END - CASE WHEN m THEN 0.15 ELSE 0 END - CASE WHEN a THEN 0.1 ELSE 0 END AS total,
      least(CASE WHEN disc THEN 0.4 ELSE 1 END, CASE WHEN tpl THEN 0.35 ELSE 1 END, CASE WHEN boil THEN 0.3 ELSE 1 END) AS cap FROM s)
    SELECT doc_id, round((CASE WHEN i >= 1 THEN least(0.95, greatest(0.05, least(total, cap))) WHEN g THEN 0.35 WHEN doc_id % 3 = 1 THEN 0.2 ELSE 0 END)::DOUBLE, 4) AS score FROM t""",
)
def support_score(spark, d):
    k = F.col("doc_id")
    s = evidence.support_score(k % 5, k % 2 == 0, k % 7 == 0, k % 3 == 0, k % 11 == 0, k % 13 == 0, k % 17 == 0, F.lower("text").rlike("licensed under"), k % 3 == 1)
    return _docs(spark, d).select("doc_id", s.alias("score"))


@BOOK.add("claim_trace", "SELECT l_orderkey, count(*) AS checks, count(*) FILTER (l_quantity > 10) AS passed, CASE WHEN count(*) FILTER (l_quantity > 10) = count(*) THEN 'traced' WHEN count(*) FILTER (l_quantity > 10) > 0 THEN 'partial' ELSE 'untraced' END AS status FROM lineitem GROUP BY 1")
def claim_trace(spark, d):
    li = load(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 10)
    return evidence.trace_status(li, ["l_orderkey"], "ok")


@BOOK.add(
    "source_index",
    "SELECT l_suppkey AS source, count(*) AS citations, count(DISTINCT l_orderkey) AS documents, round(max(l_extendedprice), 2) AS best, count(DISTINCT l_partkey) AS headings FROM lineitem GROUP BY 1",
)
def source_index(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("citations"), F.countDistinct("l_orderkey").alias("documents"), F.round(F.max("l_extendedprice"), 2).alias("best"), F.countDistinct("l_partkey").alias("headings"))


@BOOK.add("lineage_summary", "SELECT role, count(*) AS calls, count(DISTINCT conv_id) AS runs, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def lineage_summary(spark, d):
    return load(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.countDistinct("conv_id").alias("runs"), F.sum(F.length("text")).alias("chars"))


_RULES = [("license", r"(?i)licensed? under"), ("token", r"(?i)token"), ("apache", r"Apache License"), ("creative", r"CC BY")]


@BOOK.add("entity_mentions", "SELECT doc_id, code, n::INTEGER AS mentions FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS code, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for c, p in _RULES) + ") WHERE n > 0")
def entity_mentions(spark, d):
    """Dictionary entities of every document, from a small rule table."""
    rules = spark.createDataFrame(_RULES, "code string, pattern string")
    return graph.mentions(_docs(spark, d), rules)


@BOOK.add("entity_compare", "WITH e AS (SELECT DISTINCT l_partkey AS p, l_orderkey % 100 = 0 AS mine FROM lineitem) SELECT p, bool_or(mine) AND bool_or(NOT mine) AS shared FROM e GROUP BY p HAVING bool_or(mine)")
def entity_compare(spark, d):
    """Entities of a session's documents: also in the corpus, or new."""
    li = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), "l_orderkey")
    mine, rest = li.filter("l_orderkey % 100 = 0").select("p").distinct(), li.filter("l_orderkey % 100 <> 0").select("p").distinct()
    return mine.join(rest.withColumn("shared", F.lit(True)), "p", "left").select("p", F.coalesce("shared", F.lit(False)).alias("shared"))


@BOOK.add("degenerate_text", "SELECT doc_id, round(len(list_distinct(l)) / len(l), 6) AS share FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) WHERE len(l) > 0")
def degenerate_text(spark, d):
    """Share of distinct lines; loops of a generator fall below a half."""
    return _docs(spark, d).select("doc_id", F.round(scalar.distinct_line_share(F.col("text")), 6).alias("share")).filter("share is not null")


@BOOK.add("box_snapping", "WITH b AS (SELECT s_suppkey AS box, (s_suppkey * 37 % 1000)::DOUBLE AS x, (s_suppkey * 91 % 1000)::DOUBLE AS y, s_nationkey FROM supplier), p AS (SELECT c_custkey AS point, (c_custkey * 53 % 1000)::DOUBLE AS x, (c_custkey * 29 % 1000)::DOUBLE AS y, c_nationkey FROM customer), z AS (SELECT point, box, sqrt(greatest(b.x - p.x, 0, p.x - b.x - 20) ** 2 + greatest(b.y - p.y, 0, p.y - b.y - 10) ** 2) AS dist FROM p JOIN b ON s_nationkey = c_nationkey) SELECT point, arg_min(box, (dist, box)) AS box, round(min(dist), 6) AS dist FROM z WHERE dist <= 40 GROUP BY point")
def box_snapping(spark, d):
    """Loose ends snap to the nearest box of their slide within a limit."""
    n = lambda c, k: (F.col(c) * k % 1000).cast("double")
    b = load(spark, d, "supplier").select(F.col("s_suppkey").alias("box"), n("s_suppkey", 37).alias("bx"), n("s_suppkey", 91).alias("by"), F.col("s_nationkey").alias("slide"))
    p = load(spark, d, "customer").select(F.col("c_custkey").alias("point"), n("c_custkey", 53).alias("px"), n("c_custkey", 29).alias("py"), F.col("c_nationkey").alias("slide"))
    boxes = b.select(F.col("slide").alias("page"), "box", F.col("bx").alias("left"), F.col("by").alias("top"), (F.col("bx") + 20).alias("right"), (F.col("by") + 10).alias("bottom"))
    found = layout.snapped(p.select(F.col("slide").alias("page"), "point", F.col("px").alias("x"), F.col("py").alias("y")), boxes, 40.0)
    return found.select("point", "box", F.round("dist", 6).alias("dist"))


@BOOK.add("fill_forward", "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations")
def fill_forward(spark, d):
    """Each row under the last numbered row above it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("turn") % 3 == 0, F.col("turn")), ignorenulls=True).over(w).alias("parent"))


@BOOK.add("role_availability", "WITH r(role) AS (VALUES ('system'), ('user'), ('assistant'), ('tool')) SELECT r.role, count(c.conv_id) AS rows, count(c.conv_id) = 0 AS missing FROM r LEFT JOIN conversations c ON c.role = r.role GROUP BY 1")
def role_availability(spark, d):
    every = spark.createDataFrame([("system",), ("user",), ("assistant",), ("tool",)], "role string")
    n = load(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    return every.join(n, "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("rows"), F.col("n").isNull().alias("missing"))
