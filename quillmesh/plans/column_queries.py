"""Column functions, readers and search modes as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import scalar
from quillmesh.operators import catalog, chunking, evidence, graph, guardrails, quality, retrieval
from quillmesh.plans import retrieval_queries as rq
from quillmesh.plans.book import Book
from quillmesh.sources import readers
from quillmesh.sources.tables import load

BOOK = Book()


def _say(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _three(c: Column) -> Column:
    return F.lpad(c.cast("string"), 3, "0")


@BOOK.add("code_terms", "SELECT p_partkey, 'm' || a || b || ',m' || a || b || c AS terms FROM (SELECT p_partkey, lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS a, lpad(p_size::VARCHAR, 3, '0') AS b, lpad((p_partkey // 1000)::VARCHAR, 3, '0') AS c FROM part)")
def code_terms(spark, d):
    """Hyphenated codes in a text, also as runs of their parts."""
    k = F.col("p_partkey")
    text = _say("Uses M-", _three(k % 1000), "-", _three(F.col("p_size")), "-", _three(F.floor(k / 1000)), " and x-12, not M-1-", k)
    return load(spark, d, "part").select("p_partkey", F.array_join(scalar.expand_codes(text), ",").alias("terms"))


@BOOK.add(
    "verdict_columns",
    """SELECT event_id, v AS verdict, CASE WHEN v >= 0.8 THEN 'grounded' WHEN v >= 0.5 THEN 'partly' WHEN v IS NOT NULL THEN 'not' END AS bucket, CASE WHEN v >= 0.7 THEN 'good' WHEN v >= 0.4 THEN 'fair' WHEN v IS NOT NULL THEN 'poor' END AS band
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.0 WHEN 'purchase' THEN greatest(0.0, least(1.0, value / 20)) END::DOUBLE AS v FROM events)""",
)
def verdict_columns(spark, d):
    """Words, numbers, NaN and nonsense as verdicts between 0 and 1, with their bucket and band."""
    t = F.col("event_type")
    raw = F.when(t == "click", " Yes").when(t == "view", "FALSE ").when(t == "purchase", (F.col("value") / 20).cast("string")).when(t == "error", "NaN").otherwise("maybe")
    v = scalar.verdict_number(raw)
    return load(spark, d, "events").select("event_id", v.alias("verdict"), quality.bucket(v).alias("bucket"), scalar.status_band(v).alias("band"))


@BOOK.add("answer_confidence", "SELECT l_orderkey, round(min(CASE WHEN l_returnflag = 'R' THEN l_discount * 10 END), 4) AS confidence FROM lineitem GROUP BY 1")
def answer_confidence(spark, d):
    """An answer is as sure as the least sure claim that it rests on."""
    claims = load(spark, d, "lineitem").withColumn("score", F.col("l_discount") * 10)
    return evidence.least_confidence(claims, ["l_orderkey"], "score", F.col("l_returnflag") == "R")


_KINDS = ("pptx", "DOCX", "png")


@BOOK.add(
    "file_columns",
    """SELECT c_custkey, c_name || ' (' || lower(k) || ')' AS title, CASE c_custkey % 4 WHEN 0 THEN 'PKG' WHEN 1 THEN 'WP' WHEN 2 THEN CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'UNFILED' END ELSE CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'UNFILED' END END AS category,
    'in/' || lower(c_mktsegment) AS folder, k <> 'pptx' AS wanted FROM (SELECT *, ['pptx', 'DOCX', 'png'][c_custkey % 3 + 1] AS k FROM customer)""",
)
def file_columns(spark, d):
    """Titles, categories (given, declared, by folder, or none), folders and glob matches of converted files."""
    c = load(spark, d, "customer")
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (key % 3 + 1).cast("int"))
    path = _say("in/", F.lower("c_mktsegment"), "/", F.col("c_name"), "_", kind, ".md")
    text = F.when(key % 4 == 1, F.lit('---\ntitle: x\nCategory: "wp"\n---\nbody')).when(key % 4 == 2, F.lit("---\ncategory: no code!\n---\nbody")).otherwise(F.lit("body"))
    explicit = F.when(key % 4 == 0, F.lit(" pkg "))
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return c.select("c_custkey", chunking.document_title(path).alias("title"), catalog.category_of(explicit, text, path, ["BUILDING", "MACHINERY"]).alias("category"), folder.alias("folder"), scalar.glob_like(F.substring_index(path, "/", -1), "*_docx.md", "*_PN?.*").alias("wanted"))


@BOOK.add("front_matter_keys", "SELECT c_custkey, unnest(['title', 'category', 'phone']) AS key, unnest([c_name || ': draft', 'WP', 'last ' || c_nationkey]) AS value FROM customer")
def front_matter_keys(spark, d):
    """Keys and values of a leading block: quotes off, split at the first colon, the last of equal keys."""
    text = _say('---\nTitle: "', F.col("c_name"), ": draft\"\nCATEGORY: 'WP'\nphone: first\nno colon here\nPhone:last ", F.col("c_nationkey"), "\n---\nbody: none")
    return load(spark, d, "customer").select("c_custkey", F.explode(catalog.front_matter(text)).alias("key", "value"))


@BOOK.add(
    "text_columns",
    r"""SELECT doc_id, md5(CASE WHEN len(w) > 120 THEN array_to_string(w[1:120], ' ') || '…' ELSE text END) AS digest, CASE WHEN length(h) <= 90 THEN h ELSE regexp_extract(left(h, 90), '^(.*)\s', 1) || '…' END AS label, ceil(n_chars / 560)::BIGINT AS parts
    FROM (SELECT *, string_split_regex(trim(text), '\s+') AS w, trim(regexp_extract(split_part(text, chr(10), 1), '^([^(\[]*)', 1)) AS h FROM documents WHERE text IS NOT NULL)""",
)
def text_columns(spark, d):
    """Texts cut at 120 words, labels cut at a bracket or a word, and how many parts of 560 characters."""
    docs = load(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(scalar.word_limit(F.col("text"))).alias("digest"), scalar.short_label(F.substring_index("text", "\n", 1)).alias("label"), scalar.ceil_div(F.col("n_chars"), 560).alias("parts"))


@BOOK.add("table_cells", r"""SELECT s_suppkey, s_name || ';a\|b;' || s_nationkey || ';' AS cells, 'S' || s_suppkey || ';' || s_nationkey || '.1' AS refs, '{"a":"' || s_name || '","b":"' || s_nationkey || '"}' AS arguments FROM supplier""")
def table_cells(spark, d):
    """Cells of table rows with escaped pipes, references in a cell, and arguments with their keys in order."""
    s = load(spark, d, "supplier")
    row = _say("  | ", F.col("s_name"), r" | a\|b |", F.col("s_nationkey"), "  |  |")
    refs = scalar.step_refs(_say("s", F.col("s_suppkey"), " and ", F.col("s_nationkey"), ".1; S", F.col("s_suppkey"), " / "))
    arguments = F.create_map(F.lit("b"), F.col("s_nationkey").cast("string"), F.lit("a"), F.col("s_name"))
    return s.select("s_suppkey", F.array_join(scalar.table_cells(row), ";").alias("cells"), F.array_join(refs, ";").alias("refs"), scalar.canonical_json(arguments).alias("arguments"))


@BOOK.add(
    "ordered_items",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 'P' ELSE 'Q' END, p_size, p_partkey)::INTEGER AS place,
    row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_name, p_partkey)::INTEGER AS urgent FROM part""",
)
def ordered_items(spark, d):
    """Items in the order of letter and number (Q2 before Q10), and issues by severity, then title."""
    item = F.concat(F.when(F.col("p_size") > 25, "P").otherwise("Q"), F.col("p_size").cast("string"))
    ranks = spark.createDataFrame([("PROMO", 0), ("STANDARD", 1)], "p_type string, rank int")
    parts = load(spark, d, "part").join(F.broadcast(ranks), "p_type", "left").withColumn("rank", F.coalesce("rank", F.lit(2)))
    by = lambda *order: F.row_number().over(Window.partitionBy("p_brand").orderBy(*order))
    return parts.select("p_partkey", by(scalar.letter_number_key(item), "p_partkey").alias("place"), by("rank", "p_name", "p_partkey").alias("urgent"))


@BOOK.add("question_sections", "SELECT s_nationkey AS page, 'Q' || s_suppkey AS id, s_name AS title, 'Who is ' || s_name || '?' AS question, 'Number ' || s_suppkey AS reference FROM supplier")
def question_sections(spark, d):
    """Questions with their references, read from the sections of Markdown pages."""
    s = load(spark, d, "supplier")
    section = _say("## Q", F.col("s_suppkey"), " - ", F.col("s_name"), "\n\n**Question:** Who is ", F.col("s_name"), "?\n\n**Reference:** Number ", F.col("s_suppkey"), "\n\n")
    pages = s.groupBy(F.col("s_nationkey").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", section.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return readers.questions(pages, "page", "text")


@BOOK.add("spliced_blocks", "SELECT s_suppkey, 'a ' || s_name || ' b ' || CASE WHEN s_nationkey > 10 THEN 'second' ELSE '<!-- image -->' END || ' c' AS text FROM supplier")
def spliced_blocks(spark, d):
    """The n-th block at the n-th mark; a mark without a block stays."""
    blocks = F.when(F.col("s_nationkey") > 10, F.array(F.col("s_name"), F.lit("second"), F.lit("too many"))).otherwise(F.array(F.col("s_name")))
    return load(spark, d, "supplier").select("s_suppkey", readers.spliced(F.lit("a <!-- image --> b <!-- image --> c"), blocks).alias("text"))


@BOOK.add(
    "converted_files",
    r"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'line' || chr(10) || c_name WHEN 1 THEN '| name | nation |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | a \| ' || c_nationkey || ' |'
      WHEN 2 THEN '```json' || chr(10) || '{' || chr(10) || '  "name": "' || c_name || '",' || chr(10) || '  "keys": [' || chr(10) || '    ' || c_nationkey || chr(10) || '  ]' || chr(10) || '}' || chr(10) || '```'
      WHEN 3 THEN '# c' || chr(10) || chr(10) || '- @id: ' || c_custkey || chr(10) || chr(10) || '- name: ' || c_name WHEN 4 THEN '- from: a@b.org' || chr(10) || '- subject: ' || c_name || chr(10) || '- date: 2024-01-02T03:04:05+00:00' || chr(10) || chr(10) || 'Hello ' || c_nationkey END AS markdown,
    CASE c_custkey % 6 WHEN 0 THEN 2 WHEN 5 THEN NULL ELSE 1 END AS units, ['lines', 'rows', 'records', 'files', 'messages', NULL][c_custkey % 6 + 1] AS unit, CASE WHEN c_custkey % 6 = 5 THEN 'no reader for .docx' END AS error FROM customer""",
)
def converted_files(spark, d):
    """Files of six kinds as Markdown, with what they count and an error row for what has no reader."""
    k, name, nation = F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey")
    kinds = F.array(*map(F.lit, ("txt", "csv", "JSON", "xml", "eml", "docx")))
    content = (
        F.when(k % 6 == 0, _say("line\r\n", name)).when(k % 6 == 1, _say("name;nation\n", name, ";a | ", nation, "\n")).when(k % 6 == 2, _say('{"name":"', name, '","keys":[', nation, "]}"))
        .when(k % 6 == 3, _say('<c id="', k, '"><name>', name, "</name></c>")).when(k % 6 == 4, _say("From: a@b.org\nSubject: ", name, "\nDate: Tue, 02 Jan 2024 03:04:05 +0000\n\nHello ", nation, "\n")).otherwise(F.lit("PK"))
    )
    got = readers.converted(F.lower(F.element_at(kinds, (k % 6 + 1).cast("int"))), content.cast("binary"))
    files = retrieval.spread(load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"))  # one file is read by few tasks
    return files.withColumn("g", got).select("c_custkey", "g.markdown", "g.units", "g.unit", "g.error")


@BOOK.add("json_lists", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders GROUP BY 1")
def json_lists(spark, d):
    """Rows gathered into JSON lists, their length, and the lists taken apart again."""
    kind = "array<struct<id: bigint, price: double>>"
    g = load(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))).alias("body"))
    rows = g.select("o_custkey", F.json_array_length("body").cast("long").alias("n"), F.explode(F.from_json("body", kind)).alias("x"))
    return rows.groupBy("o_custkey", "n").agg(F.round(F.sum("x.price"), 2).alias("total"), F.max("x.id").alias("last"))


@BOOK.add("load_columns", "SELECT 'c' || c_custkey AS id, 'document' AS type, c_name AS label FROM customer")
def load_columns(spark, d):
    """Nodes as they are loaded into a store, without what only a picture needs."""
    c = load(spark, d, "customer")
    drawn = c.select(_say("c", F.col("c_custkey")).alias("id"), F.lit("document").alias("type"), F.col("c_name").alias("label"), F.lit("#888").alias("color"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    return graph.loadable(drawn)


@BOOK.add("cited_pages", "SELECT url, min(page_id) AS first, array_to_string(list_sort(list(DISTINCT p)), ';') AS passages FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, 'page ' || (page_id % 3) AS p FROM pages WHERE regexp_matches(url, '^https?://([a-z0-9.-]+[.])?example[.](com|org)(/|$)')) GROUP BY url ORDER BY first, url LIMIT 8")
def cited_pages(spark, d):
    """The first eight cited pages of the allowed hosts, each with its distinct passages."""
    hits = load(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"), _say("page ", F.col("page_id") % 3).alias("passage"))
    return guardrails.cite_pages(hits, "url", "passage", "page_id", ("example.com", "example.org")).select("url", "first", F.array_join(F.array_sort("passages"), ";").alias("passages"))


_MODE = """SELECT '{mode}' AS mode, * FROM (SELECT doc_id, vector_rank, keyword_rank, score, row_number() OVER (ORDER BY score DESC, least(vector_rank, keyword_rank), doc_id)::INTEGER AS rank FROM
  (SELECT doc_id, vector_rank, keyword_rank, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 9) AS score FROM {of})) WHERE rank <= 8"""
_LISTS = rq._RRF.split("u AS (")[0].rstrip().rstrip(",") + ", vq AS (SELECT doc_id, vector_rank FROM vr WHERE query_id = 0), kq AS (SELECT doc_id, keyword_rank FROM kr WHERE query_id = 0)"


@BOOK.add(
    "search_modes",
    f"{_LISTS} {_MODE.format(mode='hybrid', of='vq FULL JOIN kq USING (doc_id)')} UNION ALL {_MODE.format(mode='vector', of='(SELECT *, NULL::INTEGER AS keyword_rank FROM vq)')} UNION ALL {_MODE.format(mode='keyword', of='(SELECT *, NULL::INTEGER AS vector_rank FROM kq)')}",
)
def search_modes(spark, d):
    """One question asked three ways: by words, by its vector, by both."""
    docs, vectors = load(spark, d, "documents"), load(spark, d, "embeddings")
    text = load(spark, d, "benchmark").filter("item_id = 0").first()["text"]  # the question
    vector = vectors.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    out = None
    for mode in retrieval.MODES:
        got = retrieval.search(docs, vectors, text, vector, mode=mode).select(F.lit(mode).alias("mode"), "doc_id", "vector_rank", "keyword_rank", "score", "rank")
        out = got if out is None else out.unionByName(got)
    return out


@BOOK.add(
    "role_search",
    rf"""WITH {rq._POSTINGS}, a AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')), q AS (SELECT DISTINCT item_id AS query_id, unnest({rq._TOKENS}) AS term FROM benchmark WHERE item_id % 100 = 0),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), o AS (SELECT * FROM p SEMI JOIN a USING (doc_id)), f AS (SELECT term, count(*) AS df FROM o SEMI JOIN q USING (term) GROUP BY term),
    b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM o JOIN f USING (term) JOIN q USING (term), s GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 8""",
)
def role_search(spark, d):
    """What a session may see is kept before anything is ranked."""
    docs, asked = load(spark, d, "documents"), rq._query_terms(spark, d)
    allowed = docs.filter(F.col("lang").isin("en", "fr")).select("doc_id")
    return retrieval.similar_search(retrieval.postings(docs, only=asked), retrieval.corpus_stats(docs), asked, allowed, 8)


@BOOK.add("display_terms", "SELECT p_partkey, 'M-' || a || '-' || b || ';part;' || CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS shown FROM (SELECT *, lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS a, lpad(p_size::VARCHAR, 3, '0') AS b FROM part)")
def display_terms(spark, d):
    """Codes as typed, then the words of a question that are no forms of them."""
    code = _say("M-", _three(F.col("p_partkey") % 1000), "-", _three(F.col("p_size")))
    text = _say(code, " part ", F.when(F.col("p_size") > 25, "large").otherwise("small"), " PART")
    derived = F.concat(scalar.expand_codes(text), scalar.terms(code))
    return load(spark, d, "part").select("p_partkey", F.array_join(retrieval.display_terms(F.array(code), scalar.terms(text), derived), ";").alias("shown"))
