"""Stored answers: their gates, citations, sources and workings.

A customer is a run, its orders are findings, and their lines are the evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import catalog, citations, fingerprints, gates, routing, workings
from quillmesh.plans import graph_queries as g
from quillmesh.plans.book import Book
from quillmesh.sources.tables import load

BOOK = Book()

_RUNS = "r AS (SELECT c_custkey AS run, c_nationkey <> 3 AS localization, c_nationkey <> 4 AS score_b, c_acctbal > 0 AS scope_named FROM customer)"
_DEVIATIONS = f"""{_RUNS}, v AS (SELECT o_custkey AS run, o_orderkey::VARCHAR AS gap_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Low' ELSE 'Informational' END AS materiality,
    CASE o_orderkey % 3 WHEN 0 THEN 'LOCAL_EXTENSION' WHEN 1 THEN 'ADOPT' ELSE 'REQUIRES_DECISION' END AS disposition,
    CASE o_orderkey % 4 WHEN 0 THEN 'CONFIRMED_STATUTORY' WHEN 1 THEN 'SUSPECTED' ELSE 'NOT_LOCALIZATION' END AS state,
    CASE WHEN o_totalprice > 250000 THEN o_totalprice / 100000 END AS rating, o_orderstatus = 'F' AS considered,
    CASE WHEN o_orderkey % 5 < 2 THEN 'MUST_DISCUSS' ELSE 'CONFIRM' END AS bucket, CASE WHEN o_orderkey % 7 < 5 THEN 'Keep it?' END AS question FROM orders),
  x AS (SELECT l_orderkey::VARCHAR AS gap_id, CASE l_linenumber % 3 WHEN 0 THEN 'sap_bp' WHEN 1 THEN 'template' ELSE 'as_is' END AS side, CASE WHEN l_quantity > 25 THEN 'E1' ELSE 'E2' END AS class,
    CASE WHEN l_discount = 0 THEN 'not retrieved' WHEN l_tax = 0 THEN 'quote absent' WHEN l_linenumber % 3 = 0 AND l_returnflag = 'R' THEN 'not a standard source' END AS rule FROM lineitem),
  k AS (SELECT gap_id, count(*) AS kept, count(DISTINCT side) AS sides, count(*) FILTER (class = 'E1' AND side <> 'sap_bp') AS explicit, count(*) FILTER (side = 'sap_bp') AS standard FROM x WHERE rule IS NULL GROUP BY 1),
  j AS (SELECT v.*, localization, score_b, coalesce(kept, 0) AS kept, coalesce(sides, 0) AS sides, coalesce(explicit, 0) AS explicit, coalesce(standard, 0) AS standard FROM v JOIN r USING (run) LEFT JOIN k USING (gap_id)),
  m AS (SELECT *, materiality IN ('Critical', 'High') AS material, CASE WHEN localization THEN state ELSE 'NOT_LOCALIZATION' END AS state1, CASE WHEN score_b THEN rating END AS rating1 FROM j),
  t AS (SELECT *, material AND kept = 0 AS bare, state1 = 'CONFIRMED_STATUTORY' AND explicit = 0 AS unproved FROM m),
  u AS (SELECT *, disposition = 'LOCAL_EXTENSION' AND NOT considered AND NOT bare AS early FROM t),
  w AS (SELECT *, bare OR unproved OR early OR bucket = 'MUST_DISCUSS' AS discussed, materiality IN ('Low', 'Informational') AS minor FROM u)"""


def _gate_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, o, li = (load(spark, d, n) for n in ("customer", "orders", "lineitem"))
    key, status = F.col("o_orderkey"), lambda col, table, other: _pick(col, table, other)
    runs = c.select(F.col("c_custkey").alias("run"), (F.col("c_nationkey") != 3).alias("localization"), (F.col("c_nationkey") != 4).alias("score_b"), (F.col("c_acctbal") > 0).alias("scope_named"), F.lit("").alias("template_process"))
    deviations = o.select(
        F.col("o_custkey").alias("run"), key.cast("string").alias("gap_id"),
        status(F.col("o_orderpriority"), {"1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Low"}, "Informational").alias("materiality"),
        status(key % 3, {0: "LOCAL_EXTENSION", 1: "ADOPT"}, "REQUIRES_DECISION").alias("disposition"), status(key % 4, {0: "CONFIRMED_STATUTORY", 1: "SUSPECTED"}, "NOT_LOCALIZATION").alias("state"),
        F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice") / 100000).alias("rating"), (F.col("o_orderstatus") == "F").alias("considered"),
        F.when(key % 5 < 2, "MUST_DISCUSS").otherwise("CONFIRM").alias("bucket"), F.when(key % 7 < 5, "Keep it?").alias("question"), F.lit(0).alias("minutes"), F.lit("High").alias("confidence"), F.array().cast("array<string>").alias("open_questions"),
        F.concat_ws(", ", key.cast("string"), (key + 1).cast("string")).alias("step"),
    )
    owner = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run"))
    evidence = li.join(owner, "l_orderkey").select(
        "run", F.col("l_orderkey").cast("string").alias("gap_id"), status(F.col("l_linenumber") % 3, {0: "sap_bp", 1: "template"}, "as_is").alias("side"), F.when(F.col("l_quantity") > 25, "E1").otherwise("E2").alias("class"),
        (F.col("l_discount") != 0).alias("seen"), (F.col("l_tax") != 0).alias("held"), (F.col("l_returnflag") != "R").alias("standard"),
    )
    return runs, deviations, evidence


def _pick(column, table, other):
    out = F.lit(other)
    for value, name in table.items():
        out = F.when(column == value, name).otherwise(out)
    return out


@BOOK.add(
    "gate_repairs",
    f"""WITH {_DEVIATIONS} SELECT run, gap_id, CASE WHEN bare OR early THEN 'REQUIRES_DECISION' ELSE disposition END AS disposition, CASE WHEN unproved THEN 'SUSPECTED' ELSE state1 END AS state,
    CASE WHEN standard > 0 THEN rating1 END AS rating, CASE WHEN discussed AND question IS NULL AND minor THEN 'CONFIRM' WHEN discussed THEN 'MUST_DISCUSS' ELSE 'CONFIRM' END AS bucket,
    CASE WHEN bare THEN 'Low' ELSE 'High' END AS confidence, CASE WHEN discussed AND question IS NOT NULL THEN 10 ELSE 0 END AS minutes, (bare::INTEGER + unproved::INTEGER) AS asked FROM w""",
)
def gate_repairs(spark, d):
    """Every finding as the gates leave it."""
    mended, _ = gates.deviation_gates(*_gate_inputs(spark, d))
    return mended.select("run", "gap_id", "disposition", "state", "rating", "bucket", "confidence", "minutes", F.size("open_questions").alias("asked"))


@BOOK.add(
    "gate_issues",
    f"""WITH {_DEVIATIONS}, i AS (SELECT 'QG2' AS gate, 'hard' AS severity, rule FROM x WHERE rule IS NOT NULL
      UNION ALL SELECT 'QG4', 'soft', 'localization without a country' FROM w WHERE state <> state1 UNION ALL SELECT 'QG5', 'soft', 'rated against itself' FROM w WHERE NOT score_b AND rating IS NOT NULL
      UNION ALL SELECT 'QG2', 'soft', 'one side only' FROM w WHERE material AND kept > 0 AND sides < 2 UNION ALL SELECT 'QG2', 'hard', 'material without evidence' FROM w WHERE bare
      UNION ALL SELECT 'QG4', 'hard', 'statutory without an explicit source' FROM w WHERE unproved UNION ALL SELECT 'QG5', 'hard', 'extension before standard' FROM w WHERE early
      UNION ALL SELECT 'QG5', 'hard', 'rating without a source' FROM w WHERE rating1 IS NOT NULL AND standard = 0
      UNION ALL SELECT 'QG6', CASE WHEN minor THEN 'soft' ELSE 'hard' END, CASE WHEN minor THEN 'minor and undecidable' ELSE 'nothing to decide' END FROM w WHERE discussed AND question IS NULL)
    SELECT gate, severity, rule, count(*) AS n FROM i GROUP BY ALL""",
)
def gate_issues(spark, d):
    """What the gates of findings and evidence found, counted by rule."""
    _, issues = gates.deviation_gates(*_gate_inputs(spark, d))
    return issues.groupBy("gate", "severity", "rule").agg(F.count("*").alias("n"))


@BOOK.add(
    "gate_run_issues",
    f"""WITH {_RUNS}, g AS (SELECT o_custkey AS run, o_orderkey AS gap FROM orders), b AS (SELECT l_suppkey AS run, l_orderkey AS gap FROM lineitem WHERE l_linenumber = 1),
    n AS (SELECT run, gap AS step FROM g UNION SELECT run, gap + 1 FROM g UNION SELECT o_custkey, o_orderkey + 3 FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT o_custkey AS run, o_orderkey + 3 AS step FROM orders)
    SELECT run, NULL AS gap_id, 'QG7' AS gate, 'hard' AS severity, 'no baseline named' AS rule FROM r WHERE NOT scope_named
    UNION ALL SELECT run, gap::VARCHAR, 'QG7', 'hard', 'backlog without a gap' FROM b ANTI JOIN g USING (run, gap) UNION ALL SELECT DISTINCT run, NULL, 'QG1', 'soft', 'steps not mapped' FROM s ANTI JOIN n USING (run, step)""",
)
def gate_run_issues(spark, d):
    """Runs without a baseline or with unmapped steps, and backlog items that name no gap of their run."""
    runs, deviations, _ = _gate_inputs(spark, d)
    steps = deviations.select("run", (F.col("gap_id").cast("long") + 3).cast("string").alias("step"), "considered")
    backlog = load(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("run"), F.col("l_orderkey").cast("string").alias("gap_id"))
    return gates.run_gates(runs, deviations, steps.filter("considered").select("run", "step"), steps.select("run", "step"), backlog)[2]


@BOOK.add(
    "citation_remap",
    """WITH m AS (SELECT o_orderkey AS old, o_orderkey + 1000000 AS new FROM orders WHERE o_orderstatus = 'F'),
    a AS (SELECT l_orderkey, l_linenumber, 'ORD:' || coalesce(x.new, l_orderkey) AS own, 'ORD:' || coalesce(y.new, l_orderkey + 1) AS next, 'ORD:' || l_orderkey AS was, (x.new IS NOT NULL)::INTEGER + (y.new IS NOT NULL)::INTEGER AS moved
          FROM lineitem LEFT JOIN m x ON x.old = l_orderkey LEFT JOIN m y ON y.old = l_orderkey + 1)
    SELECT l_orderkey * 8 + l_linenumber AS answer_id, '{"chunk_id": "' || own || '", "sources": {"chunks": {"' || next || '": {"quote": "as ' || was || ' says"}}}, "note": "see ' || own || ' and (' || next || '), not X' || was || '"}' AS answer, moved FROM a""",
)
def citation_remap(spark, d):
    """Answers that cite orders, some of which have moved: ids, map keys and prose follow, quotes stay."""
    li = load(spark, d, "lineitem")
    own, following = F.concat(F.lit("ORD:"), F.col("l_orderkey").cast("string")), F.concat(F.lit("ORD:"), (F.col("l_orderkey") + 1).cast("string"))
    answer = F.concat(F.lit('{"chunk_id": "'), own, F.lit('", "sources": {"chunks": {"'), following, F.lit('": {"quote": "as '), own, F.lit(' says"}}}, "note": "see '), own, F.lit(" and ("), following, F.lit("), not X"), own, F.lit('"}'))
    moves = load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("ORD:"), F.col("o_orderkey").cast("string")).alias("old"), F.concat(F.lit("ORD:"), (F.col("o_orderkey") + 1000000).cast("string")).alias("new"))
    return citations.remap_citations(li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("answer_id"), answer.alias("answer")), moves, "answer_id", "answer")


_PLACED = """{n}0 AS (SELECT kind, category, md5('=' || key) AS pos, '=' || key || chr(9) || coalesce('=' || fp, '-') AS part, 1 AS n FROM {i}),
  {n}1 AS (SELECT kind, category, pos[1:4] AS pos, pos[1:4] || ':' || sha256(string_agg(part, chr(10) ORDER BY part)) AS part, sum(n) AS n FROM {n}0 GROUP BY 1, 2, 3),
  {n}2 AS (SELECT kind, category, pos[1:2] AS pos, pos[1:2] || ':' || sha256(string_agg(part, chr(10) ORDER BY part)) AS part, sum(n) AS n FROM {n}1 GROUP BY 1, 2, 3),
  {n}3 AS (SELECT kind, kind || '/' || category AS branch, sha256(string_agg(part, chr(10) ORDER BY part)) AS digest, sum(n) AS n FROM {n}2 GROUP BY 1, 2),
  {n}4 AS (SELECT kind AS branch, sha256(string_agg(branch || ':' || digest, chr(10) ORDER BY branch || ':' || digest)) AS digest, sum(n) AS n FROM {n}3 GROUP BY 1),
  {n} AS (SELECT 2 AS level, branch, digest, n::BIGINT AS n FROM {n}3 UNION ALL SELECT 1, branch, digest, n::BIGINT FROM {n}4
    UNION ALL SELECT 0, '', sha256(string_agg(branch || ':' || digest, chr(10) ORDER BY branch || ':' || digest)), sum(n)::BIGINT FROM {n}4)"""
_INPUTS = """i AS (SELECT 'corpus' AS kind, lang AS category, doc_id::VARCHAR AS key, md5(text) AS fp FROM documents UNION ALL SELECT 'register', p_brand, p_partkey::VARCHAR, md5(p_name) FROM part)"""
_BEFORE = """o AS (SELECT 'corpus' AS kind, lang AS category, doc_id::VARCHAR AS key, CASE WHEN lang = 'de' AND n_chars > 3000 THEN md5(text || '!') ELSE md5(text) END AS fp FROM documents
  UNION ALL SELECT 'register', p_brand, p_partkey::VARCHAR, md5(p_name) FROM part WHERE p_brand <> 'Brand#3')"""


def _inputs(spark, d, before: bool = False) -> DataFrame:
    """The corpus and a register; ``before``, as they were when some documents were longer and a brand was missing."""
    docs, parts = load(spark, d, "documents"), load(spark, d, "part")
    text = F.when((F.col("lang") == "de") & (F.col("n_chars") > 3000), F.concat("text", F.lit("!"))).otherwise(F.col("text")) if before else F.col("text")
    row = lambda df, kind, category, key, of: df.select(F.lit(kind).alias("kind"), F.col(category).alias("category"), F.col(key).cast("string").alias("key"), F.md5(of).alias("fingerprint"))
    return row(docs, "corpus", "lang", "doc_id", text).unionByName(row(parts.filter("p_brand <> 'Brand#3'") if before else parts, "register", "p_brand", "p_partkey", F.col("p_name")))


@BOOK.add("source_tree", f"WITH {_INPUTS}, {_PLACED.format(n='t', i='i')} SELECT level, branch, digest, n FROM t")
def source_tree(spark, d):
    """Digests of all that a graph is built from: root, kinds of input, categories."""
    return fingerprints.tree(_inputs(spark, d))


@BOOK.add("stale_branches", f"WITH {_INPUTS}, {_BEFORE}, {_PLACED.format(n='t', i='i')}, {_PLACED.format(n='s', i='o')} SELECT level, branch, CASE WHEN s.digest IS NULL THEN 'came' WHEN t.digest IS NULL THEN 'went' ELSE 'differs' END AS change FROM s FULL JOIN t USING (level, branch) WHERE s.digest IS DISTINCT FROM t.digest")
def stale_branches(spark, d):
    """Which branches of the sources changed since the store was built."""
    return fingerprints.changed(fingerprints.tree(_inputs(spark, d, before=True)), fingerprints.tree(_inputs(spark, d)))


@BOOK.add("stale_inputs", f"WITH {_INPUTS}, {_BEFORE} SELECT kind, category, key, CASE WHEN o.fp IS NULL THEN 'came' ELSE 'differs' END AS change FROM o FULL JOIN i USING (kind, category, key) WHERE o.fp IS DISTINCT FROM i.fp")
def stale_inputs(spark, d):
    """Which inputs are to be read again, looked for in the changed branches only."""
    was, now = _inputs(spark, d, before=True), _inputs(spark, d)
    return fingerprints.changed_inputs(was, now, fingerprints.changed(fingerprints.tree(was), fingerprints.tree(now)))


_MODELS = {"click": "NLIStatementOutput", "view": "ContextPrecisionOutput", "purchase": "AnswerRelevanceOutput", "error": "ContextRelevanceOutput"}


@BOOK.add(
    "judge_workings",
    """WITH c AS (SELECT event_id % 997 AS run, event_id AS pos, event_type AS t, (props::JSON->>'k')::INTEGER AS k FROM events),
    x AS (SELECT run, pos, t, k, CASE t WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS rank, unnest(CASE t WHEN 'click' THEN [0, 1] ELSE [0] END) AS j FROM c WHERE t IN ('click', 'view', 'purchase', 'error')),
    f AS (SELECT *, min(rank) OVER (PARTITION BY run) AS least, count(*) FILTER (t = 'view') OVER (PARTITION BY run) AS calls FROM x)
    SELECT run, CASE rank WHEN 1 THEN 'claims' WHEN 2 THEN 'excerpts' WHEN 3 THEN 'questions' ELSE 'ratings' END AS kind,
      CASE WHEN rank <> 2 OR calls = 3 THEN row_number() OVER (PARTITION BY run ORDER BY pos, j)::INTEGER END AS n,
      CASE WHEN rank = 1 THEN 'claim ' || (k + j) WHEN rank = 3 THEN 'why ' || k END AS text, CASE rank WHEN 1 THEN (k + j) % 2 = 1 WHEN 2 THEN k % 2 = 1 WHEN 3 THEN k > 50 END AS flag,
      CASE WHEN rank = 2 THEN 'because ' || k END AS reason, CASE WHEN rank = 4 THEN k % 4 END AS rating,
      CASE WHEN rank = 4 THEN CASE k % 4 WHEN 0 THEN 'not relevant' WHEN 1 THEN 'partly relevant' WHEN 2 THEN 'relevant' ELSE 'unrated' END END AS label FROM f WHERE rank = least""",
)
def judge_workings(spark, d):
    """Answers of four models, an object or a list, in one shape: the items of each run's first kind."""
    k = F.get_json_object("props", "$.k").cast("int")
    s = lambda c: c.cast("string")
    claim = lambda n: F.concat(F.lit('{"statement": "claim '), s(k + n), F.lit('", "verdict": '), s((k + n) % 2), F.lit("}"))
    answer = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"statements": ['), claim(0), F.lit(", "), claim(1), F.lit("]}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('[{"verdict": '), F.when(k % 2 == 1, "true").otherwise("false"), F.lit(', "reason": "because '), s(k), F.lit('"}]')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"question": "why '), s(k), F.lit('", "noncommittal": '), F.when(k > 50, "1").otherwise("0"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"rating": '), s(k % 4), F.lit("}")))
    )
    calls = load(spark, d, "events").select((F.col("event_id") % 997).alias("run"), F.col("event_id").alias("at"), _pick(F.col("event_type"), _MODELS, None).alias("model"), answer.alias("answer"), F.lit(3).alias("contexts"))
    return workings.items(calls, "run").drop("place")


_QUESTIONS = """q AS (SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN 'path' WHEN 1 THEN 'two hops' WHEN 2 THEN 'neighbourhood' WHEN 3 THEN 'neighbourhood' ELSE 'global' END AS route,
    CASE WHEN c_custkey % 5 < 4 THEN CASE WHEN c_custkey % 5 = 3 THEN 'n' || c_nationkey ELSE 's' || c_custkey % k END END AS source, CASE WHEN c_custkey % 5 = 0 THEN 'n' || c_nationkey END AS target,
    CASE WHEN c_custkey % 5 = 1 THEN 'document' END AS wanted FROM customer, (SELECT count(*) AS k FROM supplier)
    UNION ALL SELECT 1000000000 + item_id, 'global', NULL, NULL, NULL FROM benchmark)"""


def _questions(spark, d) -> DataFrame:
    """Questions in several wordings about the suppliers and nations of customers, and the passages, which ask about nothing."""
    c = load(spark, d, "customer")
    suppliers = load(spark, d, "supplier").count()
    key = F.col("c_custkey")
    name = F.concat(F.lit("Supplier#"), F.lpad((key % suppliers).cast("string"), 9, "0"))
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    text = (
        F.when(key % 5 == 0, F.concat(F.lit("How does "), name, F.lit(" connect to "), F.lower(nation), F.lit("?"))).when(key % 5 == 1, F.concat(F.lit("Which documents mention "), name, F.lit("?")))
        .when(key % 5 == 2, F.concat(F.lit("Tell me about "), F.upper(name))).when(key % 5 == 3, F.concat(nation, F.lit(", "), nation, F.lit("!"))).otherwise(F.lit("What is new?"))
    )
    passages = load(spark, d, "benchmark").select((F.col("item_id") + 1000000000).alias("query_id"), "text")
    return c.select(key.alias("query_id"), text.alias("text")).unionByName(passages)


def _routed(spark, d) -> DataFrame:
    return routing.routed(_questions(spark, d), routing.names_of(g.nodes(spark, d).filter("type <> 'document'"), ["label"]))


@BOOK.add("question_routes", f"WITH {_QUESTIONS} SELECT query_id, route, source, target, wanted FROM q")
def question_routes(spark, d):
    """The route of every question, and the nodes that it names."""
    return _routed(spark, d).drop("anchors")


@BOOK.add(
    "question_answers",
    f"""{g._G}, {_QUESTIONS}, u AS (SELECT source AS a, target AS b FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target),
    h AS (SELECT query_id, count(DISTINCT u.b) FILTER (u.b <> q.source) AS found FROM q JOIN u ON u.a = q.source WHERE route = 'neighbourhood' GROUP BY 1),
    w AS (SELECT query_id, u.b AS id FROM q JOIN u ON u.a = q.source JOIN n ON n.id = u.b AND n.type = 'document' WHERE route = 'two hops'
      UNION SELECT query_id, v.b FROM q JOIN u ON u.a = q.source JOIN n m ON m.id = u.b AND m.type IN ('system', 'stream') JOIN u v ON v.a = u.b JOIN n ON n.id = v.b AND n.type = 'document' WHERE route = 'two hops'),
    k AS (SELECT DISTINCT source, target FROM q WHERE route = 'path'), s1 AS (SELECT DISTINCT k.source, u.b FROM (SELECT DISTINCT source FROM k) k JOIN u ON u.a = k.source),
    s2 AS (SELECT DISTINCT s1.source, u.b FROM s1 JOIN u ON u.a = s1.b), s3 AS (SELECT DISTINCT s2.source, u.b FROM s2 JOIN u ON u.a = s2.b AND starts_with(u.b, 'n')),
    o AS (SELECT source, target, CASE WHEN (source, target) IN (SELECT (source, b) FROM s1) THEN 1 WHEN (source, target) IN (SELECT (source, b) FROM s2) THEN 2 WHEN (source, target) IN (SELECT (source, b) FROM s3) THEN 3 END AS found FROM k)
    SELECT query_id, route, CASE route WHEN 'global' THEN (SELECT count(*) FROM n) WHEN 'path' THEN o.found ELSE coalesce(h.found, w.found, 0) END::BIGINT AS found
    FROM q LEFT JOIN h USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS found FROM w GROUP BY 1) w USING (query_id) LEFT JOIN o ON o.source = q.source AND o.target = q.target AND route = 'path'""",
)
def question_answers(spark, d):
    """What each route finds, all questions at once."""
    return routing.answered(_routed(spark, d), g.nodes(spark, d), g.edges(spark, d).select("source", "target", "relation"))
