"""Rows on which queries once differed from their SQL."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import tables
from quillmesh.operators import entries, evidence, extraction, graph, layout, retrieval, routing
from quillmesh.plans import column_queries, extract_queries, graph_queries, retrieval_queries, stream_queries
from tests.conftest import rows_of, sql_rows
from tests.test_mechanisms import WORDS, plain_blocks


@pytest.fixture
def against_sql(spark, tmp_path):
    """A query on hand-made tables, and its SQL on the same."""

    def run(book, query, **tables):
        con = duckdb.connect()
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        return rows_of(book.queries[query](spark, str(tmp_path))), sql_rows(con, book.sql[query])

    return run


def test_a_ticket_in_part_of_a_longer_number_of_the_name(spark, against_sql):
    orders = ([(7, 110000, "F", "1-URGENT"), (8, 110000, "O", "2-HIGH"), (5000, 5, "F", "1-URGENT"), (9, 3, None, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    customers = ([(5, "BUILDING"), (110000, "MACHINERY")], "c_custkey long, c_mktsegment string")
    got, want = against_sql(extract_queries.BOOK, "extract_tickets", orders=orders, customer=customers)
    # order 120000 % 5000 = 0 speaks of ticket 20000, and its file is named after ticket 120000
    got2 = rows_of(extraction.tickets(spark.createDataFrame([(1, "FS TKT-120000.md", "tkt 20000")], "id int, name string, text string"), "id", "text", "name", "TKT", spark.createDataFrame([], "key string"), whole=False))
    assert got == want and ("1", "1", "implements", "TKT-20000") in got2[1]


def test_tickets_of_names_that_hold_another_number(spark, against_sql):
    orders = ([(5000, 110000, "F", "1-URGENT"), (5001, 110000, "F", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    got, want = against_sql(extract_queries.BOOK, "extract_tickets", orders=orders, customer=([(1, "BUILDING")], "c_custkey long, c_mktsegment string"))
    assert got == want and sum("implements" in r for r in got[1]) == 3


def test_accounts_below_zero_and_halves(against_sql):
    money = [-999.85, -101.0, -100.5, -99.5, -50.5, -50.4, -49.5, -12.0, -0.5, 0.0, 0.5, 30.0, 49.49, 49.5, 50.5, 99.5, 149.5, 9999.8]
    customers = ([(i, x, 3) for i, x in enumerate(money)] + [(90, 5.0, 4)], "c_custkey long, c_acctbal double, c_nationkey int")
    suppliers = ([(i, x + 1, 3) for i, x in enumerate(money)], "s_suppkey long, s_acctbal double, s_nationkey int")
    got, want = against_sql(graph_queries.BOOK, "graph_quality_largest_component", customer=customers, supplier=suppliers)
    assert got == want


def test_long_texts_meet_short_middles_in_one_pass(spark):
    """A middle without two whole words once took time by the square of a text's length."""
    text = "".join(chr(97 + i * i % 23) + (" " if i % 9 == 0 else "") for i in range(200_000))
    items = spark.createDataFrame([(1, "needle"), (2, "a needle x"), (3, "n"), (4, "abcdefgh needles")], "item_id int, text string")
    docs = spark.createDataFrame([(i, text + end) for i, end in enumerate([" a needle x", "", " needles"])], "doc_id int, text string")
    began = time.monotonic()
    got = {(r.item_id, r.doc_id, r.status) for r in entries.partial_quotes(items, docs).collect()}
    assert {(1, 0, "verbatim"), (1, 2, "verbatim"), (2, 0, "verbatim")} <= got and time.monotonic() - began < 60


def test_walks_set_out_once_from_the_end_with_fewer_nodes(spark, monkeypatch):
    """Many questions about few targets once walked one by one over the whole graph."""
    edges = spark.createDataFrame([("n0" if i % 2 else "n1", f"c{i}") for i in range(60)] + [("n0", "n1")], "source string, target string")
    pairs = spark.createDataFrame([(i, f"c{i % 60}", f"n{i % 3}") for i in range(600)], "query_id int, source string, target string")
    seen, settle = [], routing.settled
    monkeypatch.setattr(routing, "settled", lambda df, name="round": seen.append((name, (out := settle(df, name)).count())) or out)
    got = {r.query_id: r.hops for r in routing.path_lengths(pairs, edges).collect()}
    want = {i: 1 if (i % 60 % 2 == 1) == (i % 3 == 0) else 2 for i in range(600) if i % 3 < 2}
    assert got == want and max(n for name, n in seen if name in ("seen", "frontier", "ahead")) <= 3 * 62


def test_a_table_is_dealt_by_its_rows(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("b", "d")], "source string, target string")
    assert sorted(map(tuple, graph.links(edges).collect())) == [("a", "b"), ("b", "a"), ("b", "d"), ("d", "b")]
    assert graph.dealt(edges, 100 * graph.PER_TASK, "source").rdd.getNumPartitions() == 100


def test_sets_are_compared_where_they_meet(spark):
    """Pairs that are not alike were once shuffled, and joined with both of their sets."""
    rng = random.Random(4)
    rows = [(i, [f"w{int(rng.random() ** 3 * 30)}" for _ in range(rng.randint(0, 8))]) for i in range(150)]
    found = evidence.similar_sets(spark.createDataFrame(rows, "id int, w array<string>"), "id", F.col("w"))
    heads: dict = {}
    for i, w in rows:
        if w:
            heads.setdefault(frozenset(w), []).append(i)
    want = {(v[0], i, 1.0) for v in heads.values() for i in v[1:]}
    want |= {(x[0], y[0], round(len(a & b) / len(a | b), 6)) for a, x in heads.items() for b, y in heads.items() if x[0] < y[0] and 2 * len(a & b) >= len(a | b)}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # pairs are compared beneath the grouping that makes them distinct
    assert 0 <= plan.index("Aggregate [a#") < plan.index("array_intersect(")


def _page_words(seed, pages, n):
    rng = random.Random(seed)
    return [(rng.choice(pages), i % (n - 5), x := rng.random() * 400, y := rng.random() * 300, x + 10 + rng.random() * 60, y + 6 + rng.random() * 10, 90.0) for i in range(n)]


def test_words_of_a_page_meet_where_they_lie(spark, monkeypatch):
    """Every word once went through rounds of joins over the whole table; now only those of long pages do."""
    rows = _page_words(4, [1, 2, 3, 5], 160)
    monkeypatch.setattr(layout, "components", lambda *_: pytest.fail("pages of few words went through rounds of joins"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pages go on from batch to batch
    try:
        words = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 9.0, 9.0, 90.0), (1, 900, None, 0.0, 9.0, 9.0, 90.0), (7, 901, None, None, None, None, 90.0)], WORDS)
        got = {(r.page, r.word): r.block for r in layout.word_blocks(words).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.undo()
    # a page's height is the median of the heights that are known
    assert got == plain_blocks(rows) | {(1, 900): 900, (7, 901): 901}


@pytest.mark.parametrize("whole", [0, 40])
def test_long_pages_give_the_same_blocks(spark, monkeypatch, whole):
    rows = [(p, i, *rest) for i, (p, _, *rest) in enumerate(_page_words(5, [1, 1, 1, 2], 100))]
    words = spark.createDataFrame(rows, WORDS)
    want = [sorted(map(tuple, df.collect())) for df in (layout.blocks(words), layout.page_kinds(words))]
    monkeypatch.setattr(layout, "WHOLE", whole)
    assert [sorted(map(tuple, df.collect())) for df in (layout.blocks(words), layout.page_kinds(words))] == want
    assert {(r.page, r.word): r.block for r in layout.word_blocks(words).collect()} == plain_blocks(rows)


def test_only_postings_of_asked_lexemes_are_written(spark, tmp_path, monkeypatch):
    """The postings of all words were once written and joined with their lexemes, and every term that a
    question and a document share was shuffled."""
    texts = [(1, "Running dogs and the cats, runs"), (2, "the and of"), (3, None), (4, " ".join(f"word{i}" for i in range(500)) + " dog"), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, "The dog ran; a runner's run"), (200, "of the"), (300, "cat Word7")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole = retrieval.lexeme_postings(docs)
    assert {(r.term, r.tf, r.dl) for r in whole.filter("doc_id = 1").collect()} == {("run", 2, 3), ("dog", 1, 3), ("cat", 1, 3)}
    assert whole.filter("doc_id not in (1, 4)").isEmpty()
    stats = retrieval.corpus_stats(docs, stems=True).first()
    assert tuple(stats) == tuple(retrieval.lexeme_stats(whole, docs).first()) == (4, (3 + 501) / 4)
    want = rows_of(retrieval.bm25(whole, spark.createDataFrame([(100, "dog"), (100, "ran"), (100, "runner"), (100, "run"), (300, "cat"), (300, "word7")], "query_id long, term string"), retrieval.corpus_stats(docs, stems=True)))
    seen = []
    for module in (retrieval, graph):
        monkeypatch.setattr(module, "settled", lambda df, name="round", settle=module.settled: seen.append((out := settle(df, name)).count()) or out)
    got = retrieval_queries.BOOK.queries["ret_bm25_stemmed"](spark, str(tmp_path))
    assert rows_of(got) == want and max(seen) < 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)


def test_points_and_boxes_on_one_place_are_looked_at_once(spark, monkeypatch):
    """Every point was once paired with every box near it, copies and all."""
    boxes = [(1, i, 10.0 * (i % 3), 0.0, 10.0 * (i % 3) + 20, 10.0) for i in range(300, 0, -1)] + [(2, 900, 0.0, 0.0, 5.0, 5.0)]
    points = [(1, i, 45.0 + i % 2 * 10, 5.0) for i in range(200)] + [(2, 500, 30.0, 5.0), (2, 500, 15.0, 5.0), (3, 501, 0.0, 0.0)]
    seen, grid = [], layout.on_grid
    monkeypatch.setattr(layout, "on_grid", lambda df, *rest: seen.append(df.count()) or grid(df, *rest))
    got = layout.snapped(spark.createDataFrame(points, "page int, point int, x double, y double"), spark.createDataFrame(boxes, "page int, box int, left double, top double, right double, bottom double"), 40.0)
    want = {(1, i, 2, 5.0 + i % 2 * 10) for i in range(200)} | {(2, 500, 900, 10.0)}
    assert set(map(tuple, got.collect())) == want and got.count() == 201 and seen == [4]


def test_one_file_of_customers_is_converted_by_all_tasks(spark, data):
    """One task once converted all that a file held."""
    got = column_queries.BOOK.queries["converted_files"](spark, data)
    assert spark.read.parquet(f"{data}/customer.parquet").rdd.getNumPartitions() < got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_neighbours_are_cut_before_the_table_function(spark):
    """Every link once went through Python; now the first ones of a node do, and how many they stand for."""
    tables.register(spark)
    links = [("hub", f"n{i:04}", "r") for i in range(3000)] + [("hub", None, "r"), ("a", "b", None), ("a", "b", ""), ("a", "é", "q"), ("a", "z", "q"), (None, "x", "r"), ("none", None, "r")]
    df = spark.createDataFrame(links, "node string, neighbour string, relation string")
    cut = graph.first_links(df, 2)
    assert cut.groupBy("node").count().agg({"count": "max"}).first()[0] == 2
    sql = "SELECT * FROM graph_neighbours(TABLE(SELECT * FROM {links}) PARTITION BY (node), most => 2)"
    got = rows_of(spark.sql(sql, links=cut))
    assert got == rows_of(spark.sql(sql, links=df)) and ("3000", "n0000", "hub", "1", "r") in [(r[0], r[1], r[2], r[3], r[4]) for r in got[1]]


def test_a_stream_takes_files_by_their_bytes(spark, tmp_path, monkeypatch):
    """Every file once was a round of its own, and a conversation in several files came out in pieces."""
    turns = [(c, t, f"turn {t} of {c}, mail a{t}@b.org. ") for c in range(4) for t in range(5)]
    for t in range(5):
        spark.createDataFrame([x for x in turns if x[1] == t], "conv_id long, turn long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(stream_queries, "_shared", lambda _: str(tmp_path))
    got = {r.stream_id: r.text for r in stream_queries.BOOK.queries["stream_redact"](spark, str(tmp_path)).collect()}
    assert {k: v.count("turn") for k, v in got.items()} == {str(c): 5 for c in range(4)} and "@" not in "".join(got.values())
    assert len(list(tmp_path.glob("stream-*/checkpoint/commits/[0-9]*"))) == 1
