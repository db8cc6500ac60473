"""Each query against its SQL on the smallest tables, and the import contract."""

import importlib

import pytest

from tests.conftest import rows_of, sql_rows

PLANS = ("retrieval", "quality", "graph", "catalog", "register", "text", "stream", "review", "extract", "listing", "layout", "answer", "column")
BOOKS = {n: importlib.import_module(f"quillmesh.plans.{n}_queries").BOOK for n in PLANS}
CASES = [(n, q) for n, b in BOOKS.items() for q in b.sql]


@pytest.mark.parametrize(("plan", "query"), CASES, ids=[q for _, q in CASES])
def test_query_equals_its_sql(spark, data, oracle, plan, query):
    book = BOOKS[plan]
    assert rows_of(book.queries[query](spark, data)) == sql_rows(oracle, book.sql[query])


REST = [(n, q) for n, b in BOOKS.items() for q in b.queries if q not in b.sql]


@pytest.mark.parametrize(("plan", "query"), REST, ids=[q for _, q in REST])
def test_query_without_sql_runs(spark, data, plan, query):
    assert BOOKS[plan].queries[query](spark, data).count() > 0


def test_names_are_unique_and_sql_has_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
