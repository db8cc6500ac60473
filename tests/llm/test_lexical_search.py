"""Ranked search against a plain reading of its formula, and its graph against plain sums."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import lexical_search, queries
from tests.conftest import rows_of, sql_rows

SCHEMA = "doc_id long, text string, item_id long, rank string, score string"
DOCS = [(i, t, 1, "r", "s") for i, t in [
    (3, "Red fox, red DOG; 12"), (1, "red fox"), (2, "red fox"), (None, "fox fox fox"), (8, None), (9, " .,- "), (5, "blue " * 20_000 + "fox"), (5, "blue whale"), (5, "blue whale"),
    (7, "Straße ÄPFEL äpfel 東京 red_fox"), (11, ""), (6, "whale12 12 whale a1b2")]]
ITEMS = [(1, "red fox"), (2, "Red red FOX blue"), (3, None), (4, "..."), (None, "whale 12"), (5, "ÄPFEL äpfel"), (6, "nowhere"), (7, "red fox"), (8, "red fox whale"), (8, "dog")]


def plain(docs, items, k):
    read = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(d[0], read(d[1])) for d in docs]
    texts = [(d, Counter(w), len(w)) for d, w in texts if w]
    n, length, df = len(texts), sum(t[2] for t in texts), Counter(w for t in texts for w in t[1])
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(read(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, tf, own in texts:
            m = 75 + 25 * own * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w, times in terms.items() if tf[w])
            if score > 0:
                scored.append((-score, -math.inf if d is None else d))
        out += [(str(i), rank, str(None if d == -math.inf else d), -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"ENTRIES": 2, "ROUND": 1, "CELLS": 1}, {"SHARED": 2}])
@pytest.mark.parametrize("k", [2, 20])
def test_search(spark, monkeypatch, limits, k):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    got = lexical_search.search(spark.createDataFrame(DOCS, SCHEMA).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string"), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got.collect()) == plain(DOCS, ITEMS, k)


def test_query_equals_its_sql(spark, data, oracle):
    name = "op12_lexical_search"
    assert rows_of(queries.QUERIES[name](spark, data)) == sql_rows(oracle, queries.ORACLE_SQL[name])


def test_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id > 8"), items)):
        assert lexical_search.search(d, i).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.dictionaries(st.sampled_from("abcdefghij"), st.integers(1, 3), min_size=1), max_size=20), st.integers(2, 4))
def test_shared_sums_equal_plain_sums(asked, shared):
    asked = {q: Counter({t.encode(): n for t, n in terms.items()}) for q, terms in asked.items()}
    plan = lexical_search.mine(asked, shared)
    if not asked:
        return
    number = {bytes([b]): i for i, b in enumerate(b"abcdefghij")}
    value = np.arange(1, 11) ** 3
    block = lexical_search.Block(plan, number, 10)
    got = block.scores(np.repeat([0, 1], [10, 5]), np.r_[np.arange(10), np.arange(5)], np.r_[value, value[:5]], 3)
    for row, q in zip(got.tolist(), block.queries, strict=True):
        whole = sum(n * int(value[number[t]]) for t, n in asked[q].items())
        some = sum(n * int(value[number[t]]) for t, n in asked[q].items() if number[t] < 5)
        assert row == [whole, some, 0]


def test_shared_terms_are_added_once():
    """Ten queries of the same five common terms and one of their own: one node holds the common part."""
    plan = lexical_search.mine({q: Counter([b"a", b"b", b"c", b"d", b"e", b"own%d" % q]) for q in range(10)})
    assert all(len(parts) == 2 for parts in plan["parts"].values()) and len(plan["leaf"]) == 11
    nested = {q: Counter([b"a", b"b"] + [b"c", b"d"] * (q < 6) + [b"e"] * (q < 4) + [b"own%d" % q]) for q in range(10)}
    plan = lexical_search.mine(nested)
    assert plan["pairs"] and sum(map(len, plan["parts"].values())) == 20  # each query: a node of the graph, and its own term
