"""Divergence of sources against SQL and a plain reading of its rule."""

import re
from collections import Counter, defaultdict

import pytest

from quillmesh.llm import divergence, queries
from tests.conftest import rows_of, sql_rows

SCHEMA = "doc_id long, text string, lang string, source string, item string, rank long"
DOCS = [(i, t, g, s, "x", 1) for i, (g, s, t) in enumerate(
    [("en", f"s{i % 5}", f"The the common {'odd' if i % 5 == 1 else 'even'} word{i} it's x{i % 3}y") for i in range(40)]
    + [("en", None, None)] * 3 + [("en", "s9", "12 34 !")] + [("en", "s1", "the odd ODD common")] * 6
    + [(None, "s1", "été Été ÉTÉ café the")] * 5 + [(None, "s2", "café CAFÉ 東京")] * 4 + [("", "s3", "the café")]
    + [("fr", f"q{i}", "rare" + "x" * i) for i in range(4)] + [("long", "s1", "many words " * 30_000)] * 3 + [("a/b c=d", "s", "one two")] * 5)]


def plain(docs, min_docs, top):
    read = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for _, text, lang, source, *_rest in docs:
        words = read(text)
        df[lang or ""].update(set(words))
        counts[lang or ""][source or ""].update(words)
    out = []
    for lang, groups in counts.items():
        kept = {w for w, n in df[lang].items() if n >= min_docs}

        def share(c):
            total = sum(c[w] for w in kept)  # noqa: B023
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}  # noqa: B023

        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if groups[s][w] and p[s][w] > q[w])[:top]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"SOURCES": 2, "STRIP": 2}, {"VOCABULARY": 3}, {"SALTS": 1}])
@pytest.mark.parametrize(("min_docs", "top"), [(3, 50), (2, 1), (1, 3)])
def test_audit(spark, monkeypatch, limits, min_docs, top):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(spark.createDataFrame(DOCS, SCHEMA).repartition(3), min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(DOCS, min_docs, top)


def test_query_equals_its_sql(spark, data, oracle):
    name = "op13_source_divergence"
    assert rows_of(queries.QUERIES[name](spark, data)) == sql_rows(oracle, queries.ORACLE_SQL[name])


def test_nothing_and_no_kept_terms(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    assert divergence.audit(docs.limit(0)).count() == 0
    assert sorted(map(tuple, divergence.audit(docs, min_docs=1000).collect())) == plain(DOCS, 1000, 50)


def test_shares_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(10**13 + 7, 3 * 10**13, 999_999), (0, 1, 1), (10**15, 10**15, 1)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(*map(F.col, "cnv")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in rows]
