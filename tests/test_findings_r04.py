"""Queries that once took too long, or answered a part of what was asked."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import stemming
from quillmesh.operators import evidence
from quillmesh.plans import retrieval_queries


def _alike(rows):
    """similar_sets by plain pairs of classes, as a sorted list."""
    heads: dict = {}
    for i, w in rows:
        if w and i is not None:
            heads.setdefault(frozenset(w), []).append(i)
    classes = [(min(v), w) for w, v in heads.items()]
    pairs = {(a, b, round(len(v & w) / len(v | w), 6)) for a, v in classes for b, w in classes if a < b and 2 * len(v & w) >= len(v | w)}
    return sorted([*pairs, *((min(v), i, 1.0) for v in heads.values() for i in v if i != min(v))])


def test_a_word_of_many_sets_is_dealt_in_cells(spark):
    """One task once held all pairs of a word's sets, and pairs were shuffled once for every word they share."""
    rng = random.Random(8)
    # 560 sets hold the same three words as their rarest
    rows = [(i, ["of", "many", "sets", *(f"common{int(rng.random() ** 2 * 3)}" for _ in range(i % 3))]) for i in range(0, 1120, 2)]
    rows = [(i, [*w, f"own{i}"] if i % 26 else w) for i, w in rows] + [(i, [f"common{i % 3}", f"x{i % 40}"]) for i in range(1, 1120, 2)]
    found = evidence.similar_sets(spark.createDataFrame(rows, "id int, w array<string>").repartition(4), "id", F.col("w"))
    assert sorted(map(tuple, found.collect())) == _alike(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(t#\d+L?, i#\d+L?, j#\d+L?", plan)


def test_an_id_of_several_sets_loses_no_link(spark, monkeypatch):
    """The words of all sets of an id were once ordered as if they were one set, so that some links were lost."""
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(60)]), [f"w{int(rng.random() ** 3 * 25)}" for _ in range(rng.randint(0, 7))]) for _ in range(160)]
    for cell in (512, 3):
        monkeypatch.setattr(evidence, "CELL", cell, raising=False)
        found = evidence.similar_sets(spark.createDataFrame(rows, "id int, w array<string>"), "id", F.col("w"))
        assert sorted(map(tuple, found.collect())) == _alike(rows)


def _plain_lexeme_bm25(texts, asked):
    """(query_id, doc_id, score) of the forty best documents of each question, one by one."""
    lexemes = lambda text: [stemming.stem(t) for t in re.findall(r"[^\W_]+", text.lower()) if t not in stemming.STOP_WORDS]
    held = [(i, lexemes(t)) for i, t in texts if t is not None]
    mean = sum(len(set(w)) for _, w in held) / len(held)
    found = []
    for q, text in asked:
        scores = {}
        for term in set(lexemes(text or "")):
            df = sum(term in w for _, w in held)
            for i, w in held:
                if tf := w.count(term):
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(set(w)) / mean))
        found += sorted(((q, i, s) for i, s in scores.items()), key=lambda r: (-round(r[2], 6), r[1]))[:40]
    return found


def test_lexemes_of_every_passage_are_asked(spark, tmp_path):
    """Only passages whose id 100 divides were once asked."""
    rng = random.Random(6)
    words = ["run", "running", "runs", "the", "cats", "cat", "dog", "of", "nation", "national", "über", "x9"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(70)] + [(70, None), (71, ""), (72, "the of")]
    asked = [(q, " ".join(["cats", *rng.choices(words, k=2)])) for q in (0, 1, 2, 57, 99, 100, 101)] + [(150, None), (151, "the")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval_queries.BOOK.queries["ret_bm25_stemmed"](spark, str(tmp_path)).collect()}
    want = {(q, i): pytest.approx(s, abs=2e-6) for q, i, s in _plain_lexeme_bm25(texts, asked)}
    assert got == want and {q for q, _ in got} >= {1, 57, 101}
