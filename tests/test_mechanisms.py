"""Lexemes, table functions, timers and layout against plain versions."""

import random
import statistics
from collections import Counter

import pandas as pd
import pytest

from quillmesh.functions import tables
from quillmesh.functions.stemming import STOP_WORDS, lexicon, stem
from quillmesh.operators import layout, retrieval
from quillmesh.streaming import timers, windows
from quillmesh.streaming.redactor import state_store

# pairs of the published vocabulary
STEMS = """consigned consign|consignment consign|consistency consist|consolations consol|consolatory consolatori|consoled consol|conspicuously conspicu|conspirators conspir|constancy constanc|knackeries knackeri
knavish knavish|kneeling kneel|knightly knight|knives knive|knocker knocker|happiness happi|hopping hop|hoping hope|generates generat|generically generic|generally general|communism communism|ties tie|cries cri|gas gas
agreed agre|feed feed|rational ration|relational relat|nationality nation|likely like|say say|by by|enjoy enjoy|flying fli|dying die|controlling control|operator oper|formalize formal|hopefulness hope|adoption adopt
probate probat|roll roll|boyish boyish|flies fli|news news|herrings herring|succeed succeed|processing process|youth youth|analogi analog|über über|a1b2s a1b2s|yes yes|sky sky|is is|ab ab"""


def test_stems_are_those_of_the_published_vocabulary():
    pairs = [p.split() for line in STEMS.split("\n") for p in line.split("|")]
    assert [(w, stem(w)) for w, _ in pairs] == [(w, s) for w, s in pairs]


def test_lexicon_stems_distinct_terms_once(spark):
    got = lexicon(spark.createDataFrame([("running",), ("running",), ("the",), (None,), ("",), ("runs",)], "term string")).collect()
    assert sorted(map(tuple, got), key=str) == [("", ""), ("running", "run"), ("runs", "run"), ("the", None)]
    assert lexicon(spark.createDataFrame([], "term string")).count() == 0


DOCS = [(1, "The runner was running; runs and running."), (2, "A run of the mill"), (3, "Cats sleep"), (4, None), (5, "the and of"), (6, ""), (7, "mills milled cats")]


def plain_lexemes(text):
    import re

    return [stem(t) for t in re.findall(r"[^\W_]+", (text or "").lower()) if t not in STOP_WORDS]


def test_lexeme_postings_and_bm25(spark):
    import math

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    posts = retrieval.lexeme_postings(docs)
    want = {(i, w, n, len(set(plain_lexemes(t)))) for i, t in DOCS for w, n in Counter(plain_lexemes(t)).items()}
    assert set(map(tuple, posts.select("doc_id", "term", "tf", "dl").collect())) == want
    asked = spark.createDataFrame([(0, "the running cats"), (1, "of the"), (2, "milling")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(posts, retrieval.lexeme_terms(asked), retrieval.lexeme_stats(posts, docs)).collect()}
    held = {i: Counter(plain_lexemes(t)) for i, t in DOCS if t is not None}
    n, avg = len(held), sum(map(len, held.values())) / len(held)
    want = {}
    for q, text in ((0, "the running cats"), (1, "of the"), (2, "milling")):
        for d, tf in held.items():
            hits = [w for w in set(plain_lexemes(text)) if tf[w]]
            if hits:
                df = {w: sum(1 for x in held.values() if x[w]) for w in hits}
                want[q, d] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(tf) / avg)) for w in hits), 6)
    assert got == pytest.approx(want)


def test_top_rows_takes_any_table(spark):
    tables.register(spark)
    rows = [("a", 3, [1]), ("a", 5, [2]), ("a", None, [3]), ("b", 1, None), (None, 7, []), (None, 8, [4])]
    spark.createDataFrame(rows, "k string, v int, more array<int>").createOrReplaceTempView("any_table")
    got = spark.sql("SELECT * FROM top_rows(TABLE(any_table), by => 'k', first => 'v', n => 2)")
    assert got.columns == ["k", "v", "more", "place"]
    assert sorted(((str(r.k), r.v, r.place) for r in got.collect()), key=str) == [("None", 7, 2), ("None", 8, 1), ("a", 3, 2), ("a", 5, 1), ("b", 1, 1)]
    up = spark.sql("SELECT v FROM top_rows(TABLE(any_table), by => 'k', first => 'v', n => 1, ascending => true)")
    assert sorted(r.v for r in up.collect()) == [1, 3, 7]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM top_rows(TABLE(any_table), by => 'x', first => 'v', n => 1)")


def test_neighbours_of_a_hub(spark):
    tables.register(spark)
    rows = [("hub", f"n{i:03}", "r") for i in range(300)] + [("x", None, "r"), ("x", "hub", None), ("lone", None, "r")]
    links = spark.createDataFrame(rows, "node string, neighbour string, relation string")
    got = spark.sql("SELECT * FROM graph_neighbours(TABLE(SELECT * FROM {links}) PARTITION BY (node), most => 2)", links=links).collect()
    assert sorted(map(tuple, got)) == [("hub", "n000", "r", 1, 300), ("hub", "n001", "r", 2, 300), ("x", "hub", "", 1, 1)]
    with pytest.raises(Exception, match="no neighbour"):
        spark.sql("SELECT * FROM graph_neighbours(TABLE(SELECT node, relation FROM {links}) PARTITION BY (node), most => 2)", links=links)


MINUTE = 60_000


def plain_expiries(events, span, mark):
    out = []
    for key in {k for k, _, _ in events}:
        times = sorted(t for k, t, _ in events if k == key)
        out += [(key, a + span) for a, b in zip(times, times[1:]) if b - a > span]
        out += [(key, times[-1] + span)] * (times[-1] + span <= mark)
    return sorted(out)


def plain_runs(events, span, mark):
    out = []
    for key in {k for k, _, _ in events}:
        open_ = None
        for t, end in sorted((t, end) for k, t, end in events if k == key):
            if open_ is not None and t - open_ > span:
                out.append((key, open_, "abandoned"))
                open_ = None
            if end:
                if open_ is not None:
                    out.append((key, open_, "finished"))
                open_ = None
            elif open_ is None:
                open_ = t
        if open_ is not None and open_ + span <= mark:
            out.append((key, open_, "abandoned"))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 6])
def test_timers_end_sessions_and_runs_however_the_stream_is_cut(spark, tmp_path, files):
    rng = random.Random(5)
    start = 1_700_000_000_000
    events = sorted(((f"u{rng.randrange(6)}", start + rng.randrange(3_000) * MINUTE + rng.randrange(1000), rng.random() < 0.3) for _ in range(240)), key=lambda e: e[1])
    for i in range(files):
        part = events[i * len(events) // files : (i + 1) * len(events) // files]
        pdf = pd.DataFrame({"user": [e[0] for e in part], "ts": pd.to_datetime([e[1] for e in part], unit="ms", utc=True), "done": [e[2] for e in part]})
        spark.createDataFrame(pdf, "user string, ts timestamp, done boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema("user string, ts timestamp, done boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    mark = events[-1][1] - 30 * MINUTE
    from pyspark.sql import functions as F

    with state_store(spark):
        ended = windows.run_to_table(timers.expiries(stream(), "user", "ts", 60, "30 minutes"), f"{tmp_path}")
        runs = windows.run_to_table(timers.run_ends(stream(), "user", "ts", F.col("done"), 45, "30 minutes"), f"{tmp_path}")
    assert sorted(map(tuple, ended.collect())) == plain_expiries(events, 60 * MINUTE, mark)
    assert sorted(map(tuple, runs.collect())) == plain_runs(events, 45 * MINUTE, mark)


def greedy(captions, anchors, reach):
    out, used = [], set()
    for page, c, x, y in sorted(captions):
        best = min(((((x - ax) ** 2 + (y - ay) ** 2) ** 0.5, a) for p, a, ax, ay in anchors if p == page and (p, a) not in used and ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5 < reach), default=None)
        if best:
            used.add((page, best[1]))
            out.append((page, c, best[1], round(best[0], 6)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_captions_equal_a_greedy_loop(spark, seed):
    rng = random.Random(seed)
    place = lambda n: [(rng.randrange(3), i, float(rng.randrange(12) * 10), float(rng.randrange(6) * 10)) for i in range(n)]  # noqa: E731  many ties
    captions, anchors = place(60), place(45)
    got = layout.captioned(spark.createDataFrame(captions, "page int, caption int, x double, y double"), spark.createDataFrame(anchors, "page int, arrow int, x double, y double"), 35.0)
    assert sorted((r.page, r.caption, r.arrow, round(r.dist, 6)) for r in got.collect()) == greedy(captions, anchors, 35.0)


def test_captions_of_nothing(spark):
    none = spark.createDataFrame([], "page int, caption int, x double, y double")
    assert layout.captioned(none, none.withColumnRenamed("caption", "arrow"), 10.0).count() == 0


def test_chains_take_in_steps_in_order(spark):
    steps = [(1, "a", 0.0, 0.0), (1, "b", 500.0, 5.0), (1, "far", 400.0, 0.0), (1, "near", 100.0, 20.0), (1, "off", 250.0, 90.0), (2, "c", 0.0, 0.0), (2, "d", 300.0, 300.0), (2, "e", 150.0, 150.0)]
    arrows = [(1, "back", "b", "a", 500.0, 5.0, 0.0, 0.0), (1, "there", "a", "b", 0.0, 0.0, 500.0, 5.0), (1, "ghost", "a", "picture", 0.0, 0.0, 500.0, 0.0), (2, "elbow", "c", "d", 0.0, 0.0, 300.0, 300.0)]
    got = layout.chains(spark.createDataFrame(arrows, "page int, arrow string, a string, b string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(steps, "page int, step string, x double, y double"), 60, 30, 50)
    assert sorted((r.arrow, r.place, r.a, r.b) for r in got.collect()) == [
        ("back", 1, "b", "far"), ("back", 2, "far", "near"), ("back", 3, "near", "a"), ("elbow", 1, "c", "d"), ("ghost", 1, "a", "picture"), ("there", 1, "a", "near"), ("there", 2, "near", "far"), ("there", 3, "far", "b")]


def plain_blocks(words):
    """(page, word) to block, by pairs and union."""
    out = {}
    for page in {w[0] for w in words}:
        mine = [w for w in words if w[0] == page]
        h = statistics.median(w[5] - w[3] for w in mine)
        px, py = h * layout.GROW_X, h * layout.GROW_Y
        name = {w[1]: w[1] for w in mine}
        changed = True
        while changed:
            changed = False
            for a in mine:
                for b in mine:
                    if a[2] - px <= b[4] and b[2] - px <= a[4] and a[3] - py <= b[5] and b[3] - py <= a[5] and name[a[1]] != name[b[1]]:
                        name[a[1]] = name[b[1]] = min(name[a[1]], name[b[1]])
                        changed = True
        out |= {(page, w): b for w, b in name.items()}
    return out


WORDS = "page int, word int, left double, top double, right double, bottom double, confidence double"


def test_word_blocks_equal_pairs(spark):
    rng = random.Random(1)
    words = [(rng.randrange(3), i, x := rng.random() * 400, y := rng.random() * 300, x + 10 + rng.random() * 60, y + 6 + rng.random() * 10, 90.0) for i in range(150)]
    got = {(r.page, r.word): r.block for r in layout.word_blocks(spark.createDataFrame(words, WORDS)).collect()}
    assert got == plain_blocks(words)


def test_page_kinds(spark):
    word = lambda page, i, x, y, c=90.0: (page, i, x, y, x + 40, y + 10, c)
    table = [word(1, 10 * r + c, c * 200.0, r * 60.0) for r in range(3) for c in range(3)]
    diagram = [word(2, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (210.0, 5.0), (430.0, 90.0), (60.0, 130.0), (300.0, 200.0), (10.0, 290.0)])]
    text = [word(3, i, i * 45.0, 0.0) for i in range(8)]
    noise = [word(4, i, x, 0.0, 55.0) for i, x in enumerate([0.0, 300.0])]
    got = {r.page: (r.blocks, r.grid, r.kind) for r in layout.page_kinds(spark.createDataFrame(table + diagram + text + noise, WORDS)).collect()}
    assert got == {1: (9, True, "table"), 2: (6, False, "diagram"), 3: (1, False, "text"), 4: (2, False, "decoration")}
    assert layout.page_kinds(spark.createDataFrame([], WORDS)).count() == 0


def test_points_snap_to_the_nearest_box(spark):
    rng = random.Random(2)
    boxes = [(i % 2, i, x := rng.random() * 300, y := rng.random() * 300, x + 20, y + 10) for i in range(40)]
    points = [(i % 2, i, rng.random() * 300, rng.random() * 300) for i in range(80)]
    want = []
    for page, i, x, y in points:
        near = min(((max(b[2] - x, 0, x - b[4]) ** 2 + max(b[3] - y, 0, y - b[5]) ** 2) ** 0.5, b[1]) for b in boxes if b[0] == page)
        if near[0] <= 25:
            want.append((page, i, near[1], round(near[0], 6)))
    got = layout.snapped(spark.createDataFrame(points, "page int, point int, x double, y double"), spark.createDataFrame(boxes, "page int, box int, left double, top double, right double, bottom double"), 25.0)
    assert sorted((r.page, r.point, r.box, round(r.dist, 6)) for r in got.collect()) == sorted(want)
