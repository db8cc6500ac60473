"""Layout queries. A customer's orders are the shapes of a slide, and the lines
that sold a part are the words of an image; coordinates follow from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import layout
from quillmesh.plans.book import Book
from quillmesh.sources.tables import load

BOOK = Book()

_SHAPES = "p AS (SELECT o_custkey AS page, o_orderkey AS step, (o_orderkey * 37 % 1000)::DOUBLE AS x, (o_orderkey * 53 % 20 * 50)::DOUBLE AS y, o_orderstatus AS s FROM orders)"
_NEAR = f"""WITH RECURSIVE {_SHAPES}, c AS (SELECT page, step AS caption, x, y, row_number() OVER (PARTITION BY page ORDER BY step) AS k FROM p WHERE s = 'O'),
  n AS (SELECT c.page, caption, p.step AS arrow, sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2) AS dist FROM c JOIN p ON p.page = c.page AND s <> 'O' WHERE sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2) < 250),
  r AS (SELECT DISTINCT page, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS caption, NULL::BIGINT AS arrow, NULL::DOUBLE AS dist FROM c
        UNION ALL SELECT r.page, c.k, list_concat(r.used, CASE WHEN count(n.arrow) = 0 THEN [] ELSE [arg_min(n.arrow, (n.dist, n.arrow))] END), c.caption, arg_min(n.arrow, (n.dist, n.arrow)), min(n.dist)
        FROM r JOIN c ON c.page = r.page AND c.k = r.k + 1 LEFT JOIN n ON n.page = r.page AND n.caption = c.caption AND NOT list_contains(r.used, n.arrow) GROUP BY r.page, c.k, r.used, c.caption)"""
_WORDS = """w AS (SELECT l_partkey AS page, l_orderkey * 8 + l_linenumber AS word, (l_orderkey * 7919 % 900)::DOUBLE AS l, (l_orderkey * 31 % 60 * 10)::DOUBLE AS t,
    l_orderkey * 7919 % 900 + 20 + l_quantity AS r, (l_orderkey * 31 % 60 * 10 + 8 + l_linenumber)::DOUBLE AS b, 100 - 400 * l_discount AS conf FROM lineitem),
  h AS (SELECT page, median(b - t) AS h FROM w GROUP BY page), g AS (SELECT w.*, h, h * 1.6 AS px, h * 0.9 AS py FROM w JOIN h USING (page)),
  e AS (SELECT x.page, x.word AS a, y.word AS z FROM g x JOIN g y ON x.page = y.page AND x.word <> y.word AND x.l - x.px <= y.r AND y.l - x.px <= x.r AND x.t - x.py <= y.b AND y.t - x.py <= x.b),
  k(page, word, c) AS (SELECT page, word, word FROM w UNION SELECT e.page, e.z, k.c FROM k JOIN e ON k.page = e.page AND k.word = e.a),
  o AS (SELECT page, word, min(c) AS block FROM k GROUP BY page, word)"""


def _shapes(spark, d) -> DataFrame:
    n = lambda x: x.cast("double")
    return load(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("step"), n(F.col("o_orderkey") * 37 % 1000).alias("x"), n(F.col("o_orderkey") * 53 % 20 * 50).alias("y"), "o_orderstatus")


def words(spark, d) -> DataFrame:
    left, top = F.col("l_orderkey") * 7919 % 900, F.col("l_orderkey") * 31 % 60 * 10
    n = lambda x, name: x.cast("double").alias(name)
    return load(spark, d, "lineitem").select(
        F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("word"), n(left, "left"), n(top, "top"),
        n(left + 20 + F.col("l_quantity"), "right"), n(top + 8 + F.col("l_linenumber"), "bottom"), (100 - 400 * F.col("l_discount")).alias("confidence"),
    )


@BOOK.add(
    "chain_steps",
    f"""WITH {_SHAPES}, a AS (SELECT page, step AS arrow, step AS a, lead(step) OVER w AS b, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY page ORDER BY step)),
    m AS (SELECT a.page, arrow, step AS node, (x - x0) ** 2 + (y - y0) ** 2 AS dist FROM a JOIN p ON p.page = a.page AND step <> a AND step <> b
          WHERE least(abs(x1 - x0), abs(y1 - y0)) <= 60 AND x BETWEEN least(x0, x1) - 30 AND greatest(x0, x1) + 30 AND y BETWEEN least(y0, y1) - 30 AND greatest(y0, y1) + 30),
    n AS (SELECT page, arrow, 0 AS r, 0 AS dist, a AS node FROM a WHERE b IS NOT NULL UNION ALL SELECT page, arrow, 1, dist, node FROM m UNION ALL SELECT page, arrow, 2, 0, b FROM a WHERE b IS NOT NULL),
    l AS (SELECT page, arrow, r, row_number() OVER w AS place, node AS a, lead(node) OVER w AS b FROM n WINDOW w AS (PARTITION BY page, arrow ORDER BY r, dist, node))
    SELECT page, arrow, place::INTEGER AS place, a, b FROM l WHERE r < 2""",
)
def chain_steps(spark, d):
    """Arrows from each order to the customer's next one, with the orders on top of them put in."""
    p = _shapes(spark, d)
    w = Window.partitionBy("page").orderBy("step")
    arrows = p.select("page", F.col("step").alias("arrow"), F.col("step").alias("a"), F.lead("step").over(w).alias("b"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return layout.chains(arrows.filter("b is not null"), p, 60, 30, 100)


@BOOK.add("caption_arrows", f"{_NEAR} SELECT page, caption, arrow, round(dist, 6) AS dist FROM r WHERE arrow IS NOT NULL")
def caption_arrows(spark, d):
    """Open orders are captions, each with the nearest other order that none before it took."""
    p = _shapes(spark, d)
    found = layout.captioned(p.filter("o_orderstatus = 'O'").withColumnRenamed("step", "caption"), p.filter("o_orderstatus <> 'O'").withColumnRenamed("step", "arrow"), 250)
    return found.withColumn("dist", F.round("dist", 6))


@BOOK.add(
    "word_blocks",
    f"""WITH RECURSIVE {_WORDS}, s AS (SELECT o.page, block, min(l) AS "left", min(t) AS top, max(r) AS "right", max(b) AS bottom, count(*) AS words, round(avg(conf), 6) AS confidence, any_value(h) AS h FROM o JOIN g USING (page, word) GROUP BY ALL)
    SELECT page, block, "left", top, "right", bottom, words, confidence, row_number() OVER (PARTITION BY page ORDER BY round_even(top / (2 * h), 0), "left", block)::INTEGER AS place FROM s""",
)
def word_blocks(spark, d):
    """Blocks of words that touch once grown, in reading order."""
    return layout.blocks(words(spark, d)).drop("h").withColumn("confidence", F.round("confidence", 6))


@BOOK.add("page_kinds")
def page_kinds(spark, d):
    """What an image shows: text, a table, a diagram, or nothing but decoration."""
    return layout.page_kinds(words(spark, d)).withColumn("confidence", F.round("confidence", 6))
