"""Answer-quality analytics over events, labels and documents.

An event stands for a judged answer: its value, over 400 and capped at 1, is a
score; its type is the mode; its user is the subject.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import quality
from quillmesh.plans.book import Book
from quillmesh.sources.tables import load

BOOK = Book()
NOW = "2024-01-30 00:00:00"
_V = "least(value / 100.0, 1.0)"
_E = f"e AS (SELECT *, {_V} AS score, json_extract(props, '$.k')::INTEGER AS k FROM events)"


def _events(spark, d):
    e = load(spark, d, "events")
    return e.withColumns({"score": F.least(F.col("value") / 100.0, F.lit(1.0)), "k": F.get_json_object("props", "$.k").cast("int")})


def _now():
    return F.lit(NOW).cast("timestamp")


_CUR = f"(ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}')"
_PREV = f"(ts > TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)"


def _tile_sql(by: str) -> str:
    g = f"GROUP BY {by}" if by else ""
    c = f"{by}, " if by else ""
    return f"""WITH {_E}, t AS (SELECT {c}round(avg(score) FILTER ({_CUR}), 4) AS value, round(avg(score) FILTER ({_PREV}), 4) AS previous,
        count(*) FILTER ({_CUR} AND score < 0.7) AS below, count(score) FILTER ({_CUR}) AS n FROM e {g}) SELECT *, round(value - previous, 4) AS delta FROM t"""


@BOOK.add("q_tiles", _tile_sql("event_type"))
def q_tiles(spark, d):
    return quality.tiles(_events(spark, d), "score", "ts", _now(), 7, 0.7, ("event_type",))


@BOOK.add("q_prev_delta", _tile_sql(""))
def q_prev_delta(spark, d):
    return quality.tiles(_events(spark, d), "score", "ts", _now(), 7, 0.7)


@BOOK.add(
    "q_series_weekly",
    f"""WITH {_E} SELECT date_trunc('week', ts)::TIMESTAMP AS bucket, count(score) AS n, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.1), 6) AS p10,
    round(quantile_cont(score, 0.9), 6) AS p90, round(avg(score), 6) AS mean FROM e GROUP BY 1""",
)
def q_series_weekly(spark, d):
    s = quality.series(_events(spark, d), "score", "ts", "WEEK")
    return s.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@BOOK.add(
    "q_series_daily",
    f"""WITH {_E} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, count(score) AS n, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.1), 6) AS p10,
    round(quantile_cont(score, 0.9), 6) AS p90, round(avg(score), 6) AS mean FROM e GROUP BY 1""",
)
def q_series_daily(spark, d):
    return quality.series(_events(spark, d), "score", "ts", "DAY").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@BOOK.add("q_histogram", f"WITH {_E} SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n FROM e WHERE score IS NOT NULL GROUP BY 1")
def q_histogram(spark, d):
    return quality.histogram(_events(spark, d), "score")


@BOOK.add(
    "q_halves",
    f"""WITH {_E}, u AS (SELECT user_id, string_agg(DISTINCT upper(event_type), '+' ORDER BY upper(event_type)) AS half, avg(score) AS mean FROM e GROUP BY user_id)
    SELECT half, count(*) AS subjects, round(avg(mean), 4) AS mean FROM u GROUP BY half""",
)
def q_halves(spark, d):
    u = _events(spark, d).groupBy("user_id").agg(quality.half_label(F.collect_set("event_type")).alias("half"), F.avg("score").alias("mean"))
    return u.groupBy("half").agg(F.count("*").alias("subjects"), F.round(F.avg("mean"), 4).alias("mean"))


@BOOK.add(
    "q_change_events",
    f"""WITH b AS (SELECT *, nullif(CASE WHEN json_extract(props, '$.k')::INTEGER % 7 = 0 THEN '' ELSE event_type END, '') AS v FROM events),
    c AS (SELECT event_id, user_id, ts, v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
    SELECT event_id, user_id, v AS value, before FROM c WHERE before IS NOT NULL AND v <> before AND {_CUR}""",
)
def q_change_events(spark, d):
    e = _events(spark, d).withColumn("mark", F.when(F.col("k") % 7 == 0, "").otherwise(F.col("event_type")))
    out = quality.change_events(e, "mark", ("ts", "event_id"), ("user_id",), quality.in_period(F.col("ts"), _now(), 7))
    return out.select("event_id", "user_id", F.col("mark").alias("value"), "before")


@BOOK.add(
    "q_event_neighbourhood",
    f"""WITH {_E}, m AS (SELECT user_id, event_id AS mark_id, ts AS mark_ts FROM e WHERE event_type = 'error' AND k = 1)
    SELECT mark_id, round(avg(score) FILTER (ts < mark_ts), 9) AS before, round(avg(score) FILTER (ts >= mark_ts), 9) AS after, count(*) AS n
    FROM m JOIN e USING (user_id) WHERE ts >= mark_ts - INTERVAL 7 DAY AND ts < mark_ts + INTERVAL 7 DAY GROUP BY mark_id""",
)
def q_event_neighbourhood(spark, d):
    e = _events(spark, d)
    marks = e.filter("event_type = 'error' and k = 1").withColumn("mark_id", F.col("event_id"))
    return quality.around_events(marks, e, "ts", "score", ("user_id",), 7)


#: Six scores of an answer, spread from the event's value and bucket; some are missing.
_METRICS = {
    "faithfulness": ("((event_id * 7 + k) % 101) / 100.0", "k % 11 = 0"),
    "answer_relevancy": ("((event_id * 13 + k) % 101) / 100.0", "k % 13 = 0"),
    "context_precision": ("((event_id * 17 + k) % 101) / 100.0", "k % 17 = 0"),
    "context_relevance": ("((event_id * 19 + k) % 101) / 100.0", "k % 19 = 0"),
    "context_utilization": ("((event_id * 23 + k) % 101) / 100.0", "k % 23 = 0"),
    "coherence": ("((event_id * 29 + k) % 101) / 100.0", "k % 29 = 0"),
    "conciseness": ("((event_id * 31 + k) % 101) / 100.0", "k % 31 = 0"),
}
_M_SQL = f"""{_E}, m AS (SELECT event_id, event_type, user_id, ts, k, score, CASE WHEN event_id % 37 = 0 THEN 0 WHEN k % 41 = 0 THEN NULL ELSE 1 END AS safety,
    {", ".join(f"CASE WHEN {null} THEN NULL ELSE ({value})::DOUBLE END AS {name}" for name, (value, null) in _METRICS.items())} FROM e)"""


def _metrics(spark, d):
    e = _events(spark, d)
    cols = {name: F.expr(f"CASE WHEN {null} THEN NULL ELSE CAST({value} AS DOUBLE) END") for name, (value, null) in _METRICS.items()}
    return e.withColumns(cols | {"safety": F.expr("CASE WHEN event_id % 37 = 0 THEN 0 WHEN k % 41 = 0 THEN NULL ELSE 1 END")})


_FAILURE = """CASE WHEN safety < 1 THEN 'safety' WHEN context_relevance < 0.5 THEN 'wrong_sources' WHEN context_relevance >= 0.7 AND context_precision < 0.5 THEN 'buried'
    WHEN context_precision >= 0.7 AND context_utilization < 0.5 THEN 'ignored' WHEN faithfulness < 0.7 AND (context_relevance IS NULL OR context_relevance >= 0.5) THEN 'invented'
    WHEN answer_relevancy < 0.6 THEN 'off_question' END"""


@BOOK.add("q_failure_type", f"WITH {_M_SQL} SELECT event_id, {_FAILURE} AS failure FROM m")
def q_failure_type(spark, d):
    m = _metrics(spark, d)
    return m.select("event_id", quality.failure_type({n: F.col(n) for n in _METRICS}, F.col("safety")).alias("failure"))


@BOOK.add(
    "q_failure_counts",
    f"""WITH {_M_SQL}, f AS (SELECT {_FAILURE} AS failure FROM m), k(failure) AS (VALUES ('safety'), ('wrong_sources'), ('buried'), ('ignored'), ('invented'), ('off_question'), ('none of these'))
    SELECT k.failure, count(f.failure) AS n FROM k LEFT JOIN f USING (failure) GROUP BY k.failure""",
)
def q_failure_counts(spark, d):
    every = spark.createDataFrame([(f,) for f in (*quality.FAILURES, "none of these")], "failure string")
    return quality.counts_with_zeros(q_failure_type(spark, d), "failure", every)


_WSUM = " + ".join(f"coalesce({n} * {w}, 0)" for n, w in quality.WEIGHTS.items())
_WALL = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {w} END" for n, w in quality.WEIGHTS.items())


@BOOK.add("q_overall", f"WITH {_M_SQL}, w AS (SELECT event_id, safety, ({_WSUM})::DOUBLE / nullif(({_WALL})::DOUBLE, 0) AS mean FROM m) SELECT event_id, round(CASE WHEN safety < 1 THEN least(mean, 0.25) ELSE mean END, 9) AS overall FROM w")
def q_overall(spark, d):
    m = _metrics(spark, d)
    return m.select("event_id", quality.overall({n: F.col(n) for n in _METRICS}, F.col("safety"), 9).alias("overall"))


@BOOK.add("q_retrieval_index", f"WITH {_M_SQL} SELECT event_id, round(CASE WHEN context_relevance IS NULL THEN context_precision WHEN context_precision IS NULL THEN context_relevance ELSE (context_relevance + context_precision) / 2 END, 4) AS retrieval FROM m")
def q_retrieval_index(spark, d):
    return _metrics(spark, d).select("event_id", quality.mean_of_present(F.col("context_relevance"), F.col("context_precision")).alias("retrieval"))


@BOOK.add(
    "q_quadrant",
    f"""WITH {_M_SQL}, q AS (SELECT CASE WHEN context_precision >= 0.7 AND faithfulness >= 0.7 THEN 'both good' WHEN context_precision >= 0.7 AND faithfulness < 0.7 THEN 'answer strayed'
    WHEN context_precision < 0.7 AND faithfulness >= 0.7 THEN 'faithful to weak sources' WHEN context_precision < 0.7 AND faithfulness < 0.7 THEN 'both weak' END AS quadrant FROM m)
    SELECT quadrant, count(*) AS n FROM q WHERE quadrant IS NOT NULL GROUP BY quadrant""",
)
def q_quadrant(spark, d):
    q = _metrics(spark, d).withColumn("quadrant", quality.quadrant(F.col("context_precision"), F.col("faithfulness")))
    return q.filter("quadrant is not null").groupBy("quadrant").agg(F.count("*").alias("n"))


@BOOK.add(
    "q_segments",
    f"""WITH {_M_SQL}, s AS (SELECT CASE WHEN k % 53 = 0 THEN 'unscored' WHEN safety < 1 THEN 'unsafe' WHEN faithfulness < 0.7 THEN 'unfaithful' WHEN score < 0.7 THEN 'low' ELSE 'fine' END AS segment FROM m)
    SELECT segment, count(*) AS n FROM s GROUP BY segment""",
)
def q_segments(spark, d):
    m = _metrics(spark, d).withColumn("segment", quality.segment(F.col("score"), F.col("faithfulness"), F.col("safety"), F.col("k") % 53 != 0))
    return m.groupBy("segment").agg(F.count("*").alias("n"))


@BOOK.add("q_long_scores", f"WITH {_M_SQL} SELECT event_id, name, value FROM m UNPIVOT (value FOR name IN (faithfulness, answer_relevancy, context_precision)) WHERE value IS NOT NULL")
def q_long_scores(spark, d):
    from quillmesh.operators.catalog import long_scores

    return long_scores(_metrics(spark, d), "event_id", ["faithfulness", "answer_relevancy", "context_precision"])


@BOOK.add(
    "q_dropped_judges",
    f"WITH {_M_SQL} SELECT name, count(*) AS judged, count(*) FILTER (value IS NULL) AS dropped, round(count(*) FILTER (value IS NULL) / count(*), 4) AS rate FROM m UNPIVOT INCLUDE NULLS (value FOR name IN ({', '.join(_METRICS)})) GROUP BY name",
)
def q_dropped_judges(spark, d):
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in _METRICS))
    long = _metrics(spark, d).select(F.explode(pairs).alias("s")).select("s.name", "s.value")
    g = long.groupBy("name").agg(F.count("*").alias("judged"), F.count_if(F.col("value").isNull()).alias("dropped"))
    return g.withColumn("rate", F.round(F.col("dropped") / F.col("judged"), 4))


_JUDGE = "j AS (SELECT l.quality AS reviewer, CASE WHEN length(d.text) >= 200 THEN 1 ELSE 0 END AS judge FROM labels l JOIN documents d USING (doc_id))"


def _judged(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.when(F.length("text") >= 200, 1).otherwise(0).alias("judge"))
    return load(spark, d, "labels").select("doc_id", F.col("quality").alias("reviewer")).join(docs, "doc_id")


@BOOK.add("q_confusion", f"WITH {_JUDGE} SELECT reviewer, judge, count(*) AS n FROM j GROUP BY ALL")
def q_confusion(spark, d):
    return quality.confusion(_judged(spark, d), "reviewer", "judge")


@BOOK.add(
    "q_kappa",
    f"""WITH {_JUDGE}, t AS (SELECT count(*) AS n, count(*) FILTER (reviewer = judge) AS same, count(*) FILTER (reviewer = 1) AS r1, count(*) FILTER (judge = 1) AS j1 FROM j),
    p AS (SELECT n, same / n AS po, (r1::DOUBLE * j1 + (n - r1)::DOUBLE * (n - j1)) / (n::DOUBLE * n) AS pe FROM t)
    SELECT n, round(po, 6) AS agreement, CASE WHEN n >= 20 AND pe < 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM p""",
)
def q_kappa(spark, d):
    return quality.kappa(_judged(spark, d), "reviewer", "judge", 20)


@BOOK.add(
    "q_stability",
    f"""WITH {_E}, r AS (SELECT user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k2 FROM e),
    p AS (SELECT user_id, abs(max(score) FILTER (k2 = 1) - max(score) FILTER (k2 = 2)) AS change FROM r WHERE k2 <= 2 GROUP BY user_id HAVING count(*) = 2)
    SELECT count(*) AS rescored, round(quantile_cont(change, 0.5), 4) AS median_change, count(*) FILTER (change >= 0.15) AS moved FROM p""",
)
def q_stability(spark, d):
    return quality.stability(_events(spark, d), "user_id", "score", ("ts", "event_id"))


@BOOK.add(
    "q_noisy_docs",
    """WITH g AS (SELECT l_partkey AS part, count(*) AS retrieved, count(*) FILTER (l_linestatus = 'F') AS judged, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') AS useful FROM lineitem GROUP BY 1)
    SELECT part, retrieved, judged, useful, round(useful / nullif(judged, 0), 4) AS rate, coalesce(judged >= 5 AND useful / nullif(judged, 0) < 0.40, false) AS noisy FROM g""",
)
def q_noisy_docs(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), "l_returnflag", "l_linestatus")
    return quality.source_usefulness(li, "part", F.col("l_returnflag") == "A", F.col("l_linestatus") == "F")


@BOOK.add(
    "q_experiment_diff",
    f"""WITH {_E}, b AS (SELECT user_id, round(avg(score), 6) AS base FROM e WHERE ts < TIMESTAMP '2024-01-16' AND event_type = 'click' GROUP BY 1),
    c AS (SELECT user_id, round(avg(score), 6) AS candidate FROM e WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'click' GROUP BY 1),
    j AS (SELECT *, round(candidate - base, 4) AS delta FROM b FULL JOIN c USING (user_id))
    SELECT *, CASE WHEN base IS NULL OR candidate IS NULL THEN 'missing' WHEN delta <= -0.05 THEN 'regressed' WHEN delta >= 0.05 THEN 'improved' ELSE 'unchanged' END AS verdict FROM j""",
)
def q_experiment_diff(spark, d):
    e = _events(spark, d).filter("event_type = 'click'")
    cut = F.lit("2024-01-16").cast("timestamp")
    mean = lambda x: x.groupBy("user_id").agg(F.round(F.avg("score"), 6).alias("score"))
    return quality.compare_runs(mean(e.filter(F.col("ts") < cut)), mean(e.filter(F.col("ts") >= cut)), "user_id", "score")


@BOOK.add(
    "q_weekly_sample",
    """WITH s AS (SELECT event_id, (isoyear(ts)::VARCHAR || '-' || lpad(week(ts)::VARCHAR, 2, '0')) AS wk, sha256(isoyear(ts)::VARCHAR || '-' || lpad(week(ts)::VARCHAR, 2, '0') || ':' || event_id::VARCHAR) AS draw FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY wk ORDER BY draw, event_id)::INTEGER AS place FROM s) SELECT event_id, draw, place FROM r WHERE place <= 20""",
)
def q_weekly_sample(spark, d):
    return quality.weekly_sample(load(spark, d, "events"), "event_id", "ts", 20).select("event_id", "draw", "place")


@BOOK.add(
    "q_subjects",
    f"""WITH {_M_SQL}, f AS (SELECT user_id, score, {_FAILURE} AS failure FROM m), c AS (SELECT user_id, failure, count(*) AS c FROM f WHERE failure IS NOT NULL GROUP BY ALL),
    t AS (SELECT user_id, failure, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, failure) AS k2 FROM c), g AS (SELECT user_id, count(*) AS n, round(avg(score), 4) AS mean FROM f GROUP BY user_id)
    SELECT g.user_id, n, mean, t.failure AS commonest FROM g LEFT JOIN t ON g.user_id = t.user_id AND k2 = 1""",
)
def q_subjects(spark, d):
    """Each subject's mean score and commonest failure."""
    m = _metrics(spark, d).withColumn("failure", quality.failure_type({n: F.col(n) for n in _METRICS}, F.col("safety")))
    g = m.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))
    c = m.filter("failure is not null").groupBy("user_id", "failure").agg(F.count("*").alias("c"))
    top = c.groupBy("user_id").agg(F.min_by("failure", F.struct(-F.col("c"), F.col("failure"))).alias("commonest"))
    return g.join(top, "user_id", "left")


@BOOK.add(
    "q_attention",
    f"""WITH {_E}, u AS (SELECT user_id, count(*) AS n, round(avg(score), 4) AS mean FROM e GROUP BY 1)
    SELECT 'subject ' || user_id AS kind, CASE WHEN mean < 0.4 THEN 'bad' ELSE 'watch' END AS severity, n AS weight FROM u WHERE mean < 0.45 ORDER BY CASE WHEN mean < 0.4 THEN 0 ELSE 1 END, n DESC, kind LIMIT 5""",
)
def q_attention(spark, d):
    u = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean")).filter("mean < 0.45")
    found = u.select(F.concat(F.lit("subject "), F.col("user_id").cast("string")).alias("kind"), F.when(F.col("mean") < 0.4, "bad").otherwise("watch").alias("severity"), F.col("n").alias("weight"))
    return quality.attention(found, 5)


def _dash(name: str, sql: str):
    return BOOK.add(f"q_dash_{name}", f"WITH {_M_SQL} {sql}")


@_dash("avg_by_metric", "SELECT name, round(avg(value), 6) AS mean FROM m UNPIVOT (value FOR name IN (faithfulness, answer_relevancy, context_precision, context_relevance, context_utilization, coherence, conciseness)) GROUP BY name")
def q_dash_avg_by_metric(spark, d):
    from quillmesh.operators.catalog import long_scores

    return long_scores(_metrics(spark, d), "event_id", list(_METRICS)).groupBy("name").agg(F.round(F.avg("value"), 6).alias("mean"))


@_dash("quality_over_time", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(score), 6) AS mean FROM m GROUP BY 1")
def q_dash_quality_over_time(spark, d):
    return _metrics(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("score"), 6).alias("mean"))


@_dash("faithfulness_over_time", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(faithfulness), 6) AS mean FROM m GROUP BY 1")
def q_dash_faithfulness_over_time(spark, d):
    return _metrics(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("faithfulness"), 6).alias("mean"))


@_dash("distribution", "SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n FROM m GROUP BY 1")
def q_dash_distribution(spark, d):
    return quality.histogram(_metrics(spark, d), "score")


@_dash("retrieval_over_time", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(context_precision), 6) AS precision_mean, round(avg(context_relevance), 6) AS relevance_mean FROM m GROUP BY 1")
def q_dash_retrieval_over_time(spark, d):
    g = _metrics(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return g.agg(F.round(F.avg("context_precision"), 6).alias("precision_mean"), F.round(F.avg("context_relevance"), 6).alias("relevance_mean"))


@_dash("avg_by_mode", "SELECT event_type AS mode, round(avg(score), 6) AS mean FROM m GROUP BY 1")
def q_dash_avg_by_mode(spark, d):
    return _metrics(spark, d).groupBy(F.col("event_type").alias("mode")).agg(F.round(F.avg("score"), 6).alias("mean"))


@_dash("scored", "SELECT count(score) AS scored FROM m")
def q_dash_scored(spark, d):
    return _metrics(spark, d).agg(F.count("score").alias("scored"))


@_dash("below_line", "SELECT count(*) FILTER (score < 0.7) AS below FROM m")
def q_dash_below_line(spark, d):
    return _metrics(spark, d).agg(F.count_if(F.col("score") < 0.7).alias("below"))


@_dash("unsafe", "SELECT count(*) FILTER (safety < 1) AS unsafe FROM m")
def q_dash_unsafe(spark, d):
    return _metrics(spark, d).agg(F.count_if(F.col("safety") < 1).alias("unsafe"))


@_dash("safety_by_judge", "SELECT event_type AS judge, sum(1 - safety)::BIGINT AS flags FROM m GROUP BY 1")
def q_dash_safety_by_judge(spark, d):
    return _metrics(spark, d).groupBy(F.col("event_type").alias("judge")).agg(F.sum(1 - F.col("safety")).cast("long").alias("flags"))


@BOOK.add("q_answers_table", f"WITH {_M_SQL} SELECT event_id, user_id, faithfulness FROM m WHERE event_type ILIKE '%URCH%' AND k >= 90 ORDER BY coalesce(faithfulness, -1), event_id LIMIT 200")
def q_answers_table(spark, d):
    """Search, filter, and a sort that puts missing values first."""
    m = _metrics(spark, d).filter(F.col("event_type").ilike("%URCH%") & (F.col("k") >= 90))
    return m.orderBy(F.coalesce("faithfulness", F.lit(-1.0)), "event_id").limit(200).select("event_id", "user_id", "faithfulness")
