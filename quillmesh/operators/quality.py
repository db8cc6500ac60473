"""Answer-quality analytics: scores, failure rules, tiles, series, agreement.

Null means "not assessable" everywhere: it is skipped, never counted as zero,
and an aggregate over nothing is null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.scalar import iso_week

# The weights of the overall score and the cap of a flagged answer.
WEIGHTS = {
    "faithfulness": 0.30,
    "answer_relevancy": 0.20,
    "context_precision": 0.15,
    "context_relevance": 0.10,
    "context_utilization": 0.10,
    "coherence": 0.10,
    "conciseness": 0.05,
}
SAFETY_CAP = 0.25
NOISE = 0.05  #: moves within this count as unchanged
FAILURES = ("safety", "wrong_sources", "buried", "ignored", "invented", "off_question")


def weighted_mean(values: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weights of missing values are shared by the others; all missing gives null."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        v = values[name]
        total = total + F.coalesce(v * w, F.lit(0.0))
        weight = weight + F.when(v.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def overall(values: Mapping[str, Column], safety: Column, digits: int = 4) -> Column:
    """The weighted mean, capped (never raised) where safety is flagged."""
    mean = weighted_mean(values, WEIGHTS)
    return F.round(F.when(safety < 1, F.least(mean, F.lit(SAFETY_CAP))).otherwise(mean), digits)


def failure_type(v: Mapping[str, Column], safety: Column) -> Column:
    """The first rule that applies; a rule whose inputs are missing is passed over."""
    rel, prec, util, faith, ans = (v[k] for k in ("context_relevance", "context_precision", "context_utilization", "faithfulness", "answer_relevancy"))
    return (
        F.when(safety < 1, "safety")
        .when(rel < 0.5, "wrong_sources")
        .when((rel >= 0.7) & (prec < 0.5), "buried")
        .when((prec >= 0.7) & (util < 0.5), "ignored")
        .when((faith < 0.7) & (rel.isNull() | (rel >= 0.5)), "invented")
        .when(ans < 0.6, "off_question")
    )


def mean_of_present(*columns: Column) -> Column:
    values = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values), 4))


def half_label(categories: Column) -> Column:
    """The distinct categories of an answer's excerpts, joined in order."""
    cats = F.array_sort(F.array_distinct(F.filter(F.transform(categories, F.upper), lambda c: c != "")))
    return F.when(F.coalesce(F.size(cats), F.lit(0)) <= 0, "—").when(cats == F.array(F.lit("DR"), F.lit("PKG")), "PKG+DR").otherwise(F.array_join(cats, "+"))


def in_period(ts: Column, now: Column, days: int, offset: int = 0) -> Column:
    """Half open: after (now - days x (offset + 1)), up to and with (now - days x offset)."""
    start = now - F.make_interval(days=F.lit(days * (offset + 1)))
    end = now - F.make_interval(days=F.lit(days * offset))
    return (ts > start) & (ts <= end)


def tiles(rows: DataFrame, value: str, ts: str, now: Column, days: int, line: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Value, previous value, change, number below the line, and n."""
    cur, prev = in_period(F.col(ts), now, days), in_period(F.col(ts), now, days, 1)
    v = F.col(value)
    agg = rows.groupBy(*by).agg(
        F.round(F.avg(F.when(cur, v)), 4).alias("value"),
        F.round(F.avg(F.when(prev, v)), 4).alias("previous"),
        F.count_if(cur & (v < line)).alias("below"),
        F.count(F.when(cur, v)).alias("n"),
    )
    return agg.withColumn("delta", F.round(F.col("value") - F.col("previous"), 4))


def series(rows: DataFrame, value: str, ts: str, unit: str = "WEEK") -> DataFrame:
    v = F.col(value)
    return rows.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(
        F.count(v).alias("n"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(v, F.lit(0.1)), 6).alias("p10"),
        F.round(F.percentile(v, F.lit(0.9)), 6).alias("p90"), F.round(F.avg(v), 6).alias("mean"),
    )


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal bins over [0, 1]; the last one is closed."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def change_events(rows: DataFrame, value: str, order: tuple[str, ...], by: tuple[str, ...], inside: Column) -> DataFrame:
    """Rows whose value differs from the last non-empty one before. State is
    carried from outside the period; empty values neither change nor reset it."""
    kept = rows.withColumn("_v", F.nullif(F.col(value), F.lit("")))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("_v") != F.col("before")) & inside).drop("_v")


def source_usefulness(cited: DataFrame, source: str, useful: Column, judged: Column, least: int = 5, noisy_below: float = 0.40) -> DataFrame:
    """How often a source was retrieved, judged and useful; noisy if judged often and rarely useful."""
    g = cited.groupBy(source).agg(F.count("*").alias("retrieved"), F.count_if(judged).alias("judged"), F.count_if(judged & useful).alias("useful"))
    g = g.withColumn("rate", F.round(F.try_divide(F.col("useful").cast("double"), F.col("judged").cast("double")), 4))
    return g.withColumn("noisy", F.coalesce((F.col("judged") >= least) & (F.col("rate") < noisy_below), F.lit(False)))


def counts_with_zeros(rows: DataFrame, key: str, every: DataFrame) -> DataFrame:
    """Counts per key of ``every``, zero where it does not occur."""
    return every.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def kappa(rows: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    """Cohen's kappa from a confusion table; null where chance agreement is certain
    or fewer than ``least`` pairs exist."""
    c = confusion(rows, a, b)
    left, right = c.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("x")), c.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "k").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    agree = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    both = agree.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("xy", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return both.select("n", F.round(po, 6).alias("agreement"), F.when((F.col("n") >= least) & (pe < 1), F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def stability(rows: DataFrame, key: str, value: str, order: tuple[str, ...], moved: float = 0.15) -> DataFrame:
    """Last two values per key, their absolute change; median and the number that moved."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    last = rows.filter(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    per = last.groupBy(key).agg(F.count("*").alias("c"), F.abs(F.max(F.when(F.col("_r") == 1, F.col(value))) - F.max(F.when(F.col("_r") == 2, F.col(value)))).alias("change")).filter("c = 2")
    return per.agg(F.count("*").alias("rescored"), F.round(F.percentile("change", F.lit(0.5)), 4).alias("median_change"), F.count_if(F.col("change") >= moved).alias("moved"))


def compare_runs(base: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """Items of two runs, missing ones reported, with a verdict outside the noise band."""
    b = base.select(key, F.col(value).alias("base"))
    c = candidate.select(key, F.col(value).alias("candidate"))
    both = b.join(c, key, "full_outer").withColumn("delta", F.round(F.col("candidate") - F.col("base"), 4))
    verdict = F.when(F.col("base").isNull() | F.col("candidate").isNull(), "missing").when(F.col("delta") <= -NOISE, "regressed").when(F.col("delta") >= NOISE, "improved").otherwise("unchanged")
    return both.withColumn("verdict", verdict)


def bucket(faithfulness: Column) -> Column:
    return F.when(faithfulness >= 0.8, "grounded").when(faithfulness >= 0.5, "partly").when(faithfulness.isNotNull(), "not")


def weekly_sample(rows: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """The same n rows of a week whenever it is drawn: by hash of week and key."""
    draw = F.sha2(F.concat(iso_week(F.col(ts)), F.lit(":"), F.col(key).cast("string")), 256)
    week = Window.partitionBy(iso_week(F.col(ts))).orderBy("draw", key)
    return rows.withColumn("draw", draw).withColumn("place", F.row_number().over(week)).filter(F.col("place") <= n)


def around_events(marks: DataFrame, rows: DataFrame, ts: str, value: str, by: tuple[str, ...], days: int = 7) -> DataFrame:
    """Mean value in the days before and after each mark of the same group."""
    m = marks.select(*by, F.col("mark_id"), F.col(ts).alias("at"))
    span = F.make_interval(days=F.lit(days))
    near = m.join(rows.select(*by, F.col(ts).alias("t"), F.col(value).alias("v")), list(by)).filter((F.col("t") >= F.col("at") - span) & (F.col("t") < F.col("at") + span))
    return near.groupBy("mark_id").agg(F.round(F.avg(F.when(F.col("t") < F.col("at"), F.col("v"))), 9).alias("before"), F.round(F.avg(F.when(F.col("t") >= F.col("at"), F.col("v"))), 9).alias("after"), F.count("*").alias("n"))


def quadrant(x: Column, y: Column, line: float = 0.7) -> Column:
    """Retrieval against faithfulness; rows that lack either have no quadrant."""
    return (
        F.when((x >= line) & (y >= line), "both good").when((x >= line) & (y < line), "answer strayed")
        .when((x < line) & (y >= line), "faithful to weak sources").when((x < line) & (y < line), "both weak")
    )


def segment(overall_: Column, faithful: Column, safety: Column, scored: Column) -> Column:
    return F.when(~scored, "unscored").when(safety < 1, "unsafe").when(faithful < 0.7, "unfaithful").when(overall_ < 0.7, "low").otherwise("fine")


def attention(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Findings (kind, severity, weight): bad first, heaviest first."""
    return rows.orderBy(F.when(F.col("severity") == "bad", 0).otherwise(1), F.desc("weight"), "kind").limit(limit)
