"""Fit/gap registers, alignment scores and dashboards over orders and lines.

A line is a deviation: its part's brand gives the dimension, its quantity the
materiality, its flags the disposition and the localization state. A customer is
a country.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions.scalar import clock, code_level, code_parent, code_sort_key
from quillmesh.operators import registers
from quillmesh.plans.book import Book
from quillmesh.sources.tables import load

BOOK = Book()

_STATE = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'CONFIRMED_STATUTORY' WHEN 'RO' THEN 'SAP_DELIVERED' WHEN 'NO' THEN 'SUSPECTED' ELSE 'NONE' END"
_DISPO = "CASE CAST(l_linenumber AS INT) % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(registers.HARMONIZATION_BASE)) + " END"
_MAT = "CAST(greatest(1, least(5, ceil(l_quantity / 10))) AS INT)"
_FIT = "CAST(l_partkey % 5 AS INT)"
_DIM = "CAST(l_partkey % 8 AS INT)"
_WEIGHTS = {0: 0.20, 1: 0.15, 2: 0.15, 3: 0.10, 4: 0.10, 5: 0.10, 6: 0.10, 7: 0.10}
_D = f"""d AS (SELECT l_orderkey * 10 + l_linenumber AS gap, o_custkey AS country, {_DIM} AS dimension, {_MAT} AS materiality, {_FIT} AS fit, {_STATE} AS state, {_DISPO} AS disposition
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_H = f"""h AS (SELECT *, greatest(0, least(100, least({" ".join(["CASE disposition", *(f"WHEN '{k}' THEN {v}" for k, v in registers.HARMONIZATION_BASE.items()), "END"])} + 5 * (fit - 2),
  CASE state WHEN 'CONFIRMED_STATUTORY' THEN 15 WHEN 'SAP_DELIVERED' THEN 25 WHEN 'SUSPECTED' THEN 50 ELSE 1000 END)))::INTEGER AS harmonization FROM d)"""


def deviations(spark, d):
    li = load(spark, d, "lineitem").join(load(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gap"), F.col("o_custkey").alias("country"), F.expr(_DIM).alias("dimension"), F.expr(_MAT).alias("materiality"),
        F.expr(_FIT).alias("fit"), F.expr(_STATE).alias("state"), F.expr(_DISPO).alias("disposition"),
    )


def _harmonized(spark, d):
    return deviations(spark, d).withColumn("harmonization", registers.harmonization(F.col("disposition"), F.col("fit"), F.col("state")))


@BOOK.add("harmonization", f"WITH {_D}, {_H} SELECT gap, harmonization FROM h")
def harmonization(spark, d):
    return _harmonized(spark, d).select("gap", "harmonization")


@BOOK.add("harmonization_average", f"WITH {_D}, {_H} SELECT country, round(sum(harmonization * materiality) / sum(materiality), 1) AS average FROM h GROUP BY 1")
def harmonization_average(spark, d):
    return registers.weighted_average(_harmonized(spark, d), ["country"], F.col("harmonization"), F.col("materiality"))


@BOOK.add("harmonization_bands", f"WITH {_D}, {_H} SELECT CASE WHEN harmonization >= 80 THEN 0 WHEN harmonization >= 60 THEN 1 WHEN harmonization >= 40 THEN 2 WHEN harmonization >= 20 THEN 3 ELSE 4 END AS band, count(*) AS n FROM h GROUP BY 1")
def harmonization_bands(spark, d):
    return _harmonized(spark, d).groupBy(registers.band(F.col("harmonization"), registers.HARMONIZATION_BANDS).alias("band")).agg(F.count("*").alias("n"))


_RATED = f"r AS (SELECT country, dimension, CASE WHEN min(fit) = 0 THEN NULL ELSE min(fit) END AS rating FROM d GROUP BY ALL), w(dimension, weight) AS (VALUES {', '.join(f'({k}, {v})' for k, v in _WEIGHTS.items())})"


def _weights(spark):
    return spark.createDataFrame([(k, float(v)) for k, v in _WEIGHTS.items()], "dimension int, weight double")


@BOOK.add("alignment_score", f"WITH {_D}, {_RATED} SELECT country, round(round(sum(rating / 4 * 100 * weight::DOUBLE) FILTER (rating IS NOT NULL) / nullif(sum(weight::DOUBLE) FILTER (rating IS NOT NULL), 0), 6), 1) AS score FROM r JOIN w USING (dimension) GROUP BY 1")
def alignment_score(spark, d):
    r = deviations(spark, d).groupBy("country", "dimension").agg(F.nullif(F.min("fit"), F.lit(0)).alias("rating"))
    return registers.alignment(r, _weights(spark), ["country"])


@BOOK.add("weighted_mean_renorm", f"WITH {_D}, {_RATED} SELECT country, round(sum(rating * weight::DOUBLE) FILTER (rating IS NOT NULL) / nullif(sum(weight::DOUBLE) FILTER (rating IS NOT NULL), 0), 6) AS mean FROM r JOIN w USING (dimension) GROUP BY 1")
def weighted_mean_renorm(spark, d):
    r = deviations(spark, d).groupBy("country", "dimension").agg(F.nullif(F.min("fit"), F.lit(0)).alias("rating")).join(F.broadcast(_weights(spark)), "dimension")
    some = F.col("rating").isNotNull()
    return r.groupBy("country").agg(F.round(F.try_divide(F.sum(F.when(some, F.col("rating") * F.col("weight"))), F.sum(F.when(some, F.col("weight")))), 6).alias("mean"))


@BOOK.add("localization_share", f"WITH {_D} SELECT country, round(coalesce(sum(CASE WHEN state IN ('CONFIRMED_STATUTORY', 'SAP_DELIVERED') THEN materiality ELSE 0 END) / sum(materiality), 0), 4) AS share FROM d GROUP BY 1")
def localization_share(spark, d):
    return registers.localization_share(deviations(spark, d), ["country"], F.col("materiality"), F.col("state"))


@BOOK.add(
    "heatmap",
    f"""WITH {_D}, k AS (SELECT unnest(range(10))::INTEGER AS dimension), g AS (SELECT dimension, count(*) AS n, count(*) FILTER (state IN ('CONFIRMED_STATUTORY', 'SAP_DELIVERED')) AS must, max(materiality) AS worst,
    array_to_string(list_sort(list(gap))[1:5], ',') AS first_ids FROM d GROUP BY 1) SELECT k.dimension, coalesce(n, 0) AS n, coalesce(must, 0) AS must, worst, coalesce(first_ids, '') AS first_ids FROM k LEFT JOIN g USING (dimension)""",
)
def heatmap(spark, d):
    dims = spark.range(10).select(F.col("id").cast("int").alias("dimension"))
    return registers.heatmap(deviations(spark, d), dims, "dimension", "materiality", F.col("state"), "gap")


@BOOK.add(
    "risk_grid",
    f"""WITH {_D}, {_H}, b AS (SELECT materiality, CASE WHEN harmonization >= 80 THEN 0 WHEN harmonization >= 60 THEN 1 WHEN harmonization >= 40 THEN 2 WHEN harmonization >= 20 THEN 3 ELSE 4 END AS band FROM h)
    SELECT materiality, {", ".join(f"nullif(count(*) FILTER (band = {i}), 0) AS b{i}" for i in range(5))} FROM b GROUP BY 1""",
)
def risk_grid(spark, d):
    h = _harmonized(spark, d)
    g = registers.risk_grid(h, "materiality", registers.band(F.col("harmonization"), registers.HARMONIZATION_BANDS), range(5))
    return g.select("materiality", *(F.col(str(i)).alias(f"b{i}") for i in range(5)))


@BOOK.add(
    "agenda_clock",
    f"""WITH {_D}, a AS (SELECT *, (10 + 5 * materiality) AS minutes, CASE state WHEN 'CONFIRMED_STATUTORY' THEN 0 WHEN 'SAP_DELIVERED' THEN 1 WHEN 'SUSPECTED' THEN 2 ELSE 3 END AS cls FROM d),
    w AS (SELECT gap, country, minutes, row_number() OVER (PARTITION BY country ORDER BY cls, materiality DESC, gap)::INTEGER AS position, (sum(minutes) OVER (PARTITION BY country ORDER BY cls, materiality DESC, gap ROWS UNBOUNDED PRECEDING))::BIGINT AS end_minute FROM a)
    SELECT gap, position, end_minute - minutes AS start_minute, (end_minute // 60) || ':' || lpad((end_minute % 60)::VARCHAR, 2, '0') AS ends FROM w""",
)
def agenda_clock(spark, d):
    cls = F.when(F.col("state") == "CONFIRMED_STATUTORY", 0).when(F.col("state") == "SAP_DELIVERED", 1).when(F.col("state") == "SUSPECTED", 2).otherwise(3)
    rows = deviations(spark, d).withColumn("minutes", 10 + 5 * F.col("materiality"))
    a = registers.agenda(rows, ["country"], [cls, F.desc("materiality"), F.col("gap")], "minutes")
    return a.select("gap", "position", "start_minute", clock(F.col("end_minute")).alias("ends"))


@BOOK.add("register_ranking", f"WITH {_D} SELECT gap, row_number() OVER (PARTITION BY country ORDER BY materiality DESC, fit, gap)::INTEGER AS position FROM d")
def register_ranking(spark, d):
    rows = deviations(spark, d).withColumn("group", F.col("country"))
    return registers.gap_register(rows, F.col("materiality"), "fit", "gap").select("gap", "position")


@BOOK.add("materiality_counts", f"WITH {_D} SELECT country, {', '.join(f'count(*) FILTER (materiality = {i}) AS m{i}' for i in range(1, 6))} FROM d GROUP BY 1")
def materiality_counts(spark, d):
    return deviations(spark, d).groupBy("country").agg(*(F.count_if(F.col("materiality") == i).alias(f"m{i}") for i in range(1, 6)))


_CODE = "((l_partkey % 9 + 1) || '.' || (l_suppkey % 12 + 1) || '.' || (l_partkey % 4 + 1) || '.' || l_linenumber)"
_CLASS = "CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'FIT' WHEN 1 THEN 'CONFIG' WHEN 2 THEN 'GAP' WHEN 3 THEN 'EXTENSION' ELSE 'UNKNOWN' END"
_S = f"s AS (SELECT {_CODE} AS code, {_CLASS} AS class, l_suppkey, l_orderkey, l_discount, l_quantity, l_linenumber, l_shipdate, l_partkey FROM lineitem)"


def _steps(spark, d):
    li = load(spark, d, "lineitem")
    code = F.concat_ws(".", *(c.cast("string") for c in (F.col("l_partkey") % 9 + 1, F.col("l_suppkey") % 12 + 1, F.col("l_partkey") % 4 + 1, F.col("l_linenumber"))))
    return li.withColumns({"code": code, "class": F.expr(_CLASS)})


@BOOK.add(
    "reuse_rollup",
    f"""WITH {_S}, g AS (SELECT coalesce(array_to_string(string_split(code, '.')[1:3], '.'), 'ALL') AS l3, class FROM s), r AS (SELECT l3, count(*) AS steps, count(*) FILTER (class <> 'UNKNOWN') AS known, count(*) FILTER (class IN ('FIT', 'CONFIG')) AS reused FROM g GROUP BY 1
      UNION ALL SELECT 'ALL', count(*), count(*) FILTER (class <> 'UNKNOWN'), count(*) FILTER (class IN ('FIT', 'CONFIG')) FROM g)
    SELECT l3, steps, known, reused, round(known * 100 / steps, 1) AS coverage, round(reused * 100 / nullif(known, 0), 1) AS reuse FROM r""",
)
def reuse_rollup(spark, d):
    return registers.reuse(_steps(spark, d), "code", "class", ["FIT", "CONFIG"])


@BOOK.add(
    "decision_pack",
    f"""WITH {_S}, q AS (SELECT array_to_string(string_split(code, '.')[1:3], '.') AS l3, left(trim(regexp_replace(lower('Adopt: ' || class || '?'), '[^a-z0-9]+', ' ', 'g')), 120) AS key, ['keep', lower(class)] AS options, l_discount FROM s)
    SELECT l3, key, count(*) AS asked, round(sum(l_discount), 4) AS weight, array_to_string(list_sort(list_distinct(flatten(list(options)))), ',') AS options FROM q GROUP BY ALL""",
)
def decision_pack(spark, d):
    s = _steps(spark, d).withColumns({"question": F.concat(F.lit("Adopt: "), F.col("class"), F.lit("?")), "options": F.array(F.lit("keep"), F.lower("class"))})
    return registers.decision_pack(s, "code", "question", "options", "l_discount").withColumn("options", F.array_join("options", ","))


@BOOK.add(
    "integration_impacts",
    f"""WITH {_S}, a AS (SELECT l_suppkey AS system, count(DISTINCT code) AS steps, array_to_string(list_sort(list(DISTINCT 'I' || l_linenumber)), ',') AS interfaces FROM s GROUP BY 1),
    i AS (SELECT l_suppkey AS system, string_agg(class || '=' || n, ',' ORDER BY class) AS impacts FROM (SELECT l_suppkey, class, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1) SELECT * FROM a JOIN i USING (system)""",
)
def integration_impacts(spark, d):
    s = _steps(spark, d).select(F.col("l_suppkey").alias("system"), F.col("class").alias("impact"), "code", F.concat(F.lit("I"), F.col("l_linenumber").cast("string")).alias("interface"))
    out = registers.integration_impacts(s, "system", "impact", "code", "interface")
    told = F.array_join(F.transform(F.map_entries("impacts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("system", "steps", F.array_join("interfaces", ",").alias("interfaces"), told.alias("impacts"))


@BOOK.add("session_weight", f"WITH {_D} SELECT country, round(sum(materiality * (1 - fit / 4.0::DOUBLE)), 4) AS weight FROM d GROUP BY 1")
def session_weight(spark, d):
    return deviations(spark, d).groupBy("country").agg(F.round(F.sum(F.col("materiality") * (1 - F.col("fit") / 4.0)), 4).alias("weight"))


@BOOK.add("role_load", f"WITH {_D} SELECT 'owner' || (gap % 7) AS owner, count(*) AS gaps, sum(10 + 5 * materiality)::BIGINT AS minutes FROM d GROUP BY 1")
def role_load(spark, d):
    return deviations(spark, d).groupBy(F.concat(F.lit("owner"), (F.col("gap") % 7).cast("string")).alias("owner")).agg(F.count("*").alias("gaps"), F.sum(10 + 5 * F.col("materiality")).cast("long").alias("minutes"))


@BOOK.add(
    "area_impact",
    f"""WITH {_D}, x AS (SELECT unnest(['area' || (gap % 3), 'area' || (3 + gap % 4)]) AS area, materiality, gap FROM d)
    SELECT area, count(*) AS n, max(materiality) AS peak, array_to_string((list(gap ORDER BY materiality DESC, gap))[1:10], ',') AS ranked FROM x GROUP BY 1""",
)
def area_impact(spark, d):
    x = deviations(spark, d).withColumn("area", F.explode(F.array(F.concat(F.lit("area"), (F.col("gap") % 3).cast("string")), F.concat(F.lit("area"), (3 + F.col("gap") % 4).cast("string")))))
    g = x.groupBy("area").agg(F.count("*").alias("n"), F.max("materiality").alias("peak"))
    return g.join(registers.leading(x, "area", [F.desc("materiality"), F.col("gap")], "gap", 10, "ranked"), "area")


@BOOK.add("outlook_levels", f"WITH {_D}, {_H} SELECT CASE WHEN state IN ('CONFIRMED_STATUTORY') THEN 'law' WHEN state = 'SAP_DELIVERED' THEN 'local' WHEN harmonization >= 80 THEN 'will' WHEN harmonization >= 60 THEN 'can' ELSE 'decide' END AS outlook, count(*) AS n FROM h GROUP BY 1")
def outlook_levels(spark, d):
    h = _harmonized(spark, d)
    o = F.when(F.col("state") == "CONFIRMED_STATUTORY", "law").when(F.col("state") == "SAP_DELIVERED", "local").when(F.col("harmonization") >= 80, "will").when(F.col("harmonization") >= 60, "can").otherwise("decide")
    return h.groupBy(o.alias("outlook")).agg(F.count("*").alias("n"))


@BOOK.add("gate_summary", f"WITH {_D} SELECT gate, severity, count(*) AS n FROM (SELECT unnest([CASE WHEN fit <= 1 AND materiality >= 4 THEN 'QG1:block' END, CASE WHEN state = 'SUSPECTED' AND disposition = 'USE_SAP_LOCALIZATION' THEN 'QG2:warn' END, CASE WHEN disposition = 'EXTEND_STANDARD' AND fit >= 3 THEN 'QG4:warn' END]) AS g, split_part(g, ':', 1) AS gate, split_part(g, ':', 2) AS severity FROM d) WHERE g IS NOT NULL GROUP BY ALL")
def gate_summary(spark, d):
    """Issues by gate and severity, from rules over each deviation."""
    rule = lambda gate, severity, when: F.when(when, F.struct(F.lit(gate).alias("gate"), F.lit(severity).alias("severity")))
    found = F.array(
        rule("QG1", "block", (F.col("fit") <= 1) & (F.col("materiality") >= 4)),
        rule("QG2", "warn", (F.col("state") == "SUSPECTED") & (F.col("disposition") == "USE_SAP_LOCALIZATION")),
        rule("QG4", "warn", (F.col("disposition") == "EXTEND_STANDARD") & (F.col("fit") >= 3)),
    )
    return deviations(spark, d).select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).groupBy("i.gate", "i.severity").agg(F.count("*").alias("n"))


@BOOK.add("unmapped_steps", f"WITH {_S} SELECT DISTINCT code FROM s WHERE code NOT IN (SELECT code FROM s WHERE class IN ('FIT', 'CONFIG'))")
def unmapped_steps(spark, d):
    s = _steps(spark, d).select("code", "class")
    return s.select("code").distinct().join(s.filter(F.col("class").isin("FIT", "CONFIG")).select("code"), "code", "left_anti")


@BOOK.add("code_order", f"WITH {_S}, c AS (SELECT DISTINCT code FROM s) SELECT code, row_number() OVER (ORDER BY list_transform(string_split(code, '.'), lambda x: x::INTEGER))::INTEGER AS position FROM c")
def code_order(spark, d):
    """Numeric order of dotted codes, ranked within the value chain and offset by
    what lies before it, so that no single task sorts all codes."""
    c = _steps(spark, d).select("code").distinct().withColumn("k", code_sort_key(F.col("code"))).withColumn("chain", F.col("k")[0])
    sizes = c.groupBy("chain").agg(F.count("*").alias("n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.chain") < F.col("x.chain"), "left").groupBy("x.chain").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("chain").orderBy("k"))
    return c.join(F.broadcast(before), "chain").select("code", (at + F.col("before")).cast("int").alias("position"))


@BOOK.add("code_hierarchy", f"WITH {_S}, c AS (SELECT DISTINCT code FROM s) SELECT code, 4 AS level, array_to_string(string_split(code, '.')[1:3], '.') AS parent FROM c")
def code_hierarchy(spark, d):
    return _steps(spark, d).select("code").distinct().select("code", code_level(F.col("code")).alias("level"), code_parent(F.col("code")).alias("parent"))


@BOOK.add("rubric_confidence", f"WITH {_S} SELECT l_orderkey, round(min(CASE WHEN l_quantity > 25 THEN 0.9 - l_discount END), 4) AS confidence FROM s GROUP BY 1")
def rubric_confidence(spark, d):
    from quillmesh.operators.evidence import least_confidence

    li = load(spark, d, "lineitem").withColumn("score", F.lit(0.9) - F.col("l_discount"))
    return least_confidence(li, ["l_orderkey"], "score", F.col("l_quantity") > 25)


@BOOK.add("noisy_rates", "SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_acctbal < 0) AS bad, round(count(*) FILTER (s_acctbal < 0) / count(*), 4) AS rate FROM supplier GROUP BY 1 HAVING count(*) > 0")
def noisy_rates(spark, d):
    g = load(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") < 0).alias("bad"))
    return g.withColumn("rate", F.round(F.col("bad") / F.col("n"), 4))
