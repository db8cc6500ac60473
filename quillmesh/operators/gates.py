"""Quality gates with repair: rules that find what is wrong with a row and mend it.

A rule has a condition and repairs; rules run in order, each on the row as those
before left it, again and again until the row stays as it is. What each rule found
becomes issue rows. Everything is a projection of rows; tables meet by equi-joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.scalar import step_refs
from quillmesh.operators.graph import settled


@dataclass(frozen=True)
class Rule:
    gate: str
    severity: str  # hard: the finding cannot stand as it was; soft: to be read
    name: str
    when: Column
    repairs: Mapping[str, Column] = field(default_factory=dict)


# What materiality, dispositions, states and buckets are called.
MATERIAL = ("Critical", "High")
MINOR = ("Low", "Informational")
BUILD = ("TEMPLATE_EXTENSION", "LOCAL_EXTENSION", "NEW_DEVELOPMENT")
UNDECIDED, DISCUSS, CONFIRM, SUSPECTED, STATUTORY, NO_LOCALIZATION = "REQUIRES_DECISION", "MUST_DISCUSS", "CONFIRM", "SUSPECTED", "CONFIRMED_STATUTORY", "NOT_LOCALIZATION"
EXPLICIT_SIDES = ("localization", "as_is", "template")
STANDARD_SIDE = "sap_bp"
ASK_EVIDENCE = "Provide the source evidence for this difference."
ASK_STATUTE = "Confirm whether this requirement is statutory, and cite the legal or tax source."
UNNAMED = "not identified — see the quality gates"
MINUTES = 10


def _asking(question: str) -> Column:
    asked = F.coalesce(F.col("open_questions"), F.array().cast("array<string>"))
    return F.when(F.array_contains(asked, question), asked).otherwise(F.concat(asked, F.array(F.lit(question))))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def deviation_rules() -> list[Rule]:
    """Of a deviation, with its run's ``localization`` and ``score_b`` and its evidence
    counted: ``kept``, ``sides``, ``explicit`` (of the first class and an own side), ``standard``."""
    c = F.col
    material, blank = c("materiality").isin(*MATERIAL), F.trim(F.coalesce(c("question"), F.lit(""))) == ""
    discussed = c("bucket") == DISCUSS
    none = lambda kind: F.lit(None).cast(kind)
    return [
        Rule("QG4", "soft", "localization without a country", ~c("localization") & (c("state") != NO_LOCALIZATION), {"state": F.lit(NO_LOCALIZATION)}),
        Rule("QG5", "soft", "rated against itself", ~c("score_b") & c("rating").isNotNull(), {"rating": none("double")}),
        Rule("QG2", "soft", "one side only", material & (c("kept") > 0) & (c("sides") < 2)),
        Rule("QG2", "hard", "material without evidence", material & (c("kept") == 0), {"disposition": F.lit(UNDECIDED), "confidence": F.lit("Low"), "bucket": F.lit(DISCUSS), "open_questions": _asking(ASK_EVIDENCE)}),
        Rule("QG4", "hard", "statutory without an explicit source", c("localization") & (c("state") == STATUTORY) & (c("explicit") == 0), {"state": F.lit(SUSPECTED), "bucket": F.lit(DISCUSS), "open_questions": _asking(ASK_STATUTE)}),
        Rule("QG5", "hard", "extension before standard", c("disposition").isin(*BUILD) & ~_true(c("considered")), {"disposition": F.lit(UNDECIDED), "bucket": F.lit(DISCUSS)}),
        Rule("QG5", "hard", "rating without a source", c("score_b") & c("rating").isNotNull() & (c("standard") == 0), {"rating": none("double")}),
        Rule("QG6", "soft", "minor and undecidable", discussed & blank & c("materiality").isin(*MINOR), {"bucket": F.lit(CONFIRM)}),
        Rule("QG6", "hard", "nothing to decide", discussed & blank & ~c("materiality").isin(*MINOR)),
        Rule("", "", "minutes", discussed & ~blank & (F.coalesce(c("minutes"), F.lit(0)) == 0), {"minutes": F.lit(MINUTES)}),
    ]


def enforced(rows: DataFrame, rules: Sequence[Rule], passes: int = 8) -> DataFrame:
    """Rows mended by ``rules``, with ``issues``: (gate, severity, rule) in the order in
    which they were found first. Raises if rows still change after ``passes``."""
    found = "array<struct<gate:string,severity:string,rule:string>>"
    mended = rows.withColumn("issues", F.array().cast(found))
    touched = sorted({name for r in rules for name in r.repairs})
    for _ in range(passes):
        before = F.struct(*(F.col(name) for name in touched))
        new = mended.withColumn("_was", before)
        for r in rules:
            hit = _true(r.when)
            new = new.withColumn("_hit", hit)
            told = F.array(F.struct(F.lit(r.gate).alias("gate"), F.lit(r.severity).alias("severity"), F.lit(r.name).alias("rule")))
            changes = {name: F.when(F.col("_hit"), value).otherwise(F.col(name)).alias(name) for name, value in r.repairs.items()}
            if r.gate:
                changes["issues"] = F.when(F.col("_hit"), F.array_union("issues", told)).otherwise(F.col("issues"))
            new = new.withColumns(changes)
        new = settled(new.withColumn("_changed", ~F.col("_was").eqNullSafe(before)).drop("_was", "_hit"), "gates")
        mended = new.drop("_changed")
        if new.filter("_changed").isEmpty():
            return mended
    raise RuntimeError("rules undo each other's repairs")


def evidence_gate(evidence: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept evidence, issues): evidence (by, chunk, side, class, seen, held, standard)
    counts if its chunk was retrieved in the run, holds the quote, and is what its
    side says it is; the first reason against it is its issue."""
    reason = F.when(~_true(F.col("seen")), "not retrieved").when(~_true(F.col("held")), "quote absent").when((F.col("side") == STANDARD_SIDE) & ~_true(F.col("standard")), "not a standard source")
    told = evidence.withColumn("rule", reason)
    issues = told.filter("rule is not null").select(*by, F.lit("QG2").alias("gate"), F.lit("hard").alias("severity"), "rule")
    return told.filter("rule is null").drop("rule"), issues


def deviation_gates(runs: DataFrame, deviations: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mended deviations, issues (run, gap_id, gate, severity, rule)).

    ``runs``: run, localization, score_b. ``deviations``: run, gap_id, materiality,
    disposition, state, rating, considered, bucket, question, minutes, confidence,
    open_questions. ``evidence``: see :func:`evidence_gate`, by run and gap_id."""
    key = ["run", "gap_id"]
    kept, issues = evidence_gate(evidence, key)
    own = (F.col("class") == "E1") & F.col("side").isin(*EXPLICIT_SIDES)
    counts = kept.groupBy(*key).agg(F.count("*").alias("kept"), F.countDistinct("side").alias("sides"), F.count_if(own).alias("explicit"), F.count_if(F.col("side") == STANDARD_SIDE).alias("standard"))
    j = deviations.join(runs.select("run", "localization", "score_b"), "run").join(counts, key, "left")
    j = j.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("kept", "sides", "explicit", "standard")})
    mended = enforced(j, deviation_rules())
    found = mended.select(*key, F.explode("issues").alias("i")).select(*key, "i.gate", "i.severity", "i.rule")
    return mended.select(*deviations.columns), found.unionByName(issues)


def run_gates(runs: DataFrame, deviations: DataFrame, fits: DataFrame, steps: DataFrame, backlog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs with their baseline named, kept backlog, issues (run, gap_id, gate, severity, rule)).

    QG7: a run that names no baseline says so; a backlog item without a gap of its
    run goes. QG1: a step (run, step) that no fit and no deviation (run, step: one or more references) names."""
    unnamed = ~_true(F.col("scope_named")) & (F.trim(F.coalesce(F.col("template_process"), F.lit(""))) == "")
    issue = lambda df, gap, gate, severity, rule: df.select("run", gap.cast("string").alias("gap_id"), F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))
    nothing = F.lit(None)
    known = deviations.select("run", "gap_id").distinct()
    lost = backlog.join(known, ["run", "gap_id"], "left_anti")
    named = fits.select("run", "step").unionByName(deviations.select("run", "step")).select("run", F.explode(step_refs(F.col("step"))).alias("step")).distinct()
    missed = steps.select("run", F.upper("step").alias("step")).join(named.select("run", F.upper("step").alias("step")), ["run", "step"], "left_anti").select("run").distinct()
    issues = issue(runs.filter(unnamed), nothing, "QG7", "hard", "no baseline named").unionByName(issue(lost, F.col("gap_id"), "QG7", "hard", "backlog without a gap")).unionByName(issue(missed, nothing, "QG1", "soft", "steps not mapped"))
    mended = runs.withColumn("template_process", F.when(unnamed, F.lit(UNNAMED)).otherwise(F.col("template_process")))
    return mended, backlog.join(known, ["run", "gap_id"], "left_semi"), issues
