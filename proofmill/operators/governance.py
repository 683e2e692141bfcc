"""Checks over the tables that people keep: deviations, checklists, profiles, overlays, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import SEVERITY_RANK

#: Fields of a deviation, and how many days it may last.
DEVIATION_FIELDS = ["reason", "compensating_measure", "owner", "approver", "granted", "expiry"]
MAX_DAYS = 180
BAD_INTEGRITY = ["failed", "gap", "reordered", "time_suspect"]


def problems(tests: list[tuple[Column, str]]) -> Column:
    """The names of the tests that hold, as an array."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def deviation_lint(deviations: DataFrame, controls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(deviation_id, control, problem) for each rule a deviation breaks.

    ``controls(control)`` and ``outcomes(control, outcome)`` have one row a control.
    """
    known = controls.select("control", F.lit(True).alias("_known")).distinct()
    rows = deviations.join(known, "control", "left").join(outcomes.select("control", "outcome"), "control", "left")
    days = F.datediff(F.col("expiry").try_cast("date"), F.col("granted").try_cast("date"))
    tests = [
        (F.col("_known").isNull(), "unknown control"),
        (F.col("control").startswith("INT-"), "family cannot be deviated"),
        (F.col("outcome") == "insufficient_evidence", "evidence gap"),
        (~F.col("outcome").isin("insufficient_evidence", "non-conformant"), "outcome is not non-conformant"),
        *[(F.coalesce(F.col(f), F.lit("")) == "", f"missing {f}") for f in DEVIATION_FIELDS],
        (F.col("owner") == F.col("approver"), "approver is the owner"),
        (days > MAX_DAYS, "lifetime too long"),
    ]
    return rows.select("deviation_id", "control", F.explode(problems(tests)).alias("problem"))


def readiness(integrity: DataFrame, roll_up: DataFrame, cover: DataFrame, drift: DataFrame, assertions: DataFrame, recorded: DataFrame, deviation_problems: DataFrame) -> DataFrame:
    """(kind, ref, blocks): every reason against readiness; blocks is false for a mere limitation."""
    gaps = assertions.where("outcome = 'insufficient_evidence' and severity = 'high'").select("control").distinct()
    noted = recorded.select("control", F.lit(True).alias("_noted")).distinct()
    text = lambda *c: F.concat_ws(" ", *c)
    parts = [
        integrity.where(F.col("status").isin(BAD_INTEGRITY)).select(F.lit("integrity").alias("kind"), text("status", "stream").alias("ref"), F.lit(True).alias("blocks")),
        roll_up.where("coverage_status = 'gap'").select(F.lit("coverage"), F.col("subject"), F.lit(True)),
        cover.where("status = 'below_threshold'").select(F.lit("coverage"), text("subject", "etype"), F.lit(True)),
        drift.select(F.lit("drift"), text("kind", "ref"), F.lit(True)),
        gaps.join(noted, "control", "left").select(F.lit("evidence"), F.col("control"), F.col("_noted").isNull()),
        deviation_problems.select(F.lit("deviation"), text("control", "problem"), F.lit(True)),
    ]
    return reduce(DataFrame.union, parts)


def readiness_verdict(reasons: DataFrame) -> DataFrame:
    got = reasons.agg(F.count_if("blocks").alias("blockers"), F.count_if(~F.col("blocks")).alias("limitations"))
    word = F.when(F.col("blockers") > 0, "NOT READY").when(F.col("limitations") > 0, "READY WITH LIMITATIONS").otherwise("READY")
    return got.select(word.alias("verdict"), "blockers", "limitations")


def overlay_weakening(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(catalog, control, weaker_severity, looser_tolerance): overlay rows that relax a base rule of the same id."""
    rank = lambda c: F.coalesce(*[F.when(c == s, r) for s, r in SEVERITY_RANK.items()], F.lit(0))
    old = base.select("control", F.col("severity").alias("s0"), F.col("tolerance").alias("t0"))
    both = overlay.join(old, "control").withColumn("weaker_severity", rank(F.col("severity")) < rank(F.col("s0"))).withColumn("looser_tolerance", F.col("tolerance") > F.col("t0"))
    return both.where("weaker_severity or looser_tolerance").select("catalog", "control", "weaker_severity", "looser_tolerance")


def orphans(references: DataFrame, defined: DataFrame) -> DataFrame:
    """(kind, ref): what obligations name and nothing defines."""
    return references.select("kind", "ref").distinct().join(defined.select("kind", "ref").distinct(), ["kind", "ref"], "left_anti")


def insufficient_causes(assertions: DataFrame, support: DataFrame) -> DataFrame:
    """(subject, control, missing, sources): for each missing kind of evidence, the sources able to give it."""
    lost = assertions.where("outcome = 'insufficient_evidence'").select("subject", "catalog", "control", F.explode("missing").alias("missing"))
    able = support.groupBy("missing").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return lost.join(able, "missing", "left").select("subject", "catalog", "control", "missing", F.coalesce("sources", F.lit("")).alias("sources"))


def stale_checklists(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(control, artifact): recorded digests that differ from the artifact as it is now, or whose artifact is gone."""
    each = recorded.select("control", F.explode("digests").alias("artifact", "digest"))
    return each.join(current.select("artifact", F.col("digest").alias("now")), "artifact", "left").where(~F.col("digest").eqNullSafe(F.col("now"))).select("control", "artifact")


def profile_lint(sources: DataFrame, window_days: Column | int = 90) -> DataFrame:
    """(subject, source, problem) for each rule a declared source breaks."""
    known = ["enforcement_point", "independent_system", "self_report"]
    tests = [
        (~F.coalesce(F.col("class").isin(known), F.lit(False)), "unknown class"),
        (F.coalesce("justification", F.lit("")) == "", "no justification"),
        (F.col("kind").isin("model_call", "agent_log") & (F.col("class") != "self_report"), "self report upgraded"),
        ((F.col("class") == "enforcement_point") & F.col("manifest").isNull(), "enforcement point without manifest"),
        (F.col("window_days") < window_days, "window too short"),
    ]
    return sources.select("subject", "source", F.explode(problems(tests)).alias("problem"))


def set_differences(declared: DataFrame, claimed: DataFrame) -> DataFrame:
    """(kind, ref, side): members of one set that the other lacks."""
    a, b = declared.select("kind", "ref").distinct(), claimed.select("kind", "ref").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("declared")).union(b.exceptAll(a).withColumn("side", F.lit("claimed")))


def rule_regression(results: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(control, fixture, expected, outcome) of fixtures that do not give their stated result."""
    both = fixtures.join(results, ["control", "fixture"], "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("outcome"))).select("control", "fixture", "expected", "outcome")
