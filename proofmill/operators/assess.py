"""Outcomes of every control for every subject, and the evidence they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import facts as fx
from .loading import with_tolerance

#: Fixed value: citations per assertion.
CITED = 20


def minimum_evidence(ev: DataFrame) -> DataFrame:
    """(subject, have): sorted keys etype and etype:class of the subject's events; at most a few dozen."""
    keys = F.explode(F.array(F.col("etype"), F.concat_ws(":", "etype", "source_class")))
    return ev.select("subject", keys.alias("k")).distinct().groupBy("subject").agg(F.sort_array(F.collect_set("k")).alias("have"))


def assess(ev: DataFrame, rows: DataFrame, controls: DataFrame, subjects: DataFrame) -> DataFrame:
    """One assertion per (subject, control): outcome, applicable, failed, missing evidence.

    ``subjects(subject, roles)``.  The order of tests is fixed: role, rung and shape, population,
    minimum evidence, tolerance (a number of failures, or a struct of kind and max as in
    ``loading.with_tolerance``).  One job serves all subjects and controls.
    """
    names = sorted({r["checks"] for r in controls.select("checks").where("checks is not null").distinct().collect()})
    # all joins are of subjects; controls unfold after them, each with the place of its checks among the counts
    each = subjects.join(minimum_evidence(ev), "subject", "left").join(fx.check_table(rows, names), "subject", "left")
    out = with_controls(each, controls.withColumn("_nth", F.array_position(F.array(*map(F.lit, names)), F.col("checks")).cast("int")))
    own = F.get("counts", F.col("_nth") - 1)
    have = F.coalesce("have", F.array().cast("array<string>"))
    missing = F.array_except("need", have)
    out = out.withColumns({name: F.coalesce(own[name], F.lit(0)) for name in ("applicable", "failed")})
    n, bad = F.col("applicable"), F.col("failed")
    out = with_tolerance(out) if dict(controls.dtypes)["tolerance"].startswith("struct") else out.withColumn("within", bad <= F.col("tolerance"))
    outcome = (
        F.when(~F.arrays_overlap("applies_to", "roles"), "not_applicable")
        .when((F.col("rung") != 2) | F.col("checks").isNull(), "not_assessed")
        .when(n == 0, "not_applicable")
        .when(F.size(missing) > 0, "insufficient_evidence")
        .when(F.col("within"), "conformant")
        .otherwise("non-conformant")
    )
    judged = F.col("outcome").isin("conformant", "non-conformant")
    out = out.withColumn("outcome", outcome).withColumn("missing", F.array_sort(missing))
    seen = F.when(judged | (F.col("outcome") == "insufficient_evidence"), n).otherwise(0)
    return out.select("subject", "catalog", "control", "mode", "severity", "outcome", seen.cast("long").alias("applicable"), F.when(judged, bad).otherwise(0).cast("long").alias("failed"), "missing", "checks")


def with_controls(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Each row with each control.  The control table is as small as the rule files, so it becomes a
    literal that every row unfolds; nothing is joined."""
    controls = controls.withColumnRenamed("roles", "applies_to")
    table = F.from_json(F.lit("[" + ",".join(r[0] for r in controls.select(F.to_json(F.struct("*"))).collect()) + "]"), f"array<{controls.schema.simpleString()}>")
    return rows.select("*", F.explode(table).alias("_c")).select(*rows.columns, "_c.*")


def violations(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """(subject, control, catalog, focus, check) for each failed signature of each control with a shape."""
    sigs = controls.where("rung = 2 and checks is not null").select("catalog", "control", F.explode(F.split("checks", r"\+")).alias("check"))
    names = sorted(r["check"] for r in sigs.select("check").distinct().collect())  # rule files: a few dozen rows
    failed = []
    for s in names:
        where, ok = fx.population_and_check(s)
        failed.append(F.when(where & ~ok, F.lit(s)))
    bad = rows.select("subject", F.col("id").alias("focus"), F.explode(F.array_compact(F.array(*failed))).alias("check"))
    return bad.join(sigs, "check").select("subject", "catalog", "control", "focus", "check")


def evidence_pointers(ev: DataFrame, rows: DataFrame, checks: list[str], limit: int = CITED) -> DataFrame:
    """(subject, checks, focus, source_class, failing): the first ``limit`` focus nodes by id.

    Failing ones where any fail, else all applicable ones; nodes that are no event of the subject use up
    a place and are dropped afterwards.
    """
    marks = []
    for name in checks:
        where, ok = fx.population_and_check(name)
        marks.append(F.when(where, F.struct(F.lit(name).alias("checks"), (~ok).alias("failing"))))
    each = rows.select("subject", F.col("id").alias("focus"), F.explode(F.array_compact(F.array(*marks))).alias("m")).select("subject", "focus", "m.*")
    group = Window.partitionBy("subject", "checks")
    each = each.withColumn("_any", F.max("failing").over(group)).where("failing = _any")
    top = each.withColumn("_n", F.row_number().over(group.orderBy("focus"))).where(F.col("_n") <= limit).drop("_any", "_n")
    return top.join(ev.select("subject", F.col("id").alias("focus"), "source_class"), ["subject", "focus"]).select("subject", "checks", "focus", "source_class", "failing")


def uncited(assertions: DataFrame, pointers: DataFrame) -> DataFrame:
    """Verdicts that cite nothing: (subject, catalog, control, outcome) of those the evidence does not support."""
    some = pointers.select("subject", "checks").distinct()
    judged = assertions.where(F.col("outcome").isin("conformant", "non-conformant", "partial"))
    return judged.join(some, ["subject", "checks"], "left_anti").select("subject", "catalog", "control", "outcome")


def require_evidence(assertions: DataFrame, pointers: DataFrame) -> DataFrame:
    """``assertions`` as they are; raises on the first verdict that cites no evidence."""
    first = uncited(assertions, pointers).limit(1).collect()
    if first:
        raise ValueError(f"control {first[0]['control']} on {first[0]['subject']} is {first[0]['outcome']} but cites no evidence")
    return assertions
