"""Rows of the remaining reports: remediation, first-seen tools, preflight, adapter and probe comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .facts import dangling


def remediation(assertions: DataFrame, controls: DataFrame, have: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row per open finding: what the control asks for, what is there of it, what is missing.

    With ``links(catalog, control, framework, clause)`` also clauses, those that the control answers to.
    """
    need = controls.select("catalog", "control", F.col("need").alias("required"))
    rows = assertions.where(F.col("outcome").isin("non-conformant", "insufficient_evidence", "partial")).select("subject", "catalog", "control", "outcome", "missing")
    rows = rows.join(need, ["catalog", "control"]).join(have, "subject", "left")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    out = rows.select("subject", "catalog", "control", "outcome", text("required").alias("required"), text(F.array_intersect("required", "have")).alias("observed"), text("missing").alias("missing"))
    if links is None:
        return out
    clauses = links.groupBy("catalog", "control").agg(text(F.collect_set(F.concat_ws(" ", "framework", "clause"))).alias("clauses"))
    return out.join(clauses, ["catalog", "control"], "left").select(*out.columns, F.coalesce("clauses", F.lit("")).alias("clauses"))


def first_seen(events: DataFrame, column: str) -> DataFrame:
    """(subject, position, name): distinct values in the order they first arrive."""
    first = events.where(F.col(column).isNotNull()).groupBy("subject", F.col(column).alias("name")).agg(F.min("ordinal").alias("at"))
    return first.select("subject", F.row_number().over(Window.partitionBy("subject").orderBy("at", "name")).cast("long").alias("position"), "name")


def preflight(ingested: DataFrame, accepted: DataFrame, declared: DataFrame) -> DataFrame:
    """(kind, ref, n): rejects by reason, accepted events by source, class conflicts, dangling references."""
    rejects = ingested.where("reason is not null").groupBy(F.col("reason").alias("ref")).agg(F.count("*").alias("n")).select(F.lit("reject").alias("kind"), "ref", "n")
    counts = accepted.groupBy(F.col("source").alias("ref")).agg(F.count("*").alias("n")).select(F.lit("accepted"), "ref", "n")
    conflicts = accepted.join(declared, "source").where("source_class <> declared_class").groupBy(F.col("source").alias("ref")).agg(F.count("*").alias("n")).select(F.lit("class_conflict"), "ref", "n")
    loose = dangling(accepted).groupBy(F.col("subject").alias("ref")).agg(F.count("*").alias("n")).select(F.lit("dangling"), "ref", "n")
    return rejects.union(counts).union(conflicts).union(loose)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, from 1, in the total order of all rows: each range of rows is numbered by itself, and
    takes the number of rows in the ranges before it.  Only the ranges, a row each, are put in one order."""
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "placed")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn("place", F.col("_before") + own).drop("_range", "_before")


def identical_rows(produced: DataFrame, expected: DataFrame, order: list[str]) -> DataFrame:
    """(unit, rows, identical): rows of a unit equal at the same place in its order; 0 identical where the lengths differ.

    Units may hold any part of the rows: places come from ``placed``, not from a sort of a unit.
    """
    names = [c for c in produced.columns if c != "unit"]

    def within(rows: DataFrame, name: str) -> DataFrame:
        at = placed(rows, ["unit", *order])
        first = at.groupBy("unit").agg(F.min("place").alias("_first"))
        return at.join(first, "unit").select("unit", (F.col("place") - F.col("_first")).alias("_n"), F.struct(*names).alias(name))

    both = within(produced, "a").join(within(expected, "b"), ["unit", "_n"], "full_outer").groupBy("unit").agg(F.count("a").alias("rows"), F.count("b").alias("_m"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    return both.select("unit", "rows", F.when(F.col("rows") == F.col("_m"), F.col("same")).otherwise(0).cast("long").alias("identical"))


def flagged_exactly(flagged: DataFrame, attacks: DataFrame) -> DataFrame:
    """(case_id, side): flagged cases that are no attack, and attacks that were not flagged."""
    a, b = flagged.select("case_id").distinct(), attacks.select("case_id").distinct()
    extra = a.join(b, "case_id", "left_anti").withColumn("side", F.lit("flagged_only"))
    return extra.union(b.join(a, "case_id", "left_anti").withColumn("side", F.lit("missed")))
