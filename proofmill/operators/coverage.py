"""Coverage against independent counts, applicability, and what was never declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import half_even_ratio
from .assess import with_controls


def coverage(ev: DataFrame, denominators: DataFrame, threshold: tuple[int, int] = (95, 100), manifests: DataFrame | None = None) -> DataFrame:
    """(subject, etype, observed, expected, ratio, status, denominators).

    ``denominators(subject, source, covers)``: the source's own events, over all subjects, say how many
    events of the covered types to expect; observed are the subject's events from other sources.  Of
    several denominators the largest count holds, and ties keep all their names.  Where a source has
    rows in ``manifests(source, etype, n)``, these counts stand for its events.
    """
    own = denominators.select("subject", "source").distinct()
    observed = ev.join(own, ["subject", "source"], "left_anti").groupBy("subject", F.coalesce("etype", F.lit("Unknown")).alias("etype")).agg(F.count("*").alias("observed"))
    totals = ev.groupBy("source", "etype").agg(F.count("*").alias("n"))
    if manifests is not None:
        totals = totals.join(manifests.select("source").distinct(), "source", "left_anti").unionByName(manifests.select("source", "etype", "n"))
    expected = denominators.join(totals, "source", "left").where(F.col("etype").isNotNull() & (F.col("covers").isNull() | F.array_contains("covers", F.col("etype"))))
    best = expected.withColumn("_r", F.rank().over(Window.partitionBy("subject", "etype").orderBy(F.desc("n")))).where("_r = 1")
    best = best.groupBy("subject", "etype").agg(F.max("n").alias("expected"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("denominators"))
    out = observed.join(best, ["subject", "etype"], "full_outer").withColumn("observed", F.coalesce("observed", F.lit(0).cast("long")))
    enough = F.col("observed") * threshold[1] >= F.col("expected") * threshold[0]
    status = F.when(F.coalesce("expected", F.lit(0)) <= 0, "unknown").when(enough, "covered").otherwise("below_threshold")
    return out.select("subject", "etype", "observed", "expected", half_even_ratio(F.col("observed"), F.col("expected")).alias("ratio"), status.alias("status"), "denominators")


def roll_up(cover: DataFrame, denominators: DataFrame) -> DataFrame:
    """(subject, coverage_status): unknown without denominators or with any unknown type, else gap or ok."""
    any_of = cover.groupBy("subject").agg(F.bool_or(F.col("status") == "unknown").alias("u"), F.bool_or(F.col("status") == "below_threshold").alias("b"))
    has = denominators.select("subject").distinct().withColumn("has", F.lit(True))
    status = F.when(F.col("has").isNull() | F.col("u"), "unknown").when(F.col("b"), "gap").otherwise("ok")
    return any_of.join(has, "subject", "left").select("subject", status.alias("coverage_status"))


def applicability(subjects: DataFrame, controls: DataFrame) -> DataFrame:
    """(subject, catalog, control, applicable, reason_code, reason_refs) for each subject and control."""
    out = with_controls(subjects, controls)
    shared = F.array_sort(F.array_intersect("roles", "applies_to"))
    return out.select("subject", "catalog", "control", (F.size(shared) > 0).alias("applicable"), F.when(F.size(shared) > 0, "role_match").otherwise("role_mismatch").alias("reason_code"), F.array_join(shared, ",").alias("reason_refs"))


def undeclared(ev: DataFrame, declared: DataFrame) -> DataFrame:
    """(subject, kind, ref): observed decision types, components and subjects that no profile declares.

    ``declared(subject, kind, ref)``.  An undeclared subject is reported with the first declared one.
    """
    types = ev.where("decision_type is not null").select("subject", F.lit("undeclared_decision_type").alias("kind"), F.col("decision_type").alias("ref")).distinct()
    parts = ev.select("subject", F.explode("used").alias("ref")).select("subject", F.lit("undeclared_component").alias("kind"), "ref").distinct()
    names = declared.select("subject").distinct()
    first = names.agg(F.min("subject").alias("first"))
    seen = types.union(parts).join(names, "subject", "left_semi").join(declared, ["subject", "kind", "ref"], "left_anti")
    lost = ev.select("subject").distinct().join(names, "subject", "left_anti").select(F.lit(first.first()["first"]).cast("string").alias("subject"), F.lit("undeclared_subject").alias("kind"), F.col("subject").alias("ref"))
    return seen.union(lost)
