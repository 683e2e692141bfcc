"""Rules, domains and profiles that users bring as tables or JSON files, in place of the shipped ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import SEVERITY_RANK
from .facts import SIGNATURES

CONTROL = "catalog string, control string, mode string, rung int, severity string, roles array<string>, checks string, need array<string>, tolerance struct<kind:string,max:string>"
#: Classes that any event meets.
OPEN_CLASSES = ("any", "self_report")


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """Controls of JSON files, one object each or a list, with the columns of CONTROL."""
    return checked_controls(spark.read.schema(CONTROL).json(path, multiLine=True))


def checked_controls(rows: DataFrame) -> DataFrame:
    """Controls as ``assess`` wants them; raises on a control that could not be judged as written.

    ``need`` lists etype:class, and becomes the keys of ``minimum_evidence``.  A control table is as
    small as its rule files, so reading it on the driver to check it is bounded.
    """
    known = F.array(*map(F.lit, sorted(SIGNATURES)))
    problem = (
        F.when(F.col("control").isNull() | F.col("catalog").isNull(), "lacks a name")
        .when(~F.coalesce("severity", F.lit("")).isin(*SEVERITY_RANK), "unknown severity")
        .when(~F.coalesce("mode", F.lit("")).isin("automated", "semi-automated", "manual"), "unknown mode")
        .when(F.size(F.coalesce("roles", F.array().cast("array<string>"))) == 0, "applies to no role")
        .when(F.col("checks").isNotNull() & (F.size(F.array_except(F.split("checks", r"\+"), known)) > 0), "unknown check")
    )
    bad = rows.select("control", problem.alias("p")).where("p is not null").limit(1).collect()
    if bad:
        raise ValueError(f"control {bad[0]['control']}: {bad[0]['p']}")
    need = F.transform(F.coalesce("need", F.array().cast("array<string>")), lambda n: F.when(F.substring_index(n, ":", -1).isin(*OPEN_CLASSES), F.substring_index(n, ":", 1)).otherwise(n))
    return rows.withColumn("need", F.array_sort(F.array_distinct(need)))


def with_tolerance(rows: DataFrame) -> DataFrame:
    """Adds within: whether ``failed`` of ``applicable`` is tolerated, by ``tolerance`` (kind, max).

    count: failed <= max.  ratio: failed / applicable <= max, exactly, as decimals; with nothing
    applicable, failed <= the whole part of max.  No tolerance is none at all.
    """
    most = F.coalesce(F.col("tolerance.max").try_cast("decimal(18,9)"), F.lit(0))
    ratio = F.coalesce(F.col("tolerance.kind") == "ratio", F.lit(False)) & (F.col("applicable") > 0)
    return rows.withColumn("within", F.when(ratio, F.col("failed") <= most * F.col("applicable")).otherwise(F.col("failed") <= F.floor(most)))


def read_domain(spark: SparkSession, path: str) -> DataFrame:
    """(decision_type, parent, consequential, required_modality) from JSON lines; parent Decision unless given."""
    rows = spark.read.schema("id string, subclass_of string, consequential boolean, required_oversight_modality string").json(path)
    return rows.select(F.col("id").alias("decision_type"), F.coalesce("subclass_of", F.lit("Decision")).alias("parent"), F.coalesce("consequential", F.lit(False)).alias("consequential"), F.col("required_oversight_modality").alias("required_modality"))


def observation_window(events: DataFrame, profile: DataFrame) -> DataFrame:
    """(subject, start, end) of ``profile(subject, start, end)``: declared where both ends are, else the least and
    greatest event time as text, else the epoch."""
    seen = events.where("time is not null and time <> ''").groupBy("subject").agg(F.min("time").alias("a"), F.max("time").alias("b"))
    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    epoch = F.lit("1970-01-01T00:00:00Z")
    out = profile.join(seen, "subject", "left")
    return out.select("subject", F.when(whole, F.col("start")).otherwise(F.coalesce("a", epoch)).alias("start"), F.when(whole, F.col("end")).otherwise(F.coalesce("b", epoch)).alias("end"))


def profile_problems(profile: DataFrame, components: DataFrame) -> DataFrame:
    """(subject, problem) of what a profile leaves open beside its sources, which ``governance.profile_lint`` judges.

    ``profile(subject, start, end, confirmed_by)``, ``components(subject, name, task_scope)``.
    """
    day = lambda c: F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))
    own = F.array(
        F.when(F.col("start").isNull() | F.col("end").isNull(), "no observation window").when(~F.coalesce(F.date_diff(day("end"), day("start")) >= 90, F.lit(False)), "window under 90 days"),
        F.when(F.coalesce("confirmed_by", F.lit("")) == "", "not confirmed"),
    )
    part = F.array(F.when(F.coalesce("task_scope", F.lit("")) == "", F.concat(F.col("name"), F.lit(": no task scope"))))
    each = [df.select("subject", F.explode(F.array_compact(problems)).alias("problem")) for df, problems in ((profile, own), (components, part))]
    return each[0].union(each[1])
