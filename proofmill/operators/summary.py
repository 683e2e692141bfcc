"""Tallies, verdicts, gaps, comparisons and scores over assertion tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import family
from .catalog import OUTCOMES, SEVERITY_RANK

GAPS = ["non-conformant", "partial", "insufficient_evidence", "not_assessed"]
#: Fixed value: controls named per gap.
LISTED = 5
#: Level of a finding by outcome; other outcomes make no finding.
LEVELS = {"non-conformant": "error", "partial": "warning", "insufficient_evidence": "warning", "not_assessed": "note"}


def column(outcome: str) -> str:
    return "n_" + outcome.replace("-", "_")


def counts() -> list:
    return [F.count_if(F.col("outcome") == o).alias(column(o)) for o in OUTCOMES]


def tally(assertions: DataFrame, *by: str) -> DataFrame:
    """Counts of all six outcomes, zeros included, in total or by columns."""
    return assertions.groupBy(*by).agg(*counts())


def verdict(assertions: DataFrame, *by: str) -> DataFrame:
    """non-conformant before incomplete before conformant."""
    t = tally(assertions, *by)
    open_ = F.col("n_partial") + F.col("n_insufficient_evidence") + F.col("n_not_assessed") > 0
    return t.select(*by, F.when(F.col("n_non_conformant") > 0, "non-conformant").when(open_, "incomplete").otherwise("conformant").alias("verdict"))


def families(assertions: DataFrame) -> DataFrame:
    return tally(assertions.withColumn("family", family(F.col("control"))), "family")


def automation(controls: DataFrame) -> DataFrame:
    """Controls per family and mode, and a total row (family null)."""
    modes = [F.count_if(F.col("mode") == m).alias(m.replace("-", "_")) for m in ("automated", "semi-automated", "manual")]
    return controls.withColumn("family", family(F.col("control"))).rollup("family").agg(F.count("*").alias("controls"), *modes)


def top_gaps(assertions: DataFrame) -> DataFrame:
    """(outcome, controls, more): the first five controls of each gap, and how many there are besides."""
    got = assertions.where(F.col("outcome").isin(GAPS)).groupBy("outcome").agg(F.array_sort(F.collect_set("control")).alias("c"))
    return got.select("outcome", F.array_join(F.slice("c", 1, LISTED), ",").alias("controls"), F.greatest(F.size("c") - LISTED, F.lit(0)).cast("long").alias("more"))


def ranked(assertions: DataFrame) -> DataFrame:
    """Findings with severity_rank, for reports that sort the gravest first."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITY_RANK.items()], F.lit(0))
    return assertions.where(F.col("outcome").isin("non-conformant", "insufficient_evidence")).select("subject", "catalog", "control", "outcome", rank.cast("long").alias("severity_rank"))


def findings(assertions: DataFrame) -> DataFrame:
    """(subject, control, level, fingerprint) of outcomes that make a finding."""
    level = F.coalesce(*[F.when(F.col("outcome") == o, v) for o, v in LEVELS.items()])
    mark = F.sha2(F.concat_ws("|", "catalog", "control", "subject", "outcome"), 256)
    return assertions.select("subject", "catalog", "control", level.alias("level"), mark.alias("fingerprint")).where("level is not null")


def observations(assertions: DataFrame) -> DataFrame:
    """(subject, control, observation_id, state): satisfied only where conformant."""
    return assertions.select("subject", "catalog", "control", F.sha2(F.concat_ws("|", "subject", "catalog", "control"), 256).alias("observation_id"), F.when(F.col("outcome") == "conformant", "satisfied").otherwise("not-satisfied").alias("state"))


def test_cases(assertions: DataFrame) -> DataFrame:
    """(subject, tests, failures): every pair is a case, failed unless conformant."""
    return assertions.groupBy("subject").agg(F.count("*").alias("tests"), F.count_if(F.col("outcome") != "conformant").alias("failures"))


def packs(assertions: DataFrame, pointers: DataFrame) -> DataFrame:
    """One row per subject: how many assertions, and the distinct sorted references they cite."""
    refs = pointers.groupBy("subject").agg(F.array_sort(F.collect_set("focus")).alias("refs"))
    own = assertions.groupBy("subject").agg(F.count("*").alias("assertions"))
    return own.join(refs, "subject", "left").select("subject", "assertions", F.coalesce(F.size("refs"), F.lit(0)).cast("long").alias("n_refs"), F.sha2(F.coalesce(F.array_join("refs", ","), F.lit("")), 256).alias("refs_sha256"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subject, catalog, control, before, after) where two assertion tables differ; null: added or removed."""
    keys = ["subject", "catalog", "control"]
    both = before.select(*keys, F.col("outcome").alias("before")).join(after.select(*keys, F.col("outcome").alias("after")), keys, "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def drift(state: DataFrame, now: DataFrame) -> DataFrame:
    """Pairs with an earlier outcome that differs; a pair never seen before reports nothing."""
    keys = ["subject", "catalog", "control"]
    both = state.select(*keys, F.col("outcome").alias("previous")).join(now.select(*keys, "outcome"), keys)
    return both.where("previous <> outcome")


def crosswalk(assertions: DataFrame, links: DataFrame) -> DataFrame:
    """Assertions by framework clause; ``links(catalog, control, framework, clause, verified)``."""
    return assertions.join(links, ["catalog", "control"]).select("subject", "catalog", "control", "outcome", "framework", "clause", F.coalesce("verified", F.lit(False)).alias("verified"))


def gate(assertions: DataFrame, any_of: list[list[tuple[str, str]]]) -> DataFrame:
    """How many assertions match an OR of ANDs of (field, value); fields are allow-listed."""
    allowed = {"subject", "catalog", "control", "outcome", "severity", "mode"}
    test = F.lit(False)
    for group in any_of:
        one = F.lit(True)
        for field, value in group:
            if field not in allowed:
                raise ValueError(f"unknown field {field}")
            one = one & (F.col(field) == F.lit(value))
        test = test | one
    return assertions.agg(F.count_if(test).alias("matches"))


def detection(truth: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: recall over seeded faults and false-positive rate over known-pass projects, as counts.

    ``truth(project, control, expected, variant)``, ``outcomes(project, control, outcome)``.
    """
    both = truth.join(outcomes, ["project", "control"], "left")
    bad, seeded, clean = F.col("outcome") == "non-conformant", F.col("expected") == "non-conformant", F.col("variant") == "known-pass"
    return both.agg(F.count_if(seeded).alias("seeded"), F.count_if(seeded & bad).alias("detected"), F.count_if(clean).alias("negatives"), F.count_if(clean & bad).alias("false_positives"))


def held_out(truth: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: faults seeded and detected in the held-out group, controls of the adversarial group, and whether all of these match.

    ``truth(project, control, expected, group)``, ``outcomes(project, control, outcome)``.
    """
    both = truth.join(outcomes, ["project", "control"], "left")
    held, other = F.col("group") == "held-out", F.col("group") == "adversarial"
    seeded = held & (F.col("expected") == "non-conformant")
    match = F.col("outcome").eqNullSafe(F.col("expected"))
    return both.agg(
        F.count_if(seeded).alias("seeded"), F.count_if(seeded & (F.col("outcome") == "non-conformant")).alias("detected"),
        F.count_if(other).alias("adversarial_controls"), F.coalesce(F.bool_and(F.when(other, match)), F.lit(True)).alias("adversarial_match"),
    )


def run_manifest(spark, input_digest: str, outputs: dict[str, str], catalogs: DataFrame, started_at: str, operator: str, supersedes: str | None = None) -> DataFrame:
    """One row that names a run: what it read, which controls it judged by, the digest of each output, when, and what it replaces."""
    digest = catalogs.select(F.sha2(F.to_json(F.struct(*sorted(catalogs.columns))), 256).alias("d")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256)).first()[0]  # one row a control
    rows = [(input_digest, digest, dict(sorted(outputs.items())), started_at, operator, supersedes)]
    return spark.createDataFrame(rows, "input_digest string, catalog_digest string, outputs map<string,string>, started_at string, operator string, supersedes string")


def nothing_evaluated(assertions: DataFrame) -> bool:
    """Whether no assertion reached a verdict: such a run is an error, not a pass."""
    return assertions.where(F.col("outcome").isin("conformant", "non-conformant", "partial")).limit(1).count() == 0
