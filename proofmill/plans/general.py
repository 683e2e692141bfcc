"""Queries of the general rule path and of the remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess as az
from ..operators import catalog as cat
from ..operators import facts as fx
from ..operators import ingest as ing
from ..operators import reports as rp
from ..operators import rules as ru
from ..sources import binding as bd
from . import sql
from .evidence import FEED, assertions
from .measures import ASR
from .sql import with_

QUERIES, ORACLE = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


def graph(spark, d):
    """Links, literals and the class closure of the evidence."""
    ev = bd.evidence(spark, d, dealt=True)
    lit = ev.select("subject", F.col("id").alias("s"), F.explode(F.array_compact(F.array(F.struct(F.lit("atTime").alias("p"), F.col("time").alias("value"), F.lit("dateTime").alias("datatype")), F.when(F.col("chain_verified").isNotNull(), F.struct(F.lit("chainVerified").alias("p"), F.col("chain_verified").cast("string").alias("value"), F.lit("boolean").alias("datatype"))), F.when(F.col("latency_ms").isNotNull(), F.struct(F.lit("latency").alias("p"), F.col("latency_ms").cast("string").alias("value"), F.lit("integer").alias("datatype")))))).alias("x")).select("subject", "s", "x.*")
    up = bd.domain(spark).select(F.col("decision_type").alias("child"), "parent").union(spark.createDataFrame([("ConsequentialDecision", "Decision")], "child string, parent string"))
    return fx.edges(ev), lit, fx.class_closure(up)


#: Each rule beside the SQL of its population and test over ``facts`` or ``ev``.
RULES = {
    "inputs": ({"target": "ConsequentialDecision", "path": ["used"], "check": ("min_count", 1)}, "SELECT subject, n_used >= 1 AS ok FROM facts WHERE class_consequential"),
    "delegation": ({"target": "ToolCall", "path": ["delegatedVia", "chainVerified"], "check": ("has_value", "true")}, "SELECT subject, delegation_verified AS ok FROM facts WHERE target = 'ToolCall'"),
    "single_call": ({"target": "Decision", "path": ["^executes"], "check": ("max_count", 1)}, "SELECT f.subject, count(c.id) <= 1 AS ok FROM facts f LEFT JOIN ev c ON c.subject = f.subject AND c.etype = 'ToolCall' AND c.ref_decision = f.id WHERE f.target = 'Decision' GROUP BY f.subject, f.id"),
    "recorded": ({"target": "ToolCall", "path": ["sourceClass"], "check": ("in", ["enforcement_point", "independent_system"])}, "SELECT subject, source_class IN ('enforcement_point', 'independent_system') AS ok FROM facts WHERE target = 'ToolCall'"),
    "of_class": ({"target": "ToolCall", "path": ["executes"], "check": ("class", "ConsequentialDecision")}, "SELECT c.subject, c.ref_decision IS NULL OR coalesce(f.class_consequential, false) AS ok FROM ev c LEFT JOIN facts f ON f.subject = c.subject AND f.id = c.ref_decision WHERE c.etype = 'ToolCall'"),
    "any_link": ({"target": "Decision", "path": [["reviewedBy", "notifiedBy"]], "check": ("min_count", 2)}, "SELECT subject, n_reviewed + n_notified >= 2 AS ok FROM facts WHERE target = 'Decision'"),
    "quick": ({"target": "Decision", "path": ["reviewedBy", "latency"], "check": ("max_inclusive", "20000")}, "SELECT d.subject, coalesce(bool_and(a.latency_ms <= 20000), true) AS ok FROM ev d LEFT JOIN ev a ON a.subject = d.subject AND a.etype = 'ApprovalDecided' AND a.ref_decision = d.id WHERE d.etype = 'Decision' GROUP BY d.subject, d.id"),
    "time_kind": ({"target": "Incident", "path": ["atTime"], "check": ("datatype", "dateTime")}, "SELECT subject, true AS ok FROM facts WHERE target = 'Incident'"),
    "own_agent": ({"target": "ToolCall", "path": ["wasAssociatedWith"], "check": ("equals", ["executes", "wasAssociatedWith"])}, "SELECT c.subject, c.agent IS NOT DISTINCT FROM d.agent AS ok FROM ev c LEFT JOIN ev d ON d.subject = c.subject AND d.id = c.ref_decision WHERE c.etype = 'ToolCall'"),
    "before": ({"target": "ToolCall", "path": ["executes", "atTime"], "check": ("less_than_or_equals", ["atTime"])}, "SELECT c.subject, d.id IS NULL OR d.time <= c.time AS ok FROM ev c LEFT JOIN ev d ON d.subject = c.subject AND d.id = c.ref_decision WHERE c.etype = 'ToolCall'"),
    "sound_decision": ({"target": "ToolCall", "path": ["executes"], "check": ("node", "reviewed")}, "SELECT c.subject, c.ref_decision IS NULL OR coalesce(f.n_reviewed >= 1, false) AS ok FROM ev c LEFT JOIN facts f ON f.subject = c.subject AND f.id = c.ref_decision AND f.target = 'Decision' WHERE c.etype = 'ToolCall'"),
    "one_reviewed": ({"target": "ToolCall", "path": ["executes"], "check": ("qualified_min", ("reviewed", 1))}, "SELECT c.subject, coalesce(f.n_reviewed >= 1, false) AS ok FROM ev c LEFT JOIN facts f ON f.subject = c.subject AND f.id = c.ref_decision AND f.target = 'Decision' WHERE c.etype = 'ToolCall'"),
    "enforced": ({"target": "ToolCall", "where": {"sourceClass": "enforcement_point"}, "path": ["wasAssociatedWith"], "check": ("min_count", 1)}, "SELECT subject, n_agent >= 1 AS ok FROM facts WHERE target = 'ToolCall' AND source_class = 'enforcement_point'"),
}
SHAPES = {"reviewed": {"target": "Decision", "path": ["reviewedBy"], "check": ("min_count", 1)}}


@query(with_(sql.EV, sql.FACTS) + " UNION ALL ".join(f"SELECT '{n}' AS rule, subject, count(*) AS applicable, count(*) FILTER (NOT ok) AS failed FROM ({s}) GROUP BY subject" for n, (_, s) in RULES.items()))
def user_rules(spark, d):
    """Thirteen user rules on the general path: populations and failures by subject."""
    links, literals, closure = graph(spark, d)
    # many rules read the same graph: it is written once for all of them
    links, literals = ing.written(links, "links"), ing.written(literals, "literals")
    return ru.results(links, literals, closure, {n: r for n, (r, _) in RULES.items()}, SHAPES)


@query(with_(sql.EV) + "SELECT subject, count(*) AS decisions FROM ev WHERE decision_type IN ('dom:Credit', 'dom:Hiring') GROUP BY subject")
def consequential_matcher(spark, d):
    """Decisions below ConsequentialDecision, or of a type flagged consequential."""
    _, _, closure = graph(spark, d)
    flagged = bd.domain(spark).where("consequential").select("decision_type")
    return ru.where_subclass(bd.evidence(spark, d), "decision_type", closure, "ConsequentialDecision", flagged).groupBy("subject").agg(F.count("*").alias("decisions"))


@query(
    ASR
    + """SELECT a.subject, a.catalog, a.control, outcome, array_to_string(list_sort(c.need), ',') AS required, array_to_string(list_sort(list_filter(c.need, lambda x: list_contains(h.h, x))), ',') AS observed, array_to_string(a.missing, ',') AS missing
FROM asr a JOIN controls c USING (catalog, control) JOIN have h ON h.subject = a.subject WHERE outcome IN ('non-conformant', 'insufficient_evidence')"""
)
def remediation(spark, d):
    return rp.remediation(assertions(spark, d), cat.controls(spark), az.minimum_evidence(bd.evidence(spark, d)))


@query(with_(sql.EV) + ", f AS (SELECT subject, terminus AS name, min(ordinal) AS at0 FROM ev WHERE terminus IS NOT NULL GROUP BY ALL)\nSELECT subject, row_number() OVER (PARTITION BY subject ORDER BY at0, name) AS position, name FROM f")
def first_seen_principals(spark, d):
    ev = bd.evidence(spark, d)
    return rp.first_seen(ev.withColumn("who", F.try_element_at("acted_for", F.lit(-1))), "who")


@query(with_(sql.EV) + FEED + "\nSELECT 'reject' AS kind, reason AS ref, count(*) AS n FROM final WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT 'accepted', source, count(*) FROM ev GROUP BY source UNION ALL SELECT 'dangling', subject, count(*) FROM (SELECT DISTINCT e.subject, e.id, r FROM ev e, unnest([ref_decision, ref_delegation, ref_instruction, ref_request, ref_authorization]) AS t(r) WHERE r IS NOT NULL) q WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.subject = q.subject AND x.id = q.r) GROUP BY subject")
def bundle_preflight(spark, d):
    """Rejects of the raw feed, and counts and loose references of the clean bundle."""
    return rp.preflight(ing.ingest(bd.raw_feed(spark, d), bd.sources(spark)), bd.evidence(spark, d), bd.sources(spark))


@query("SELECT 'conversations' AS unit, count(*) AS rows, count(*) FILTER (NOT (conv_id % 50 = 0 AND turn = 0)) AS identical FROM conversations")
def adapter_identity(spark, d):
    """Produced against expected rows of one unit, place by place; some expected rows were altered."""
    t = bd.table(spark, d, "conversations").select(F.lit("conversations").alias("unit"), "conv_id", "turn", "role")
    want = t.withColumn("role", F.when((F.col("conv_id") % 50 == 0) & (F.col("turn") == 0), "altered").otherwise(F.col("role")))
    return rp.identical_rows(t, want, ["conv_id", "turn"])


@query("WITH f AS (SELECT conv_id AS case_id FROM conversations WHERE role = 'user' AND length(text) % 5 = 0), a AS (SELECT conv_id AS case_id FROM conversations WHERE conv_id % 4 = 0) SELECT DISTINCT case_id, 'flagged_only' AS side FROM f WHERE case_id NOT IN (SELECT case_id FROM a) UNION ALL SELECT DISTINCT case_id, 'missed' FROM a WHERE case_id NOT IN (SELECT case_id FROM f)")
def flagged_exactness(spark, d):
    t = bd.table(spark, d, "conversations").withColumnRenamed("conv_id", "case_id")
    return rp.flagged_exactly(t.where((F.col("role") == "user") & (F.length("text") % 5 == 0)), t.where("case_id % 4 = 0"))
