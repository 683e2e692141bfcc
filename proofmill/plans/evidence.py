"""Queries over the evidence itself: ingest, integrity, facts, rules, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pseudonym
from ..operators import assess as az
from ..operators import catalog as cat
from ..operators import facts as fx
from ..operators import ingest as ing
from ..operators import integrity as it
from ..sources import binding as bd
from . import sql
from .sql import with_

QUERIES, ORACLE = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


def facts(spark: SparkSession, d: str) -> DataFrame:
    return fx.facts(bd.evidence(spark, d, dealt=True), bd.domain(spark), bd.principals(bd.evidence(spark, d)))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and their roles: user_id % 3 says both, deployer or provider."""
    n = F.substring_index("subject", "-", -1).cast("long") % 3
    both = F.array(F.lit("deployer"), F.lit("provider"))
    return bd.event_types(bd.table(spark, d, "events")).select("subject").distinct().select("subject", F.when(n == 0, both).when(n == 1, F.array(F.lit("deployer"))).otherwise(F.array(F.lit("provider"))).alias("roles"))


def assertions(spark: SparkSession, d: str) -> DataFrame:
    return az.assess(bd.evidence(spark, d), facts(spark, d), cat.controls(spark), subjects(spark, d))


INT01 = """, per AS (SELECT subject, count(*) FILTER (executes_consequential) AS applicable, count(*) FILTER (executes_consequential AND source_class <> 'enforcement_point') AS failed FROM facts GROUP BY subject)
SELECT s.subject, coalesce(applicable, 0) AS applicable, coalesce(failed, 0) AS failed, CASE WHEN coalesce(applicable, 0) = 0 THEN 'not_applicable' WHEN failed = 0 THEN 'conformant' ELSE 'non-conformant' END AS outcome
FROM (SELECT DISTINCT subject FROM ev) s LEFT JOIN per USING (subject)"""


@query(with_(sql.EV, sql.FACTS) + INT01)
def int01_by_subject(spark, d):
    """Of each subject's tool calls that carry out a consequential decision: how many no enforcement point recorded."""
    ev = bd.evidence(spark, d)
    flags = bd.domain(spark).where("consequential").select("decision_type")
    dec = ev.where("etype = 'Decision'").join(flags, "decision_type", "left_semi").select("subject", F.col("id").alias("ref_decision"))
    calls = ev.where("etype = 'ToolCall'").join(dec, ["subject", "ref_decision"], "left_semi").select("subject", "source_class")
    got = calls.groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.col("source_class") != "enforcement_point").alias("bad"))
    out = bd.event_types(bd.table(spark, d, "events")).select("subject").distinct().join(got, "subject", "left").withColumns({"applicable": F.coalesce("n", F.lit(0)), "failed": F.coalesce("bad", F.lit(0))})
    return out.select("subject", "applicable", "failed", F.when(F.col("applicable") == 0, "not_applicable").when(F.col("failed") == 0, "conformant").otherwise("non-conformant").alias("outcome"))


# -- ingest -------------------------------------------------------------------------------------

FEED = """,
f0 AS (SELECT id, subject, ordinal, CASE WHEN n % 211 = 6 THEN 'Heartbeat' ELSE etype END AS etype, CASE WHEN n % 199 = 7 THEN 'src:unknown' ELSE source END AS source, source_class,
    CASE WHEN n % 83 = 4 THEN strftime(strptime(time, '%Y-%m-%dT%H:%M:%S.%gZ') - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') || substr(time, 20) ELSE time END AS time, n FROM ev),
feed AS (SELECT * FROM f0 UNION ALL SELECT id, subject, ordinal + 1, etype, source, source_class, time, n FROM f0 WHERE n % 50 = 0),
local AS (SELECT *, CASE WHEN etype = 'Heartbeat' THEN 'unknown_type' WHEN source = 'src:unknown' THEN 'unknown_source' WHEN source <> 'src:' || source_class THEN 'class_mismatch' END AS r0 FROM feed),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS nth FROM local WHERE r0 IS NULL),
p1 AS (SELECT *, coalesce(time < max(time) OVER (PARTITION BY source ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM g WHERE nth = 1),
p2in AS (SELECT id, ordinal, source, time, subject, etype FROM p1 WHERE NOT late UNION ALL SELECT g.id, g.ordinal, g.source, g.time, g.subject, g.etype FROM g JOIN p1 ON p1.id = g.id AND p1.late WHERE g.nth = 2),
p2 AS (SELECT *, coalesce(time < max(time) OVER (PARTITION BY source ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM p2in),
judged AS (SELECT id, ordinal, source, late FROM p2 UNION ALL SELECT id, ordinal, source, true FROM p1 WHERE late),
final AS (SELECT source, CASE WHEN late THEN 'time_order' END AS reason FROM judged
    UNION ALL SELECT g.source, 'duplicate_id' FROM g LEFT JOIN judged j ON j.id = g.id AND j.ordinal = g.ordinal WHERE j.id IS NULL UNION ALL SELECT source, r0 FROM local WHERE r0 IS NOT NULL)"""


def feed(spark, d):
    return ing.ingest(bd.raw_feed(spark, d), bd.sources(spark))


@query(with_(sql.EV) + FEED + "\nSELECT coalesce(reason, 'accepted') AS reason, count(*) AS events FROM final GROUP BY ALL")
def quarantine_by_reason(spark, d):
    return feed(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("events"))


@query(with_(sql.EV) + FEED + "\nSELECT source, count(*) AS accepted FROM final WHERE reason IS NULL GROUP BY source")
def accepted_by_source(spark, d):
    return feed(spark, d).where("reason is null").groupBy("source").agg(F.count("*").alias("accepted"))


# -- graph facts ---------------------------------------------------------------------------------


@query(with_(sql.EV, sql.DANGLING) + "SELECT subject, id, ref FROM dangling")
def dangling_refs(spark, d):
    return fx.dangling(bd.evidence(spark, d))


def flag_query(name: str, columns: str, where: str):
    def run(spark, d):
        return facts(spark, d).where(where).select("subject", "id", *columns.split(", "))

    run.__name__ = name
    run.__doc__ = f"{columns} of each {where}."
    query(with_(sql.EV, sql.FACTS) + f"SELECT subject, id, {columns} FROM facts WHERE {where}")(run)


flag_query("executes_consequential", "executes_consequential", "target = 'ToolCall'")
flag_query("oversight_match", "modality_ok", "target = 'Decision'")
flag_query("scope_budget_flags", "within_scope, within_budget", "target = 'ToolCall'")
flag_query("acts_on_untrusted", "acts_on_untrusted", "target in ('ToolCall', 'Decision')")
flag_query("delegation_verified", "delegation_verified", "target = 'ToolCall'")
flag_query("decision_links", "n_reviewed, n_notified, n_resulted", "target = 'Decision'")
flag_query("instruction_links", "instruction_untrusted, n_refused", "target = 'Instruction'")


@query(
    """WITH RECURSIVE up AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'World' FROM region),
c AS (SELECT child AS descendant, child AS ancestor FROM up UNION SELECT 'World', 'World' UNION SELECT c.descendant, up.parent FROM c JOIN up ON c.ancestor = up.child)
SELECT ancestor, count(*) AS customers, count(DISTINCT descendant) AS classes FROM c JOIN nation ON n_name = descendant JOIN customer ON c_nationkey = n_nationkey GROUP BY ancestor"""
)
def class_members(spark, d):
    """Members of each class under the reflexive-transitive closure: customers by nation, region and world."""
    nation, region = bd.table(spark, d, "nation"), bd.table(spark, d, "region")
    up = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    up = up.union(region.select("r_name", F.lit("World")))
    own = bd.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("descendant"))
    return own.join(fx.class_closure(up), "descendant").groupBy("ancestor").agg(F.count("*").alias("customers"), F.count_distinct("descendant").alias("classes"))


@query(
    with_(sql.EV)
    + """, rv AS (SELECT DISTINCT subject, ref_decision AS id FROM ev WHERE etype = 'ApprovalDecided'),
dd AS (SELECT ev.subject, ev.id, decision_type, time, CASE WHEN rv.id IS NOT NULL THEN ev.id END AS seen FROM ev LEFT JOIN rv ON rv.subject = ev.subject AND rv.id = ev.id WHERE etype = 'Decision'),
pb AS (SELECT subject, id, last_value(seen IGNORE NULLS) OVER (PARTITION BY subject, decision_type ORDER BY time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceded_by FROM dd)
SELECT subject, id, preceded_by FROM pb WHERE preceded_by IS NOT NULL"""
)
def preceded_by(spark, d):
    """The nearest earlier reviewed decision of the same subject and type."""
    from pyspark.sql import Window

    ev = bd.evidence(spark, d)
    reviewed = ev.where("etype = 'ApprovalDecided'").select("subject", F.col("ref_decision").alias("id"), F.col("ref_decision").alias("seen")).where("id is not null").distinct()
    dec = ev.where("etype = 'Decision'").select("subject", "id", "decision_type", "time").join(reviewed, ["subject", "id"], "left")
    w = Window.partitionBy("subject", "decision_type").orderBy("time", "id").rowsBetween(Window.unboundedPreceding, -1)
    return dec.select("subject", "id", F.last("seen", ignorenulls=True).over(w).alias("preceded_by")).where("preceded_by is not null")


EDGES = """, e AS (SELECT subject, id AS s, 'type' AS p, etype AS o FROM ev UNION SELECT subject, id, 'type', decision_type FROM ev UNION SELECT subject, id, 'sourceClass', source_class FROM ev UNION SELECT subject, id, 'wasAssociatedWith', agent FROM ev
UNION SELECT subject, id, 'authorizedBy', ref_authorization FROM ev UNION SELECT subject, id, 'authorizedBy', ref_request FROM ev UNION SELECT subject, id, 'delegatedVia', ref_delegation FROM ev UNION SELECT subject, id, 'actsOn', ref_instruction FROM ev
UNION SELECT subject, id, 'executes', ref_decision FROM ev WHERE etype = 'ToolCall' UNION SELECT subject, ref_decision, 'resultedIn', id FROM ev WHERE etype = 'Outcome' UNION SELECT subject, ref_decision, 'reviewedBy', id FROM ev WHERE etype = 'ApprovalDecided'
UNION SELECT subject, ref_decision, 'notifiedBy', id FROM ev WHERE etype = 'Notice' UNION SELECT subject, ref_instruction, 'refusedBy', id FROM ev WHERE etype = 'Refusal' UNION SELECT subject, id, 'used', unnest(used) FROM ev
UNION SELECT subject, agent, 'actedOnBehalfOf', terminus FROM ev WHERE terminus IS NOT NULL UNION SELECT subject, agent, 'type', 'Agent' FROM ev UNION SELECT subject, unnest(used), 'type', 'ContextItem' FROM ev)"""


@query(with_(sql.EV) + EDGES + """
SELECT subject, p, count(*) AS edges, count(DISTINCT s) AS sources, count(DISTINCT o) AS targets FROM e WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY subject, p""")
def edges_build(spark, d):
    """Typed links of each subject's graph, counted by predicate."""
    return fx.edge_counts(fx.edges(bd.evidence(spark, d, dealt=True)))


@query(with_(sql.EV) + "SELECT subject, id, 'principal:' || sha256(unhex(repeat('5C', 64)) || unhex(sha256(unhex(repeat('36', 64)) || encode(terminus)))) AS terminus FROM ev WHERE terminus IS NOT NULL")
def chain_terminus(spark, d):
    """Pseudonym of the last principal in each tool call's delegation chain."""
    ev = bd.evidence(spark, d).where(F.size("acted_for") > 0)
    return ev.select("subject", "id", pseudonym(F.element_at("acted_for", -1)).alias("terminus"))


# -- integrity -----------------------------------------------------------------------------------

CHAIN = """, t AS (SELECT source || '|' || subject AS stream, id, ordinal, time, n, sha256(concat_ws('|', id, subject, etype, k)) AS content_hash FROM ev),
h AS (SELECT *, CASE WHEN n % 997 = 3 THEN sha256('tampered') ELSE content_hash END AS hash FROM t),
c AS (SELECT *, CASE WHEN n % 1009 = 5 THEN sha256('gap') ELSE lag(hash, 1, repeat('0', 64)) OVER w END AS prev, lag(hash, 1, repeat('0', 64)) OVER w AS back, row_number() OVER w - 1 AS idx FROM h WINDOW w AS (PARTITION BY stream ORDER BY ordinal)),
m AS (SELECT c.*, hash <> content_hash AS broken, prev <> back AS unlinked, prev <> back AND prev <> repeat('0', 64) AND NOT EXISTS (SELECT 1 FROM c x WHERE x.stream = c.stream AND x.hash = c.prev) AS gap FROM c)"""


@query(
    with_(sql.EV)
    + CHAIN
    + """, s AS (SELECT stream, count(*) AS n_events, min(idx) FILTER (broken) AS f, min(idx) FILTER (unlinked) AS l, arg_min(gap, idx) FILTER (unlinked) AS g FROM m GROUP BY stream)
SELECT stream, 'export_chained' AS strength, CASE WHEN f IS NOT NULL THEN 'failed' WHEN l IS NOT NULL THEN CASE WHEN g THEN 'gap' ELSE 'reordered' END ELSE 'verified_weak' END AS status, coalesce(f, l) AS first_bad_index, n_events FROM s"""
)
def chain_status(spark, d):
    return it.stream_status(bd.chain(spark, d))


ANCHORS = ", an AS (SELECT stream, max(time) AS anchor_time FROM t WHERE n % 3 <> 0 GROUP BY stream)"


def anchors(spark, d):
    """Newest anchor of each stream: the time of its last event whose number is no multiple of three."""
    return bd.chain(spark, d).where("(ordinal / 2) % 3 <> 0").groupBy("stream").agg(F.max("time").alias("anchor_time"))


@query(
    with_(sql.EV)
    + CHAIN
    + ANCHORS
    + """, s AS (SELECT m.stream, min(idx) FILTER (broken) AS f, min(idx) FILTER (unlinked) AS l, min(idx) FILTER (time > anchor_time) AS t FROM m LEFT JOIN an USING (stream) GROUP BY m.stream)
SELECT stream, t AS first_bad_index FROM s WHERE f IS NULL AND l IS NULL AND t IS NOT NULL"""
)
def late_anchor(spark, d):
    """Streams sound but for an event later than their newest anchor."""
    return it.stream_status(bd.chain(spark, d), anchors(spark, d)).where("status = 'time_suspect'").select("stream", "first_bad_index")


# -- rules and outcomes --------------------------------------------------------------------------


@query(with_(sql.EV, sql.FACTS, sql.SIGS) + "SELECT subject, checks, count(*) AS applicable, count(*) FILTER (NOT ok) AS failed FROM sigs GROUP BY ALL")
def sig_facts(spark, d):
    """Population and failures of each of the 22 checks, by subject."""
    return fx.check_counts(facts(spark, d), sorted(fx.SIGNATURES)).where("applicable > 0")


@query(with_(sql.EV, sql.ASSERT) + "SELECT subject, catalog, control, outcome, applicable, failed, array_to_string(missing, ',') AS missing FROM asr")
def control_outcomes(spark, d):
    """Outcome of each of the 67 controls for each subject."""
    return assertions(spark, d).select("subject", "catalog", "control", "outcome", "applicable", "failed", F.array_join("missing", ",").alias("missing"))


@query(
    with_(sql.EV, sql.FACTS, sql.SIGS, sql.CONTROLS)
    + ", cs AS (SELECT catalog, control, unnest(string_split(checks, '+')) AS s FROM controls WHERE rung = 2 AND checks IS NOT NULL)\nSELECT subject, catalog, control, id AS focus, checks AS \"check\" FROM sigs JOIN cs ON cs.s = sigs.checks WHERE NOT ok"
)
def violations(spark, d):
    return az.violations(facts(spark, d), cat.controls(spark))


@query(
    with_(sql.EV, sql.FACTS, sql.CHECKS)
    + """, a AS (SELECT *, bool_or(NOT ok) OVER (PARTITION BY subject, checks) AS bad FROM chk), r AS (SELECT *, row_number() OVER (PARTITION BY subject, checks ORDER BY id) AS n FROM a WHERE (NOT ok) = bad)
SELECT r.subject, checks, r.id AS focus, ev.source_class, bad AS failing FROM r JOIN ev ON ev.subject = r.subject AND ev.id = r.id WHERE r.n <= 20"""
)
def evidence_pointers(spark, d):
    ev = bd.evidence(spark, d)
    return az.evidence_pointers(ev, facts(spark, d), sql.ALL_CHECKS)


@query(with_(sql.EV, sql.ASSERT) + "SELECT subject, catalog, control, m AS missing FROM asr, unnest(missing) AS t(m) WHERE outcome = 'insufficient_evidence'")
def min_evidence_gap(spark, d):
    return assertions(spark, d).where("outcome = 'insufficient_evidence'").select("subject", "catalog", "control", F.explode("missing").alias("missing"))


@query(
    with_(sql.EV, sql.FACTS)
    + """SELECT d.subject, d.id, ev.agent IS NOT NULL AS has_role, n_used AS n_inputs, n_reviewed, n_reviewed > 0 OR coalesce(ev.terminus LIKE 'human-%', false) AS human_ok,
n_used > 0 AND n_reviewed > 0 AS reconstructable FROM facts d JOIN ev ON ev.subject = d.subject AND ev.id = d.id WHERE target = 'Decision' AND flag_consequential"""
)
def narrative_slots(spark, d):
    """What can be told of each consequential decision: agent, inputs, human part."""
    f = facts(spark, d).where("target = 'Decision' and flag_consequential")
    human = (F.col("n_reviewed") > 0) | F.col("terminus_human")
    return f.select("subject", "id", (F.col("n_agent") > 0).alias("has_role"), F.col("n_used").alias("n_inputs"), "n_reviewed", human.alias("human_ok"), ((F.col("n_used") > 0) & (F.col("n_reviewed") > 0)).alias("reconstructable"))
