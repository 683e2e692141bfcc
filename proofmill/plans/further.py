"""Queries over payloads, user rules, narratives, signatures, held-out truth and the remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess as az
from ..operators import catalog as cat
from ..operators import coverage as cv
from ..operators import facts as fx
from ..operators import governance as gv
from ..operators import ingest as ing
from ..operators import integrity as it
from ..operators import loading as ld
from ..operators import metrics as mt
from ..operators import narrative as nv
from ..operators import schema as sc
from ..operators import summary as sm
from ..sources import binding as bd
from . import sql
from .evidence import CHAIN, EDGES, assertions, facts, subjects
from .general import graph
from .measures import ASR, COVER, LAB, denominators, exact, interval_sql, labelled
from .sql import with_

QUERIES, ORACLE = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


# -- payloads ---------------------------------------------------------------------------------------

PAYLOAD = """,
pay AS (SELECT *, '{"agent": ' || CASE WHEN k % 19 = 0 THEN '{"name": "x"}' WHEN k % 23 = 0 THEN '{"id": 7}' ELSE '{"id": "a"}' END || ', "decision": "' || CASE WHEN k % 9 = 0 THEN 'maybe' WHEN k % 2 = 0 THEN 'deny' ELSE 'allow' END
    || '", "latency_ms": ' || CASE WHEN k % 13 = 0 THEN '"slow"' WHEN k % 13 = 1 THEN '1.5' ELSE k::VARCHAR END || ', "explanation_viewed": ' || CASE WHEN k % 17 = 0 THEN '"yes"' ELSE 'true' END
    || ', "integrity": {"hash": "h", "prev": "p", "stream": "st-' || (k % 4) || '", "strength": "' || CASE WHEN k % 29 = 0 THEN 'none' ELSE 'export_chained' END || '"}}' AS data FROM ev)"""


def payloads(spark, d):
    """The evidence with a JSON payload, some of whose members break the rules."""
    k = F.col("k")
    when = lambda n, m, text, other: F.when(k % n == m, text).otherwise(other)
    data = F.concat(
        F.lit('{"agent": '), when(19, 0, '{"name": "x"}', when(23, 0, '{"id": 7}', F.lit('{"id": "a"}'))), F.lit(', "decision": "'), when(9, 0, "maybe", when(2, 0, "deny", F.lit("allow"))),
        F.lit('", "latency_ms": '), when(13, 0, '"slow"', when(13, 1, "1.5", k.cast("string"))), F.lit(', "explanation_viewed": '), when(17, 0, '"yes"', F.lit("true")),
        F.lit(', "integrity": {"hash": "h", "prev": "p", "stream": "st-'), (k % 4).cast("string"), F.lit('", "strength": "'), when(29, 0, "none", F.lit("export_chained")), F.lit('"}}'),
    )
    return bd.evidence(spark, d).withColumn("data", data)


@query(
    with_(sql.EV)
    + PAYLOAD
    + """, er AS (SELECT etype, CASE WHEN k % 23 = 0 AND k % 19 <> 0 THEN 'agent.id is not of kind text' WHEN k % 29 = 0 THEN 'integrity.strength has no allowed value'
WHEN etype = 'PolicyDecision' AND k % 9 = 0 THEN 'decision has no allowed value' WHEN etype = 'ApprovalDecided' AND k % 13 IN (0, 1) THEN 'latency_ms is not of kind integer'
WHEN etype = 'ApprovalDecided' AND k % 17 = 0 THEN 'explanation_viewed is not of kind boolean' WHEN json_extract(data, '$.agent.id') IS NULL THEN 'agent.id is missing' END AS error FROM pay)
SELECT etype, error, count(*) AS events FROM er WHERE error IS NOT NULL GROUP BY ALL"""
)
def payload_errors(spark, d):
    """First broken rule of each event's payload, counted by event type."""
    got = sc.payload_errors(payloads(spark, d)).withColumn("error", F.try_element_at("errors", F.lit(1))).where("error is not null")
    return got.groupBy("etype", "error").agg(F.count("*").alias("events"))


@query(
    with_(sql.EV)
    + PAYLOAD
    + ", g AS (SELECT coalesce(data ->> '$.integrity.strength', 'None') AS s, coalesce(data ->> '$.agent.id', 'None') AS a, latency_ms AS v FROM pay WHERE etype = 'ApprovalDecided' AND data ->> '$.decision' = 'deny')\nSELECT s AS by_strength, a AS by_who, "
    + exact("sum(v)", "count(*)", "count(*)", "sum(v) <= 20000 * count(*)", 2)
    + " FROM g GROUP BY s, a"
)
def payload_projection(spark, d):
    """A metric filtered and grouped by dotted paths of the payload; a missing member groups as None."""
    rows = sc.projected(payloads(spark, d), {"strength": "integrity.strength", "who": "agent.id", "verdict": "decision"})
    spec = {"where": {"etype": "ApprovalDecided", "verdict": "deny"}, "group_by": ["strength", "who"], "statistic": {"kind": "mean", "field": "latency_ms"}, "threshold": ("<=", 20000, 1), "min_population": 2}
    return mt.evaluate_metric(rows, spec)


STREAMED = """,
sf AS (SELECT id, 2 * n AS ordinal, CASE WHEN n % 7 = 3 THEN strftime(strptime(time, '%Y-%m-%dT%H:%M:%S.%gZ') - to_hours((n % 48)::INT), '%Y-%m-%dT%H:%M:%S') || substr(time, 20) ELSE time END AS time, k % 4 AS st, n, k % 29 = 0 AS bad FROM pay),
ff AS (SELECT id, ordinal, time, st, n, bad FROM sf UNION ALL SELECT id, ordinal + 1, CASE WHEN n % 2 = 0 THEN strftime(strptime(time, '%Y-%m-%dT%H:%M:%S.%gZ') + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || substr(time, 20) ELSE time END, st, n, bad FROM sf WHERE n % 7 = 3),
fr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ordinal) AS rn, *, n % 7 = 3 AS twice FROM ff WHERE NOT bad),
walk AS (SELECT 0::BIGINT AS rn, ['', '', '', '']::VARCHAR[] AS m, []::VARCHAR[] AS taken, -1 AS st, 'start' AS reason
    UNION ALL SELECT rn, CASE WHEN reason = 'accepted' THEN [CASE WHEN st = 0 THEN greatest(m[1], time) ELSE m[1] END, CASE WHEN st = 1 THEN greatest(m[2], time) ELSE m[2] END, CASE WHEN st = 2 THEN greatest(m[3], time) ELSE m[3] END, CASE WHEN st = 3 THEN greatest(m[4], time) ELSE m[4] END] ELSE m END,
        CASE WHEN reason = 'accepted' AND twice THEN list_append(taken, id) ELSE taken END, st, reason
    FROM (SELECT fr.rn, w.m, w.taken, fr.st, fr.time, fr.id, fr.twice, CASE WHEN fr.twice AND list_contains(w.taken, fr.id) THEN 'duplicate_id' WHEN fr.time < w.m[fr.st + 1] THEN 'time_order' ELSE 'accepted' END AS reason FROM walk w JOIN fr ON fr.rn = w.rn + 1))"""


def streamed(spark, d):
    """Arrivals in four streams named by the payload: late clocks, broken payloads, and copies whose time differs from the first one's."""
    strength = [r for r in sc.member_rules() if r["path"] == "integrity.strength"]
    rows = sc.payload_errors(sc.with_stream(payloads(spark, d)), strength).withColumn("n", F.expr("ordinal div 2"))
    stamp, form = F.to_timestamp_ntz(F.substring("time", 1, 23), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), "yyyy-MM-dd'T'HH:mm:ss.SSS"
    moved = lambda h: F.concat(F.date_format(stamp + F.make_interval(hours=h), form), F.lit("Z"))
    rows = rows.withColumn("time", F.when(F.col("n") % 7 == 3, moved(-(F.col("n") % 48).cast("int"))).otherwise(F.col("time")))
    copies = rows.where("n % 7 = 3").withColumn("ordinal", F.col("ordinal") + 1).withColumn("time", F.when(F.col("n") % 2 == 0, moved(F.lit(2))).otherwise(F.col("time")))
    return rows.union(copies)


@query(with_(sql.EV).replace("WITH ", "WITH RECURSIVE ", 1) + PAYLOAD + STREAMED + "\nSELECT 'st-' || st AS stream, reason, count(*) AS events FROM (SELECT st, reason FROM walk WHERE rn > 0 UNION ALL SELECT st, 'schema_invalid' FROM ff WHERE bad) GROUP BY ALL")
def ingest_streams(spark, d):
    """Identity and order by the payload's own streams, against one pass in order of arrival."""
    got = ing.ingest(streamed(spark, d))
    return got.groupBy("stream", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("events"))


# -- rules of users -----------------------------------------------------------------------------------


def own_controls(spark):
    """The catalogue as a user's table: graver controls tolerate a tenth of their population, others two failures."""
    ratio = F.struct(F.lit("ratio").alias("kind"), F.lit("0.1").alias("max"))
    return ld.checked_controls(cat.controls(spark).withColumn("tolerance", F.when(F.col("severity") == "high", ratio).otherwise(F.struct(F.lit("count").alias("kind"), F.lit("2").alias("max")))))


@query(
    ASR
    + """SELECT subject, catalog, control, CASE WHEN NOT role_ok THEN 'not_applicable' WHEN rung <> 2 OR checks IS NULL THEN 'not_assessed' WHEN na = 0 THEN 'not_applicable' WHEN len(missing) > 0 THEN 'insufficient_evidence'
WHEN CASE WHEN severity = 'high' THEN 10 * nf <= na ELSE nf <= 2 END THEN 'conformant' ELSE 'non-conformant' END AS outcome FROM a0"""
)
def tolerant_outcomes(spark, d):
    """Outcomes under a user's own control table, with tolerances as a ratio and as a count."""
    ev = bd.evidence(spark, d)
    return az.assess(ev, facts(spark, d), own_controls(spark), subjects(spark, d)).select("subject", "catalog", "control", "outcome")


@query(
    with_(sql.EV)
    + """SELECT subject, CASE WHEN min(user_id) % 4 = 0 THEN '2024-01-01T00:00:00Z' ELSE coalesce(min(time) FILTER (etype = 'Incident'), '1970-01-01T00:00:00Z') END AS start,
CASE WHEN min(user_id) % 4 = 0 THEN '2024-12-31T00:00:00Z' ELSE coalesce(max(time) FILTER (etype = 'Incident'), '1970-01-01T00:00:00Z') END AS "end" FROM ev GROUP BY subject"""
)
def observation_windows(spark, d):
    """Declared for every fourth subject; else from the first to the last incident, or the epoch."""
    ev = bd.evidence(spark, d)
    given = lambda v: F.when(F.substring_index("subject", "-", -1).cast("long") % 4 == 0, v)
    profile = ev.select("subject").distinct().select("subject", given("2024-01-01T00:00:00Z").alias("start"), given("2024-12-31T00:00:00Z").alias("end"))
    return ld.observation_window(ev.where("etype = 'Incident'"), profile)


@query(
    ASR
    + """, f AS (SELECT DISTINCT c.subject, c.checks FROM (SELECT subject, checks, id, bool_or(NOT ok) OVER (PARTITION BY subject, checks) AS bad, ok FROM chk) c JOIN ev ON ev.subject = c.subject AND ev.id = c.id WHERE (NOT c.ok) = c.bad AND ev.source_class <> 'self_report')
SELECT a.subject, catalog, control, outcome FROM asr a LEFT JOIN f ON f.subject = a.subject AND f.checks = a.checks WHERE outcome IN ('conformant', 'non-conformant', 'partial') AND f.subject IS NULL"""
)
def uncited_verdicts(spark, d):
    """Verdicts for which no event beyond a self report can be cited."""
    ev = bd.evidence(spark, d)
    rows = facts(spark, d)
    cited = az.evidence_pointers(ev, rows, sql.ALL_CHECKS, limit=1 << 30).where("source_class <> 'self_report'")
    return az.uncited(az.assess(ev, rows, cat.controls(spark), subjects(spark, d)), cited)


# -- integrity ----------------------------------------------------------------------------------------


@query(
    with_(sql.EV)
    + CHAIN
    + """, sg AS (SELECT m.*, CASE WHEN split_part(stream, '|', 1) = 'src:enforcement_point' THEN 'source_signed' WHEN split_part(stream, '|', 1) = 'src:self_report' THEN 'export_anchored' ELSE 'export_chained' END AS strength,
    n % 40 < (SELECT count(DISTINCT s_suppkey % 40) FROM supplier) AND n % 3 <> 0 AS signed FROM m),
s AS (SELECT stream, strength, count(*) AS n_events, bool_and(signed) AS signed, count(*) FILTER (signed) AS n_signed, min(idx) FILTER (broken) AS f, min(idx) FILTER (unlinked) AS l, arg_min(gap, idx) FILTER (unlinked) AS g FROM sg GROUP BY ALL)
SELECT stream, strength, n_events, n_signed, CASE WHEN f IS NOT NULL THEN 'failed' WHEN l IS NOT NULL THEN CASE WHEN g THEN 'gap' ELSE 'reordered' END WHEN strength = 'source_signed' THEN CASE WHEN signed THEN 'verified' ELSE 'unsigned' END WHEN strength = 'export_anchored' THEN 'verified' ELSE 'verified_weak' END AS status FROM s"""
)
def signed_streams(spark, d):
    """Streams of three strengths: signed ones need a signature file for every event, anchored ones an anchor."""
    rows = bd.chain(spark, d).withColumn("n", F.expr("ordinal div 2"))
    who = F.substring_index("stream", "|", 1)
    rows = rows.withColumn("strength", F.when(who == "src:enforcement_point", "source_signed").when(who == "src:self_report", "export_anchored").otherwise("export_chained"))
    files = bd.table(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("k")).distinct()
    files = files.agg(F.count("*").alias("c")).select(F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("k")).select(F.concat(F.lit("sig/"), "k").alias("path"))
    rows = it.signatures(rows.withColumn("sig_ref", F.when(F.col("n") % 3 != 0, F.concat(F.lit("sig/"), F.col("n") % 40))), files)
    anchors = rows.groupBy("stream").agg(F.max("time").alias("anchor_time"))
    return it.stream_status(rows, anchors).drop("first_bad_index").join(rows.groupBy("stream").agg(F.count_if("signed").alias("n_signed")), "stream")


# -- coverage, truth, probes --------------------------------------------------------------------------


@query(
    with_(sql.EV)
    + COVER.replace("tot AS (SELECT count(*) AS n FROM ev WHERE source = 'src:enforcement_point' AND etype = 'ToolCall')", "tot AS (SELECT count(*) AS n FROM ev WHERE etype = 'ToolCall')")
    + "\nSELECT subject, etype, observed, expected, ratio, status, denominators FROM cov"
)
def coverage_by_manifest(spark, d):
    """Coverage against the counts that a denominator's manifest states, here all tool calls."""
    ev = bd.evidence(spark, d)
    stated = ev.where("etype = 'ToolCall'").groupBy("etype").agg(F.count("*").alias("n")).withColumn("source", F.lit("src:enforcement_point"))
    return cv.coverage(ev, denominators(spark, d), manifests=stated)


@query(
    ASR
    + """, o AS (SELECT subject, outcome, cast(split_part(subject, '-', 2) AS BIGINT) AS u FROM asr WHERE control = 'INT-01')
SELECT count(*) FILTER (u % 3 = 2 AND u % 2 = 1) AS seeded, count(*) FILTER (u % 3 = 2 AND u % 2 = 1 AND outcome = 'non-conformant') AS detected, count(*) FILTER (u % 3 = 1) AS adversarial_controls, coalesce(bool_and(outcome = 'non-conformant') FILTER (u % 3 = 1), true) AS adversarial_match FROM o"""
)
def held_out_recall(spark, d):
    """Rule INT-01 on the held-out and the adversarial group of the binding's ground truth."""
    u = F.substring_index("subject", "-", -1).cast("long")
    truth = subjects(spark, d).select(F.col("subject").alias("project"), F.lit("INT-01").alias("control"), F.when((u % 3 == 1) | (u % 2 == 1), "non-conformant").otherwise("conformant").alias("expected"), F.when(u % 3 == 2, "held-out").when(u % 3 == 1, "adversarial").otherwise("open").alias("group"))
    return sm.held_out(truth, assertions(spark, d).where("control = 'INT-01'").select(F.col("subject").alias("project"), "control", "outcome"))


@query(
    """WITH bad AS (SELECT DISTINCT u.conv_id FROM conversations u WHERE u.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')),
c AS (SELECT conv_id % 10 AS bucket, count(*) AS total, count(*) FILTER (conv_id IN (SELECT conv_id FROM bad)) AS failed FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1)
SELECT bucket, total, failed, CASE WHEN failed * 2 <= total THEN 'pass' ELSE 'fail' END AS outcome FROM c"""
)
def probe_structural(spark, d):
    """Probe cases judged by a rule over their own graph: every user turn is answered by the turn after it."""
    t = bd.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("subject"), F.concat(F.lit("t"), "turn").alias("s"), "turn", "role", "conv_id")
    kinds = t.select("subject", "s", F.lit("type").alias("p"), F.initcap("role").alias("o"))
    answers = t.where("role = 'assistant'").select("subject", F.concat(F.lit("t"), F.col("turn") - 1).alias("s"), F.lit("answeredBy").alias("p"), F.col("s").alias("o"))
    links = kinds.union(answers).distinct()
    literals = links.select("subject", "s", "p", F.col("o").alias("value"), F.lit("string").alias("datatype")).limit(0)
    closure = fx.class_closure(spark.createDataFrame([("User", "Turn"), ("Assistant", "Turn")], "child string, parent string"))
    bad = mt.structural_failures(links, literals, closure, {"target": "User", "path": ["answeredBy"], "check": ("min_count", 1)})
    cases = t.select("conv_id", F.col("subject").alias("case_id")).distinct().join(bad.withColumn("bad", F.lit(True)), "case_id", "left").withColumn("bucket", F.col("conv_id") % 10)
    return mt.attack_success(cases, F.col("bad"), ["bucket"], ("<=", 1, 2))


@query(interval_sql("(" + ORACLE["probe_structural"] + ")", "bucket, outcome", "failed", "total"))
def probe_interval(spark, d):
    """Exact interval of the attack-success rate of each bucket of cases."""
    return mt.success_interval(probe_structural(spark, d))


@query("SELECT CASE WHEN bool_or(o = 'fail') THEN 'fail' WHEN bool_or(o = 'pass') THEN 'pass' ELSE 'not_assessed' END AS outcome FROM (SELECT CASE WHEN count(*) FILTER (good) * 10 >= count(*) * 9 THEN 'pass' ELSE 'fail' END AS o FROM " + LAB + " GROUP BY lang)")
def metric_overall(spark, d):
    """One outcome over all groups of a metric."""
    return mt.overall(mt.evaluate_metric(labelled(spark, d), {"group_by": ["lang"], "statistic": {"kind": "proportion", "field": "good"}, "threshold": (">=", 9, 10)}))


# -- narratives and reports ---------------------------------------------------------------------------

TOLD = """, nd AS (SELECT e.subject, e.id, e.agent, CASE WHEN e.k % 4 <> 0 THEN 'assist' END AS ai_role, e.used, CASE WHEN e.k % 3 <> 0 THEN ['a', 'b'] ELSE [] END AS options, CASE WHEN e.k % 5 <> 0 THEN 'a' ELSE 'z' END AS chosen FROM facts d JOIN ev e ON e.subject = d.subject AND e.id = d.id WHERE target = 'Decision' AND flag_consequential),
rw AS (SELECT subject, ref_decision AS id, list_sort(list(DISTINCT id)) AS seen FROM ev WHERE etype = 'ApprovalDecided' AND ref_decision IS NOT NULL GROUP BY ALL),
hu AS (SELECT x.subject, x.ref_decision AS id, min(x.terminus) AS ends FROM ev x WHERE x.etype = 'ToolCall' AND x.terminus LIKE 'human-%' AND x.ref_decision IS NOT NULL AND x.k % 6 = 0 GROUP BY ALL),
na AS (SELECT nd.*, seen, ends FROM nd LEFT JOIN rw USING (subject, id) LEFT JOIN hu USING (subject, id)),
sl AS (SELECT subject, id, 'role' AS slot, ai_role IS NOT NULL AS told, CASE WHEN ai_role IS NOT NULL THEN [coalesce(agent, id)] ELSE [id] END AS cites FROM na
UNION ALL SELECT subject, id, 'inputs', len(used) > 0, CASE WHEN len(used) > 0 THEN list_sort(used) ELSE [id] END FROM na
UNION ALL SELECT subject, id, 'options', len(options) > 0, CASE WHEN len(options) > 0 THEN list_transform(options, lambda o: id || '/option/' || o) ELSE [id] END FROM na
UNION ALL SELECT subject, id, 'chosen', list_contains(options, chosen), CASE WHEN list_contains(options, chosen) THEN [id || '/option/' || chosen] ELSE [id] END FROM na
UNION ALL SELECT subject, id, 'human', ends IS NOT NULL OR seen IS NOT NULL, coalesce(CASE WHEN ends IS NOT NULL THEN [ends] ELSE seen END, [id]) FROM na)"""


def told(spark, d, k: int | None = None):
    ev = bd.evidence(spark, d)
    flagged = facts(spark, d).where("target = 'Decision' and flag_consequential").select("subject", "id")
    kk = F.col("k")
    own = ev.join(flagged, ["subject", "id"], "left_semi").select(
        "subject", "id", "agent", F.when(kk % 4 != 0, "assist").alias("ai_role"), "used", F.when(kk % 3 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("options"), F.when(kk % 5 != 0, "a").otherwise("z").alias("chosen")
    )
    reviews = ev.where("etype = 'ApprovalDecided' and ref_decision is not null").select("subject", F.col("ref_decision").alias("id"), F.col("id").alias("review"))
    humans = ev.where("etype = 'ToolCall' and ref_decision is not null and k % 6 = 0").select("subject", F.col("ref_decision").alias("id"), F.element_at("acted_for", -1).alias("principal")).where("principal like 'human-%'")
    return nv.slots(nv.sampled(own, k) if k else own, reviews, humans).withColumn("cites", F.array_join("cites", ","))


@query(with_(sql.EV, sql.FACTS) + TOLD + "\nSELECT subject, id, slot, told, array_to_string(cites, ',') AS cites FROM sl")
def narrative_full(spark, d):
    """The five slots of each consequential decision, each with what it cites."""
    return told(spark, d)


@query(with_(sql.EV, sql.FACTS) + TOLD + "\nSELECT subject, id, slot, told, array_to_string(cites, ',') AS cites FROM sl WHERE id IN (SELECT id FROM nd ORDER BY sha256(id), id LIMIT 50)")
def narrative_sample(spark, d):
    """The same for the fifty decisions with the least digest."""
    return told(spark, d, 50)


@query(with_(sql.EV) + "SELECT DISTINCT subject, agent, 0 AS position, terminus AS principal FROM ev WHERE agent IS NOT NULL AND terminus IS NOT NULL")
def chain_positions(spark, d):
    return nv.chain_index(bd.evidence(spark, d))


@query(
    ASR
    + """, pt AS (SELECT r.subject, list_sort(list(DISTINCT r.id)) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY subject, checks ORDER BY id) AS n FROM (SELECT *, bool_or(NOT ok) OVER (PARTITION BY subject, checks) AS bad FROM chk) WHERE (NOT ok) = bad) r JOIN ev ON ev.subject = r.subject AND ev.id = r.id WHERE r.n <= 20 GROUP BY r.subject)
SELECT a.subject, a.n AS assertions, coalesce(len(refs), 0) AS n_refs, sha256(coalesce(array_to_string(refs, ','), '')) AS refs_sha256 FROM (SELECT subject, count(*) AS n FROM asr GROUP BY subject) a LEFT JOIN pt USING (subject)"""
)
def evidence_packs(spark, d):
    """How many assertions each subject has, and the references that they cite."""
    ev = bd.evidence(spark, d)
    rows = facts(spark, d)
    return sm.packs(az.assess(ev, rows, cat.controls(spark), subjects(spark, d)), az.evidence_pointers(ev, rows, sql.ALL_CHECKS))


@query(ASR + "SELECT subject, catalog, control, outcome, r_name AS framework, n_name AS clause, n_nationkey % 2 = 0 AS verified FROM asr JOIN nation ON n_nationkey % 5 = length(control) % 5 JOIN region ON r_regionkey = n_regionkey WHERE control LIKE 'INT-%'")
def crosswalk_rows(spark, d):
    """Assertions by the clauses that a crosswalk table, here nations and regions, links to their control."""
    names = cat.controls(spark).where("control like 'INT-%'").select("catalog", "control")
    nation, region = bd.table(spark, d, "nation"), bd.table(spark, d, "region")
    clauses = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    links = names.join(clauses, F.col("n_nationkey") % 5 == F.length("control") % 5).select("catalog", "control", F.col("r_name").alias("framework"), F.col("n_name").alias("clause"), (F.col("n_nationkey") % 2 == 0).alias("verified"))
    return sm.crosswalk(assertions(spark, d), links)


@query(
    """WITH o AS (SELECT o_custkey % 3 AS u, o_orderkey, o_orderstatus FROM orders)
SELECT o_orderkey::VARCHAR AS fixture, o_orderstatus AS control, 'conformant' AS expected, 'non-conformant' AS outcome FROM o WHERE u = 0 UNION ALL SELECT o_orderkey::VARCHAR, o_orderstatus, 'conformant', NULL FROM o WHERE u = 1"""
)
def rule_regressions(spark, d):
    """Fixtures (orders) whose rule gives another result than stated, or none."""
    o = bd.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("fixture"), F.col("o_orderstatus").alias("control"), (F.col("o_custkey") % 3).alias("u"))
    results = o.where("u <> 1").select("control", "fixture", F.when(F.col("u") == 0, "non-conformant").otherwise("conformant").alias("outcome"))
    return gv.rule_regression(results, o.select("control", "fixture", F.lit("conformant").alias("expected")))


@query(
    with_(sql.EV)
    + EDGES
    + """, l AS (SELECT subject, id AS s, 'atTime' AS p, time AS value FROM ev WHERE time IS NOT NULL UNION SELECT subject, id, 'chainVerified', CASE WHEN k % 6 <> 0 THEN 'true' ELSE 'false' END FROM ev WHERE etype = 'DelegationIssued' UNION SELECT subject, id, 'latency', latency_ms::VARCHAR FROM ev WHERE latency_ms IS NOT NULL),
x AS (SELECT subject, count(*) AS edges FROM e WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY subject), y AS (SELECT subject, count(*) AS literals FROM l GROUP BY subject)
SELECT subject, edges, literals, edges + literals AS triples FROM x JOIN y USING (subject)"""
)
def triple_count(spark, d):
    """Edges and literals of each subject's graph, each counted once."""
    links, literals, _ = graph(spark, d)
    edges = links.distinct().groupBy("subject").agg(F.count("*").alias("edges"))
    values = literals.distinct().groupBy("subject").agg(F.count("*").alias("literals"))
    return edges.join(values, "subject").withColumn("triples", F.col("edges") + F.col("literals"))
