"""Queries over outcomes and tables: coverage, summaries, statistics, comparison, governance, adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import half_even_ratio
from ..operators import catalog as cat
from ..operators import coverage as cv
from ..operators import governance as gv
from ..operators import integrity as it
from ..operators import metrics as mt
from ..operators import summary as sm
from ..sources import adapters as ad
from ..sources import binding as bd
from . import sql
from .evidence import CHAIN, assertions, subjects
from .sql import with_

QUERIES, ORACLE = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


ASR = with_(sql.EV, sql.ASSERT)
TALLY = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {sm.column(o)}" for o in cat.OUTCOMES)


def before(spark, d):
    """The same assertions over the first half of the events."""
    from ..operators import assess as az
    from ..operators import facts as fx

    ev = half(spark, d)
    return az.assess(ev, fx.facts(half(spark, d, dealt=True), bd.domain(spark), bd.principals(ev)), cat.controls(spark), ev.select("subject").distinct().join(subjects(spark, d), "subject"))


def half(spark, d, dealt=False):
    ev = bd.evidence(spark, d, dealt)
    top = bd.table(spark, d, "events").agg(F.max("event_id").alias("m")).first()["m"] or 0
    return ev.where(F.col("ordinal") < 2 * ((top + 1) // 2))


# -- coverage and applicability -------------------------------------------------------------------

COVER = """, obs AS (SELECT subject, etype, count(*) AS observed FROM ev WHERE source <> 'src:enforcement_point' GROUP BY ALL),
tot AS (SELECT count(*) AS n FROM ev WHERE source = 'src:enforcement_point' AND etype = 'ToolCall'),
exp AS (SELECT DISTINCT subject, 'ToolCall' AS etype, (SELECT n FROM tot) AS expected FROM ev WHERE (SELECT n FROM tot) > 0),
cov AS (SELECT coalesce(o.subject, x.subject) AS subject, coalesce(o.etype, x.etype) AS etype, coalesce(observed, 0) AS observed, expected, CASE WHEN expected IS NOT NULL THEN 'src:enforcement_point' END AS denominators,
    CASE WHEN coalesce(expected, 0) <= 0 THEN 'unknown' WHEN coalesce(observed, 0) * 100 >= expected * 95 THEN 'covered' ELSE 'below_threshold' END AS status,
    CASE WHEN expected > 0 THEN (SELECT (z // 10000)::VARCHAR || '.' || lpad((z % 10000)::VARCHAR, 4, '0') FROM (SELECT q + CASE WHEN 2 * r > expected OR (2 * r = expected AND q % 2 = 1) THEN 1 ELSE 0 END AS z FROM (SELECT (coalesce(observed, 0) * 10000) // expected AS q, (coalesce(observed, 0) * 10000) % expected AS r))) END AS ratio
    FROM obs o FULL JOIN exp x ON x.subject = o.subject AND x.etype = o.etype)"""


def denominators(spark, d):
    own = bd.event_types(bd.table(spark, d, "events")).select("subject").distinct()
    return own.select("subject", F.lit("src:enforcement_point").alias("source"), F.array(F.lit("ToolCall")).alias("covers"))


@query(with_(sql.EV) + COVER + "\nSELECT subject, etype, observed, expected, ratio, status, denominators FROM cov")
def coverage(spark, d):
    """Tool calls captured by self report against the enforcement points' own count."""
    return cv.coverage(bd.evidence(spark, d), denominators(spark, d))


@query(with_(sql.EV) + COVER + "\nSELECT subject, CASE WHEN bool_or(status = 'unknown') THEN 'unknown' WHEN bool_or(status = 'below_threshold') THEN 'gap' ELSE 'ok' END AS coverage_status FROM cov GROUP BY subject")
def coverage_rollup(spark, d):
    return cv.roll_up(cv.coverage(bd.evidence(spark, d), denominators(spark, d)), denominators(spark, d))


@query(
    with_(sql.EV, sql.CONTROLS, sql.ROLES)
    + "SELECT subject, catalog, control, list_has_any(c.roles, s.roles) AS applicable, CASE WHEN list_has_any(c.roles, s.roles) THEN 'role_match' ELSE 'role_mismatch' END AS reason_code, array_to_string(list_sort(list_intersect(c.roles, s.roles)), ',') AS reason_refs FROM subjects s CROSS JOIN controls c"
)
def applicability_matrix(spark, d):
    return cv.applicability(subjects(spark, d), cat.controls(spark))


@query(
    with_(sql.EV)
    + """, declared AS (SELECT DISTINCT subject FROM ev WHERE user_id % 10 <> 9),
o AS (SELECT subject, 'undeclared_decision_type' AS kind, decision_type AS ref FROM ev WHERE decision_type IS NOT NULL UNION SELECT subject, 'undeclared_component', unnest(used) FROM ev)
SELECT subject, kind, ref FROM o WHERE subject IN (SELECT subject FROM declared) AND NOT (ref IN ('dom:Credit', 'dom:Minor') OR (kind = 'undeclared_component' AND try_cast(substr(ref, 5) AS INT) < 40))
UNION ALL SELECT (SELECT min(subject) FROM declared), 'undeclared_subject', subject FROM (SELECT DISTINCT subject FROM ev WHERE user_id % 10 = 9)"""
)
def undeclared(spark, d):
    """Decision types, components and subjects that no profile declares."""
    ev = bd.evidence(spark, d)
    names = ev.select("subject").distinct().where("cast(substring_index(subject, '-', -1) as long) % 10 <> 9")
    kinds = [("undeclared_decision_type", "dom:Credit"), ("undeclared_decision_type", "dom:Minor"), *[("undeclared_component", f"ctx-{k}") for k in range(40)]]
    declared = names.select("subject", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("ref")) for k, r in kinds])).alias("x")).select("subject", "x.*")
    return cv.undeclared(ev, declared)


# -- summaries ------------------------------------------------------------------------------------


@query(ASR + f"SELECT subject, {TALLY} FROM asr GROUP BY subject")
def outcome_tally(spark, d):
    return sm.tally(assertions(spark, d), "subject")


@query(ASR + "SELECT subject, CASE WHEN bool_or(outcome = 'non-conformant') THEN 'non-conformant' WHEN bool_or(outcome IN ('partial', 'insufficient_evidence', 'not_assessed')) THEN 'incomplete' ELSE 'conformant' END AS verdict FROM asr GROUP BY subject")
def verdict(spark, d):
    return sm.verdict(assertions(spark, d), "subject")


@query(ASR + f"SELECT split_part(control, '-', 1) AS family, {TALLY} FROM asr GROUP BY ALL")
def family_outcomes(spark, d):
    return sm.families(assertions(spark, d))


@query(
    ASR
    + """SELECT split_part(control, '-', 1) AS family, count(*) AS controls, count(*) FILTER (mode = 'automated') AS automated, count(*) FILTER (mode = 'semi-automated') AS semi_automated, count(*) FILTER (mode = 'manual') AS manual FROM asr GROUP BY ROLLUP (split_part(control, '-', 1))"""
)
def automation_matrix(spark, d):
    """Assessed pairs by family and by mode, with a total row."""
    return sm.automation(assertions(spark, d))


@query(
    ASR
    + """, g AS (SELECT outcome, list_sort(list(DISTINCT control)) AS c FROM asr WHERE outcome IN ('non-conformant', 'partial', 'insufficient_evidence', 'not_assessed') GROUP BY outcome)
SELECT outcome, array_to_string(c[1:5], ',') AS controls, greatest(len(c) - 5, 0) AS more FROM g"""
)
def top_gaps(spark, d):
    return sm.top_gaps(assertions(spark, d))


@query(ASR + "SELECT subject, catalog, control, outcome, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS severity_rank FROM asr WHERE outcome IN ('non-conformant', 'insufficient_evidence')")
def severity_ranked(spark, d):
    return sm.ranked(assertions(spark, d))


@query(ASR + "SELECT subject, catalog, control, CASE outcome WHEN 'non-conformant' THEN 'error' WHEN 'not_assessed' THEN 'note' ELSE 'warning' END AS level, sha256(concat_ws('|', catalog, control, subject, outcome)) AS fingerprint FROM asr WHERE outcome IN ('non-conformant', 'partial', 'insufficient_evidence', 'not_assessed')")
def finding_rows(spark, d):
    return sm.findings(assertions(spark, d))


@query(ASR + "SELECT subject, catalog, control, sha256(concat_ws('|', subject, catalog, control)) AS observation_id, CASE WHEN outcome = 'conformant' THEN 'satisfied' ELSE 'not-satisfied' END AS state FROM asr")
def observation_rows(spark, d):
    return sm.observations(assertions(spark, d))


@query(ASR + "SELECT subject, count(*) AS tests, count(*) FILTER (outcome <> 'conformant') AS failures FROM asr GROUP BY subject")
def testcase_totals(spark, d):
    return sm.test_cases(assertions(spark, d))


@query(ASR + "SELECT subject, catalog, control, outcome, applicable, failed FROM asr WHERE outcome NOT IN ('not_applicable')")
def export_csv_rows(spark, d):
    """Rows of the flat export; the sink writes them sorted by subject and control."""
    return assertions(spark, d).where("outcome <> 'not_applicable'").select("subject", "catalog", "control", "outcome", "applicable", "failed")


@query(ASR + "SELECT count(*) FILTER ((outcome = 'non-conformant' AND severity = 'high') OR (outcome = 'insufficient_evidence' AND mode = 'automated')) AS matches FROM asr")
def assertion_gate(spark, d):
    return sm.gate(assertions(spark, d), [[("outcome", "non-conformant"), ("severity", "high")], [("outcome", "insufficient_evidence"), ("mode", "automated")]])


BEFORE_AFTER = "WITH b AS MATERIALIZED (" + "WITH " + sql.BEFORE + " SELECT * FROM asr), a AS MATERIALIZED (WITH " + sql.EV + "," + sql.ASSERT + " SELECT * FROM asr)\n"


@query(BEFORE_AFTER + "SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.catalog, b.catalog) AS catalog, coalesce(a.control, b.control) AS control, b.outcome AS before, a.outcome AS after FROM a FULL JOIN b ON a.subject = b.subject AND a.catalog = b.catalog AND a.control = b.control WHERE a.outcome IS DISTINCT FROM b.outcome")
def assertion_diff(spark, d):
    return sm.diff(before(spark, d), assertions(spark, d))


@query(BEFORE_AFTER + "SELECT subject, catalog, control, b.outcome AS previous, a.outcome AS outcome FROM b JOIN a USING (subject, catalog, control) WHERE a.outcome <> b.outcome")
def runtime_drift(spark, d):
    return sm.drift(before(spark, d), assertions(spark, d))


@query(
    with_(sql.EV)
    + ", e0 AS (SELECT time FROM ev WHERE n = (SELECT (max(event_id) + 1) // 2 - 1 FROM events))\nSELECT source || '|' || subject AS stream, count(*) AS late FROM ev WHERE time <= (SELECT time FROM e0) GROUP BY ALL"
)
def late_events(spark, d):
    """Of a new delivery, all events once more, how many per stream fall in the window already closed."""
    ev = bd.evidence(spark, d)
    end = half(spark, d).agg(F.max_by("time", "ordinal").alias("end")).first()["end"]
    from ..operators.state import late_by_stream

    return late_by_stream(ev, end)


@query(
    ASR
    + """, o AS (SELECT subject, outcome, cast(split_part(subject, '-', 2) AS BIGINT) AS u FROM asr WHERE control = 'INT-01')
SELECT count(*) FILTER (u % 3 = 1) AS seeded, count(*) FILTER (u % 3 = 1 AND outcome = 'non-conformant') AS detected, count(*) FILTER (u % 3 = 0) AS negatives, count(*) FILTER (u % 3 = 0 AND outcome = 'non-conformant') AS false_positives FROM o"""
)
def recall_fpr(spark, d):
    """Rule INT-01 against the binding's ground truth, as counts."""
    got = assertions(spark, d).where("control = 'INT-01'").select(F.col("subject").alias("project"), "control", "outcome")
    u = F.substring_index("subject", "-", -1).cast("long") % 3
    truth = subjects(spark, d).select(F.col("subject").alias("project"), F.lit("INT-01").alias("control"), F.when(u == 1, "non-conformant").otherwise("conformant").alias("expected"), F.when(u == 0, "known-pass").otherwise("other").alias("variant"))
    return sm.detection(truth, got)


# -- statistics -----------------------------------------------------------------------------------


def exact(numerator: str, denominator: str, n: str, test: str, few: int = 1) -> str:
    return f"({numerator})::DECIMAL(38,4) AS numerator, ({denominator})::BIGINT AS denominator, {n} AS n, CASE WHEN {n} < {few} OR ({denominator}) = 0 THEN 'not_assessed' WHEN {test} THEN 'pass' ELSE 'fail' END AS outcome"


@query("SELECT o_orderpriority AS by_o_orderpriority, " + exact("count(*)", "1", "count(*)", "count(*) >= 100") + " FROM orders GROUP BY o_orderpriority")
def metric_count(spark, d):
    return mt.evaluate_metric(bd.table(spark, d, "orders"), {"group_by": ["o_orderpriority"], "statistic": {"kind": "count"}, "threshold": (">=", 100, 1)})


@query(with_(sql.EV) + "SELECT subject AS by_subject, " + exact("sum(latency_ms)", "1", "count(*)", "sum(latency_ms) <= 200000", 3) + " FROM ev WHERE etype = 'ApprovalDecided' GROUP BY subject")
def metric_sum(spark, d):
    return mt.evaluate_metric(bd.evidence(spark, d), {"where": {"etype": "ApprovalDecided"}, "group_by": ["subject"], "statistic": {"kind": "sum", "field": "latency_ms"}, "threshold": ("<=", 200000, 1), "min_population": 3})


@query(with_(sql.EV) + "SELECT subject AS by_subject, " + exact("sum(latency_ms)", "count(*)", "count(*)", "sum(latency_ms) <= 20000 * count(*)", 3) + " FROM ev WHERE etype = 'ApprovalDecided' GROUP BY subject")
def metric_mean(spark, d):
    return mt.evaluate_metric(bd.evidence(spark, d), {"where": {"etype": "ApprovalDecided"}, "group_by": ["subject"], "statistic": {"kind": "mean", "field": "latency_ms"}, "threshold": ("<=", 20000, 1), "min_population": 3})


@query(
    """WITH r AS (SELECT l_shipmode_ AS g, q, row_number() OVER (PARTITION BY l_shipmode_ ORDER BY q) AS r, count(*) OVER (PARTITION BY l_shipmode_) AS n FROM (SELECT l_returnflag AS l_shipmode_, cast(round(l_quantity) AS BIGINT) AS q FROM lineitem))
SELECT g AS by_l_returnflag, max(q)::DECIMAL(38,4) AS numerator, 1 AS denominator, max(n) AS n, CASE WHEN max(q) <= 3 THEN 'pass' ELSE 'fail' END AS outcome FROM r WHERE r = greatest(1, least(n, (n * 7 + 99) // 100)) GROUP BY g"""
)
def metric_quantile(spark, d):
    """Nearest-rank 7 % quantile of quantities by return flag."""
    rows = bd.table(spark, d, "lineitem").select("l_returnflag", F.round("l_quantity").cast("long").alias("q"))
    return mt.evaluate_metric(rows, {"group_by": ["l_returnflag"], "statistic": {"kind": "quantile", "field": "q", "q": (7, 100)}, "threshold": ("<=", 3, 1)})


LAB = "(SELECT *, quality = 1 AS good, toxic = 1 AS bad FROM labels JOIN documents USING (doc_id))"


@query("SELECT lang AS by_lang, " + exact("count(*) FILTER (bad)", "count(*) FILTER (good)", "count(*)", "count(*) FILTER (bad) * 5 <= count(*) FILTER (good)") + f" FROM {LAB} GROUP BY lang")
def metric_ratio(spark, d):
    return mt.evaluate_metric(labelled(spark, d), {"group_by": ["lang"], "statistic": {"kind": "ratio", "field": "bad", "of": "good"}, "threshold": ("<=", 1, 5)})


@query("SELECT lang AS by_lang, " + exact("count(*) FILTER (good)", "count(*)", "count(*)", "count(*) FILTER (good) * 10 >= count(*) * 9") + f" FROM {LAB} GROUP BY lang")
def metric_proportion(spark, d):
    return mt.evaluate_metric(labelled(spark, d), {"group_by": ["lang"], "statistic": {"kind": "proportion", "field": "good"}, "threshold": (">=", 9, 10)})


def labelled(spark, d):
    docs = bd.table(spark, d, "documents").select("doc_id", "lang", "source")
    return bd.table(spark, d, "labels").join(docs, "doc_id").withColumns({"good": F.col("quality") == 1, "bad": F.col("toxic") == 1})


def interval_sql(rows: str, keys: str, k: str, n: str) -> str:
    """low and high of k in n for each of ``rows``: how many half steps of the fourth decimal lie before each bound, by both tails."""
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln(p) + ({n} - i) * ln(1 - p))"
    tails = f"SELECT {keys}, {k}, {n}, p, sum({term}) FILTER (i >= {k}) AS up, sum({term}) FILTER (i <= {k}) AS down FROM {rows}, (SELECT (m + 0.5) / 10000 AS p FROM range(10000) t(m)), unnest(range(0, {n} + 1)) AS u(i) GROUP BY ALL"
    return f"SELECT {keys}, {k}, {n}, printf('%.4f', count(*) FILTER (up <= 0.025) / 10000) AS low, printf('%.4f', count(*) FILTER (down > 0.025) / 10000) AS high FROM ({tails}) GROUP BY ALL"


@query(interval_sql(f"(SELECT lang, count(*) FILTER (good) AS k, count(*) AS n FROM {LAB} GROUP BY lang)", "lang", "k", "n"))
def clopper_pearson(spark, d):
    """Exact intervals of the share of good documents by language."""
    got = labelled(spark, d).groupBy("lang").agg(F.count_if("good").alias("k"), F.count("*").alias("n"))
    return mt.with_interval(got, F.col("k"), F.col("n"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey::VARCHAR LIMIT 200")
def hash_sample(spark, d):
    """A fixed sample: the 200 orders with the least digest of their key."""
    return mt.hash_sample(bd.table(spark, d, "orders"), 200, "o_orderkey").select("o_orderkey", "o_custkey")


CASES = """WITH p AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id % 10 AS bucket, count(*) AS total, CASE WHEN count(*) < 5 THEN 0 ELSE count(*) FILTER (length(output) % 3 = 0) END AS failed, CASE WHEN count(*) < 5 THEN 'not_assessed' WHEN count(*) FILTER (length(output) % 3 = 0) * 2 <= count(*) THEN 'pass' ELSE 'fail' END AS outcome FROM p GROUP BY ALL"""


@query(CASES)
def probe_asr(spark, d):
    """Attack-success rate of probe cases made of user turns and the answers that follow."""
    t = bd.table(spark, d, "conversations")
    nxt = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    cases = t.where("role = 'user'").join(nxt, ["conv_id", "turn"]).withColumn("bucket", F.col("conv_id") % 10)
    event = lambda etype, decision, effect: F.struct(F.lit(etype).alias("etype"), F.lit(decision).alias("decision"), F.lit(effect).alias("effect"))
    cases = cases.withColumn("events", F.when(F.length("output") % 3 == 0, F.array(event("ToolCall", None, "write"))).otherwise(F.array(event("ToolCall", None, "read"), event("PolicyDecision", "deny", None))))
    return mt.attack_success(cases, "policy_violation", ["bucket"], ("<=", 1, 2), min_cases=5)


# -- governance -----------------------------------------------------------------------------------

DEV = """, dv AS (SELECT o_orderkey AS deviation_id, (SELECT list(control ORDER BY catalog, control) FROM controls)[1 + o_orderkey % 67] AS control, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'x' END AS reason, 'x' AS compensating_measure, 'p' || (o_custkey % 5) AS owner, 'p' || (o_orderkey % 5) AS approver,
strftime(o_orderdate, '%Y-%m-%d') AS granted, strftime(o_orderdate + to_days((o_orderkey % 250)::INT), '%Y-%m-%d') AS expiry FROM orders),
oc AS (SELECT control, min(outcome) AS outcome FROM asr GROUP BY control)"""


def deviations(spark, d):
    """Deviations made of orders: control by order number, owner and approver by customer and order."""
    names = [r["control"] for r in sorted(cat.control_rows(), key=lambda r: (r["catalog"], r["control"]))]
    o = bd.table(spark, d, "orders")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").alias("deviation_id"),
        F.element_at(F.array(*map(F.lit, names)), (1 + F.col("o_orderkey") % 67).cast("int")).alias("control"),
        F.when(F.col("o_custkey") % 7 == 0, "").otherwise("x").alias("reason"),
        F.lit("x").alias("compensating_measure"),
        F.concat(F.lit("p"), F.col("o_custkey") % 5).alias("owner"),
        F.concat(F.lit("p"), F.col("o_orderkey") % 5).alias("approver"),
        day("o_orderdate").alias("granted"),
        day(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 250).cast("int"))).alias("expiry"),
    )


LINT = """, lint AS (SELECT deviation_id, dv.control, p AS problem FROM dv LEFT JOIN oc USING (control), unnest([
CASE WHEN dv.control LIKE 'INT-%' THEN 'family cannot be deviated' END, CASE WHEN outcome = 'insufficient_evidence' THEN 'evidence gap' END, CASE WHEN outcome NOT IN ('insufficient_evidence', 'non-conformant') THEN 'outcome is not non-conformant' END,
CASE WHEN reason = '' THEN 'missing reason' END, CASE WHEN owner = approver THEN 'approver is the owner' END, CASE WHEN date_diff('day', granted::DATE, expiry::DATE) > 180 THEN 'lifetime too long' END]) AS t(p) WHERE p IS NOT NULL)"""


def lint(spark, d, rows):
    return gv.deviation_lint(deviations(spark, d), cat.controls(spark), rows.groupBy("control").agg(F.min("outcome").alias("outcome")))


@query(ASR + DEV + LINT + "\nSELECT deviation_id, control, problem FROM lint")
def deviation_lint(spark, d):
    return lint(spark, d, assertions(spark, d))


@query(
    ASR
    + DEV
    + LINT
    + COVER
    + CHAIN
    + """, st AS (SELECT stream, min(idx) FILTER (broken) AS f, min(idx) FILTER (unlinked) AS l FROM m GROUP BY stream),
ru AS (SELECT subject, bool_or(status = 'unknown') AS u, bool_or(status = 'below_threshold') AS b FROM cov GROUP BY subject),
x AS (SELECT 'integrity' AS kind, true AS blocks FROM st WHERE f IS NOT NULL OR l IS NOT NULL UNION ALL SELECT 'coverage', true FROM ru WHERE NOT u AND b UNION ALL SELECT 'coverage', true FROM cov WHERE status = 'below_threshold'
UNION ALL SELECT 'evidence', NOT (control LIKE 'INC-%') FROM (SELECT DISTINCT control FROM asr WHERE outcome = 'insufficient_evidence' AND severity = 'high') UNION ALL SELECT 'deviation', true FROM lint)
SELECT kind, blocks, count(*) AS reasons FROM x GROUP BY ALL"""
)
def readiness(spark, d):
    """Reasons against readiness by kind; gaps of family INC are on record."""
    rows = assertions(spark, d)
    cover = cv.coverage(bd.evidence(spark, d), denominators(spark, d))
    noted = cat.controls(spark).where("control like 'INC-%'").select("control")
    nothing = spark.createDataFrame([], "kind string, ref string")
    got = gv.readiness(it.stream_status(bd.chain(spark, d)), cv.roll_up(cover, denominators(spark, d)), cover, nothing, rows, noted, lint(spark, d, rows))
    return got.groupBy("kind", "blocks").agg(F.count("*").alias("reasons"))


@query("SELECT 'make' AS kind, p_brand || '/' || p_type || '/' || floor(p_retailprice / 10)::INT AS ref FROM part WHERE p_size <= 25 EXCEPT SELECT 'make', p_brand || '/' || p_type || '/' || floor(p_retailprice / 10)::INT FROM part WHERE p_size > 25")
def crosswalk_orphans(spark, d):
    """References that nothing defines: brand, type and price together that small parts name and no large part has."""
    p = bd.table(spark, d, "part").select("p_size", F.lit("make").alias("kind"), F.concat_ws("/", "p_brand", "p_type", F.floor(F.col("p_retailprice") / 10).cast("int")).alias("ref"))
    return gv.orphans(p.where("p_size <= 25").drop("p_size"), p.where("p_size > 25").drop("p_size"))


@query(
    """WITH b AS (SELECT p_partkey AS control, ['low', 'medium', 'high'][1 + p_size % 3] AS s0, p_size % 7 AS t0 FROM part), o AS (SELECT l_partkey AS control, 'o' || (l_orderkey % 3) AS catalog, min(l_linenumber) % 3 AS s, max(l_linenumber) AS t FROM lineitem GROUP BY 1, 2),
r AS (SELECT catalog, control, s + 1 < CASE s0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS weaker_severity, t > t0 AS looser_tolerance FROM o JOIN b USING (control)) SELECT * FROM r WHERE weaker_severity OR looser_tolerance"""
)
def overlay_weakening(spark, d):
    """Overlay rows (line items by part) that relax a base rule (part)."""
    names = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    base = bd.table(spark, d, "part").select(F.col("p_partkey").alias("control"), F.get(names, F.col("p_size") % 3).alias("severity"), (F.col("p_size") % 7).alias("tolerance"))
    over = bd.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("control"), F.concat(F.lit("o"), F.col("l_orderkey") % 3).alias("catalog")).agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("tolerance"))
    return gv.overlay_weakening(base, over.withColumn("severity", F.get(names, F.col("a") % 3)))


@query(
    ASR
    + """, sup AS (SELECT x AS missing, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ev, unnest([etype, etype || ':' || source_class]) AS t(x) GROUP BY x)
SELECT subject, catalog, control, q AS missing, coalesce(sources, '') AS sources FROM asr, unnest(asr.missing) AS t(q) LEFT JOIN sup ON sup.missing = q WHERE outcome = 'insufficient_evidence'"""
)
def insufficient_causes(spark, d):
    ev = bd.evidence(spark, d)
    support = ev.select("source", F.explode(F.array(F.col("etype"), F.concat_ws(":", "etype", "source_class"))).alias("missing")).distinct()
    return gv.insufficient_causes(assertions(spark, d), support)


@query(
    """WITH r AS (SELECT l_returnflag AS g, count(*) FILTER (l_tax > l_discount) AS a, count(*) AS b FROM lineitem GROUP BY 1), q AS (SELECT g, a, b, (a * 10000) // b AS q, (a * 10000) % b AS r FROM r)
SELECT g AS l_returnflag, (z // 10000)::VARCHAR || '.' || lpad((z % 10000)::VARCHAR, 4, '0') AS ratio FROM (SELECT g, q + CASE WHEN 2 * r > b OR (2 * r = b AND q % 2 = 1) THEN 1 ELSE 0 END AS z FROM q)"""
)
def exact_ratio(spark, d):
    """A share with four places, rounded half to even on exact integers."""
    got = bd.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_tax") > F.col("l_discount")).alias("a"), F.count("*").alias("b"))
    return got.select("l_returnflag", half_even_ratio(F.col("a"), F.col("b")).alias("ratio"))


# -- adapters -------------------------------------------------------------------------------------


@query("SELECT CASE role WHEN 'assistant' THEN 'ModelCall' WHEN 'user' THEN 'ToolCall' ELSE 'SessionStart' END AS etype, count(*) AS events, count(DISTINCT conv_id) AS traces FROM conversations GROUP BY 1 UNION ALL SELECT 'SessionEnd', count(*), count(DISTINCT conv_id) FROM conversations WHERE role = 'system' HAVING count(*) > 0")
def otel_events(spark, d):
    """Span documents made of conversations, unnested and mapped to events; counted by type."""
    out = ad.spans_to_events(ad.unnest_spans(ad.conversation_spans(bd.table(spark, d, "conversations"))), "agent-otel", "self_report", "otel")
    return out.where("reason is null").groupBy("etype").agg(F.count("*").alias("events"), F.count_distinct("trace_id").alias("traces"))
