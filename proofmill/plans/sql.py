"""DuckDB SQL of the registered queries, built from shared common table expressions."""

from __future__ import annotations

from ..operators.catalog import control_rows
from ..operators.facts import SIGNATURES

#: ``events`` as evidence (binding).
EV = """
raw AS (SELECT event_id, ts, user_id, value, event_type, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events),
typed AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'Decision' WHEN 'click' THEN 'ToolCall'
    WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'Notice' WHEN 1 THEN 'Outcome' ELSE 'ApprovalDecided' END
    WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'Instruction' WHEN 1 THEN 'DelegationIssued' WHEN 2 THEN 'ResourceAccess' ELSE 'ModelCall' END
    WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'Incident' WHEN 1 THEN 'PolicyDecision' ELSE 'Refusal' END END AS etype FROM raw),
prev AS (SELECT *, max(CASE WHEN etype = 'Decision' THEN event_id END) OVER b AS pd, max(CASE WHEN etype = 'DelegationIssued' THEN event_id END) OVER b AS pg,
    max(CASE WHEN etype = 'Instruction' THEN event_id END) OVER b AS pi, max(CASE WHEN etype = 'ToolCall' THEN event_id END) OVER b AS pt, max(CASE WHEN etype = 'PolicyDecision' THEN event_id END) OVER b AS pp
    FROM typed WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cls AS (SELECT *, CASE WHEN etype = 'ToolCall' THEN CASE WHEN k % 4 = 0 THEN 'self_report' ELSE 'enforcement_point' END WHEN etype IN ('Decision', 'ModelCall') THEN 'self_report'
    WHEN etype IN ('Incident', 'ApprovalDecided', 'Notice', 'Outcome') THEN 'independent_system' ELSE 'enforcement_point' END AS source_class FROM prev),
ev AS (SELECT event_id AS n, 'e' || event_id AS id, 'agent-' || user_id AS subject, user_id, 2 * event_id AS ordinal, etype, 'src:' || source_class AS source, source_class,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS time, CASE WHEN k % 11 <> 0 THEN 'agent-' || user_id END AS agent, CASE WHEN k % 7 <> 0 THEN ['ctx-' || k] ELSE [] END AS used,
    CASE WHEN etype = 'Decision' THEN CASE k % 3 WHEN 0 THEN 'dom:Credit' WHEN 1 THEN 'dom:Hiring' ELSE 'dom:Minor' END END AS decision_type,
    CASE WHEN etype = 'Decision' THEN CASE WHEN k % 5 = 0 THEN 'review_after' ELSE 'review_before' END END AS oversight_modality,
    CASE WHEN etype IN ('ToolCall', 'ApprovalDecided', 'Notice', 'Outcome') THEN 'e' || CASE WHEN k % 10 = 7 THEN event_id + 100000000 ELSE pd END END AS ref_decision,
    CASE WHEN etype = 'ToolCall' THEN 'e' || pg END AS ref_delegation, CASE WHEN etype IN ('ToolCall', 'Decision', 'Refusal') THEN 'e' || pi END AS ref_instruction,
    CASE WHEN etype IN ('PolicyDecision', 'Refusal') THEN 'e' || pt END AS ref_request, CASE WHEN etype = 'Decision' THEN 'e' || pp END AS ref_authorization,
    etype = 'DelegationIssued' AND k % 6 <> 0 AS chain_verified, CASE WHEN etype = 'Instruction' THEN CASE WHEN k % 3 = 0 THEN 'tool_output' ELSE 'user' END END AS instruction_class,
    CASE WHEN etype = 'PolicyDecision' THEN CASE WHEN k % 2 = 0 THEN 'deny' ELSE 'allow' END END AS policy_decision, CASE WHEN etype = 'Refusal' THEN CASE WHEN k % 2 = 0 THEN 'budget_exceeded' ELSE 'scope_exceeded' END END AS reason_class,
    CASE WHEN etype = 'ToolCall' THEN CASE WHEN k % 8 = 0 THEN 'svc-1' ELSE 'human-' || (k % 5) END END AS terminus,
    CASE WHEN etype = 'ApprovalDecided' THEN cast(round(value * 1000) AS BIGINT) END AS latency_ms, CASE WHEN etype = 'ApprovalDecided' THEN k % 2 = 0 END AS viewed,
    CASE WHEN etype = 'Incident' THEN 'inc-' || (k % 7) END AS incident_id, k FROM cls)"""

DOM = """
dom(decision_type, parent, consequential, need) AS (VALUES ('dom:Credit', 'ConsequentialDecision', true, 'review_before'), ('dom:Hiring', 'Decision', true, NULL), ('dom:Minor', 'Decision', false, NULL))"""

DANGLING = """
refs AS (SELECT DISTINCT subject, id, r AS ref FROM ev, unnest([ref_decision, ref_delegation, ref_instruction, ref_request, ref_authorization]) AS t(r) WHERE r IS NOT NULL),
dangling AS (SELECT refs.* FROM refs LEFT JOIN ev x ON x.subject = refs.subject AND x.id = refs.ref WHERE x.id IS NULL)"""

FACTS = (
    DOM
    + ","
    + DANGLING
    + """,
dec AS (SELECT ev.subject, ev.id, coalesce(d.consequential, false) AS flag, d.parent = 'ConsequentialDecision' AS cls, d.need IS NULL OR d.need = ev.oversight_modality AS ok FROM ev LEFT JOIN dom d USING (decision_type) WHERE etype = 'Decision'),
back AS (SELECT subject, r AS id, count(*) FILTER (h = 'ApprovalDecided') AS n_reviewed, count(*) FILTER (h = 'Notice') AS n_notified, count(*) FILTER (h = 'Outcome') AS n_resulted, count(*) FILTER (h = 'refused') AS n_refused,
    count(*) FILTER (h = 'denied') AS n_denied, count(*) FILTER (h = 'budget') AS n_budget FROM (
    SELECT subject, ref_decision AS r, etype AS h FROM ev WHERE etype IN ('ApprovalDecided', 'Notice', 'Outcome')
    UNION ALL SELECT subject, ref_instruction, 'refused' FROM ev WHERE etype = 'Refusal' UNION ALL SELECT subject, ref_request, 'denied' FROM ev WHERE policy_decision = 'deny'
    UNION ALL SELECT subject, ref_request, 'budget' FROM ev WHERE reason_class = 'budget_exceeded') WHERE r IS NOT NULL GROUP BY ALL),
dg AS (SELECT subject, id, count(*) AS n_dangling FROM dangling GROUP BY ALL),
facts AS (SELECT e.subject, e.id, e.etype AS target, coalesce(own.cls, false) AS class_consequential, coalesce(own.flag, false) AS flag_consequential, e.source_class, (e.agent IS NOT NULL)::INT AS n_agent, len(e.used) AS n_used, e.time IS NOT NULL AS has_time,
    coalesce(n_reviewed, 0) AS n_reviewed, coalesce(n_notified, 0) AS n_notified, coalesce(n_resulted, 0) AS n_resulted, coalesce(n_refused, 0) AS n_refused, coalesce(n_dangling, 0) AS n_dangling,
    (e.ref_authorization IS NOT NULL)::INT AS n_authorized, (e.etype = 'ToolCall' AND e.ref_instruction IS NOT NULL)::INT AS n_acts_on, coalesce(own.ok, false) AS modality_ok, e.chain_verified,
    e.etype = 'ToolCall' AND coalesce(x.flag, false) AS executes_consequential, e.etype = 'ToolCall' AND coalesce(x.ok, false) AS executed_modality_ok, e.etype = 'ToolCall' AND coalesce(g.chain_verified, false) AS delegation_verified,
    coalesce(e.terminus LIKE 'human-%', false) AS terminus_human, coalesce(n_denied, 0) = 0 AS within_scope, coalesce(n_budget, 0) = 0 AS within_budget,
    e.etype IN ('ToolCall', 'Decision') AND coalesce(i.instruction_class = 'tool_output', false) AS acts_on_untrusted, e.etype = 'Instruction' AND coalesce(e.instruction_class = 'tool_output', false) AS instruction_untrusted
    FROM ev e LEFT JOIN dec own ON own.id = e.id AND own.subject = e.subject LEFT JOIN back b ON b.subject = e.subject AND b.id = e.id LEFT JOIN dg ON dg.subject = e.subject AND dg.id = e.id
    LEFT JOIN dec x ON e.etype = 'ToolCall' AND x.subject = e.subject AND x.id = e.ref_decision LEFT JOIN ev g ON e.etype = 'ToolCall' AND g.subject = e.subject AND g.id = e.ref_delegation AND g.etype = 'DelegationIssued'
    LEFT JOIN ev i ON e.etype IN ('ToolCall', 'Decision') AND i.subject = e.subject AND i.id = e.ref_instruction AND i.etype = 'Instruction'
    WHERE e.etype IN ('Decision', 'ToolCall', 'DelegationIssued', 'Incident', 'Instruction'))"""
)


def quoted(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def listed(vs) -> str:
    return "[" + ", ".join(map(quoted, vs)) + "]::VARCHAR[]"


CONTROLS = "\ncontrols(catalog, control, mode, rung, severity, roles, checks, need) AS (VALUES " + ", ".join(
    f"({quoted(r['catalog'])}, {quoted(r['control'])}, {quoted(r['mode'])}, {r['rung']}, {quoted(r['severity'])}, {listed(r['roles'])}, {quoted(r['checks'])}, {listed(r['need'])})" for r in control_rows()
) + ")"


def sig_rows(names: list[str]) -> str:
    """subject, id, checks, ok of every focus node in a check's population."""
    parts = []
    for name in names:
        pop = SIGNATURES[name.split("+")[0]][0]
        ok = " AND ".join(f"coalesce({SIGNATURES[s][1]}, false)" for s in name.split("+"))
        parts.append(f"SELECT subject, id, '{name}' AS checks, {ok} AS ok FROM facts WHERE {pop}")
    return " UNION ALL ".join(parts)


ALL_CHECKS = sorted({r["checks"] for r in control_rows() if r["checks"]})
ALL_SIGS = sorted(SIGNATURES)
ROLES = "subjects AS (SELECT DISTINCT subject, CASE user_id % 3 WHEN 0 THEN ['deployer', 'provider'] WHEN 1 THEN ['deployer'] ELSE ['provider'] END AS roles FROM ev)"
SIGS = f"\nsigs AS ({sig_rows(ALL_SIGS)})"
CHECKS = f"\nchk AS ({sig_rows(ALL_CHECKS)}),\ncounts AS (SELECT subject, checks, count(*) AS applicable, count(*) FILTER (NOT ok) AS failed FROM chk GROUP BY ALL)"
ASSERT = (
    FACTS + "," + CHECKS + "," + CONTROLS + ",\n" + ROLES + """,
have AS (SELECT subject, list(DISTINCT x) AS h FROM ev, unnest([etype, etype || ':' || source_class]) AS t(x) GROUP BY subject),
a0 AS (SELECT s.subject, c.*, coalesce(n.applicable, 0) AS na, coalesce(n.failed, 0) AS nf, list_sort(list_filter(c.need, lambda x: NOT list_contains(h.h, x))) AS missing, list_has_any(c.roles, s.roles) AS role_ok
    FROM subjects s CROSS JOIN controls c JOIN have h USING (subject) LEFT JOIN counts n ON n.subject = s.subject AND n.checks = c.checks),
a1 AS (SELECT *, CASE WHEN NOT role_ok THEN 'not_applicable' WHEN rung <> 2 OR checks IS NULL THEN 'not_assessed' WHEN na = 0 THEN 'not_applicable' WHEN len(missing) > 0 THEN 'insufficient_evidence' WHEN nf <= 0 THEN 'conformant' ELSE 'non-conformant' END AS outcome FROM a0),
asr AS (SELECT subject, catalog, control, mode, severity, outcome, CASE WHEN outcome IN ('conformant', 'non-conformant', 'insufficient_evidence') THEN na ELSE 0 END AS applicable, CASE WHEN outcome IN ('conformant', 'non-conformant') THEN nf ELSE 0 END AS failed, missing, checks FROM a1)"""
)
#: The same assertions over the first half of the events.
BEFORE = (EV + "," + ASSERT).replace("FROM events)", "FROM events WHERE event_id < (SELECT (max(event_id) + 1) // 2 FROM events))")


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"
